"""Registered queries and their SQL, one for each operator; importing the modules fills the registry."""

from . import inference, matching, registry, scoring, vectors, votes  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
