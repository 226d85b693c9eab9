"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Digits that floating results are compared with.
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Floating columns rounded, negative zero made zero."""
    return df.select(*[(F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with SQL that gives the same rows."""

    def add(run):
        QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def sql(ctes: list[str], body: str, keys: str, floats: str = "") -> str:
    """SQL of common table expressions and a body, of which ``floats`` are rounded."""
    cols = [k.strip() for k in keys.split(",") if k.strip()] + [f"round({f.strip()}, {DIGITS}) + 0.0::double {f.strip()}" for f in floats.split(",") if f.strip()]
    head = "with " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}select {', '.join(cols)} from ({body})"
