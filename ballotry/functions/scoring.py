"""Correctness rules as Column expressions; a null prediction is always wrong.

``SCORERS`` maps a task's rule name to a builder (prediction, gold) -> boolean Column, and
``score`` dispatches on a task column. Rules that compare token multisets are joins, in
``operators.tokens``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?<![A-Za-z0-9_])(a|an|the)(?![A-Za-z0-9_])"


#: White space that is stripped from both ends.
BLANKS = " \t\n\r\f\x0b"
#: LaTeX thousands separators: {,} and \\, \\; \\! and an escaped or a hard blank.
SEPARATOR = r"(?:\{,\}|\\[,;! ]|~)"
#: A separator at the head of a valid number or after one that was just removed.
_GROUPING = rf"(?:(?<![0-9])(?<![0-9]{SEPARATOR})(?=[0-9]+(?:{SEPARATOR}[0-9]{{3}})+(?![0-9]|{SEPARATOR}[0-9]))|(?<={SEPARATOR})\G)([0-9]+){SEPARATOR}(?=[0-9])"


def strip(x: Column) -> Column:
    """White space off both ends."""
    return F.btrim(x, F.lit(BLANKS))


def thousands_free(x: Column) -> Column:
    """LaTeX thousands separators removed from numbers in which every group after the first has three
    digits; other numbers stay as they are. Texts without a separator between digits aren't searched for groups."""
    return F.when(x.rlike(rf"[0-9]{SEPARATOR}[0-9]"), F.regexp_replace(x, _GROUPING, "$1")).otherwise(x)


def clean_number(x: Column) -> Column:
    """Thousands separators, commas and one final full stop removed."""
    plain = strip(F.replace(thousands_free(x), F.lit(","), F.lit("")))
    return strip(F.regexp_replace(plain, r"\.$", ""))


def as_number(x: Column) -> Column:
    """Double value of a plainly written number, else null."""
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def numbers_match(pred: Column, gold: Column, tol: float = 1e-3) -> Column:
    a, b = clean_number(pred), clean_number(gold)
    x, y = as_number(a), as_number(b)
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < tol).otherwise(a == b), F.lit(False))


def _squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\r\n\f]+", " "))


def squad_text(x: Column) -> Column:
    """Lower case, punctuation out, then articles out."""
    bare = F.translate(F.lower(x), PUNCTUATION, "")
    return _squeeze(F.regexp_replace(bare, ARTICLES, " "))


def hotpot_text(x: Column) -> Column:
    """Lower case, articles out, then punctuation out."""
    return _squeeze(F.translate(F.regexp_replace(F.lower(x), ARTICLES, " "), PUNCTUATION, ""))


def yes_no(x: Column, legacy: bool = False) -> Column:
    """Trailing punctuation off, lower case."""
    tail = r"[.!?;,]+$" if legacy else r"[!-/:-@\[-`{-~]+$"
    return F.lower(F.trim(F.regexp_replace(F.trim(x), tail, "")))


def number_or_text(x: Column) -> Column:
    """A number to three decimals without trailing .0, else normalised text."""
    v = F.round(as_number(clean_number(x)), 3) + F.lit(0.0)
    whole = F.when((v == F.floor(v)) & (F.abs(v) < 1e15), F.floor(v).cast("long").cast("string")).otherwise(v.cast("string"))
    return F.coalesce(whole, squad_text(x))


def answers_match(pred: Column, gold: Column, tol: float = 1e-3) -> Column:
    """Float tolerance, else trimmed equality."""
    x, y = as_number(F.trim(pred)), as_number(F.trim(gold))
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < tol).otherwise(F.trim(pred) == F.trim(gold)), F.lit(False))


def _safe(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "numeric": numbers_match,
    "stored": lambda p, g: _safe(p == g),
    "exact": lambda p, g: _safe(F.lower(F.trim(p)) == F.lower(F.trim(g))),
    "yesno": lambda p, g: _safe(yes_no(p) == yes_no(g)),
    "letter": lambda p, g: _safe(F.upper(F.trim(p)) == F.upper(F.trim(g))),
    "alias": lambda p, g: _safe(squad_text(p) == squad_text(g)),
    "number_or_text": lambda p, g: _safe(number_or_text(p) == number_or_text(g)),
    "assertions": lambda p, g: _safe((p == g) & g.rlike("^P+$")),
    "contained": lambda p, g: _safe(F.contains(hotpot_text(p), hotpot_text(g))),
}


def score(task: Column, pred: Column, gold: Column, rules: dict[str, str]) -> Column:
    """Dispatch by task; tasks without a rule compare exactly."""
    out = SCORERS["exact"](pred, gold)
    for name, rule in rules.items():
        out = F.when(task == name, SCORERS[rule](pred, gold)).otherwise(out)
    return out


BUCKETS: dict[str, Callable[[Column], Column]] = {
    "numeric": lambda x: F.coalesce(F.round(as_number(clean_number(x)), 3).cast("string"), clean_number(x)),
    "yesno": yes_no,
    "letter": lambda x: F.upper(F.trim(x)),
    "alias": squad_text,
    "number_or_text": number_or_text,
    "exact": lambda x: F.lower(F.trim(x)),
    "stored": lambda x: x,
}


def bucket(task: Column, answer: Column, rules: dict[str, str]) -> Column:
    """Vote bucket of an answer; blank is null and doesn't vote."""
    out = BUCKETS["exact"](answer)
    for name, rule in rules.items():
        out = F.when(task == name, BUCKETS[rule](answer)).otherwise(out)
    return F.when(F.trim(out) != "", out)


def gold_bucket(task: Column, gold: Column, canonical: dict[str, str]) -> Column:
    """Canonical bucket for the listed tasks (an empty one is an error), else commas out and trimmed."""
    out = F.trim(F.replace(gold, F.lit(","), F.lit("")))
    for name, rule in canonical.items():
        own = BUCKETS[rule](gold)
        checked = F.when(F.coalesce(F.trim(own), F.lit("")) == "", F.raise_error(F.lit("empty gold answer"))).otherwise(own)
        out = F.when(task == name, checked).otherwise(out)
    return out
