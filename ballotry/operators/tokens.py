"""Token F1 of prediction and gold text as a join on shared tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def token_f1(pairs: DataFrame, key: str, pred: Column, gold: Column) -> DataFrame:
    """(key, f1): multiset overlap of lower-case tokens; both empty 1, one empty 0.

    Tokens of both sides are counted by (pair, token) in one aggregation, in which a side counts up
    its own column, so that no self-join is needed and a long text is split over its tokens.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    both = pairs.select(F.col(key), tokens(pred).alias("p"), tokens(gold).alias("g"))
    sides = F.concat(F.transform("p", lambda t: F.struct(t.alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform("g", lambda t: F.struct(t.alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    rows = both.select(key, F.explode_outer(sides).alias("x")).select(key, "x.*")
    counts = rows.groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = counts.groupBy(key).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("np"), F.coalesce(F.sum("b"), F.lit(0)).alias("ng"), F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("o"))
    f1 = F.when((F.col("np") == 0) & (F.col("ng") == 0), 1.0).when((F.col("np") == 0) | (F.col("ng") == 0), 0.0).otherwise(2.0 * F.col("o") / (F.col("np") + F.col("ng")))
    return sums.select(key, f1.alias("f1"))
