"""Exact numbers within groups by range buckets: rows are numbered inside (group, bucket), and totals of the buckets
before give where each begins. So no group is one task's window, however large it is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotry.sources.shared import with_cells, written

#: Rows of a bucket, about.
BUCKET_ROWS = 100_000


def range_bucket(rows: DataFrame, value: str, bucket_rows: int = BUCKET_ROWS, n: int | None = None) -> Column:
    """Number of the range bucket of a numeric column, nulls in bucket 0; buckets follow the number of rows, which is
    counted unless given."""
    n = rows.count() if n is None else n
    buckets = -(-n // bucket_rows)
    if buckets < 2:
        return F.lit(0)
    cuts = rows.approxQuantile(value, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    return F.coalesce(_cuts_below(sorted(set(cuts)), F.col(value).cast("double")), F.lit(0))


def _cuts_below(cuts: list[float], x: Column) -> Column:
    """How many of the sorted cuts are below x, by whole runs of cuts first: a row looks at some 2 sqrt(cuts) of them."""
    if not cuts:
        return F.lit(0)
    run = math.isqrt(len(cuts)) + 1
    runs = [cuts[i : i + run] for i in range(0, len(cuts), run)]
    below = lambda array: F.size(F.filter(array, lambda c: c < x))
    whole = below(F.array(*[F.lit(r[-1]) for r in runs]))
    return F.least(whole * run, F.lit(len(cuts))) + F.when(whole < len(runs), below(F.get(F.array(*[F.array(*[F.lit(c) for c in r]) for r in runs]), whole))).otherwise(0)


def numbered(rows: DataFrame, by: list[str], value: str, ties: list[str] | None = None, name: str = "position", size: str | None = None, bucket_rows: int = BUCKET_ROWS, alike: bool = False) -> DataFrame:
    """Rows with their number from 0 in order of ``value`` (numeric, nulls first) and then ``ties`` within the groups
    ``by``, and, where ``size`` names a column, the number of rows of the group. Rows that are equal in all of these
    get numbers in any order, or, where ``alike``, one number, and ``size`` counts numbers.

    Partitions are as many as the rows ask for: adaptive execution would join those of narrow rows, whose sorts in
    memory are many times their compressed bytes, to a few for each core at any size.
    """
    n = rows.count()
    placed = rows.withColumn("__bucket", range_bucket(rows, value, bucket_rows, n))
    order = Window.partitionBy(*by, "__bucket").orderBy(value, *(ties or []))
    dealt = placed.repartition(max(1, -(-n // bucket_rows)), *by, "__bucket")
    own = dealt.withColumn("__own", (F.dense_rank() if alike else F.row_number()).over(order) - 1)
    # a row a group and bucket
    sums = own.groupBy(*by, "__bucket").agg((F.max("__own") + 1).alias("__rows")) if alike else placed.groupBy(*by, "__bucket").agg(F.count("*").alias("__rows"))
    ahead = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__rows").over(ahead), F.lit(0))).withColumn("__size", F.sum("__rows").over(Window.partitionBy(*by))).drop("__rows")
    met = with_cells(own, written(offsets), [*by, "__bucket"])
    return met.select(*rows.columns, (F.col("__own") + F.col("__before")).cast("long").alias(name), *([F.col("__size").alias(size)] if size else []))
