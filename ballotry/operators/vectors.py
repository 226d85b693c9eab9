"""Metrics of vector tables: rates, interference, label bins, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotry.plans.numbering import BUCKET_ROWS, range_bucket


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _let(x: Column, f) -> Column:
    """f of x, with x evaluated once: lambdas would evaluate an outer expression for every element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def entropy_bits(p: Column) -> Column:
    """Entropy of a vector of weights, taken as probabilities after entries up to 1e-15 are left out."""
    def bits(w: Column) -> Column:
        total = _sum(w)
        return F.when(total > 0, F.log2(total) - _sum(F.transform(w, lambda v: v * F.log2(v))) / total).otherwise(F.lit(0.0))

    return _let(F.filter(p, lambda v: v > 1e-15), bits) + F.lit(0.0)


def _shares(w: Column) -> Column:
    return _let(w, lambda e: _let(_sum(e), lambda t: F.transform(e, lambda v: v / t)))


def softmax(x: Column) -> Column:
    return _shares(_let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m))))


def top_probabilities(x: Column, k: int) -> Column:
    """The k largest probabilities of a softmax, renormalised."""
    return _shares(F.slice(F.sort_array(softmax(x), asc=False), 1, k))


def dominant(p: Column) -> Column:
    """Index of the largest entry, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("long")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda u, v: u * v))
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def confusability(candidates: DataFrame, by: str, slot: str, weight: str, column: str = "embedding") -> DataFrame:
    """Weighted mean cosine of candidate pairs of each output; 0 for fewer than two or no weight."""
    a = candidates.select(by, F.col(slot).alias("i"), F.col(weight).cast("double").alias("wi"), F.transform(column, lambda x: x.cast("double")).alias("a"))
    b = a.select(by, F.col("i").alias("j"), F.col("wi").alias("wj"), F.col("a").alias("b"))
    p = a.join(b, by).where("i < j").withColumn("w", F.col("wi") * F.col("wj"))
    p = p.groupBy(by).agg((F.sum(F.col("w") * cosine(F.col("a"), F.col("b"))) / F.sum("w")).alias("c"), F.sum("w").alias("w"))
    return candidates.select(by).distinct().join(p, by, "left").select(by, F.when(F.col("w") >= 1e-10, F.col("c")).otherwise(F.lit(0.0)).alias("confusability"))


def mean_vectors(vectors: DataFrame, by: list[str], column: str = "embedding", weight: Column | None = None) -> DataFrame:
    """Mean, or weighted mean, vector of each group."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = vectors.select(*by, w.alias("w"), F.posexplode(column).alias("i", "x"))
    means = rows.groupBy(*by, "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))


def head_specialisation(vectors: DataFrame, head: str, column: str = "embedding") -> DataFrame:
    """1 - mean cosine of the heads' mean vectors; 1 with fewer than two heads."""
    m = mean_vectors(vectors, [head], column)
    a = m.select(F.col(head).alias("h1"), F.col("mean").alias("a"))
    b = m.select(F.col(head).alias("h2"), F.col("mean").alias("b"))
    p = a.join(b, F.col("h1") < F.col("h2"))  # heads, not rows
    return p.agg(F.coalesce(1 - F.avg(cosine(F.col("a"), F.col("b"))), F.lit(1.0)).alias("specialisation"), F.count("*").alias("pairs"))


def label_entropy(rows: DataFrame, label: str) -> DataFrame:
    n = rows.count()
    p = rows.groupBy(label).count().select((F.col("count") / n).alias("p"))
    return p.agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count("*").alias("classes"))


def quantile_edges(values: DataFrame, value: str, parts: int, bucket_rows: int = BUCKET_ROWS) -> list[float]:
    """Exact edges of equal parts of a double column without nulls: the least value with at least ceil(n i / parts) rows
    up to it, for i = 1 to parts. Values are counted first and running counts are kept by range bucket, so no task
    orders all values."""
    counts = values.groupBy(value).agg(F.count("*").alias("__rows"))
    placed = counts.withColumn("__bucket", range_bucket(counts, value, bucket_rows))
    sums = placed.groupBy("__bucket").agg(F.sum("__rows").alias("__in"))  # a row a bucket
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__bucket", F.coalesce(F.sum("__in").over(ahead), F.lit(0)).alias("__before"), F.sum("__in").over(Window.partitionBy()).alias("__all"))
    upto = F.col("__before") + F.sum("__rows").over(Window.partitionBy("__bucket").orderBy(value))
    run = placed.join(offsets, "__bucket").select(value, "__all", upto.alias("__upto"))
    rank = lambda i: F.expr(f"(__all * {i} + {parts - 1}) div {parts}")
    edges = run.agg(*[F.min(F.when(F.col("__upto") >= rank(i), F.col(value))).alias(f"e{i}") for i in range(1, parts + 1)]).first()  # a row of ``parts`` edges
    return list(edges)


def label_bins(rows: DataFrame, label: str, bins: int = 20, numeric: float = 0.8) -> DataFrame:
    """rows with a text column ``bin``: labels of up to ``bins`` values as they are; else, where more than the share
    ``numeric`` of the rows are numbers, equal parts of the numbers (what is no number counts as 0), else by hash.

    Edges are exact quantiles. Null labels stay null.
    """
    text = F.col(label).cast("string")
    if rows.select(text.alias("l")).where("l is not null").distinct().limit(bins + 1).count() <= bins:
        return rows.withColumn("bin", text)
    number = F.expr(f"try_cast(try_cast(`{label}` as string) as double)")
    number = F.when(F.isnan(number), None).otherwise(number)
    found = rows.agg(F.count(number).alias("numbers"), F.count(text).alias("n")).first()
    if found["numbers"] > numeric * found["n"]:
        q = F.array(*[F.lit(x) for x in quantile_edges(rows.select(number.alias("__x")).where("__x is not null"), "__x", bins)])
        x = F.coalesce(number, F.lit(0.0))
        made = F.least(F.size(F.filter(q, lambda e: e < x)), F.lit(bins - 1))
    else:
        made = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % bins
    return rows.withColumn("bin", F.when(text.isNotNull(), made.cast("string")))


def interference_summary(rows: DataFrame, confus: str, separ: str) -> DataFrame:
    """Means, population deviations, share of confusability above 0.8 and of separability below 0.4."""
    return rows.agg(
        F.avg(confus).alias("conf_mean"), F.stddev_pop(confus).alias("conf_std"), F.avg((F.col(confus) > 0.8).cast("double")).alias("conf_high"),
        F.avg(separ).alias("sep_mean"), F.avg((F.col(separ) < 0.4).cast("double")).alias("sep_low"),
    )
