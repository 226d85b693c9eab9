"""Matching arms, grids and key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotry.plans.numbering import numbered
from ballotry.sources.shared import written

KEY = ["model", "task", "seed", "instance_id"]


def arm_records(paths: DataFrame, arm: str, k: int = 8) -> DataFrame:
    """Records of one arm on its first k paths: gold and correct paths."""
    own = paths.where((F.col("arm") == arm) & (F.col("path") < k))
    return own.groupBy(*KEY).agg(F.max("gold").alias("gold"), F.sum("y").alias("s"), F.count("*").alias("k"))


def matched_arms(pt: DataFrame, sc: DataFrame, canonical=None) -> DataFrame:
    """Records of both arms whose golds are equal, as text or after ``canonical``."""
    left = pt.select(*KEY, F.col("gold").alias("gold_pt"), F.col("s").alias("s_pt"))
    right = sc.select(*KEY, F.col("gold").alias("gold_sc"), F.col("s").alias("s_sc"))
    same = (canonical(F.col("gold_pt")) == canonical(F.col("gold_sc"))) if canonical else F.col("gold_pt") == F.col("gold_sc")
    return left.join(right, KEY).where(same)


def key_sets(a: DataFrame, b: DataFrame, record: list[str], item: str) -> DataFrame:
    """(kind, n): distinct keys (record, item) of a that b lacks (missing) and that both hold (common); nulls are equal.

    Each record's items are gathered in a list first, so rows that are dealt by some of ``record`` stay where they are
    and one row a record and side is shuffled instead of one a key. Items of a record must fit in a row.
    """
    x = F.col(item)  # plain items are compared by hash; a missing one, which lists leave out, is counted beside them
    own = lambda df: df.groupBy(*record).agg(F.collect_set(x).alias("__items"), F.max(x.isNull()).alias("__null"))
    both = own(a).withColumn("__a", F.lit(True)).unionByName(own(b).withColumn("__a", F.lit(False)))
    of = lambda side, c, none: F.coalesce(F.max(F.when(F.col("__a") == side, F.col(c))), none)
    empty, no = F.array().cast(both.schema["__items"].dataType), F.lit(False)
    met = both.groupBy(*record).agg(of(True, "__items", empty).alias("a"), of(False, "__items", empty).alias("b"), of(True, "__null", no).alias("an"), of(False, "__null", no).alias("bn"))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    missing = F.size(F.array_except("a", "b")) + (F.col("an") & ~F.col("bn")).cast("int")
    common = F.size(F.array_intersect("a", "b")) + (F.col("an") & F.col("bn")).cast("int")
    counted = met.agg(total(missing).alias("missing"), total(common).alias("common"))
    return counted.unpivot([], ["missing", "common"], "kind", "n")


def base_accuracy(paths: DataFrame, least: float = 0.02) -> DataFrame:
    """(model, task, p_sc, p_pt, excluded): path accuracy of both arms; a cell is excluded where that of SC is below
    ``least`` or unknown, whatever PT does."""
    p = lambda a: F.avg(F.when(F.col("arm") == a, F.col("y")))
    out = paths.groupBy("model", "task").agg(p("SC").alias("p_sc"), p("PT").alias("p_pt"))
    return out.withColumn("excluded", F.coalesce(F.isnan("p_sc") | (F.col("p_sc") < least), F.lit(True)))


def valid_cells(cells: DataFrame, paths: DataFrame, least: float = 0.02) -> DataFrame:
    """Rows of cells that aren't excluded by ``base_accuracy``."""
    return cells.join(base_accuracy(paths, least).where(~F.col("excluded")).select("model", "task"), ["model", "task"], "left_semi")


def match_violations(pt: DataFrame, sc: DataFrame) -> DataFrame:
    """What keeps arms from matching, by cell: unmatched on either side, differing golds, repeated keys."""
    one = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(f"n_{name}"), F.max("gold").alias(f"gold_{name}"))
    both = one(pt, "pt").join(one(sc, "sc"), KEY, "full_outer")
    n = lambda c: F.count_if(c)
    return both.groupBy("model", "task").agg(
        n(F.col("n_sc").isNull()).alias("only_pt"), n(F.col("n_pt").isNull()).alias("only_sc"),
        n(F.col("n_pt").isNotNull() & F.col("n_sc").isNotNull() & ~F.col("gold_pt").eqNullSafe(F.col("gold_sc"))).alias("other_gold"), n((F.col("n_pt") > 1) | (F.col("n_sc") > 1)).alias("repeated"),
    )


def require_matched(pt: DataFrame, sc: DataFrame, seeds: list[int], per_seed: int) -> DataFrame:
    """matched_arms as a contract: an error that names cells if any record lacks its partner, repeats, or differs in
    its gold, or if a cell's seeds or its records of a seed aren't the expected ones."""
    counts = pt.groupBy("model", "task", "seed").agg(F.count("*").alias("n")).groupBy("model", "task").agg(
        F.count_if(~F.col("seed").isin(seeds)).alias("other_seed"), (F.lit(len(seeds)) - F.count_if(F.col("seed").isin(seeds) & (F.col("n") == per_seed))).alias("wrong_seed")
    )
    found = match_violations(pt, sc).join(counts, ["model", "task"], "left").na.fill(0)
    kinds = ["only_pt", "only_sc", "other_gold", "repeated", "other_seed", "wrong_seed"]
    bad = found.where(sum(F.col(c) for c in kinds) > 0).orderBy("model", "task").limit(5).collect()  # a few for the message
    if bad:
        raise ValueError("arms don't match: " + "; ".join(f"{r.model}/{r.task} " + ", ".join(f"{c}={r[c]}" for c in kinds if r[c]) for r in bad))
    return matched_arms(pt, sc)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side that the other lacks, with the side."""
    a = left.select(*keys).distinct().join(right, keys, "left_anti").withColumn("side", F.lit("left"))
    b = right.select(*keys).distinct().join(left, keys, "left_anti").withColumn("side", F.lit("right"))
    return a.unionByName(b)


def grid_report(recs: DataFrame, seeds: list[int], n: Column | int) -> DataFrame:
    """By cell: keys that repeat, that the grid seeds x 0..n-1 expects and lacks, and that it doesn't expect.

    The grid isn't built: expected keys are counted by arithmetic, and found ones in one aggregation.
    """
    found = recs.groupBy("model", "task", "seed", "instance_id").agg(F.count("*").alias("c"))
    n = F.lit(n) if isinstance(n, int) else n
    fits = F.col("seed").isin(seeds) & (F.col("instance_id") >= 0) & (F.col("instance_id") < n)
    out = found.groupBy("model", "task").agg(F.count_if(F.col("c") > 1).alias("repeated"), F.count_if(fits).alias("fit"), F.count_if(~fits).alias("unexpected"))
    return out.select("model", "task", "repeated", (F.lit(len(seeds)) * n - F.col("fit")).cast("long").alias("missing"), "unexpected")


def two_folds(keys: DataFrame, frac: float = 0.5, seed: int = 2026) -> DataFrame:
    """Disjoint folds A and B of each cell's questions, by an integer hash order cut at floor(m * frac), 1 to m - 1."""
    cell = ["model", "task"]
    q = written(keys.select(*cell, "instance_id").distinct()).withColumn("__hash", (F.col("instance_id") * 7919 + seed) % 1000003)
    placed = numbered(q, cell, "__hash", ["instance_id"], name="__at", size="__m")
    cut = F.greatest(F.lit(1), F.least(F.col("__m") - 1, F.floor(F.col("__m") * F.lit(frac))))
    return placed.withColumn("fold", F.when(F.col("__at") < cut, "A").otherwise("B")).select(*cell, "instance_id", "fold")


def leave_one_seed_out(recs: DataFrame) -> DataFrame:
    """Train and test records of each held-out seed: one row for each record and other seed."""
    seeds = recs.select(F.col("seed").alias("test_seed")).distinct()
    return recs.crossJoin(F.broadcast(seeds)).withColumn("part", F.when(F.col("seed") == F.col("test_seed"), "test").otherwise("train"))


def first_instances(recs: DataFrame, n: int) -> DataFrame:
    """The first n questions of each task in every cell."""
    q = written(recs.select("model", "task", "instance_id").distinct())
    return numbered(q, ["model", "task"], "instance_id", name="r").where(F.col("r") < n).drop("r")


def alias_bucket(pred: Column, gold: Column, aliases: Column, norm) -> Column:
    """The gold bucket if the prediction is one of the aliases or the gold, else its own."""
    return F.when(F.array_contains(F.transform(F.concat(F.array(gold), aliases), norm), norm(pred)), norm(gold)).otherwise(norm(pred))
