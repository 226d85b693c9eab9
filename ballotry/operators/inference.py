"""Intervals, rank tests and held-out evaluation over votes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotry.functions import closed_forms as cf
from ballotry.functions import tails as ta
from ballotry.plans import replicates as rp
from ballotry.sources.shared import with_cells, written

from .correlation import pairwise_rho
from .matching import two_folds
from .votes import majority, prefix, prefix_records, records

CELL = ["model", "task"]


def adaptive_k(sc: DataFrame, eps: tuple[float, ...] = (0.025,), pilot: int = 4, most: int = 32, clipped: bool = False) -> DataFrame:
    """Per cell and eps: pilot rho, operating point K*, majority at K* and at all paths, what is retained, and net cost.

    K* is 1 where rho isn't in (0, 1) and may exceed ``most``, where the majority is that of ``most`` paths; ``clipped``
    keeps rho in [0.05, 0.99] and K* in 1..most instead. All prefixes come from one running count, so a data-dependent
    K* is a join on (cell, k).
    """
    rho = pairwise_rho(records(prefix(sc, pilot)), CELL).drop("pairs")
    star = cf.k_star_clipped(F.col("rho"), F.col("eps"), most) if clipped else cf.k_star(F.col("rho"), F.col("eps"))
    points = rho.withColumn("eps", F.explode(F.array(*[F.lit(e) for e in eps]))).withColumn("k_star", star)
    w = Window.partitionBy(*CELL, "seed", "instance_id").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sc.select(*CELL, (F.col("path") + 1).alias("k"), F.sum("y").over(w).alias("s"))
    mv = run.groupBy(*CELL, "k").agg(F.avg(majority(F.col("s"), F.col("k"))).alias("mv"))
    at = mv.withColumnRenamed("k", "k_used").withColumnRenamed("mv", "mv_k")
    full = mv.where(F.col("k") == most).select(*CELL, F.col("mv").alias("mv_all"))
    out = points.withColumn("k_used", F.least(F.col("k_star"), F.lit(most))).join(at, [*CELL, "k_used"]).join(full, CELL).drop("k_used")
    return out.withColumn("retained", F.when(F.col("mv_all") > 0, F.col("mv_k") / F.col("mv_all"))).withColumn("net_cost", (F.col("k_star") + pilot) / F.lit(most))


def held_out_calibration(sc: DataFrame, ks: tuple[int, ...] = (4, 8, 16, 32), pilot: int = 4) -> DataFrame:
    """Accuracy and rho of one fold's pilot predict the other fold's majority: errors in points by cell, fold and k."""
    folds = two_folds(sc)
    both = sc.join(folds, [*CELL, "instance_id"])
    key = [*CELL, "fold"]
    small = both.where(F.col("path") < pilot)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("path").cast("int"))
    recs = small.groupBy(*key, "seed", "instance_id").agg(F.count("*").alias("k"), F.sum("y").alias("s"), (F.sum(bit * F.col("y"))).alias("mask"))
    fit = pairwise_rho(recs, key).drop("pairs").join(recs.groupBy(*key).agg((F.sum("s") / F.sum("k")).alias("p")), key)
    fit = fit.withColumn("fold", F.when(F.col("fold") == "A", "B").otherwise("A"))  # what a fold is predicted from
    many = both.withColumn("kk", F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))).where("path < kk")
    votes = many.groupBy(*key, "kk", "seed", "instance_id").agg(F.count("*").alias("k"), F.sum("y").alias("s"))
    seen = votes.groupBy(*key, "kk").agg(F.avg(majority(F.col("s"), F.col("k"))).alias("observed"))
    rows = seen.join(fit, key)
    bb = F.coalesce(*[F.when(F.col("kk") == k, cf.beta_binomial_majority(k, F.col("p"), F.col("rho"))) for k in ks])
    bi = F.coalesce(*[F.when(F.col("kk") == k, cf.binomial_majority(k, F.col("p"))) for k in ks])
    return rows.select(*key, "kk", "observed", bb.alias("predicted"), bi.alias("independent"), (100 * (bb - F.col("observed"))).alias("error_pp"))


def exactly(k: int) -> Column:
    """The vote mask of records of exactly k paths; others are an error."""
    return F.when(F.col("paths") == k, F.col("mask")).otherwise(F.raise_error(F.concat(F.lit(f"a record doesn't have {k} paths but "), F.col("paths").cast("string"))).cast("long"))


def intervals(reps: DataFrame, values: list[str], by: list[str] = CELL) -> DataFrame:
    """Per cell and value: the point (replicate -1), the 95 % percentile interval of the other replicates that are
    defined, and how many are."""
    made = F.col("rep") >= 0
    out = []
    for v in values:
        x = F.when(F.isnan(v), None).otherwise(F.col(v))
        out += [F.max(F.when(~made, x)).alias(v), *[F.percentile(F.when(made, x), F.lit(q)).alias(f"{v}_{side}") for q, side in ((0.025, "lo"), (0.975, "hi"))], F.count(F.when(made, x)).alias(f"{v}_draws")]
    return reps.groupBy(*by).agg(*out)


def vote_replicates(sc: DataFrame, reps: int, k: int = 32, pilot: int = 4) -> DataFrame:
    """(model, task, rep, c_pilot, c_all, mv_pilot, mv_all, diff): mean pairwise correlation and plurality vote of the
    first ``pilot`` and of all k paths, and the difference of the votes in points, of each replicate of questions."""
    recs = prefix_records(sc, {"pilot": F.lit(pilot), "all": F.lit(k)})
    rows = recs.select(*CELL, "instance_id", exactly(k).alias("mask"), F.col("prefixes")[0]["won"].alias("won_pilot"), F.col("prefixes")[1]["won"].alias("won_all"))
    first = 3 + rp.prefix_columns(pilot, k)

    def expand(x: dict[str, np.ndarray]) -> np.ndarray:
        return np.column_stack([np.ones(len(x["mask"])), x["won_pilot"], x["won_all"], rp.pair_products(rp.bits(x["mask"], k))])

    def finish(s: np.ndarray) -> dict[str, np.ndarray]:
        n = s[:, 0]
        return {
            "c_pilot": rp.mean_pair_rho(n, s[:, first], pilot), "c_all": rp.mean_pair_rho(n, s[:, 3:], k),
            "mv_pilot": s[:, 1] / n, "mv_all": s[:, 2] / n, "diff": 100 * (s[:, 2] - s[:, 1]) / n,
        }

    return rp.replicate_sums(rows, CELL, ["instance_id"], ["mask", "won_pilot", "won_all"], expand, finish, ["c_pilot", "c_all", "mv_pilot", "mv_all", "diff"], reps)


def clustered_bootstrap(sc: DataFrame, reps: int = 1_000) -> DataFrame:
    """Points and 95 % intervals of ``vote_replicates``, questions resampled."""
    return intervals(vote_replicates(sc, reps), ["c_pilot", "c_all", "mv_pilot", "mv_all", "diff"])


def paired_difference(sc: DataFrame, reps: int = 10_000, eps: float = 0.025, most: int = 32) -> DataFrame:
    """Majority at the cell's operating point K* less the majority at all paths, with its 95 % interval: questions
    are drawn, and one draw serves both."""
    stars = written(adaptive_k(sc, (eps,), most=most).select(*CELL, "k_star", F.least(F.col("k_star"), F.lit(most)).alias("used")))
    recs = with_cells(sc, stars, CELL).groupBy(*CELL, "seed", "instance_id").agg(F.sum("y").alias("s"), F.count("*").alias("k"), F.sum(F.when(F.col("path") < F.col("used"), F.col("y")).otherwise(0)).alias("sk"), F.max("used").alias("used"))
    rows = recs.select(*CELL, "instance_id", majority(F.col("s"), F.col("k")).alias("mv"), majority(F.col("sk"), F.col("used")).alias("mvk"))
    expand = lambda x: np.column_stack([np.ones(len(x["mv"])), x["mvk"], x["mv"]])
    finish = lambda s: {"mv_k": s[:, 1] / s[:, 0], "mv_all": s[:, 2] / s[:, 0], "diff": (s[:, 1] - s[:, 2]) / s[:, 0]}
    found = intervals(rp.replicate_sums(rows, CELL, ["instance_id"], ["mv", "mvk"], expand, finish, ["mv_k", "mv_all", "diff"], reps), ["mv_k", "mv_all", "diff"])
    return found.join(stars, CELL).select(*CELL, "k_star", "mv_k", "mv_all", "diff", "diff_lo", "diff_hi")


def interval_summary(points: DataFrame, intervals: DataFrame, value: str) -> DataFrame:
    """Widths of the intervals (median and quartiles), how many exclude zero, and the range of the point values."""
    both = points.where(F.col(value).isNotNull()).join(intervals.where(F.col(f"{value}_lo").isNotNull()), CELL)
    lo, hi = F.col(f"{value}_lo"), F.col(f"{value}_hi")
    q = lambda x: F.percentile(hi - lo, F.lit(x))
    return both.agg(F.count("*").alias("cells"), q(0.5).alias("width"), q(0.25).alias("width_25"), q(0.75).alias("width_75"), F.count_if((lo > 0) | (hi < 0)).alias("excluding_zero"), F.min(value).alias("least"), F.max(value).alias("most"))


def fold_evaluation(sc: DataFrame, eps: float = 0.025, ks: tuple[int, ...] = (1, 2, 4, 8, 16, 32)) -> DataFrame:
    """Each fold as pilot of the other, one row a cell and pilot fold: the pilot's accuracy, rho and operating point
    at 4 paths, plurality votes at it and at 32 paths on both folds, fixed-k votes held out, and six predictions of
    the held-out vote (votes at 4 reused, beta-binomial, independent; each fitted on the same or on the pilot fold)
    with their errors in points. Cells whose pilot is constant or has no rho take one path."""
    folds = two_folds(sc)
    key = [*CELL, "fold"]
    first = records(prefix(sc, 4)).join(folds, [*CELL, "instance_id"])
    p, rho = F.col("p4"), F.col("rho")
    fit = first.groupBy(*key).agg((F.sum("s") / F.sum("k")).alias("p4"), F.count_distinct("instance_id").alias("n_inst"), F.count_distinct("seed").alias("n_seeds"))
    fit = fit.join(pairwise_rho(first, key).drop("pairs"), key, "left").withColumn("degenerate", (p <= 0) | (p >= 1) | rho.isNull())
    fit = fit.withColumn("c", F.when(~F.col("degenerate"), rho)).withColumn("k_star", cf.k_star_clipped(F.col("c"), F.lit(eps)))
    star = lambda f: F.max(F.when(F.col("fold") == f, F.col("k_star"))).alias(f"k{f}")
    stars = written(fit.groupBy(*CELL).agg(star("A"), star("B")))
    upto = {str(k): F.lit(k) for k in ks} | {f: F.col(f"k{f}") for f in "AB"}
    votes = prefix_records(with_cells(sc, stars, CELL), upto).join(folds, [*CELL, "instance_id"]).select(*key, F.explode("prefixes").alias("v"))
    won = [F.avg(F.when(F.col("v.name") == n, F.col("v.won"))).alias(f"won{n}") for n in upto]
    side = votes.groupBy(*key).agg(*won, F.avg(F.when(F.col("v.name") == "32", majority(F.col("v.s"), F.col("v.k")))).alias("binary32")).join(fit, key)
    other = side.select(*CELL, F.when(F.col("fold") == "A", "B").otherwise("A").alias("fold"), *[F.col(c).alias(f"e_{c}") for c in side.columns if c not in key])
    x = side.join(other, key)
    own = lambda s: F.when(F.col("fold") == "A", F.col(f"{s}wonA")).otherwise(F.col(f"{s}wonB"))
    ratio = lambda a, b: F.when(b > 0, 100 * a / b)
    held, binary = F.col("e_won32"), F.col("e_binary32")
    predictions = {
        "reuse_same": (F.col("e_won4"), held), "reuse_deploy": (F.col("won4"), held),
        "bb_same": (cf.beta_binomial_majority(32, F.col("e_p4"), F.col("e_c")), binary), "bb_deploy": (cf.beta_binomial_majority(32, p, F.col("c")), binary),
        "indep_same": (cf.binomial_majority(32, F.col("e_p4")), binary), "indep_deploy": (cf.binomial_majority(32, p), binary),
    }
    return x.select(
        *key, (F.col("n_inst") + F.col("e_n_inst")).alias("n_instances"), "n_seeds", F.col("n_inst").alias("n_pilot"), F.col("e_n_inst").alias("n_eval"), p.alias("pilot_acc"), F.col("c").alias("c_pilot"), "degenerate", "k_star",
        own("").alias("same_mv_k"), F.col("won32").alias("same_mv_32"), ratio(own(""), F.col("won32")).alias("same_retained"), own("e_").alias("held_mv_k"), held.alias("held_mv_32"), ratio(own("e_"), held).alias("held_retained"),
        *[F.col(f"e_won{k}").alias(f"fixed{k}") for k in ks], binary.alias("held_binary_32"),
        *[c for n, (pred, seen) in predictions.items() for c in (pred.alias(n), (100 * F.abs(pred - seen)).alias(f"{n}_err"))],
    )


def pilot_sensitivity(sc: DataFrame, questions: tuple[int, ...] = (25, 50, 100, 200), reps: int = 500, pilot: int = 4, eps: float = 0.025) -> DataFrame:
    """Mean, deviation and variation (percent) of a pilot's mean pairwise correlation and mean and deviation of K* over
    draws of n questions, by n, with how many draws are at the bound (not in (0, 1)). A draw whose correlation is
    undefined is an error."""
    recs = prefix_records(prefix(sc, pilot), {"pilot": F.lit(pilot)})
    rows = recs.select(*CELL, "instance_id", exactly(pilot).alias("mask"))
    expand = lambda x: np.column_stack([np.ones(len(x["mask"])), rp.pair_products(rp.bits(x["mask"], pilot))])
    finish = lambda s: {"c": rp.mean_pair_rho(s[:, 0], s[:, 1:], pilot)}
    out = None
    for n in questions:
        x = rp.replicate_sums(rows, CELL, ["instance_id"], ["mask"], expand, finish, ["c"], reps, draws=n).where("rep >= 0")
        c = F.when(F.isnan("c"), F.raise_error(F.format_string("no correlation in %s, %s at %d questions, draw %d", "model", "task", F.lit(n), F.col("rep") + 1)).cast("double")).otherwise(F.col("c"))
        x = x.withColumn("c", c).withColumn("ks", cf.k_star(F.col("c"), F.lit(eps)))
        own = x.groupBy(*CELL).agg(
            F.avg("c").alias("c_mean"), F.stddev_samp("c").alias("c_std"), F.avg("ks").alias("k_mean"), F.stddev_samp("ks").alias("k_std"), F.count_if((F.col("c") <= 0) | (F.col("c") >= 1)).alias("at_bound"),
        ).withColumn("c_cv", F.when(F.col("c_mean") != 0, 100 * F.col("c_std") / F.col("c_mean"))).withColumn("questions", F.lit(n).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out


def paired_rho_replicates(matched: DataFrame, reps: int = 10_000, k: int = 8, least: float = 0.01) -> DataFrame:
    """(model, task, rep, drho): relative change in percent of the mean pairwise correlation of PT against SC; records
    are drawn, and one draw serves both arms. NaN where |rho SC| is below ``least`` or one is undefined.

    matched: (model, task, seed, instance_id, sc_mask, pt_mask) with k paths each.
    """
    width = k + k * (k - 1) // 2

    def expand(x: dict[str, np.ndarray]) -> np.ndarray:
        return np.column_stack([np.ones(len(x["sc_mask"])), *[rp.pair_products(rp.bits(x[m], k)) for m in ("sc_mask", "pt_mask")]])

    def finish(s: np.ndarray) -> dict[str, np.ndarray]:
        sc, pt = (rp.mean_pair_rho(s[:, 0], s[:, 1 + at : 1 + at + width], k) for at in (0, width))
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"drho": np.where(np.abs(sc) >= least, 100 * (pt - sc) / np.abs(sc), np.nan)}

    return rp.replicate_sums(matched, CELL, ["instance_id", "seed"], ["sc_mask", "pt_mask"], expand, finish, ["drho"], reps)


def paired_rho_bootstrap(matched: DataFrame, reps: int = 10_000) -> DataFrame:
    """95 % interval of ``paired_rho_replicates`` and the number of defined draws."""
    return intervals(paired_rho_replicates(matched, reps), ["drho"]).select(*CELL, F.col("drho_draws").alias("draws"), "drho_lo", "drho_hi")


def mid_ranks(rows: DataFrame, value: str, buckets: int = 64) -> DataFrame:
    """Mid-ranks with ties: values are counted first, and distinct values are ordered in range buckets whose
    totals give the ranks before each, so no task orders them all."""
    counts = rows.groupBy(value).agg(F.count("*").alias("ties"))
    cuts = sorted(set(rows.where(F.col(value).isNotNull()).approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.01)))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    placed = counts.withColumn("bucket", bucket)
    sums = placed.groupBy("bucket").agg(F.sum("ties").alias("s"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", F.coalesce(F.sum("s").over(ahead(Window.orderBy("bucket"))), F.lit(0)).alias("offset"))  # a row a bucket
    before = F.col("offset") + F.coalesce(F.sum("ties").over(ahead(Window.partitionBy("bucket").orderBy(value))), F.lit(0))
    ranks = placed.join(F.broadcast(offsets), "bucket").select(value, "ties", (before + (F.col("ties") + 1) / 2).alias("rank"))
    return rows.join(ranks, value)


def mann_whitney(rows: DataFrame, value: str, group: str) -> DataFrame:
    """U of group 1 against group 0, the tie term, and the two-sided p: normal with continuity correction, and exact
    where a side has 8 values or fewer and nothing ties."""
    r = mid_ranks(rows.where(F.col(value).isNotNull()), value)
    one = r.agg(F.sum(F.when(F.col(group) == 1, F.col("rank"))).alias("r1"), F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"), F.sum(F.pow("ties", F.lit(2.0)) - 1).alias("tie_term"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return with_rank_sum_p(one.select(u.alias("u"), "n1", "n0", "tie_term"))


def with_rank_sum_p(rows: DataFrame) -> DataFrame:
    """Rows (u, n1, n0, tie_term) with p."""

    @F.pandas_udf("double")
    def exact(u: pd.Series, n1: pd.Series, n0: pd.Series, small: pd.Series) -> pd.Series:
        return pd.Series([exact_rank_sum_p(*x[:3]) if x[3] else None for x in zip(u, n1, n0, small)], dtype=float)

    n1, n0 = F.col("n1"), F.col("n0")
    small = (F.least(n1, n0) <= EXACT_SIDE) & (F.col("tie_term") == 0) & (n1 > 0) & (n0 > 0)
    out = rows.withColumn("__small", small).withColumn("__exact", exact("u", "n1", "n0", "__small"))
    return out.withColumn("p", F.when(F.col("__small"), F.col("__exact")).otherwise(ta.rank_sum_normal_p(F.col("u"), n1, n0, F.col("tie_term")))).drop("__small", "__exact")


#: Values of the smaller side up to which p is exact.
EXACT_SIDE = 8


@lru_cache(maxsize=64)
def rank_sum_ways(n1: int, n0: int) -> np.ndarray:
    """Number of arrangements of n1 and n0 different values by U, one value of the first group at a time."""
    ways = np.zeros(n1 * n0 + 1)
    ways[0] = 1
    for i in range(1, n1 + 1):
        up = n0 + i
        for s in range(len(ways) - 1, up - 1, -1):
            ways[s] -= ways[s - up]
        for s in range(i, len(ways)):
            ways[s] += ways[s - i]
    return ways


def exact_rank_sum_p(u: float, n1: int, n0: int) -> float:
    ways = rank_sum_ways(int(min(n1, n0)), int(max(n1, n0)))
    far = int(round(max(u, n1 * n0 - u)))
    return float(min(1.0, 2 * ways[far:].sum() / ways.sum()))


def replicated_rank_test(reps: DataFrame, value: str, group: str, level: float = 0.001) -> DataFrame:
    """One row: u and p of the data as they are (replicate -1), and over the replicates how many are used, how many are
    dropped as a cell has no value there, and the share of used ones with p below ``level``.

    reps: (rep, group 1 or 0, value), a row a cell and replicate; NaN is no value. All replicates are ranked in one
    shuffle by replicate.
    """
    rows = reps.where(F.col(group).isin(0, 1)).select("rep", F.col(group).alias("g"), F.when(F.isnan(value), None).otherwise(F.col(value)).alias("v"))
    own = Window.partitionBy("rep")
    ties = F.count("*").over(Window.partitionBy("rep", "v"))
    ranked = rows.withColumn("missing", F.count_if(F.col("v").isNull()).over(own)).withColumn("r", F.rank().over(own.orderBy("v"))).withColumn("t", ties)
    mid = F.col("r") + (F.col("t") - 1) / 2
    tests = ranked.groupBy("rep").agg(F.max("missing").alias("missing"), F.sum(F.when(F.col("g") == 1, mid)).alias("r1"), F.count_if(F.col("g") == 1).alias("n1"), F.count_if(F.col("g") == 0).alias("n0"), F.sum(F.pow("t", F.lit(2.0)) - 1).alias("tie_term"))
    tests = with_rank_sum_p(tests.select("rep", "missing", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "n1", "n0", "tie_term"))
    data, used = F.col("rep") == -1, (F.col("rep") >= 0) & (F.col("missing") == 0)
    return tests.agg(
        F.max(F.when(data & (F.col("missing") == 0), F.col("u"))).alias("u"), F.max(F.when(data & (F.col("missing") == 0), F.col("p"))).alias("p"), F.max("n1").alias("n1"), F.max("n0").alias("n0"),
        F.count_if(used).alias("used"), F.count_if((F.col("rep") >= 0) & (F.col("missing") > 0)).alias("dropped"), F.avg(F.when(used, (F.col("p") < level).cast("double"))).alias("share"),
    )


def pearson(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation from central moments, which neither overflow nor cancel as sums of squares do, and its two-sided p;
    null for constant columns or fewer than two rows."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    r = F.when(varied, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))
    s = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), r.alias("r"))
    return s.withColumn("p", ta.pearson_p(F.col("r"), F.col("n")))


def spearman_slots(slots: DataFrame, seed_a: int, seed_b: int) -> DataFrame:
    """Rank stability of slot accuracies between two seeds, mid-ranks for ties."""
    w = lambda: Window.partitionBy(*CELL, "seed").orderBy("hits")
    ties = F.count("*").over(Window.partitionBy(*CELL, "seed", "hits"))
    ranked = slots.withColumn("r", F.rank().over(w()) + (ties - 1) / 2)
    a = ranked.where(F.col("seed") == seed_a).select(*CELL, "path", F.col("r").alias("ra"))
    b = ranked.where(F.col("seed") == seed_b).select(*CELL, "path", F.col("r").alias("rb"))
    return pearson(a.join(b, [*CELL, "path"]), "ra", "rb", CELL)
