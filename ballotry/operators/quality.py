"""Distortion, reruns, weighted-vote summaries and held-out vote weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .correlation import pair_sums
from .votes import CELL, RECORD, records


def distortion(method: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Reference accuracy less method accuracy, and the share of wrong answers with a right candidate.
    method: keys, ok, any_ok; reference: keys, ok."""
    both = method.join(reference.select(*keys, F.col("ok").alias("ref_ok")), keys)
    return both.groupBy("model", "task").agg((F.avg("ref_ok") - F.avg("ok")).alias("distortion"), F.avg(((F.col("ok") == 0) & (F.col("any_ok") == 1)).cast("double")).alias("coverage_failure"), F.count("*").alias("n"))


def rerun_instability(runs: DataFrame, keys: list[str], run: str, answer: str) -> DataFrame:
    """Share of rerun pairs that disagree, by key: pairs follow from counts of equal answers, so none is built."""
    counted = runs.where(F.col(answer).isNotNull()).groupBy(*keys, answer).agg(F.count("*").alias("c"))
    n, same = F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1))
    out = counted.groupBy(*keys).agg(n.alias("n"), same.alias("same"))
    return out.select(*keys, F.when(F.col("n") > 1, 1 - F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("instability"))


def weighted_summary(stats: DataFrame, high_cv: float = 0.225, high_mv: float = 0.3, least_p: float = 0.02) -> DataFrame:
    """Cells of accuracy ``least_p`` or more by part (all; high and low slot variation; high and low majority):
    number, mean gain, mean and median variation, percent with high variation.
    stats: p_bar, slot_cv, gain_pp, mv_acc; a row a cell."""
    cv = F.col("slot_cv")
    parts = F.array(F.lit("all"), F.when(cv > high_cv, "high_cv").otherwise("low_cv"), F.when(F.col("mv_acc") >= high_mv, "high_mv").otherwise("low_mv"))
    return stats.where(F.col("p_bar") >= least_p).withColumn("part", F.explode(parts)).groupBy("part").agg(
        F.count("*").alias("n"), F.avg("gain_pp").alias("mean_gain"), F.avg(cv).alias("mean_cv"), F.median(cv).alias("median_cv"),
        (100 * F.avg((cv > high_cv).cast("double"))).alias("high_cv_pct"),
    )


def extremes(stats: DataFrame, measures: list[str]) -> DataFrame:
    """By measure the cells with its least and largest value (to nine digits), the first and last by name of equals."""
    key, x = F.concat_ws("/", *CELL), F.col("value")
    long = stats.unpivot(CELL, measures, "measure", "value").where(x.isNotNull()).withColumn("value", F.round(x, 9))
    at = F.struct(x, key)
    return long.groupBy("measure").agg(F.min_by(key, at).alias("least_cell"), F.min(x).alias("least"), F.max_by(key, at).alias("most_cell"), F.max(x).alias("most"))


def gls_weights(stats: DataFrame, by: list[str], ridges: tuple[float, ...] = (0.1, 0.5, 1.0, 5.0)) -> DataFrame:
    """(by, path, w): for each slot its weights S^-1 g / (g' S^-1 g), one for each ridge, with S = covariance + ridge
    and g the slot means; uniform where that is undefined. stats: by, i, j, n, si, sj, sij for i <= j: K (K + 1) / 2
    rows of sums over the n records that weights are fitted on."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.j.max()) + 1
        s, g = np.zeros((k, k)), np.zeros(k)
        i, j = pdf.i.to_numpy(), pdf.j.to_numpy()
        n, si, sj, sij = (pdf[c].to_numpy(float) for c in ("n", "si", "sj", "sij"))
        s[i, j] = s[j, i] = (sij - si * sj / n) / np.maximum(n - 1, 1)
        g[i], g[j] = si / n, sj / n
        out = []
        for ridge in ridges:
            w = np.full(k, 1 / k)
            try:
                x = np.linalg.solve(s + ridge * np.eye(k), g)
                w = x / (g @ x) if abs(g @ x) > 1e-10 else w
            except np.linalg.LinAlgError:
                pass
            out.append(w)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * k for c in by}, "path": range(k), "w": list(np.array(out).T)})

    fields = {f.name: f.dataType.simpleString() for f in stats.schema}
    return stats.groupBy(*by).applyInPandas(solve, ", ".join([*[f"`{c}` {fields[c]}" for c in by], "path long", "w array<double>"]))


def held_out_gls(paths: DataFrame, ridges: tuple[float, ...] = (0.1, 0.5, 1.0, 5.0)) -> DataFrame:
    """One row a cell, test seed and ridge: plurality vote of the seed's records, their vote weighted by what the other
    seeds' records say about the slots, gain and oracle (any path right) in percent and points.

    Sums of products are added up once by cell and seed; those of all other seeds are the total less one's own. Votes
    of all ridges come from one pass over the paths. Missing answers don't vote, equal weights (to nine digits) go to
    the answer that came first; cells of one seed give no rows.
    """
    key = [*CELL, "seed"]
    recs = records(paths)
    own = pair_sums(recs, key).unionByName(
        paths.groupBy(*key, F.col("path").cast("long").alias("i")).agg(F.count("*").alias("n"), F.sum("y").alias("si")).select(*key, "i", F.col("i").alias("j"), "n", "si", F.col("si").alias("sj"), F.col("si").alias("sij"))
    )
    every = Window.partitionBy(*CELL, "i", "j")  # a row a seed
    rest = own.select(*key, "i", "j", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "si", "sj", "sij")]).where("n > 0")
    weights = gls_weights(rest, key, ridges)
    votes = paths.join(weights, [*key, "path"])
    answered = F.col("answer").isNotNull()
    sums = votes.groupBy(*RECORD, "answer").agg(
        F.count("*").alias("votes"), F.min("path").alias("first"), F.max("y").alias("y"), *[F.round(F.sum(F.col("w")[r]), 9).alias(f"w{r}") for r in range(len(ridges))]
    )
    won = lambda x: F.coalesce(F.max_by("y", F.when(answered, F.struct(F.col(x), -F.col("first")))), F.lit(0))
    one = sums.groupBy(*RECORD).agg(won("votes").alias("mv"), F.max("y").alias("any"), *[won(f"w{r}").alias(f"g{r}") for r in range(len(ridges))])
    out = one.groupBy(*key).agg(F.count("*").alias("n_test"), (100 * F.avg("mv")).alias("mv_acc"), (100 * F.avg("any")).alias("oracle_acc"), F.array(*[F.struct(F.lit(float(x)).alias("ridge"), (100 * F.avg(f"g{r}")).alias("gls_acc")) for r, x in enumerate(ridges)]).alias("fits"))
    trained = rest.where("i = 0 and j = 0").select(*key, F.col("n").alias("n_train"))
    flat = out.join(trained, key).select(*key, "n_train", "n_test", "mv_acc", "oracle_acc", F.inline("fits"))
    return flat.withColumn("gain", F.col("gls_acc") - F.col("mv_acc")).withColumn("headroom", F.col("oracle_acc") - F.col("mv_acc"))
