"""How correlated the votes of a record are, and how many independent ones they are worth.

Agreement and the pooled estimate follow from vote counts alone. The mean pairwise correlation of a
paths comes from vote masks: each task multiplies its records' votes to one matrix a cell, and only
these are shuffled, so no record is ever paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotry.functions import closed_forms as cf

from .votes import CELL, WORD_PATHS, ballots, majority, of_prefixes, paths_below, prefix, prefix_ballots, records, weighted_mean, weighted_statistics


def pair_sums(recs: DataFrame, by: list[str] = CELL, weight: str | None = None) -> DataFrame:
    """n, Si, Sj and Sij of every pair of paths i < j of the records that have both; a row counts ``weight`` times.

    Each task adds up one matrix product of votes a cell and batch, and gives one row for each cell and
    pair, so what is shuffled doesn't grow with the records.
    """

    def votes(masks: pd.Series, k: int) -> np.ndarray:
        """Rows x k votes; masks of several words hold 63 paths in each."""
        words = np.stack(masks.to_numpy()) if len(masks) and isinstance(masks.iloc[0], (list, np.ndarray)) else masks.to_numpy()[:, None]
        path = np.arange(k)
        return (words.astype(np.int64)[:, path // WORD_PATHS] >> (path % WORD_PATHS) & 1).astype(float)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        held = 0

        def rows() -> pd.DataFrame:
            out = []
            for key, (n, a, s) in sums.items():
                i, j = np.nonzero(np.triu(n, 1))
                frame = pd.DataFrame({"i": i, "j": j, "n": n[i, j], "si": a[i, j], "sj": a[j, i], "sij": s[i, j]}).astype("int64")
                for c, v in zip(by, key):
                    frame[c] = v
                out.append(frame[[*by, "i", "j", "n", "si", "sj", "sij"]])
            sums.clear()
            return pd.concat(out, ignore_index=True)

        for batch in batches:
            for key, own in batch.groupby(by, dropna=False, sort=False):
                m = int(own.k.max())
                there = (own.k.to_numpy()[:, None] > np.arange(m)[None, :]).astype(float)
                y = votes(own["mask"], m)
                times = 1.0 if weight is None else own[weight].to_numpy(float)[:, None]
                new = np.stack([(there * times).T @ there, (y * times).T @ there, (y * times).T @ y])
                key = tuple(None if x != x else x for x in key)
                old = sums.get(key)
                if old is not None and old.shape[1] != m:
                    size = max(m, old.shape[1])
                    new, old = (np.pad(x, ((0, 0), (0, size - x.shape[1]), (0, size - x.shape[1]))) for x in (new, old))
                held += 0 if old is not None else m * m
                sums[key] = new if old is None else old + new
            if held > 4_000_000:
                yield rows()
                held = 0
        if sums:
            yield rows()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in recs.schema if f.name in by]
    fields.sort(key=lambda f: by.index(f.split("`")[1]))
    rows = recs.select(*by, "k", "mask", *([weight] if weight else []))
    if weight:  # few rows stand for many records: batches of one group each cost less than the sort
        rows = rows.sortWithinPartitions(*by)
    found = rows.mapInPandas(each, ", ".join([*fields, "i long", "j long", "n long", "si long", "sj long", "sij long"]))
    return found.groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def pair_correlations(recs: DataFrame, by: list[str] = CELL, weight: str | None = None) -> DataFrame:
    """r of every pair of paths i < j; null where a path is constant."""
    c = F.col
    r = pearson_of_sums(c("n"), c("si"), c("sj"), c("si"), c("sj"), c("sij"))
    return pair_sums(recs, by, weight).select(*by, "i", "j", r.alias("r"))


def pearson_of_sums(n: Column, si: Column, sj: Column, sii: Column, sjj: Column, sij: Column) -> Column:
    """Correlation from sums; null if a side is constant. Products are doubles, as those of large sums exceed 64 bits."""
    n, si, sj, sii, sjj, sij = (x.cast("double") for x in (n, si, sj, sii, sjj, sij))
    vi, vj = n * sii - si * si, n * sjj - sj * sj
    return F.when((vi > 0) & (vj > 0), (n * sij - si * sj) / F.sqrt(vi * vj))


def pairwise_rho(recs: DataFrame, by: list[str] = CELL, weight: str | None = None) -> DataFrame:
    """Mean correlation over path pairs; constant paths are skipped, null if none is left."""
    return pair_correlations(recs, by, weight).groupBy(*by).agg(F.avg("r").alias("rho"), F.count("r").alias("pairs"))


def pairwise_rho_join(paths: DataFrame, by: list[str] = CELL) -> DataFrame:
    """The same by a self-join of paths, as a cross-check."""
    key = [*by, *[x for x in ("seed", "instance_id") if x not in by]]
    a = paths.select(*key, F.col("path").alias("i"), F.col("y").alias("yi"))
    b = paths.select(*key, F.col("path").alias("j"), F.col("y").alias("yj"))
    p = a.join(b, key).where("i < j").groupBy(*by, "i", "j")
    sums = p.agg(F.count("*").alias("n"), F.sum("yi").alias("si"), F.sum("yj").alias("sj"), F.sum(F.col("yi") * F.col("yj")).alias("sij"))
    c = F.col
    r = pearson_of_sums(c("n"), c("si"), c("sj"), c("si"), c("sj"), c("sij"))
    return sums.groupBy(*by).agg(F.avg(r).alias("rho"), F.count(r).alias("pairs"))


def agreement(recs: DataFrame, by: list[str] = CELL) -> DataFrame:
    """Mean share of path pairs that agree; null for single paths."""
    s, k = F.col("s"), F.col("k")
    pairs = F.when(k > 1, (s * (s - 1) + (k - s) * (k - s - 1)).cast("double") / (k * (k - 1)))
    return recs.groupBy(*by).agg(F.avg(pairs).alias("agreement"))


def pooled_c(recs: DataFrame, by: list[str] = CELL, weight: str | None = None) -> DataFrame:
    """(mean pair moment - p^2) / (p (1 - p)); null where undefined. A row counts ``weight`` times."""
    s, k, n = F.col("s"), F.col("k"), F.lit(1) if weight is None else F.col(weight)
    both = weighted_mean(F.when(k > 1, (s * (s - 1)).cast("double") / (k * (k - 1))), n)
    p = F.sum(n * s) / F.sum(n * k)
    out = recs.groupBy(*by).agg(both.alias("both"), p.alias("p_bar"))
    v = F.col("p_bar") * (1 - F.col("p_bar"))
    return out.select(*by, "p_bar", F.when(v > 0, (F.col("both") - F.col("p_bar") * F.col("p_bar")) / v).alias("c_hat"))


def k_eff(k: Column, c: Column, strict: bool = False) -> Column:
    """K / (1 + (K - 1) c). Strict: null unless c > 0, and 1 for one path; else null only with c."""
    value = k / (1 + (k - 1) * c)
    return F.when(k == 1, F.lit(1.0)).when(c > 0, value) if strict else F.when(c.isNotNull() & (1 + (k - 1) * c != 0), value)


def ceiling(c: Column) -> Column:
    return F.when(c > 0, 1 / c)


def exact_k(paths: DataFrame, ks: tuple[int, ...] = (1, 2, 4, 8, 16, 32), width: int = WORD_PATHS) -> DataFrame:
    """Row of the first kk paths for every kk: records n, seeds, path accuracy, plurality vote (mv_acc) and binary
    vote, agreement, rho over pairs with its K_eff, ceiling and share of it, the pooled c_hat, mean tokens, and
    mean and standard deviation over seeds of path accuracy.

    All prefixes come from one written table of counted ballots and one matrix of pair correlations. Records of more than 63 paths need
    their largest number of paths as ``width``.
    """
    b = prefix_ballots(paths, ks, width)
    one = of_prefixes(b, ks, width)
    key = [*CELL, "kk"]
    s, k, n = F.col("s"), F.col("k"), F.col("n")
    paired = lambda x: F.when(k > 1, x.cast("double") / (k * (k - 1)))
    sums = {"n": n, "s": n * s, "k": n * k, "won": n * F.col("won"), "binary": n * majority(s, k), "tokens": F.col("tokens"), "pairs": F.when(k > 1, n), "agree": n * paired(s * (s - 1) + (k - s) * (k - s - 1)), "both": n * paired(s * (s - 1))}
    seeds = one.groupBy(*key, "seed").agg(*[F.sum(x).alias(name) for name, x in sums.items()]).withColumn("acc", F.col("s") / F.col("k"))
    base = seeds.groupBy(*key).agg(*[F.sum(x).alias(x) for x in sums], F.count("*").alias("n_seeds"), F.avg("acc").alias("seed_mean"), F.stddev_samp("acc").alias("seed_std"))
    p = F.col("mean_path_acc")
    base = base.select(
        *key, "n", (s / k).alias("mean_path_acc"), (F.col("won") / n).alias("mv_acc"), (F.col("binary") / n).alias("binary_acc"), (F.col("tokens") / n).alias("tokens"), "n_seeds", "seed_mean", "seed_std",
        (F.col("agree") / F.col("pairs")).alias("agreement"), (F.col("both") / F.col("pairs")).alias("both"),
    ).withColumn("c_hat", F.when(p * (1 - p) > 0, (F.col("both") - p * p) / (p * (1 - p)))).drop("both")
    r = pair_correlations(b.select(*CELL, paths_below(F.col("there"), width, width).alias("k"), "mask", "n"), weight="n")
    rho = r.withColumn("kk", F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))).where("j < kk").groupBy(*key).agg(F.avg("r").alias("rho"))
    out = base.join(rho, key, "left")
    out = out.withColumn("keff", k_eff(F.col("kk"), F.col("rho"), strict=True)).withColumn("ceiling", ceiling(F.col("rho")))
    return out.withColumn("pct_ceiling", F.col("keff") / F.col("ceiling"))


def cross_model(paths: DataFrame, ks: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    """rho and K_eff of each k in columns; at the last k accuracy, observed vote, its beta-binomial and binomial
    predictions in percent and their errors in points, ceiling and share of it."""
    rows, last = exact_k(paths, ks), ks[-1]
    at = lambda k, x: F.max(F.when(F.col("kk") == k, F.col(x)))
    wide = rows.groupBy(*CELL).agg(
        *[at(k, x).alias(f"{name}{k}") for k in ks for x, name in (("rho", "rho"), ("keff", "keff"))], at(last, "mean_path_acc").alias("p_bar"),
        (100 * at(last, "binary_acc")).alias("observed"), at(last, "ceiling").alias("ceiling"), (100 * at(last, "pct_ceiling")).alias("pct_ceiling"),
    )
    bb, bi = 100 * cf.beta_binomial_majority(last, F.col("p_bar"), F.col(f"rho{last}")), 100 * cf.binomial_majority(last, F.col("p_bar"))
    wide = wide.withColumn("predicted", bb).withColumn("independent", bi)
    return wide.withColumn("error_pp", F.abs(F.col("observed") - F.col("predicted"))).withColumn("independent_error_pp", F.abs(F.col("observed") - F.col("independent")))


def cell_report(paths: DataFrame, eps: float = 0.025, pilot: int = 4) -> DataFrame:
    """One row a cell: accuracy, rho at the pilot and at all paths, K_eff, plurality vote of each prefix, the
    operating point of the pilot's rho, missing answers and cap hits."""
    ks = (1, 2, 4, 8, 16, 32)
    at = lambda k, x: F.max(F.when(F.col("kk") == k, F.col(x)))
    wide = exact_k(paths, ks).groupBy(*CELL).agg(
        at(32, "mean_path_acc").alias("p_bar"), at(pilot, "rho").alias("rho_pilot"), at(32, "rho").alias("rho_all"), at(32, "keff").alias("keff"), *[at(k, "mv_acc").alias(f"mv{k}") for k in ks]
    )
    cut = paths.groupBy(*CELL).agg(F.count_if("truncated").alias("cut"), F.count_if(F.col("answer").isNull()).alias("missing"))
    return wide.join(cut, CELL).withColumn("k_star", cf.k_star(F.col("rho_pilot"), F.lit(eps)))


def block_k_eff(recs: DataFrame, least_rows: int = 20, least_p: float = 0.02, weight: str | None = None) -> DataFrame:
    """p (1 - p) / variance of row means, or the reason why it isn't eligible. A row of recs counts ``weight`` times."""
    rho = pairwise_rho(recs, weight=weight).select(*CELL, "rho")
    k, p, v = F.col("k"), F.col("p_bar"), F.col("v")
    if weight is None:
        sums = [F.count("*").alias("rows"), (F.sum("s") / F.sum("k")).alias("p_bar"), F.var_samp(F.col("s") / F.col("k")).alias("v")]
    else:
        n, x = F.col(weight), F.col("s") / F.col("k")
        total = F.sum(n)
        var = F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise((F.sum(n * x * x) - F.sum(n * x) * F.sum(n * x) / total) / (total - 1))
        sums = [total.alias("rows"), (F.sum(n * F.col("s")) / F.sum(n * F.col("k"))).alias("p_bar"), F.when(total > 1, var).alias("v")]
    out = recs.groupBy(*CELL).agg(F.max("k").alias("k"), *sums)
    out = out.join(rho, CELL, "left")
    reason = (
        F.when(F.col("rows") < least_rows, "too few rows").when(p < least_p, "base accuracy").when(F.col("rho").isNull(), "no correlation")
        .when(F.col("rho") <= -1 / (k - 1), "negative correlation").when(v <= 0, "no variance")
    )
    out = out.withColumn("reason", reason)
    out = out.withColumn("block_keff", F.when(F.col("reason").isNull(), p * (1 - p) / v))
    vote = k_eff(k, F.col("rho"))
    return out.select(*CELL, "reason", "block_keff", F.when(F.col("reason").isNull(), F.col("block_keff") / vote).alias("ratio"))


def slot_covariance(paths: DataFrame, by: list[str] = CELL, width: int = WORD_PATHS) -> DataFrame:
    """Means and sample covariances of all path pairs i <= j."""
    recs = records(paths, width)
    pairs = pair_sums(recs, by)
    own = paths.groupBy(*by, F.col("path").alias("i")).agg(F.count("*").alias("n"), F.sum("y").alias("si"))
    own = own.select(*by, "i", F.col("i").alias("j"), "n", "si", F.col("si").alias("sj"), F.col("si").alias("sij"))
    both = pairs.unionByName(own)
    n = F.col("n").cast("double")
    cov = (F.col("sij") - F.col("si") * F.col("sj") / n) / (n - 1)
    return both.select(*by, "i", "j", (F.col("si") / n).alias("mean_i"), (F.col("sj") / n).alias("mean_j"), F.when(n > 1, cov).alias("cov"))


def arm_statistics(paths: DataFrame) -> DataFrame:
    """One row a cell and arm: accuracy, rho, c, both effective votes, majority, weighted majority, gain, slot CV."""
    b = ballots(paths)
    out = b.groupBy(*CELL).agg(F.max("k").alias("k")).join(pairwise_rho(b, weight="n").drop("pairs"), CELL, "left").join(pooled_c(b, weight="n"), CELL)
    out = out.join(weighted_statistics(b), CELL).select(*CELL, "k", "mv_acc", "rho", "p_bar", "c_hat", "weighted_acc", "gain_pp", "slot_cv")
    return out.withColumn("keff_rho", k_eff(F.col("k"), F.col("rho"))).withColumn("keff_c", k_eff(F.col("k"), F.col("c_hat"), strict=True))


def arm_cells(paths: DataFrame, k: int = 8, least: float = 0.01) -> DataFrame:
    """One row (model, task): rho and majority of both arms on the first k paths, relative change of rho of PT against
    SC in percent (null if |rho SC| is at most ``least``), change of effective votes and of the majority."""
    recs = records(prefix(paths, k))
    cell = CELL[:2]
    stats = pairwise_rho(recs).join(recs.groupBy(*CELL).agg(F.avg(majority(F.col("s"), F.col("k"))).alias("mv")), CELL)
    arm = lambda a, x: F.max(F.when(F.col("arm") == a, F.col(x))).alias(f"{x}_{a.lower()}")
    wide = stats.groupBy(*cell).agg(*[arm(a, x) for a in ("SC", "PT") for x in ("rho", "mv")])
    sc, pt, n = F.col("rho_sc"), F.col("rho_pt"), F.lit(k)
    return wide.select(
        *cell, "rho_sc", "rho_pt", "mv_sc", "mv_pt", F.when(F.abs(sc) > least, 100 * (pt - sc) / F.abs(sc)).alias("drho_pct"),
        (k_eff(n, pt) - k_eff(n, sc)).alias("dkeff"), (F.col("mv_pt") - F.col("mv_sc")).alias("dmv"),
    )


def arm_delta(paths: DataFrame, k: int = 8, least: float = 0.01) -> DataFrame:
    """The changes of ``arm_cells`` alone."""
    return arm_cells(paths, k, least).drop("rho_sc", "rho_pt", "mv_sc", "mv_pt")
