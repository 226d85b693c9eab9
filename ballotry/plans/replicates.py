"""Bootstrap replicates as matrices: weights (replicates x clusters) times sums (clusters x statistics).

A replicate draws as many clusters of a cell as the cell has, or a given number, with replacement. The
draws of a cell are dealt to blocks of its clusters first: how many of them fall in each block is
counted without listing them. A task then draws within some blocks of several cells, multiplies the weights
with the blocks' sums and gives rows of sums for the replicates, so that what is shuffled grows neither with
questions nor with draws. Rows of a block are cut in slices of bounded size, whose products add up.

Draws are one cyclic sequence: that of a replicate and block begins at a place of its own and goes on from there. So
the draws of a block serve all cells, which only take different numbers of them, and dealing a cell's draws takes one
pass over the part of the cycle that the replicates cover, at most the cycle, however many draws there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotry.sources.shared import with_cells, written

from .numbering import numbered

#: Prime of the draws: squares stay within 64 bits, and both engines of the tests get the same draws.
MODULUS = 2147483647
#: Clusters of a block, rows of a slice, draws that fit a core's cache, numbers of a row of partial sums, places of the
#: cycle that a task deals at least, rows and cells of a task, and block ranges at which tasks take several blocks.
BLOCK, SLICE_ROWS, CHUNK, ROW_NUMBERS, PLACES, TASK_ROWS, TASK_CELLS, RANGES = 4096, 200_000, 16_384, 8_192, 1 << 22, 1_000_000, 16, 64
#: Steps from one draw, replicate and block to the next, and by how many places of the cycle a replicate begins later.
DRAW_STEP, REP_STEP, BLOCK_STEP = 69621, 48271, 40503
REP_PLACES = REP_STEP * pow(DRAW_STEP, -1, MODULUS) % MODULUS


def _rest(x: np.ndarray, m: int) -> np.ndarray:
    """x % m in place for non-negative integers: NumPy divides by one number much faster than it takes remainders."""
    x -= x // m * m
    return x


def _mixed(z: np.ndarray) -> np.ndarray:
    """Quadratic congruences of z in place, which SQL computes alike."""
    z *= z
    w = _rest(z, MODULUS)
    w *= 7919
    w = _rest(w, MODULUS)
    w *= w + 31
    return _rest(w, MODULUS)


def draw_index(rep: np.ndarray, draw: np.ndarray, block: int, m: int) -> np.ndarray:
    """Cluster below m of each draw."""
    return _rest(_mixed(_rest((rep + 1) * REP_STEP + (draw + 1) * DRAW_STEP + block * BLOCK_STEP, MODULUS)), m)


_STEPS = np.arange(CHUNK, dtype=np.int64) * DRAW_STEP % MODULUS


def draw_values(rep: int, block: int, n: int) -> np.ndarray:
    """The first n draws of a replicate and block before they are taken below a number of clusters."""
    out = np.empty(n, np.int64)
    for begin in range(0, n, CHUNK):
        size = min(CHUNK, n - begin)
        first = ((rep + 1) * REP_STEP + block * BLOCK_STEP + (begin + 1) * DRAW_STEP) % MODULUS
        out[begin : begin + size] = _mixed(_rest(_STEPS[:size] + first, MODULUS))
    return out


def dealt_counts(begin: int, end: int, sizes: list[int], draws: list[int], reps: int, block_size: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each cell of sizes[i] clusters and draws[i] draws: the replicates with draws at the places begin to end - 1 of
    the cycle, and how many of these fall in each block: (replicates x blocks)."""
    starts = (1 + (np.arange(reps, dtype=np.int64) + 1) * REP_PLACES) % MODULUS
    spans = []  # of each cell: replicate, from, to; draws that pass the cycle's end go on at its begin
    for k in draws:
        rep = np.concatenate([np.arange(reps)] * 2)
        lo = np.concatenate([starts, starts - MODULUS])
        hi = np.minimum(lo + k, end)
        lo = np.maximum(lo, begin)
        spans.append((rep[lo < hi], lo[lo < hi], hi[lo < hi]))
    cuts = np.unique(np.concatenate([x for _, lo, hi in spans for x in (lo, hi)]))
    if not len(cuts):
        return [(np.zeros(0, np.int64), np.zeros((0, -(-m // block_size)), np.int64)) for m in sizes]
    # cells whose replicates cover the segment from a cut to the next
    covered = []
    for _, lo, hi in spans:
        change = np.bincount(np.searchsorted(cuts, lo), minlength=len(cuts)) - np.bincount(np.searchsorted(cuts, hi), minlength=len(cuts))
        covered.append(np.cumsum(change) > 0)
    upto = [np.zeros((len(cuts), -(-m // block_size)), np.int64) for m in sizes]
    for at in np.flatnonzero(np.any(covered, axis=0)).tolist():
        for first in range(int(cuts[at]), int(cuts[at + 1]), CHUNK):
            places = np.arange(first, min(int(cuts[at + 1]), first + CHUNK), dtype=np.int64)
            values = _mixed(_rest(places * DRAW_STEP, MODULUS))
            for c, m in enumerate(sizes):
                if covered[c][at]:
                    upto[c][at + 1] += np.bincount(_rest(values.copy(), m) // block_size, minlength=upto[c].shape[1])
    out = []
    for (rep, lo, hi), sums in zip(spans, upto):
        np.cumsum(sums, axis=0, out=sums)
        out.append((rep, sums[np.searchsorted(cuts, hi)] - sums[np.searchsorted(cuts, lo)]))
    return out


def block_weights(first: int, counts: np.ndarray, block: int, sizes: list[int], out: list[np.ndarray]) -> None:
    """Weights (replicates x clusters) of a block of each cell: replicate ``first`` + i draws counts[c, i] of its sizes[c]
    clusters. Cells of a size take the draws in one pass, those with fewer first."""
    alike: dict[int, np.ndarray] = {}
    for size in set(sizes):
        own = np.flatnonzero(np.asarray(sizes) == size)
        alike[size] = own[np.argsort(counts[own], axis=0, kind="stable")]
    for i, most in enumerate(counts.max(axis=0).tolist()):
        values = draw_values(first + i, block, most)
        for size, order in alike.items():
            index = values & (size - 1) if size & (size - 1) == 0 else _rest(values.copy(), size)
            row, seen = None, 0
            for c in order[:, i].tolist():
                n = int(counts[c, i])
                if row is None:
                    row = np.bincount(index[:n], minlength=size)
                elif n > seen:
                    np.add.at(row, index[seen:n], 1)
                seen = n
                out[c][i] = row


def add_rows(sums: np.ndarray, index: np.ndarray, values: np.ndarray) -> None:
    """Adds rows of values to the rows of sums at index, which may repeat."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    begins = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    sums[index[begins]] += np.add.reduceat(values[order], begins, axis=0)


def replicate_sums(
    rows: DataFrame, by: list[str], cluster: list[str], columns: list[str], expand: Callable[[dict[str, np.ndarray]], np.ndarray],
    finish: Callable[[np.ndarray], dict[str, np.ndarray]], results: list[str], reps: int, draws: int | None = None, block_size: int = BLOCK, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(by, rep, results) of every replicate of every cell; replicate -1 is the data as they are.

    ``expand`` makes statistics (rows x statistics) of columns of rows, which are summed with the weights of the rows'
    clusters; ``finish`` makes double columns ``results`` of sums (replicates x statistics). Clusters are the distinct
    values of the columns ``cluster``, of which the first is numeric, within a cell, and are numbered in their order.
    """
    key, spark = list(by), rows.sparkSession
    rows = written(rows.select(*dict.fromkeys([*by, *cluster, *columns])))
    own = numbered(rows, by, cluster[0], cluster[1:], name="__index", size="__m", alike=True).select(*dict.fromkeys([*by, *columns]), "__index", "__m")
    own = written(own.withColumn("__block", F.floor(F.col("__index") / block_size).cast("long")))
    slices = written(own.groupBy(*by, "__block", "__m").agg(F.count("*").alias("__rows"), F.ceil(F.count("*") / slice_rows).alias("__slices")))
    cut = with_cells(own, slices.select(*by, "__block", "__slices"), [*by, "__block"])
    cut = cut.withColumn("__slice", F.pmod(F.hash(*columns, "__index"), F.col("__slices"))).select(*by, "__block", "__slice", "__index", "__m", *[c for c in columns if c not in by])

    types = {f.name: f.dataType for f in rows.schema}
    cells = slices.select(*by).distinct()
    whole = slices.agg(F.count("*").alias("groups"), F.sum("__rows").alias("rows"), F.max("__m").alias("m")).first()  # one row
    blocks = -(-(whole["m"] or 1) // block_size)
    cell_groups = -(-cells.count() // TASK_CELLS)
    group_rows = max(1, (whole["rows"] or 0) // blocks // cell_groups)
    width = max(1, min(TASK_ROWS // group_rows, -(-blocks // RANGES)))  # blocks of a task
    ranges = -(-blocks // width)
    # small inputs have few blocks, so that replicates are dealt out as well
    chunks = max(1, min(-(-reps // 16), -(-4 * spark.sparkContext.defaultParallelism // (ranges * cell_groups))))
    chunk = -(-reps // chunks)
    chunks = -(-reps // chunk)
    cell_group = F.pmod(F.hash(*by), F.lit(cell_groups)) if by else F.lit(0)
    block_range = F.floor(F.col("__block") / width).cast("long")
    group = ["__cells", "__range", "__slice", "__chunk"]
    n = min(10_000, 4 * ranges * cell_groups * chunks)  # keys are hashed to partitions: few share one

    # draws that fall in each block, for cells of more than one block
    many = slices.where(F.col("__m") > block_size).select(*by, "__m").distinct()
    k = F.lit(draws).cast("long") if draws else F.col("__m")
    places = max(PLACES, draws or whole["m"] or 1)
    parts = many.select(*by, "__m", k.alias("__k"), cell_group.alias("__cells"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((MODULUS - 1) // places).cast("long"))).alias("__part"))
    counted = T.StructType([*[T.StructField(c, types[c]) for c in by], T.StructField("__cells", T.IntegerType()), T.StructField("__range", T.LongType()), T.StructField("__chunk", T.LongType()), T.StructField("__reps", T.ArrayType(T.LongType())), T.StructField("__counts", T.ArrayType(T.LongType()))])

    def deal(batch: pd.DataFrame) -> pd.DataFrame:
        begin = int(batch["__part"].iloc[0]) * places
        got = dealt_counts(begin, min(MODULUS, begin + places), batch["__m"].tolist(), batch["__k"].tolist(), reps, block_size)
        out = []
        for at, (rep, counts) in enumerate(got):
            for c in np.unique(rep // chunk).tolist():
                own = rep // chunk == c
                for r in range(-(-counts.shape[1] // width)):
                    out.append([*[batch[b].iloc[at] for b in by], batch["__cells"].iloc[at], r, c, rep[own], np.ascontiguousarray(counts[own, r * width : (r + 1) * width]).ravel()])
        return pd.DataFrame(out, columns=counted.names)

    # rows are few and work is not, so adaptive execution must not join these partitions
    dealt = parts.repartition(min(10_000, (MODULUS // places + 1) * cell_groups), "__part", "__cells").groupBy("__part", "__cells").applyInPandas(deal, counted)
    most = slices.groupBy(cell_group.alias("s_cells"), block_range.alias("s_range")).agg(F.max("__slices").alias("__slices"))
    dealt = dealt.join(most, (F.col("__cells") == F.col("s_cells")) & (F.col("__range") == F.col("s_range")))
    dealt = dealt.select(*by, "__cells", "__range", "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__slices") - 1)).alias("__slice"), "__reps", "__counts")
    cut = cut.withColumn("__cells", cell_group).withColumn("__range", block_range).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    partial = T.StructType([*[T.StructField(c, types[c]) for c in by], T.StructField("__first", T.LongType()), T.StructField("__n", T.LongType()), T.StructField("__sums", T.ArrayType(T.DoubleType()))])

    def multiply(block_rows: pd.DataFrame, block_draws: pd.DataFrame) -> pd.DataFrame:
        if block_rows.empty:
            return pd.DataFrame({c: [] for c in partial.names})
        begin = int(block_rows["__chunk"].iloc[0]) * chunk
        here, lowest = min(chunk, reps - begin), int(block_rows["__range"].iloc[0]) * width
        key_of = lambda row: tuple(None if x is None or x != x else x for x in row)
        counts: dict[tuple, np.ndarray] = {}
        for row in block_draws[[*by, "__reps", "__counts"]].itertuples(index=False, name=None):
            own = counts.setdefault(key_of(row[: len(by)]), np.zeros((width, here), np.int64))
            got = np.asarray(row[-1], np.int64).reshape(len(row[-2]), -1)
            np.add.at(own[: got.shape[1]].T, np.asarray(row[-2], np.int64) - begin, got)
        done: dict[tuple, list[np.ndarray]] = {}  # sums of the data and of the replicates
        for block, of_block in block_rows.groupby("__block", sort=True):
            keys, sizes, sums, drawn = [], [], [], []
            for _, own in of_block.groupby(by, dropna=False, sort=False) if by else [((), of_block)]:
                key, m = key_of(own[c].iloc[0] for c in by), int(own["__m"].iloc[0])
                size, total = min(block_size, m - block * block_size), None
                for first in range(0, len(own), 4_096):
                    piece = own.iloc[first : first + 4_096]
                    got = expand({c: piece[c].to_numpy() for c in columns}).astype(float)
                    total = np.zeros((size, got.shape[1])) if total is None else total
                    add_rows(total, piece["__index"].to_numpy() - block * block_size, got)
                n = counts[key][block - lowest] if m > block_size and key in counts else np.full(here, 0 if m > block_size else draws or m, np.int64)
                if key not in done:
                    done[key] = [np.zeros(total.shape[1]), np.zeros((here, total.shape[1]))]
                done[key][0] += total.sum(axis=0)
                # products of halves are exact in single precision up to this bound
                small = 2 * np.abs(total).max() * max(1, n.max()) < 1 << 24 and bool((2 * total == np.rint(2 * total)).all())
                keys, sizes, sums, drawn = [*keys, key], [*sizes, size], [*sums, total.astype(np.float32) if small else total], [*drawn, n]
            drawn = np.stack(drawn)
            weights = [np.empty((64, size), x.dtype) for size, x in zip(sizes, sums)]
            for first in range(0, here, 64):
                some = drawn[:, first : first + 64]
                block_weights(begin + first, some, int(block), sizes, weights)
                for key, w, x in zip(keys, weights, sums):
                    done[key][1][first : first + some.shape[1]] += w[: some.shape[1]] @ x
        out = []
        for key, (data, made) in done.items():
            step = max(1, ROW_NUMBERS // made.shape[1])
            if begin == 0:
                out.append([*key, -1, 1, data])
            out += [[*key, begin + first, len(made[first : first + step]), made[first : first + step].ravel()] for first in range(0, here, step)]
        return pd.DataFrame(out, columns=partial.names)

    done = T.StructType([*[T.StructField(c, types[c]) for c in by], T.StructField("rep", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in results]])

    def total(batch: pd.DataFrame) -> pd.DataFrame:
        n = int(batch["__n"].iloc[0])
        sums = np.zeros(len(batch["__sums"].iloc[0]))
        for one in batch["__sums"]:
            sums += one
        frame = pd.DataFrame(finish(sums.reshape(n, -1)))
        frame["rep"] = np.arange(n) + int(batch["__first"].iloc[0])
        for c in by:
            frame[c] = [batch[c].iloc[0]] * n
        return frame[done.names]

    products = cut.repartition(n, *group).groupBy(*group).cogroup(dealt.repartition(n, *group).groupBy(*group)).applyInPandas(multiply, partial)
    return products.groupBy(*key, "__first").applyInPandas(total, done)


# Statistics of votes ---------------------------------------------------------------------------------


def bits(mask: np.ndarray, k: int) -> np.ndarray:
    """Votes (rows x k) of masks."""
    return (mask.astype(np.int64)[:, None] >> np.arange(k) & 1).astype(float)


def pair_products(votes: np.ndarray) -> np.ndarray:
    """Votes, then the products of all pairs of columns i < j."""
    i, j = np.triu_indices(votes.shape[1], 1)
    return np.hstack([votes, votes[:, i] * votes[:, j]])


def prefix_columns(k: int, of: int) -> np.ndarray:
    """Where ``pair_products`` of ``of`` columns has those of the first k."""
    i, j = np.triu_indices(of, 1)
    return np.concatenate([np.arange(k), of + np.flatnonzero(j < k)])


def mean_pair_rho(n: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """Mean correlation over pairs of k columns from the sums of ``pair_products``; constant columns are left out, NaN
    if no pair is left."""
    i, j = np.triu_indices(k, 1)
    n = n[:, None]
    one, both = sums[:, :k], sums[:, k : k + len(i)]
    var = n * one - one * one
    good = (var[:, i] > 0) & (var[:, j] > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.where(good, (n * both - one[:, i] * one[:, j]) / np.sqrt(np.where(good, var[:, i] * var[:, j], 1.0)), 0.0)
        return np.where(good.any(axis=1), r.sum(axis=1) / good.sum(axis=1), np.nan)


def replicates_sql(name: str, clusters: str, reps: int, draws: int | None = None, cell: str = "model, task") -> str:
    """Common table expressions in DuckDB that end in ``name`` (cell, rep, cluster_idx), one row a draw: the same draws
    of the numbered clusters (cell, cluster_idx)."""
    index = lambda rep, draw, block, m: (
        f"(({_MIX.format(z=_Z.format(rep=rep, draw=draw, block=block))}) * ({_MIX.format(z=_Z.format(rep=rep, draw=draw, block=block))} + 31)) % {MODULUS} % {m}"
    )
    k = str(draws) if draws else "m"
    return f"""cm_{name} as (select {cell}, count(distinct cluster_idx)::bigint m from {clusters} group by all),
rb_{name} as (select {cell}, m, rep, 0::bigint b, {k}::bigint n from cm_{name}, (select range rep from range({reps})) where m <= {BLOCK}
  union all select {cell}, m, rep, {index("rep", "draw", "0", "m")} // {BLOCK} b, count(*)::bigint n from (select *, unnest(range({k})) draw from cm_{name} where m > {BLOCK}), (select range rep from range({reps})) group by all),
{name} as (select {cell}, rep, b * {BLOCK} + {index("rep", "draw", "b", f"least({BLOCK}, m - b * {BLOCK})")} cluster_idx from (select *, unnest(range(n)) draw from rb_{name}))"""


_Z = f"(({{rep}} + 1) * 48271 + ({{draw}} + 1) * 69621 + {{block}} * 40503) % {MODULUS}"
_MIX = f"(({{z}}) * ({{z}}) % {MODULUS}) * 7919 % {MODULUS}"
