"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample and kept balanced by splitting the largest and dropping
the smallest lists. Every vector is put in the list of its nearest centroid and, where it lies near
a boundary, in further ones whose centroids are hardly farther. A query searches the centroids by a
best-first walk over their neighbour graph, in memory, and probes the lists that a distance ratio
keeps, and further ones until they hold enough rows for its answer. Queries meet lists in one shuffle: neighbouring lists are packed in shards of bounded size, a
list larger than that is cut in parts, so that copies of one vector fill many tasks rather than one,
and each shard returns its best for each query once.

The nearness is the largest inner product. Vectors get one more component that makes all norms equal
(the square root of the largest squared norm less their own), which turns it into the smallest
distance; the scores returned are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_runs
from .cover_tree import usable

#: Rows that the centroids are fitted on at most, and centroids at most: what is broadcast.
SAMPLE_ROWS = 20_000
MOST_CENTROIDS = 256
#: Rows of a list aimed at, and of a shard of lists (or a part of a large list) in a task.
LIST_ROWS = 400
PART_ROWS = 8_000
#: A vector joins further lists whose centroids are at most so many times as far as its nearest one's.
BOUNDARY_RATIO, MOST_COPIES = 1.03, 3
#: A query probes lists whose centroids are at most so many times as far as the nearest one's, or as
#: the sample's median vector is from its nearest one, so that a query on a centroid looks around too.
PROBE_RATIO = 1.25
#: It goes on to farther lists until they hold so many rows for each neighbour asked for.
ROWS_A_NEIGHBOUR = 20
#: Neighbours of a centroid in the graph, and centroids that a walk keeps open.
GRAPH_LINKS, WALK_WIDTH = 24, 256


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means with a penalty for large lists, so that lists end up of similar size."""
    rng = np.random.default_rng(7)
    k = max(1, min(k, len(np.unique(sample, axis=0))))
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    weight = np.zeros(k)
    scale = float(np.median(distances(sample[:1000], centres).min(1))) or 1.0
    for _ in range(rounds):
        near = (distances(sample, centres) + weight * scale).argmin(1)
        size = np.bincount(near, minlength=k)
        for c in np.flatnonzero(size):
            centres[c] = sample[near == c].mean(0)
        weight = np.clip(weight + 0.05 * (size / max(1.0, size.mean()) - 1), -0.3, 0.3)
        for c in np.flatnonzero(size == 0):  # an empty list takes a vector of the largest one
            largest = np.flatnonzero(near == size.argmax())
            centres[c] = sample[rng.choice(largest)]
            weight[c] = 0.0
    return centres


def spanning_tree(d: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a smallest spanning tree of a matrix of distances."""
    left = np.ones(len(d), bool)
    left[0] = False
    least, via = d[0].copy(), np.zeros(len(d), int)
    edges = []
    for _ in range(len(d) - 1):
        b = int(np.where(left, least, np.inf).argmin())
        edges.append((int(via[b]), b))
        left[b] = False
        nearer = d[b] < least
        least[nearer], via[nearer] = d[b][nearer], b
    return edges


class CentroidGraph:
    """Best-first search over the neighbour graph of the centroids."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        d = distances(centres, centres)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(GRAPH_LINKS, len(centres) - 1)]
        # links go both ways: a centroid far from all others is among no one's nearest
        linked = np.zeros(d.shape, bool)
        np.put_along_axis(linked, near, True, axis=1)
        linked |= linked.T
        # groups of centroids that link only within themselves are joined by the smallest spanning tree
        for a, b in spanning_tree(d):
            linked[a, b] = linked[b, a] = True
        self.links = [np.flatnonzero(row) for row in linked]
        self.entry = int(((centres - centres.mean(0)) ** 2).sum(1).argmin())

    def nearest(self, query: np.ndarray, width: int = WALK_WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Centroids found, nearest first, and their distances."""
        start = float(np.linalg.norm(self.centres[self.entry] - query))
        seen = np.zeros(len(self.centres), bool)
        seen[self.entry] = True
        open_ = [(start, self.entry)]
        best = [(-start, self.entry)]
        while open_:
            d, c = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            new = self.links[c][~seen[self.links[c]]]
            if not len(new):
                continue
            seen[new] = True
            for e, x in zip(np.linalg.norm(self.centres[new] - query, axis=1).tolist(), new.tolist()):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(open_, (e, x))
                    heapq.heappush(best, (-e, x))
                    if len(best) > width:
                        heapq.heappop(best)
        found = sorted((-d, c) for d, c in best)
        return np.array([c for _, c in found]), np.array([d for d, _ in found])


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    """One more component that gives all vectors the norm of the longest one."""
    return np.column_stack([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(1)))])


def shards(sizes: dict[tuple[int, int], int], index: dict[int, tuple[float, np.ndarray, float]]) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """By vector length: the shard of each list, and the parts of each shard. Lists are packed along
    a chain of near centroids, so that a query's lists share shards."""
    shard_of, parts_of = {}, {}
    for dim, (_, centres, _) in index.items():
        d = distances(centres, centres)
        left = set(range(len(centres)))
        at = 0
        chain = []
        while left:
            chain.append(at)
            left.discard(at)
            if left:
                rest = sorted(left)
                at = rest[int(d[at, rest].argmin())]
        shard_of[dim], parts_of[dim] = [0] * len(centres), []
        held = PART_ROWS
        for c in chain:
            n = sizes.get((dim, c), 0)
            if held + n > PART_ROWS:
                parts_of[dim].append(0)
                held = 0
            held += n
            shard_of[dim][c] = len(parts_of[dim]) - 1
            parts_of[dim][-1] = max(1, -(-held // PART_ROWS))
    return shard_of, parts_of


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose vec_id divides by ``every`` the k nearest found.

    Defined results: null ids and vectors that are null, empty, zero or hold null or non-finite
    components take no part; vectors of different lengths aren't compared; a row isn't its own
    neighbour, but other rows of the same id are; ties go to the smaller vec_id; repeated rows are
    candidates each for itself and queries once an id and vector; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    slim = slim.where(usable("v") & F.col("vec_id").isNotNull())
    # equal vectors of one id are one row with a count
    rows = scratch.table(slim.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("dim", F.size("v")))
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).collect()  # one row a vector length
    index: dict[int, tuple[float, np.ndarray, float]] = {}
    for s in lengths:
        drawn = rows.where(F.col("dim") == s["dim"]).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
        lists = int(min(MOST_CENTROIDS, max(1, s["n"] // LIST_ROWS)))
        sample = _lifted(np.array([r[0] for r in drawn]), s["top"])
        centres = balanced_centroids(sample, lists)
        index[s["dim"]] = (s["top"], centres, float(np.median(distances(sample, centres).min(1))))
    shared = spark.sparkContext.broadcast(index)  # at most MOST_CENTROIDS for each vector length

    def placed(lists_of: Callable[[list[float]], list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [lists_of(v) for v in batch.column("v").to_pylist()]
                yield pa.record_batch([*[batch.column(n) for n in ("vec_id", "v", "copies", "dim", "query")], pa.array(out, pa.list_(pa.int32()))], ["vec_id", "v", "copies", "dim", "query", "lists"])

        return place

    def joined(v: list[float]) -> list[int]:
        top, centres, _ = shared.value[len(v)]
        d = np.linalg.norm(centres - _lifted(np.array(v)[None], top)[0], axis=1)
        c = np.argsort(d, kind="stable")[:MOST_COPIES]
        return c[d[c] <= BOUNDARY_RATIO * d[c[0]] + 1e-12].tolist()

    schema = "vec_id long, v array<double>, copies long, dim int, query boolean, lists array<int>"
    held = scratch.table(rows.withColumn("query", F.lit(False)).mapInArrow(placed(joined), schema))
    place = F.posexplode("lists").alias("nth", "list")
    sizes = held.select("dim", "copies", place).groupBy("dim", "list").agg(F.count("*").alias("count"), F.sum(F.when(F.col("nth") == 0, F.col("copies")).otherwise(0)).alias("own")).collect()  # a row a list
    # every row counts in its nearest list only, so that lists add up
    own = {d: np.zeros(len(c), np.int64) for d, (_, c, _) in index.items()}
    for r in sizes:
        own[r["dim"]][r["list"]] = r["own"]
    filled = spark.sparkContext.broadcast(own)
    graphs: dict[int, CentroidGraph] = {}

    def probed_by(v: list[float]) -> list[int]:
        _, centres, usual = shared.value[len(v)]
        if len(v) not in graphs:
            graphs[len(v)] = CentroidGraph(centres)
        # a query's own lift is 0: only then is the distance the inner product's order
        c, d = graphs[len(v)].nearest(np.append(np.array(v), 0.0))
        near = int((d <= PROBE_RATIO * max(d[0], usual) + 1e-12).sum())
        # one more than k for the query's own row
        enough = int(np.searchsorted(filled.value[len(v)][c].cumsum(), ROWS_A_NEIGHBOUR * k + 1)) + 1
        return c[: max(near, enough)].tolist()

    asked = rows.where(F.col("vec_id") % every == 0).withColumn("query", F.lit(True)).mapInArrow(placed(probed_by), schema)
    both = held.unionByName(asked)
    shard_of, parts_of = shards({(r["dim"], r["list"]): r["count"] for r in sizes}, index)
    pick = lambda table, d, i: F.element_at(F.array(*[F.lit(x) for x in table[d]]), i + 1)
    by_dim = lambda table, i: F.coalesce(*[F.when(F.col("dim") == d, pick(table, d, i)) for d in index]) if index else F.lit(0)
    cut = both.withColumn("shard", F.explode(F.array_distinct(F.transform("lists", lambda x: by_dim(shard_of, x)))))
    cut = cut.withColumn("lists", F.filter("lists", lambda x: by_dim(shard_of, x) == F.col("shard"))).withColumn("parts", by_dim(parts_of, F.col("shard")))
    part = F.when(F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")))
    dealt = cut.withColumn("part", F.explode(part)).select(F.xxhash64("dim", "shard", "part").alias("key"), "vec_id", "v", F.xxhash64("v").alias("vh"), "copies", "query", "lists")

    def probe(group: pa.Table) -> dict[str, list]:
        ids, copies, query, vh = (group.column(c).to_numpy() for c in ("vec_id", "copies", "query", "vh"))
        v = np.stack([np.asarray(x.values) for x in group.column("v").combine_chunks()]) + 0.0
        q, c = np.flatnonzero(query), np.flatnonzero(~query)
        out: dict[str, list] = {n: [] for n in ("query_id", "qh", "vec_id", "vh", "copies", "score")}
        if not len(q) or not len(c):
            return out
        c = c[np.argsort(ids[c], kind="stable")]  # ties: smaller ids first
        # equal vectors are scored once, so that they tie exactly
        unique, which = np.unique(v[c], axis=0, return_inverse=True)
        which = which.ravel()
        lists = group.column("lists").to_pylist()
        number = {x: i for i, x in enumerate(sorted({x for own in lists for x in own}))}
        member = np.zeros((len(number), len(c)), bool)
        for j, i in enumerate(c.tolist()):
            member[[number[x] for x in lists[i]], j] = True
        for at in range(0, len(q), 256):
            some = q[at : at + 256]
            for i, row in zip(some.tolist(), v[some] @ unique.T):
                probed = np.flatnonzero(member[[number[x] for x in lists[i]]].any(0))
                if not len(probed):
                    continue
                row = row[which[probed]]
                enough = min(len(probed), k + 1)  # one more for the query's own row
                floor = np.partition(row, len(row) - enough)[len(row) - enough]
                own = probed[row >= floor - 1e-9 * max(1.0, abs(floor))]
                exact = (unique[which[own]] * v[i]).sum(1)
                own = own[np.lexsort((ids[c[own]], -exact))[:enough]]
                pick = c[own]
                out["query_id"] += [int(ids[i])] * len(own)
                out["qh"] += [int(vh[i])] * len(own)
                out["vec_id"] += ids[pick].tolist()
                out["vh"] += vh[pick].tolist()
                out["copies"] += copies[pick].tolist()
                out["score"] += (unique[which[own]] * v[i]).sum(1).tolist()
        return out

    return _ranked(by_runs(dealt, "key", probe, "query_id long, qh long, vec_id long, vh long, copies long, score double"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query among what its lists found; qh and vh stand for the vectors."""
    same = (F.col("query_id") == F.col("vec_id")) & (F.col("qh") == F.col("vh"))
    # a vector found in several lists counts once; the query's own row is taken away
    left = F.max(F.when(same, F.col("copies") - 1).otherwise(F.col("copies"))).alias("copies")
    one = found.groupBy("query_id", "qh", "vec_id", "vh").agg(F.max("score").alias("score"), left).where("copies > 0")
    best = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    one = one.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies"), F.lit(k).cast("long")))).alias("copy")
    rank = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id", "copy")
    out = one.select("query_id", "qh", "vec_id", "score", copy).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
