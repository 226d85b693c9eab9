"""Embedding near-duplicates by a dual traversal of cover trees.

Unit vectors have cosine >= c exactly if their distance is at most sqrt(2 - 2c). Equal vectors are
collapsed first. A bounded set of pivots cuts space in cells; each cell (and each part of a large
one) becomes a cover tree: nested levels of centres whose covering radii halve. Pairs of cells, then
pairs of nodes level by level, are dropped when their centres are further apart than the threshold
and both covering radii, which loses nothing; pairs of leaves that remain get the exact cosine in
double precision, a bounded number at a time. Blocks are numbered and lie in tiles; a task takes the
blocks of two tiles in pieces of bounded bytes and returns links as sums by vector and a spanning set
of pairs, so that a dense cluster gives no square of rows. Pairs of tiles are dealt in rounds, in each
of which a tile meets two others: what a round shuffles grows with the rows, not with their square.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_runs, connected_components, lean, small

#: Pivots at most, drawn from as many rows at most: what is broadcast, whatever the table.
PIVOTS = 64
#: Vectors of a part of a cell at most, about, if they have up to PART_DIM components; fewer of longer ones.
PART_ROWS, PART_DIM = 3_000, 64
#: Blocks of a tile at most: what a task holds is two tiles.
TILE_BLOCKS = 8
#: Bytes of a piece of a block, so that no row is large, and bytes up to which rounds are shuffled together.
PIECE_BYTES, ROUND_BYTES = 64 << 10, 256 << 20
#: Tasks of a round at most.
ROUND_TASKS = 2_000
#: Pairs of nodes that a task holds at once, about, and numbers of a matrix that it makes for them.
PAIRS, NUMBERS = 1 << 17, 1 << 20
#: Slack for rounding of single-precision products in bounds: no pair is dropped by it.
SLACK = 2e-3
#: Links of a task: sums by vector (b is null) and spanning pairs.
FOUND = "a long, b long, n long"


def usable(column: str) -> Column:
    """Whether a vector takes part: neither null nor empty nor zero, all components finite."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class CoverTree:
    """Levels of a cover tree: each level's centres cover all vectors below them within its radius,
    and the radius halves from level to level until every vector is its own centre."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.single = vectors.astype(np.float32)
        n = len(vectors)
        # a level: centre of each node, its parent in the level above, its true covering radius
        self.centre: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        self.radius: list[np.ndarray] = []
        owner = np.zeros(n, np.int64)  # node of each vector at the current level
        self._add(np.zeros(1, np.int64), np.zeros(1, np.int64), owner)
        bound = self.radius[-1].max(initial=0.0) / 2
        while len(self.centre[-1]) < n:
            centres, parents, owner = self._split(owner, bound)
            self._add(centres, parents, owner)
            bound /= 2
        self.leaf = self.centre[-1]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def packed(self) -> list[tuple[np.ndarray, ...]]:
        """The levels in fewer bytes; radii are rounded up."""
        return [(c.astype(np.int32), p.astype(np.int32), np.nextafter(r.astype(np.float32), np.float32(np.inf))) for c, p, r in zip(self.centre, self.parent, self.radius)]

    @classmethod
    def unpacked(cls, vectors: np.ndarray, levels: list[tuple[np.ndarray, ...]]) -> CoverTree:
        tree = cls.__new__(cls)
        tree.vectors, tree.single = vectors, vectors.astype(np.float32)
        tree.centre, tree.parent, tree.radius = ([x[i].astype(kind) for x in levels] for i, kind in enumerate((np.int64, np.int64, np.float64)))
        tree.leaf, tree.sorted = tree.centre[-1], {}
        return tree

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the next level by parent, and where each parent's begin; below the last level a node is its own child."""
        if level not in self.sorted:
            if level == len(self.centre) - 1:
                self.sorted[level] = np.arange(len(self.centre[level])), np.arange(len(self.centre[level]) + 1)
            else:
                order = np.argsort(self.parent[level + 1], kind="stable")
                self.sorted[level] = order, np.searchsorted(self.parent[level + 1][order], np.arange(len(self.centre[level]) + 1))
        return self.sorted[level]

    def _add(self, centres, parents, owner) -> None:
        far = np.linalg.norm(self.vectors - self.vectors[centres[owner]], axis=1) if len(owner) else np.zeros(0)
        radius = np.zeros(len(centres))
        np.maximum.at(radius, owner, far)
        self.centre.append(centres)
        self.parent.append(parents)
        self.radius.append(radius)

    def _split(self, owner: np.ndarray, bound: float):
        """Children of every node: its centre again, then greedily each vector further than the bound from all so far."""
        n_nodes, above = len(self.centre[-1]), self.centre[-1]
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(n_nodes + 1))
        size = np.diff(cut)
        alone = np.flatnonzero(size == 1)
        centres, parents = [above[alone]], [alone]
        new = np.empty(len(owner), np.int64)
        new[order[cut[alone]]] = np.arange(len(alone))
        made = len(alone)
        for node in np.flatnonzero(size > 1).tolist():
            own = order[cut[node] : cut[node + 1]]
            own = np.concatenate((own[own == above[node]], own[own != above[node]]))
            if bound < SLACK:  # equal up to rounding: every vector for itself
                near, pick = None, np.arange(len(own))
                new[own] = made + pick
            else:
                left = np.ones(len(own), bool)
                pick = []
                while len(ahead := np.flatnonzero(left)[: max(1, NUMBERS // len(own))]):
                    rows = _distances(self.single[own[ahead]], self.single[own])
                    for i, row in zip(ahead.tolist(), rows):
                        if left[i]:
                            near = left & (row <= bound)
                            near[i] = True
                            new[own[near]] = made + len(pick)
                            pick.append(i)
                            left &= ~near
            centres.append(own[pick])
            parents.append(np.full(len(pick), node))
            made += len(pick)
        return np.concatenate(centres), np.concatenate(parents), new


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def dual_pairs(a: CoverTree, b: CoverTree, same: bool, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors (x of a, y of b; x before y if both trees are one) that bounds don't part, a bounded number at a time."""
    # the two roots pair all nodes of the first levels below them: matrix products of some rows each
    la, lb = min(1, len(a.centre) - 1), min(1, len(b.centre) - 1)
    ca, cb = a.centre[la], b.centre[lb]
    step = max(1, NUMBERS // len(cb))
    far = b.radius[lb].max()
    for i in range(0, len(ca), step):
        near = reach + SLACK + a.radius[la][i : i + step]
        product = a.single[ca[i : i + step]] @ b.single[cb].T
        x, y = np.nonzero(product >= _least(near + far)[:, None])  # by the row's widest bound, then by each pair's
        keep = product[x, y] >= _least(near[x] + b.radius[lb][y])
        x, y = x[keep] + i, y[keep]
        del product
        if same:
            x, y = x[x <= y], y[x <= y]
        yield from _below(a, b, same, reach, la, lb, x, y)


def _least(near: np.ndarray) -> np.ndarray:
    """The cosine, less rounding, that unit vectors of at most these distances have."""
    return (1 - np.minimum(near, 2) ** 2 / 2 - 1e-6).astype(np.float32)


def _rows(dim: int) -> int:
    """Pairs of vectors that are compared at once."""
    return max(1, NUMBERS // (2 * max(1, dim)))


def _below(a: CoverTree, b: CoverTree, same: bool, reach: float, la: int, lb: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors below pairs of nodes. Lists of more than PAIRS pairs of children are halved before they are made."""
    step = _rows(a.vectors.shape[1])
    todo = [(la, lb, x, y, False)]
    while todo:
        la, lb, x, y, checked = todo.pop()
        if not checked and len(x):
            ca, cb = a.centre[la], b.centre[lb]
            d = np.empty(len(x))
            for i in range(0, len(x), step):
                s = slice(i, i + step)
                d[s] = np.linalg.norm(a.vectors[ca[x[s]]] - b.vectors[cb[y[s]]], axis=1)
            keep = d <= reach + a.radius[la][x] + b.radius[lb][y] + SLACK
            x, y = x[keep], y[keep]
        if not len(x):
            continue
        if la == len(a.centre) - 1 and lb == len(b.centre) - 1:
            x, y = a.leaf[x], b.leaf[y]
            if same:
                x, y = np.minimum(x, y), np.maximum(x, y)
                x, y = x[x < y], y[x < y]
            yield x, y
            continue
        (order_a, cut_a), (order_b, cut_b) = a.children(la), b.children(lb)
        n_a, n_b = cut_a[x + 1] - cut_a[x], cut_b[y + 1] - cut_b[y]
        made = n_a * n_b
        if made.sum() > PAIRS and len(x) > 1:
            half = len(x) // 2
            todo += [(la, lb, x[:half], y[:half], True), (la, lb, x[half:], y[half:], True)]
            continue
        # a single pair of nodes may still have more: some children of the one with all of the other
        some = max(1, PAIRS // int(n_b[0])) if len(x) == 1 else None
        ka, kb = min(la + 1, len(a.centre) - 1), min(lb + 1, len(b.centre) - 1)
        for i in range(0, int(n_a[0]) if some else 1, some or 1):
            if some:
                of_a, of_b = order_a[cut_a[x[0]] : cut_a[x[0] + 1]][i : i + some], order_b[cut_b[y[0]] : cut_b[y[0] + 1]]
                u, v = np.repeat(of_a, len(of_b)), np.tile(of_b, len(of_a))
            else:
                nth = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
                width = np.repeat(n_b, made)
                u, v = order_a[np.repeat(cut_a[x], made) + nth // width], order_b[np.repeat(cut_b[y], made) + nth % width]
            if same and ka > la:  # a node's pairs with itself give each pair of children twice
                keep = (a.parent[ka][u] != a.parent[ka][v]) | (u <= v)
                u, v = u[keep], v[keep]
            if some and i:
                yield from _below(a, b, same, reach, ka, kb, u, v)
            else:
                todo.append((ka, kb, u, v, False))


@dataclass
class Block:
    ids: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    tree: CoverTree
    #: Its cell and the cell's radius.
    cell: int = 0
    far: float = 2.0

    @classmethod
    def of(cls, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, cell: int = 0, far: float = 2.0) -> Block:
        return cls(ids, copies, vectors, CoverTree(vectors / np.linalg.norm(vectors, axis=1)[:, None]), cell, far)

    def pieces(self) -> list[bytes]:
        """The block as texts of PIECE_BYTES; components that single precision holds take four bytes."""
        with np.errstate(over="ignore"):
            single = self.vectors.astype(np.float32)
        vectors = single if (single == self.vectors).all() else self.vectors
        whole = pickle.dumps((self.ids, self.copies, vectors, self.tree.packed(), self.cell, self.far))
        return [whole[i : i + PIECE_BYTES] for i in range(0, len(whole), PIECE_BYTES)]

    @classmethod
    def whole(cls, pieces: list[bytes]) -> Block:
        ids, copies, vectors, levels, cell, far = pickle.loads(b"".join(pieces))
        vectors = vectors.astype(np.float64)
        return cls(ids, copies, vectors, CoverTree.unpacked(vectors / np.linalg.norm(vectors, axis=1)[:, None], levels), cell, far)


class Forest:
    """Which of n vectors links have joined."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that join what wasn't."""
        if not len(x):
            return []
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        new = self.parent[x] != self.parent[y]
        changed: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := changed.get(i, i)) != i:
                changed[i] = changed.get(up, up)
                i = up
            return i

        out = []
        for p, q, i, j in zip(x[new].tolist(), y[new].tolist(), self.parent[x[new]].tolist(), self.parent[y[new]].tolist()):
            i, j = root(i), root(j)
            if i != j:
                changed[j] = i
                out.append((p, q))
        if changed:
            self.parent[list(changed)] = list(changed.values())
        return out


def tile_links(left: list[list[bytes]], right: list[list[bytes]] | None, cosine: float, apart: Callable[[Block, Block], bool] = lambda a, b: False):
    """Links of all pairs of blocks of one tile (right is None) or of two: (ids, sums of links) by vector and spanning
    pairs. The left tile's blocks are held, the right one's come one after the other."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    held = [Block.whole(p) for p in left]
    ids = [b.ids for b in held]
    begin = np.cumsum([0, *map(len, ids)]).tolist()
    span, links = [], [np.zeros(len(x), np.int64) for x in ids]
    joins = None
    for n in range(len(held) if right is None else len(right)):
        two = held[n] if right is None else Block.whole(right[n])
        if right is not None:
            ids.append(two.ids)
            begin.append(begin[-1] + len(two.ids))
            links.append(np.zeros(len(two.ids), np.int64))
        at = n if right is None else len(held) + n
        if joins is None or len(joins.parent) < begin[-1]:
            more = Forest(begin[-1])
            if joins is not None:
                more.parent[: len(joins.parent)] = joins.parent
            joins = more
        norm_two = np.linalg.norm(two.vectors, axis=1)
        for m in range(n + 1 if right is None else len(held)):
            one = held[m]
            if apart(one, two):
                continue
            norm_one = np.linalg.norm(one.vectors, axis=1)
            for x, y in dual_pairs(one.tree, two.tree, right is None and m == n, reach):
                step = _rows(one.vectors.shape[1])
                exact = np.zeros(len(x), bool)
                for i in range(0, len(x), step):
                    p, q = x[i : i + step], y[i : i + step]
                    exact[i : i + step] = (one.vectors[p] * two.vectors[q]).sum(1) >= cosine * norm_one[p] * norm_two[q]
                x, y = x[exact], y[exact]
                np.add.at(links[m], x, two.copies[y])
                np.add.at(links[at], y, one.copies[x])
                span += joins.join(begin[m] + x, begin[at] + y)
    all_ids = np.concatenate(ids)
    return all_ids, np.concatenate(links), [(int(all_ids[p]), int(all_ids[q])) for p, q in span]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
    rows without an id, link with nothing; vectors of different lengths don't link; rows that repeat
    an id count as vectors of their own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    part = usable("embedding") & F.col("vec_id").isNotNull()
    classes = scratch.table(slim.where(part).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")))
    # ids of classes must be their own: those that one id has several vectors of are told apart by the vector's hash
    named_classes = classes.withColumn("node", F.when(F.count("*").over(Window.partitionBy("id")) == 1, F.col("id")).otherwise(F.xxhash64("id", F.col("embedding").cast("string"))))
    merged, classes = classes, scratch.table(named_classes)
    scratch.drop(merged)
    n = classes.count()
    n_pivots = int(min(PIVOTS, max(1, n // PART_ROWS)))
    drawn = classes.orderBy(F.xxhash64("node"), "node").limit(n_pivots).select("embedding").collect()
    by_dim: dict[int, np.ndarray] = {}
    for row in drawn:
        v = np.array(row[0])
        by_dim[len(v)] = np.vstack([by_dim.get(len(v), np.zeros((0, len(v)))), v[None] / np.linalg.norm(v)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            dims = batch.column("dim").to_numpy()
            cells, far = np.zeros(len(dims), np.int32), np.full(len(dims), 2.0)
            for dim in set(dims.tolist()) & set(by_dim):
                at = np.flatnonzero(dims == dim)
                u = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                u = u / np.linalg.norm(u, axis=1)[:, None]
                cells[at] = (u @ by_dim[dim].T).argmax(1)
                far[at] = np.linalg.norm(u - by_dim[dim][cells[at]], axis=1)
            yield pa.record_batch([*[batch.column(c) for c in ("node", "copies", "dim", "embedding")], pa.array(cells, pa.int32()), pa.array(far, pa.float64())], ["node", "copies", "dim", "embedding", "cell", "far"])

    placed = scratch.table(classes.select("node", "copies", "dim", "embedding").mapInArrow(lean(assign), "node long, copies long, dim int, embedding array<double>, cell int, far double"))
    # one row a cell: at most PIVOTS for each length of vectors that pivots have, one for each other length
    cells = placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") * F.greatest("dim", F.lit(PART_DIM)) / (PART_ROWS * PART_DIM)).cast("int"))
    # blocks are a cell's parts, numbered through the cells of a length
    ahead = Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.table(cells.withColumn("first", F.coalesce(F.sum("parts").over(ahead), F.lit(0)).cast("int")).withColumn("blocks", F.sum("parts").over(Window.partitionBy("dim")).cast("int")))
    most = cells.agg(F.max("blocks")).first()[0] or 0
    tile = max(1, min(TILE_BLOCKS, most // TILE_BLOCKS))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    pivot_rows = [(d, i, j, float(np.linalg.norm(p[i] - p[j]))) for d, p in by_dim.items() for i in range(len(p)) for j in range(i, len(p))]
    apart = spark.createDataFrame(pivot_rows, "dim int, c1 int, c2 int, apart double") if pivot_rows else spark.createDataFrame([], "dim int, c1 int, c2 int, apart double")
    own_tiles = F.sequence(F.floor(F.col("first") / tile), F.floor((F.col("first") + F.col("parts") - 1) / tile))
    one = lambda i: cells.select("dim", F.col("cell").alias(f"c{i}"), F.col("radius").alias(f"r{i}"), own_tiles.alias(f"tiles{i}"), F.ceil(F.col("blocks") / tile).alias(f"all{i}"))
    pairs = one(1).join(one(2), "dim").where("c1 <= c2").join(F.broadcast(apart), ["dim", "c1", "c2"], "left")
    pairs = pairs.where(F.col("apart").isNull() | (F.col("apart") <= reach + F.col("r1") + F.col("r2") + SLACK))
    pairs = pairs.withColumn("t1", F.explode("tiles1")).withColumn("t2", F.explode("tiles2")).where("t1 <= t2").select("dim", "t1", "t2", "all1").distinct()
    # in round r a tile meets the r-th ones after and before it
    pairs = scratch.table(pairs.select("dim", "t1", "t2", F.least(F.col("t2") - F.col("t1"), F.col("all1") - F.col("t2") + F.col("t1")).alias("round")))
    own = placed.join(F.broadcast(cells.select("dim", "cell", "parts", "radius", "first")), ["dim", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    own = own.select("dim", "cell", "radius", "block", "node", "copies", "embedding", F.concat_ws(",", "dim", "block").alias("k"))

    def plant(group: pa.Table) -> dict[str, list]:
        ids, copies, dim, block = group.column("node").to_numpy(), group.column("copies").to_numpy(), group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        vectors = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        pieces = Block.of(ids, copies, vectors, group.column("cell")[0].as_py(), group.column("radius")[0].as_py()).pieces()
        return {"dim": [dim] * len(pieces), "tile": [block // tile] * len(pieces), "block": [block] * len(pieces), "piece": list(range(len(pieces))), "bytes": pieces}

    blocks = scratch.table(by_runs(own, "k", plant, "dim int, tile long, block int, piece int, bytes binary"))
    size = blocks.agg(F.sum(F.length("bytes"))).first()[0] or 0
    scratch.drop(placed)

    def cells_apart(a: Block, b: Block) -> bool:
        pivots = by_dim.get(a.vectors.shape[1])
        return pivots is not None and float(np.linalg.norm(pivots[a.cell] - pivots[b.cell])) > reach + a.far + b.far + SLACK

    def work(group: pa.Table) -> dict[str, list]:
        tiles: dict[int, dict[int, list]] = {}
        for t, b, piece, own_bytes in zip(*[group.column(c).to_pylist() for c in ("tile", "block", "piece", "bytes")]):
            tiles.setdefault(t, {}).setdefault(b, []).append((piece, own_bytes))
        two = [[[x for _, x in sorted(p)] for _, p in sorted(t.items())] for _, t in sorted(tiles.items())]
        if len(two) == 1 and not group.column("same")[0].as_py():  # the other tile is empty
            return {"a": [], "b": [], "n": []}
        ids, links, span = tile_links(two[0], two[1] if len(two) > 1 else None, cosine, cells_apart)
        hit = np.flatnonzero(links)
        return {"a": ids[hit].tolist() + [p for p, _ in span], "b": [None] * len(hit) + [q for _, q in span], "n": links[hit].tolist() + [None] * len(span)}

    # a round after the other, or several if they are small
    per_round = sorted((r["round"], r["count"]) for r in pairs.groupBy("round").count().collect())
    tile_bytes = max(1, size * tile // max(1, most))
    found_in, i = [], 0
    while i < len(per_round):
        end, n_pairs = i + 1, per_round[i][1]
        while end < len(per_round) and 2 * (n_pairs + per_round[end][1]) * tile_bytes <= ROUND_BYTES:
            n_pairs += per_round[end][1]
            end += 1
        now = pairs.where(F.col("round").between(per_round[i][0], per_round[end - 1][0])).withColumn("k", F.concat_ws(",", "dim", "t1", "t2")).withColumn("same", F.col("t1") == F.col("t2"))
        sides = now.select("k", "same", "dim", F.explode(F.array_distinct(F.array("t1", "t2"))).alias("tile"))
        dealt = blocks.join(small(sides, 2 * n_pairs), ["dim", "tile"]).select("k", "same", "tile", "block", "piece", "bytes")
        found_in.append(scratch.table(by_runs(dealt, "k", work, FOUND, min(n_pairs, ROUND_TASKS))))
        i = end
    found = spark.read.schema(FOUND).parquet(*[scratch.paths[id(x)] for x in found_in]) if found_in else spark.createDataFrame([], FOUND)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    components = connected_components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    # a component's id is its smallest vec_id, which need not be its smallest node
    named = classes.select("node", "id", "embedding", "copies").join(components.select(F.col("id").alias("node"), "component"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(lowest, "component").join(counts, "node", "left")
    named = scratch.table(named.select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    scratch.drop(cells, pairs, blocks, *found_in, components)
    key = F.when(part, F.col("embedding"))
    out = slim.select("vec_id", key.alias("embedding")).join(named, "embedding", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
