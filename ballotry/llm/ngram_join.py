"""N-gram Jaccard join: components of documents whose n-gram sets are similar.

Rows of the document by n-gram incidence matrix are sets of 64-bit n-gram hashes. The similarity
join is the product of that matrix with its transpose, worked in blocks, in which overlap counts of
row pairs are summed up and pairs that their sizes rule out are dropped:

1. Equal rows are collapsed to classes; only one row of a class goes on.
2. Rows by size bound. A row that links shares at least ``percent`` of its columns, so under any one
   order of all columns the first few of both rows have columns in common, and the number of these
   follows from the sizes. Only the first columns by hash are shuffled; a row too few of whose first
   columns stand in any other row can't link and is dropped.
3. Columns. Of the rows that remain all columns are counted; those of one row only add nothing to
   any overlap and are dropped, and so are rows with too few others left.
4. Candidates share one of the first columns in order of rising frequency. In each such column one
   row is multiplied with the others, in blocks; rows that are found linked are contracted, and
   after ``STARS`` rounds the columns in which rows are still apart are multiplied in full, by pairs
   of row blocks. Each task sums overlaps over ranges of columns, drops pairs that can no longer
   reach their bound, and returns a spanning set of its links, never all pairs.
5. Components of these links, joined back to all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_runs, connected_components, lean, small
from .shingles import mix, ngram_sets, pieces, text_buffer

#: Share of a row's columns that are shuffled beyond the fewest that the bound allows: more of them drop more rows.
EXTRA = 0.1
#: Rows of a block in the product, and columns of its rows in sum.
BLOCK_ROWS, BLOCK_ENTRIES = 400, 400_000
#: Columns that are multiplied at once.
BLOCK_COLUMNS = 4096
#: Rounds in which one row of each column is multiplied with the others.
STARS = 3
#: Rows of the sample that tells frequent columns, the share of it that makes one, and how many are kept at most.
SAMPLE_ROWS, FREQUENT_SHARE, FREQUENT = 20_000, 0.001, 50_000
#: Classes whose first columns a task remembers having given.
SEEN = 200_000
#: Frequencies from here on count as equal.
LONG_RUN = 1_000


def needed_overlap(a, b, percent: int):
    """Least overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -((-(np.asarray(a) + b) * percent) // (100 + percent))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of size n with any set that it links to; also the least size of such a set."""
    return -((-n * percent) // 100)


def _common(n: np.ndarray, percent: int) -> np.ndarray:
    """Columns that the first columns of a set of size n should share, as far as its own size tells."""
    return np.minimum(1 + np.floor(EXTRA * n).astype(np.int64), least_overlap(n, percent))


def first_columns(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(count of first columns, how many of them are shared at least with any set that links).

    Of sets a and b at most a - overlap columns of a aren't shared, so the k-th shared column is among
    the first a - overlap + k of a, and of b likewise; b may be as small as the least overlap.
    """
    low = least_overlap(n, percent)
    return n - low + _common(n, percent), _common(low, percent)


def _describe(width: int, percent: int):
    """Task: (doc_id, version, text) to (doc_id, version, n, h1, h2, first): the hashes of the n-gram set, and
    the first columns by hash, unless this task has given those of an equal set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in pieces(whole, "text"):
                flat, at = ngram_sets(*text_buffer(batch.column("text")), width)
                n = np.diff(at)
                sums = []
                for seed in (0x51ED270B, 0x3C79AC49):
                    with np.errstate(over="ignore"):
                        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(seed)), dtype=np.uint64)))
                        sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                take, _ = first_columns(n, percent)
                first: list[np.ndarray | None] = []
                for i, h in enumerate(sums[0].tolist()):
                    first.append(None if h in seen or not n[i] else flat[at[i] : at[i] + take[i]].view(np.int64))
                    if len(seen) < SEEN:
                        seen.add(h)
                lists = pa.array(first, pa.list_(pa.int64()))
                yield pa.record_batch([batch.column("doc_id"), batch.column("version"), pa.array(n), *map(pa.array, sums), lists], ["doc_id", "version", "n", "h1", "h2", "first"])

    return each


def _runs_of_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (gram, h1) sorted by both to the distinct entries of grams that have two or more h1, with f, the
    number of these, LONG_RUN at most. Up to LONG_RUN entries are held, however often a gram occurs."""
    g, h = np.zeros(0, np.int64), np.zeros(0, np.int64)
    long = False  # whether the held entry's run is a long one, given up to here
    for batch in batches:
        if not batch.num_rows:
            continue
        n_held = len(g) if long else 0
        g, h = np.concatenate((g, batch.column("gram").to_numpy())), np.concatenate((h, batch.column("h1").to_numpy()))
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])))
        g, h = g[new], h[new]
        begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(begin, len(g)))
        f = np.minimum(size, LONG_RUN)
        if n_held:
            f[0] = LONG_RUN
        last = f[-1] == LONG_RUN  # else the last run waits for the next batch
        give = np.repeat(f > 1, size)
        give[:n_held] = False
        if not last:
            give[begin[-1] :] = False
        yield pa.record_batch([pa.array(g[give]), pa.array(h[give]), pa.array(np.repeat(f, size)[give].astype(np.int32))], ["gram", "h1", "f"])
        long = bool(last)
        keep = len(g) - 1 if long else begin[-1]
        g, h = g[keep:], h[keep:]
    if not long and len(g) > 1:
        yield pa.record_batch([pa.array(g), pa.array(h), pa.array(np.full(len(g), len(g), np.int32))], ["gram", "h1", "f"])


def shared_columns(rows: DataFrame, n_rows: int) -> DataFrame:
    """(gram, h1, f) of rows (h1, grams): the entries whose gram other rows have, too, and how often, LONG_RUN at most.

    One shuffle by gram. Grams that a bounded sample of rows shows to be frequent need no count and stay where
    they are, so no task gets all rows of a hot one.
    """
    every = max(1, n_rows // SAMPLE_ROWS)
    least = max(8, int(FREQUENT_SHARE * min(n_rows, SAMPLE_ROWS)))
    sample = rows.where(F.pmod(F.xxhash64("h1"), F.lit(every)) == 0).dropDuplicates(["h1"])
    seen = sample.select(F.explode("grams").alias("gram")).groupBy("gram").count().where(F.col("count") >= least)
    often = [r["gram"] for r in seen.orderBy(F.desc("count"), "gram").limit(FREQUENT).collect()]
    entries = rows.select(F.explode("grams").alias("gram"), "h1")
    schema = "gram long, h1 long, f int"
    if not often:
        return entries.repartition("gram").sortWithinPartitions("gram", "h1").mapInArrow(lean(_runs_of_columns), schema)
    known = F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in often], "gram long"))  # FREQUENT numbers at most
    rare = entries.join(known, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "h1")
    hot = entries.join(known, "gram", "left_semi").select("gram", "h1", F.lit(LONG_RUN).alias("f"))
    return rare.mapInArrow(lean(_runs_of_columns), schema).unionByName(hot)


def _sets(width: int):
    """Task: (doc_id, h1, text) to the row's n-gram hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                flat, at = ngram_sets(*text_buffer(batch.column("text")), width)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.record_batch([batch.column("h1"), lists], ["h1", "grams"])

    return each


def product_links(ids: np.ndarray, n: np.ndarray, rows: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links between rows of the left and the right block (masks; the same block twice if equal).

    ``n`` are the rows' whole sizes; the rows themselves may lack columns that no other row has. Rows of
    equal labels are known to be connected and aren't compared.
    """
    m = len(rows)
    if m < 2:
        return []
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    own = np.array([len(r) for r in rows])
    need = needed_overlap(n[a][:, None], n[b][None, :], percent)
    alive = (np.minimum(own[a][:, None], own[b][None, :]) >= need) & (ids[a][:, None] != ids[b][None, :])
    if label is not None:
        alive &= label[a][:, None] != label[b][None, :]
    if not alive.any():
        return []
    columns, where, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    rank = np.empty(len(columns), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(columns))  # rare columns first: they part most pairs
    owner = np.repeat(np.arange(m), own)
    keep = count[where] > 1
    col, owner = rank[where[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    place = np.full(m, -1)
    place[b] = np.arange(len(b))
    overlap = np.zeros(need.shape, np.int64)
    rest = np.bincount(owner, minlength=m)
    first = int(col[0]) if len(col) else 0
    for start in range(first, len(columns), BLOCK_COLUMNS):
        lo, hi = np.searchsorted(col, (start, start + BLOCK_COLUMNS))
        block_col, block_owner = col[lo:hi], owner[lo:hi]
        # the right rows of each column, end to end, and the columns of each left row
        is_right = place[block_owner] >= 0
        right_row, begin = place[block_owner[is_right]], np.searchsorted(block_col[is_right], np.arange(start, start + BLOCK_COLUMNS + 1))
        by_row = np.argsort(block_owner, kind="stable")
        row_col, row_at = block_col[by_row] - start, np.searchsorted(block_owner[by_row], np.arange(m + 1))
        for i in np.flatnonzero(alive.any(1)):
            mine = row_col[row_at[a[i]] : row_at[a[i] + 1]]
            size = begin[mine + 1] - begin[mine]
            end = np.cumsum(size)
            if len(end) and end[-1]:
                pick = np.arange(end[-1]) + np.repeat(begin[mine] - (end - size), size)
                overlap[i] += np.bincount(right_row[pick], minlength=len(b))
        rest = rest - np.bincount(block_owner, minlength=m)
        alive &= overlap + np.minimum(rest[a][:, None], rest[b][None, :]) >= need
        if not alive.any():
            return []
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(alive & (overlap >= need))):
        x, y = root(int(a[i])), root(int(b[j]))
        if x != y:
            parent[y] = x
            out.append((int(ids[a[i]]), int(ids[b[j]])))
    return out


def _products(keyed: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the blocks; keyed: (k, h1, side, label), side 1 in the left block, 2 in the right
    one, 3 in both; matrix: (h1, n, grams). Rows of one k make one task's product."""

    def product(group: pa.Table) -> dict[str, list]:
        ids, n, side, label = (group.column(c).to_numpy() for c in ("h1", "n", "side", "label"))
        sets = [np.asarray(x.values) for x in group.column("grams")]
        found = product_links(ids, n, sets, side & 1 > 0, side & 2 > 0, percent, label)
        return {"u": [x for x, _ in found], "v": [y for _, y in found]}

    return by_runs(keyed.join(matrix, "h1").select("k", "h1", "side", "label", "n", "grams"), "k", product, "u long, v long")


def _parts(rows: Column, entries: Column) -> Column:
    """Blocks that so many rows are cut in."""
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(entries / BLOCK_ENTRIES)).cast("int")


def _part(of: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(F.col(of)), F.col(parts)).cast("int")


def _star_products(stars: DataFrame, matrix: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links among stars (hub, v, hub_label, label): blocks of the hub and some of its v."""
    load = stars.join(sizes.withColumnRenamed("h1", "v"), "v").groupBy("hub", "hub_label").agg(_parts(F.count("*"), F.sum("n")).alias("parts"))
    key = F.xxhash64("hub", "part").alias("k")
    rays = stars.join(load.drop("hub_label"), "hub").select(F.col("v").alias("h1"), "hub", _part("v", "parts").alias("part"), F.lit(2).alias("side"), "label")
    hubs = load.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub_label").alias("label"))
    hubs = hubs.select(F.col("hub").alias("h1"), "hub", "part", F.lit(1).alias("side"), "label")
    return _products(rays.unionByName(hubs).select(key, "h1", "side", "label"), matrix, percent)


def _full_products(apart: DataFrame, matrix: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links inside columns: apart (gram, h1, label), cut in row blocks; each pair of blocks is a task's product."""
    load = apart.join(sizes, "h1").groupBy("gram").agg(_parts(F.count("*"), F.sum("n")).alias("parts"))
    placed = apart.join(load, "gram").withColumn("part", _part("h1", "parts"))
    part = F.col("part")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(part, q).alias("p"), F.greatest(part, q).alias("q"), F.when(part == q, 3).when(part < q, 1).otherwise(2).alias("side")))
    dealt = placed.select("gram", "h1", "label", F.explode(pairs).alias("e"))
    return _products(dealt.select(F.xxhash64("gram", "e.p", "e.q").alias("k"), "h1", "e.side", "label"), matrix, percent)


def _links(matrix: DataFrame, heads: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (u, v) that connect what the matrix (h1, n, grams) links; heads: (gram, h1), the first columns of each row."""
    sizes = matrix.select("h1", "n")
    # columns that hold the same rows are one: sums of two hashes tell
    held = heads.groupBy("gram").agg(F.sum(F.xxhash64("h1").cast("decimal(20,0)")).alias("s"), F.count("*").alias("m"), F.min("h1").alias("low"))
    once = held.where("m > 1").groupBy("s", "m", "low").agg(F.min("gram").alias("gram")).select("gram")
    heads = scratch.table(heads.join(once, "gram", "left_semi"))
    placed = heads.withColumn("label", F.col("h1"))
    none = scratch.spark.createDataFrame([], "u long, v long")
    links, tried = none, none.toDF("hub", "v")
    for turn in range(STARS):
        best = F.min(F.struct(F.xxhash64("label", F.lit(turn)), "label", "h1")).alias("best")
        hubs = placed.groupBy("gram").agg(best, F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
        hubs = hubs.select("gram", F.col("best.h1").alias("hub"), F.col("best.label").alias("hub_label"))
        stars = placed.join(hubs, "gram").where("label <> hub_label").select("hub", F.col("h1").alias("v"), "hub_label", "label").distinct()
        stars = scratch.table(stars.join(tried, ["hub", "v"], "left_anti"))
        if stars.take(1):
            links = links.unionByName(scratch.table(_star_products(stars, matrix, sizes, percent)))
            tried = tried.unionByName(stars.select("hub", "v")).unionByName(stars.select(F.col("v").alias("hub"), F.col("hub").alias("v")))
            known = scratch.table(connected_components(links, scratch))
            found = small(known.withColumnRenamed("id", "h1"), known.count())
            placed = scratch.table(heads.join(found, "h1", "left").select("gram", "h1", F.coalesce("component", "h1").alias("label")))
    # two rows of one column have been compared; of more some haven't
    mixed = placed.groupBy("gram").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m")).where("a < b and m > 2").select("gram")
    apart = scratch.table(placed.join(mixed, "gram", "left_semi"))
    if apart.take(1):
        links = links.unionByName(scratch.table(_full_products(apart, matrix, sizes, percent)))
    return links


def _survivors(rows: DataFrame, classes: DataFrame, scratch: Scratch, n_rows: int, percent: int) -> DataFrame:
    """(h1, n, rep) of the classes enough of whose first columns stand in another class."""
    given = rows.where("first is not null").select("h1", F.col("first").alias("grams"))
    counts = shared_columns(given, n_rows).groupBy("h1").agg(F.count("*").alias("shared"))
    low = lambda c: F.ceil(c * percent / 100)
    least = low(F.col("n"))
    need = F.least(1 + F.floor(least * EXTRA), low(least))
    return scratch.table(counts.join(classes, "h1").where(F.col("shared") >= need).select("h1", "n", "rep"))


def _grouped(docs: DataFrame, width: int, percent: int, tie: bool, scratch: Scratch) -> DataFrame:
    """(doc_id, version, n_shingles, grp, least) of every row of docs: grp tells the rows of one component, least
    is its smallest doc_id; both are null for rows that are alone. ``version`` is a hash of the text."""
    version = F.xxhash64("text").alias("version")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version, "text")
    rows = scratch.table(slim.mapInArrow(lean(_describe(width, percent)), "doc_id long, version long, n long, h1 long, h2 long, first array<long>"))
    known = rows.where("n > 0 and doc_id is not null")
    one = F.min(F.struct("doc_id", "version")).alias("rep")
    classes = scratch.table(known.groupBy("h1", "h2", "n").agg(one, F.count("*").alias("copies")))
    kept = _survivors(known, classes, scratch, rows.count(), percent)
    wanted = kept.select("h1", "rep.doc_id", "rep.version")
    n_kept = kept.count()
    texts = slim.join(small(wanted, n_kept), ["doc_id", "version"]).select("h1", "text")
    # a column of one row adds to no overlap; rows that have too few others can't link
    whole = scratch.table(texts.mapInArrow(lean(_sets(width)), "h1 long, grams array<long>"))
    sets = shared_columns(whole, n_kept).groupBy("h1").agg(F.sort_array(F.collect_set(F.struct("f", "gram"))).alias("own"))
    least = F.ceil(F.col("n") * percent / 100)
    full = sets.join(kept.select("h1", "n"), "h1").where(F.size("own") >= least)
    matrix = scratch.table(full.select("h1", "n", F.col("own.gram").alias("grams"), (F.size("own") - least + 1).cast("int").alias("head")))
    scratch.drop(whole, kept)
    heads = matrix.select(F.explode(F.slice("grams", F.lit(1), F.col("head"))).alias("gram"), "h1")
    links = _links(matrix.select("h1", "n", "grams"), heads, scratch, percent)
    if tie:  # an id that repeats with other texts belongs to several classes, which it ties together
        again = known.groupBy("doc_id").agg(F.min("h1").alias("u"), F.max("h1").alias("w")).where("u < w").select("doc_id", "u")
        links = links.unionByName(known.join(again, "doc_id").where("h1 <> u").select("u", F.col("h1").alias("v")))
    components = scratch.table(connected_components(links, scratch))
    n_components = components.count()
    found = classes.join(small(components.withColumnRenamed("id", "h1"), n_components), "h1", "left").where("copies > 1 or component is not null")
    found = found.withColumn("grp", F.coalesce("component", "h1"))
    smallest = found.groupBy("grp").agg(F.min("rep.doc_id").alias("least"))
    by_class = scratch.table(found.join(smallest, "grp").select("h1", "h2", "n", "grp", "least"))
    scratch.drop(classes, components, matrix)
    # null ids and empty rows match no class: their n is hidden from the join
    key = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("n"))
    out = rows.select("doc_id", "version", F.col("n").alias("n_shingles"), "h1", "h2", key.alias("n")).join(by_class, ["h1", "h2", "n"], "left")
    return out.select("doc_id", "version", "n_shingles", "grp", "least")


def ngram_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of docs (doc_id, text).

    Documents link if 100 * intersection >= percent * union of their distinct word n-grams; a
    component's id is its smallest doc_id. Defined results: null or wordless texts have no n-grams
    and link with nothing; a null doc_id links with nothing and its component is null; rows that
    repeat an id are each returned, with the id's component; an empty table gives no rows.
    N-grams are told by 64-bit hashes, equal sets by 128-bit ones.
    """
    got = _grouped(docs, width, percent, True, Scratch(docs.sparkSession))
    return got.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_component(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component, the one of the smallest doc_id.

    Defined results: rows without words or without an id link with nothing and stay, also where others have
    their id; rows of one id with unlike texts are different documents; of wholly repeated rows one stays.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(_grouped(docs, width, percent, False, scratch).where("grp is not null").select("doc_id", "version", "grp"))
    best = found.groupBy("grp").agg(F.min(F.struct("doc_id", "version")).alias("best"))
    lose = scratch.table(found.join(best, "grp").where(F.struct("doc_id", "version") != F.col("best")).select("doc_id", "version").distinct())
    named = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__version", F.xxhash64("text"))
    match = lambda df: small(df.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")), df.count())
    kept = named.join(match(lose), ["__id", "__version"], "left_anti")
    twice = scratch.table(found.groupBy("doc_id", "version").count().where("count > 1").select("doc_id", "version"))
    if twice.take(1):
        others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
        first = kept.join(match(twice), ["__id", "__version"], "left_semi")
        first = first.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__version").orderBy(*others, F.lit(0)))).where("__n = 1").drop("__n")
        kept = kept.join(match(twice), ["__id", "__version"], "left_anti").unionByName(first)
    return kept.select(*docs.columns)
