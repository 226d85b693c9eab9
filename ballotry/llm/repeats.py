"""Repeated substrings by a hash-compared suffix sort of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting every
suffix of a corpus would shuffle many times its size, so suffixes are sampled first, exactly:

* The windows of ``length`` bytes of a text are cut in ranges of starts that share their smallest
  hashed k-gram. Equal windows share it too, so a range whose k-gram occurs once holds no repeat,
  and a range whose whole span occurs twice holds nothing else. Hashes are counted only to choose
  what is sorted: the count pre-aggregates before its shuffle, so hot passages cost no more.
* Spans that seem to occur twice are sorted as suffixes at the ranges' first starts, in buckets of a
  bounded number of copies, and each must agree byte for byte with a neighbour. Where one doesn't,
  its hash had collided: its key gets another hash and the cut is decided again.
* The rest, around the ends of repeated passages, is cut again with longer k-grams, and of what then
  remains every suffix is sorted, in buckets of one k-gram; buckets of very many contexts are cut by
  whole windows, which are sorted as spans like all others.

The sort is a mergesort whose comparisons find common extensions by binary search over prefix
polynomial hashes; nothing is removed that wasn't verified on its bytes there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, lean, text_or_empty
from .shingles import _M1, _power_table, mix, pieces, text_buffer

#: Bytes of the k-grams that sample the windows, as parts of their length, and of those that cut the rest.
SAMPLE_PART = 0.25
CUT_LESS = 30
#: Contexts of one k-gram up to which all their suffixes are sorted in one task; larger buckets are cut by windows.
BUCKET_CONTEXTS = 2_000
#: Copies of one span that are sorted together; more are dealt to several buckets.
BUCKET_COPIES = 1_000
#: Bytes of contexts that are sorted at once.
SORT_BYTES = 1 << 19


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums of byte times power: the polynomial hash of any substring is one difference away."""
    power, _ = _power_table(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings, the same wherever they stand."""
    _, inverse = _power_table(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def window_ranges(prefix: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text index, first start, last start, k-gram hash) of the ranges of window starts whose first
    smallest k-gram stands at the same place; texts end at offsets and windows don't cross them."""
    n, width = len(prefix) - 1, length - k + 1
    n_starts = n - length + 1
    none = np.zeros(0, np.int64)
    if n_starts <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    _, inverse = _power_table(n + 1)
    with np.errstate(over="ignore"):
        h = (prefix[k:] - prefix[:-k]) * inverse[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= _M1
        h ^= h >> np.uint64(29)
    if width > 1:
        m = -(-len(h) // width) * width
        padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = h
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        low = np.minimum(behind[:n_starts], ahead[width - 1 : width - 1 + n_starts])
    else:
        low = h[:n_starts]
    size = np.diff(offsets)
    begins = np.zeros(n_starts + 1, bool)
    begins[0] = True
    begins[1:-1] = (low[1:] != low[:-1]) | (h[: n_starts - 1] == low[:-1])  # the next window's is another one
    edge = offsets[:-1][size > 0]
    begins[edge[edge < n_starts]] = True
    stops = offsets[1:][size >= length] - length + 1  # the first start past a text's last window
    begins[stops] = True
    first = np.flatnonzero(begins[:-1])
    last = np.append(first[1:], n_starts) - 1
    text = np.searchsorted(offsets, first, side="right") - 1
    inside = first + length <= offsets[text + 1]
    return text[inside], first[inside], last[inside], low[first[inside]]


# ------------------------------------------------------------------------------- the suffix sort


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Bytes on which the substrings at a and b agree, ``length`` at most: binary search over hashes."""
    _, inverse = _power_table(len(prefix))
    length = np.broadcast_to(np.asarray(length, np.int64), a.shape)

    def agree(n):
        return (prefix[a + n] - prefix[a]) * inverse[a] == (prefix[b + n] - prefix[b]) * inverse[b]

    with np.errstate(over="ignore"):
        whole = agree(length)
        low, high = np.where(whole, length, 0), np.where(whole, length, length - 1)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = agree(mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _not_above(data, prefix, head, a, b, length, or_equal) -> np.ndarray:
    """Whether the suffix at a sorts before the one at b, or is equal where or_equal."""
    out = head[a] < head[b]
    tie = np.flatnonzero(head[a] == head[b])
    if len(tie):
        x, y = a[tie], b[tie]
        most = length[tie]
        n = common_extension(prefix, x, y, most)
        same = n == most
        n = np.minimum(n, most - 1)
        out[tie] = np.where(same, or_equal[tie], data[x + n] < data[y + n])
    return out


def sort_suffixes(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, segment: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Order of the suffixes at ``at`` by segment (already grouped), then by their first ``length`` bytes, which may
    differ between segments.

    A bottom-up mergesort of all segments at once: each suffix finds its rank in the sibling run by
    binary search, and a comparison is a common extension and one byte.
    """
    order = np.arange(len(at))
    if len(at) < 2:
        return order
    length = np.broadcast_to(np.asarray(length, np.int64), at.shape)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    head = np.zeros(len(data), np.uint64)
    for i in range(8):
        head = (head << np.uint64(8)) | padded[i : i + len(data)]
    new = np.concatenate(([True], segment[1:] != segment[:-1]))
    start = np.flatnonzero(new)
    begin = np.repeat(start, np.diff(np.append(start, len(at))))
    end = np.repeat(np.append(start[1:], len(at)), np.diff(np.append(start, len(at))))
    width, longest = 1, int((end - begin).max())
    while width < longest:
        pos = np.flatnonzero(end - begin > width)
        rel = pos - begin[pos]
        run = rel // width
        left = run % 2 == 0
        base = begin[pos] + (run // 2) * 2 * width
        low = np.where(left, base + width, base)
        high = np.minimum(np.where(left, base + 2 * width, base + width), end[pos])
        low = np.minimum(low, high)
        first = low.copy()
        own, most = at[order[pos]], length[order[pos]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            # rank: siblings before the suffix; of equal ones the left run comes first
            less = _not_above(data, prefix, head, at[order[mid]], own[open_], most[open_], ~left[open_])
            low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
        target = base + rel % width + (low - first)
        moved = order.copy()
        moved[target] = order[pos]
        order = moved
        width *= 2
    return order


def repeated_suffixes(data: np.ndarray, at: np.ndarray, segment: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of the suffixes agree on ``length`` bytes (one number a segment) with another one of their segment."""
    prefix = prefix_hashes(data)
    length = np.broadcast_to(np.asarray(length, np.int64), at.shape)
    order = sort_suffixes(data, prefix, at, segment, length)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(segment[a] == segment[b])
    a, b = a[same], b[same]
    near = common_extension(prefix, at[a], at[b], length[a]) == length[a] if len(a) else np.zeros(0, bool)
    a, b = a[near], b[near]
    out = np.zeros(len(at), bool)
    broken = []
    for i in range(0, len(a), 4096):  # equal hashes are verified on the bytes
        x, y = a[i : i + 4096], b[i : i + 4096]
        reach = np.minimum(np.arange(length[x].max()), length[x][:, None] - 1)  # shorter ones repeat their last byte
        equal = (data[at[x][:, None] + reach] == data[at[y][:, None] + reach]).all(1)
        out[x[equal]] = out[y[equal]] = True
        broken += segment[x[~equal]].tolist()
    for g in set(broken):  # a collision may have parted others: this segment by its bytes
        own = np.flatnonzero(segment == g)
        seen: dict[bytes, int] = {}
        for i in own.tolist():
            window = data[at[i] : at[i] + length[i]].tobytes()
            if window in seen:
                out[i] = out[seen[window]] = True
            seen.setdefault(window, i)
    return out


# ------------------------------------------------------------------------------- the Spark job

#: Bytes of a text (or context) buffer that is hashed at once, long texts aside.
PIECE_BYTES = 1 << 18
#: A range of starts as one number: its first start, then how many more it has.
MORE_BITS = 16


def _place(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << MORE_BITS) | (last - first)


def _starts(place):
    """First and last start of a range."""
    return place >> MORE_BITS, (place >> MORE_BITS) + (place & ((1 << MORE_BITS) - 1))


def _ranges_of(length: int, k: int, value: str, keep: list[str], begin: str | None = None):
    """Task: rows with texts (or contexts) to their ranges (keep..., place, g, f)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, value, PIECE_BYTES):
                data, at = text_buffer(batch.column(value))
                prefix = prefix_hashes(data)
                text, a1, a2, g = window_ranges(prefix, at, length, k)
                f = span_hash(prefix, a1, a2 + length)
                pick = pa.array(text)
                shift = (batch.column(begin).to_numpy()[text] if begin else 0) - at[text]
                yield pa.record_batch(
                    [*[batch.column(c).take(pick) for c in keep], pa.array(_place(a1 + shift, a2 + shift)), pa.array(g.view(np.int64)), pa.array(f.view(np.int64))],
                    [*keep, "place", "g", "f"],
                )

    return each


#: Ranges as asked of their texts: claims are spans that seem to occur twice, the others stay undecided.
_ASKED = ["place", "open", "claim", "g", "f", "salt", "contexts"]
_CUT = "r long, place long, open boolean, claim boolean, g long, f long, salt long, contexts long, context binary"
#: Bytes of contexts in one Arrow batch.
CUT_BYTES = 4 << 20


def _cut_out(length: int, value: str, begin: str | None):
    """Task: rows with texts (or contexts) and wanted ranges to one row a range with its bytes."""
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["r", *_ASKED, "context"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, value, PIECE_BYTES):
                rows: list[tuple] = []
                held = 0
                data, at = text_buffer(batch.column(value))
                shift = batch.column(begin).to_pylist() if begin else [0] * batch.num_rows
                for i, (r, wanted) in enumerate(zip(batch.column("r").to_pylist(), batch.column("wanted").to_pylist())):
                    base = int(at[i]) - shift[i]
                    for w in wanted:
                        first, last = _starts(w["place"])
                        context = data[base + first : base + last + length].tobytes()
                        rows.append((r, *[w[c] for c in _ASKED], context))
                        held += len(context)
                        if held >= CUT_BYTES:
                            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

    return each


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str], same) -> Iterator[list[tuple]]:
    """Rows of sorted batches, the context last, in lists of whole groups (by ``same`` of a row) and some bytes."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns]):
            if held >= SORT_BYTES and same(row) != same(rows[-1]):
                yield rows
                rows, held = [], 0
            rows.append(row)
            held += len(row[-1])
    if rows:
        yield rows


_CHECKED = "r long, place long, open boolean, g long, f long, ok boolean"


def _sorted_spans():
    """Task: claims sorted by key, salt and length to (r, place, open, g, f, ok): whether the span's bytes equal those
    of a neighbour in the suffix sort of its bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket(row):
            return row[2], row[3], row[5], len(row[6])

        for rows in _grouped(batches, ["r", "place", "g", "f", "open", "salt", "context"], bucket):
            data = np.frombuffer(b"".join(row[6] for row in rows), np.uint8)
            size = np.array([len(row[6]) for row in rows])
            segment = np.cumsum([0, *[bucket(x) != bucket(y) for x, y in zip(rows, rows[1:])]])
            ok = repeated_suffixes(data, np.cumsum(size) - size, segment, size)
            r, place, g, f, open_, _, _ = zip(*rows)
            long = [pa.array(v, pa.int64()) for v in (r, place, g, f)]
            yield pa.record_batch([*long[:2], pa.array(open_, pa.bool_()), *long[2:], pa.array(ok)], ["r", "place", "open", "g", "f", "ok"])

    return each


def _round(source: DataFrame, value: str, k: int, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One cut of the windows of texts (r, text) or contexts (r, base, open, context) by k-grams: runs (r, place) of
    verified repeats in open ranges, the undecided contexts (r, base, open, g, contexts, context), and the tables that
    both read.

    Undecided are the spans whose k-gram also stands in another span, if any of these is open and occurs once; of
    each span that occurs more often one range goes with them, closed.
    """
    inner = "base" in source.columns
    names = ["r", "base"] if inner else ["r"]
    begin = "base" if inner else None
    keep = [*names, "open"] if inner else names
    kept = ", ".join(f"{c} {'boolean' if c == 'open' else 'long'}" for c in keep)
    ranges = source.mapInArrow(lean(_ranges_of(length, k, value, keep, begin)), f"{kept}, place long, g long, f long")
    ranges = scratch.table(ranges if inner else ranges.withColumn("open", F.lit(True)))
    again = 0
    while True:
        one = F.min(F.struct(*names, "place", "open")).alias("one")
        spans = scratch.table(ranges.groupBy("g", "f").agg(F.count("*").alias("c"), F.max("open").alias("some"), one))
        lone = (F.col("c") == 1) & F.col("one.open")
        groups = spans.groupBy("g").agg(F.count("*").alias("contexts"), F.max(lone).alias("undecided")).where("contexts > 1 and undecided")
        rest = spans.join(groups.drop("undecided"), "g").select(
            *[F.col(f"one.{c}") for c in (*names, "place")], lone.alias("open"), F.lit(False).alias("claim"), "g", "f", F.lit(0).cast("long").alias("salt"), "contexts"
        )
        # copies of one span are dealt to buckets, in each of which they verify each other
        salt = F.pmod(F.xxhash64("r", "place", "f"), F.ceil(F.col("c") / BUCKET_COPIES))
        claims = ranges.join(spans.where("c > 1 and some").select("g", "f", "c"), ["g", "f"]).select(
            *names, "place", "open", F.lit(True).alias("claim"), "g", "f", salt.alias("salt"), F.lit(0).cast("long").alias("contexts")
        )
        # repeated rows ask once; lists are a table, so that shuffles of ranges and spans go before texts are shuffled
        wanted = scratch.table(rest.unionByName(claims).groupBy(*names).agg(F.collect_set(F.struct(*_ASKED)).alias("wanted")))
        scratch.drop(spans)
        # lists grow with the corpus, so texts meet them by a shuffle at every size
        asked = source.select(*names, value).join(wanted, names)
        cut = scratch.table(asked.mapInArrow(lean(_cut_out(length, value, begin)), _CUT))
        scratch.drop(wanted)
        key = ["g", "f", "salt"]
        dealt = cut.where("claim").repartition(*key).sortWithinPartitions(*key, F.octet_length("context"))
        checked = scratch.table(dealt.mapInArrow(lean(_sorted_spans()), _CHECKED))
        broken = checked.where("not ok").select("g", "f").distinct()
        if not broken.take(1):
            break
        # different bytes under one key: these ranges get another hash
        again += 1
        fresh = cut.where("claim").join(broken, ["g", "f"]).select("r", "place", F.xxhash64(F.lit(again), "context").alias("fresh")).distinct()
        before, ranges = ranges, scratch.table(ranges.join(fresh, ["r", "place"], "left").withColumn("f", F.coalesce("fresh", "f")).drop("fresh"))
        scratch.drop(before, cut, checked)
    scratch.drop(ranges)
    contexts = cut.where("not claim").select("r", F.shiftright("place", MORE_BITS).alias("base"), "open", "g", "contexts", "context")
    return checked.where("open").select("r", "place"), contexts, [cut, checked]


_FOUND = "r long, place long"


def _sorted_repeats(length: int):
    """Task: contexts sorted by g to runs (r, place) of repeated starts in the open ones."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (r, base, open, g, context)"""
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        size = np.array([len(r[4]) for r in rows])
        begin = np.cumsum(size) - size
        n = size - length + 1
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        context = np.repeat(np.arange(len(rows)), n)
        g = np.array([r[3] for r in rows])
        group = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))
        hit = repeated_suffixes(data, at, group[context], length)
        hit &= np.array([r[2] for r in rows])[context]
        first = hit & np.concatenate(([True], ~hit[:-1] | (context[1:] != context[:-1])))
        last = hit & np.concatenate((~hit[1:] | (context[1:] != context[:-1]), [True]))
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        shift = np.array([r[1] for r in rows])[context[a]] - begin[context[a]]
        own = np.array([r[0] for r in rows])[context[a]]
        return pa.record_batch([pa.array(own, pa.int64()), pa.array(_place(at[a] + shift, at[b] + shift), pa.int64())], ["r", "place"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["r", "base", "open", "g", "context"], lambda row: row[3]):
            yield work(rows)

    return each


def repeated_starts(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """Runs (r, place) of starts of repeated windows; docs: (r, text), r standing for a row. Repeated rows share
    it and count as often as they occur."""
    if length >= 1 << MORE_BITS:
        raise ValueError(f"length must be below {1 << MORE_BITS}")
    k1, k2 = max(1, int(length * SAMPLE_PART)), max(1, length - CUT_LESS)
    k1 = min(k1, k2)
    docs = docs.where(F.octet_length("text") >= length)  # shorter ones hold no window
    found, contexts, held = _round(docs, "text", k1, length, scratch)
    found2, contexts, held2 = _round(contexts, "context", k2, length, scratch)
    buckets = contexts.where(F.col("contexts") <= BUCKET_CONTEXTS).select("r", "base", "open", "g", "context")
    found3 = buckets.repartition("g").sortWithinPartitions("g").mapInArrow(lean(_sorted_repeats(length)), _FOUND)
    # of a k-gram as long as the window every span is one window, so none stays undecided
    found4, _, held4 = _round(contexts.where(F.col("contexts") > BUCKET_CONTEXTS), "context", length, length, scratch)
    out = scratch.table(found.unionByName(found2).unionByName(found3).unionByName(found4).distinct())
    scratch.drop(*held, *held2, *held4)
    return out


def _remove(length: int, keep: list[str], rest: list[str]):
    """Task: rows with text and runs of repeated starts to what remains, in the columns ``rest``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans = [], [], []
            left_as = {c: [] for c in rest}
            for text, runs in zip(batch.column("__text").to_pylist(), batch.column("__runs").to_pylist()):
                raw = (text or "").encode()
                kept, at, gone, n = [], 0, 0, 0
                for a, b in sorted((first, last + length) for first, last in map(_starts, runs or [])):
                    if n == 0 or a > at:
                        kept.append(raw[at:a])
                        n += 1
                        at = a
                    if b > at:
                        gone += b - at
                        at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                size.append(len(raw))
                removed.append(gone)
                spans.append(n)
                if "__rest" in left_as:
                    left_as["__rest"].append(left.decode(errors="ignore") if n else text)
                if "__sha256" in left_as:
                    left_as["__sha256"].append(hashlib.sha256(left).hexdigest())
            yield pa.record_batch(
                [*[batch.column(c) for c in keep], pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), *[pa.array(v, pa.string()) for v in left_as.values()]],
                [*keep, "__bytes", "__removed", "__spans", *rest],
            )

    return each


def without_repeats(docs: DataFrame, length: int = 400, keep: list[str] | None = None, rest: tuple[str, ...] = ("__rest",)) -> DataFrame:
    """docs' columns (or ``keep``) with __bytes, __removed, __spans and those of ``rest``: __rest, the remaining
    text, in which characters that a cut parts are dropped, and __sha256, that of the remaining bytes.

    Defined results: null texts are empty and stay null; empty and short texts lose nothing; repeated
    rows are copies of each other and lose what they share; an empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession)
    r = F.xxhash64(F.col("doc_id").cast("string"), text_or_empty())
    runs = repeated_starts(docs.select(r.alias("r"), text_or_empty().alias("text")), scratch, length)
    by_row = scratch.table(runs.groupBy(F.col("r").alias("__r")).agg(F.collect_list("place").alias("__runs")))
    scratch.drop(runs)
    named = docs.select(*keep, F.col("text").alias("__text"), r.alias("__r"))
    joined = named.join(by_row, "__r", "left")
    out = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, T.LongType()) for n in ("__bytes", "__removed", "__spans")], *[T.StructField(n, T.StringType()) for n in rest]])
    return joined.mapInArrow(lean(_remove(length, keep, list(rest))), out)


def suffix_dedup(docs: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, with ``texts`` also text: what remains."""
    got = without_repeats(docs, length, ["doc_id"], ("__sha256", *(["__rest"] if texts else [])))
    return got.select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), F.col("__sha256").alias("kept_sha256"), *([F.col("__rest").alias("text")] if texts else []))
