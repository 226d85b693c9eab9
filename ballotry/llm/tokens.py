"""Token counts (op6) and byte-level BPE encoding and decoding (op7).

Counting proves once, offline, which vocabulary strings encode alone as one token; a pre-token
found in that table costs one look-up, and only the rest is merged.

Encoding shuffles distinct words, not token streams. A block of documents gives its distinct
pre-tokens and the positions where they stand; words meet by hash, each distinct word is encoded
once, and its ids return to the blocks, where the streams are put together by position. Decoding
joins the fixed token-byte table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, by_runs, lean


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def load_merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], dict[bytes, int], list[str]]:
    """Ranks of merged pairs, the vocabulary, and the special strings of a tokenizers .json file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_alphabet()
    raw = lambda s: bytes(letters[c] for c in s)
    special = [x["content"] for x in spec["added_tokens"]]
    vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}, vocab, special


def merge_pairs(word: bytes, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Byte-pair merging by ranked pairs: the lowest rank first, the leftmost of equals.

    Parts are linked in a list and pairs wait in a heap, so a word of n bytes takes O(n log n).
    """
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; 0 if none does
    heap = []
    for i in range(n - 1):
        r = rank.get((word[i : i + 1], word[i + 1 : i + 2]))
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or end[j] != stop:  # one of the two has merged since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            r = rank.get((word[i:stop], word[stop : end[stop]]))
            if r is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        p = before[i]
        if p >= 0:
            r = rank.get((word[p:i], word[i:stop]))
            if r is not None:
                heapq.heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


class _Joined(dict):
    """Rank of a pair as the rank of its joined bytes, as .tiktoken files define it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def get(self, pair, default=None):
        return self.ranks.get(pair[0] + pair[1], default)


#: Most words that a worker keeps results of at once, beyond which the memo starts anew, and the length of the longest.
MEMO_WORDS, MEMO_LETTERS = 400_000, 256


def whole_tokens(rank: dict[tuple[bytes, bytes], int], vocab: dict[bytes, int]) -> list[str]:
    """The vocabulary strings for which merging proves that they encode alone as one token."""
    out = []
    for token in vocab:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if len(merge_pairs(token, rank)) == 1:
            out.append(text)
    return out


class Counter:
    """Counts tokens of texts as the tokenizer of a .json file does, special strings included."""

    def __init__(self, whole: list[str], rank: dict, special: list[str], pattern: str):
        self.rank, self.pattern = rank, regex.compile(pattern)
        self.whole = dict.fromkeys(whole, 1)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.special_strings = special
        self.memo = dict(self.whole)

    def plain(self, text: str) -> int:
        words = self.pattern.findall(text)
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            pass
        long = 0
        for w in set(words):
            if len(w) > MEMO_LETTERS:
                long += words.count(w) * len(merge_pairs(w.encode(), self.rank))
            elif w not in memo:
                memo[w] = len(merge_pairs(w.encode(), self.rank))
        n = long + sum(memo[w] for w in words if len(w) <= MEMO_LETTERS)
        if len(memo) > MEMO_WORDS:
            self.memo = dict(self.whole)
        return n

    def count(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.special_strings):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    Defined results: null and empty texts have 0 bytes and 0 tokens; a special string inside a text
    is one token; repeated rows are counted each for itself; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rank, vocab, special = load_merges(path)
    # the pairs of a fixed vocabulary: a few MB, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((whole_tokens(rank, vocab), rank, special, pattern))

    made = uuid.uuid4().hex

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if made not in _COUNTERS:  # kept while the worker lives
            _COUNTERS.clear()
            _COUNTERS[made] = Counter(*shared.value)
        counter = _COUNTERS[made]
        for batch in batches:
            counts = [counter.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    cut = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return cut.mapInArrow(lean(each), out).withColumn("over_limit", F.col("n_tokens") > limit)


# ---------------------------------------------------------------------------------------------
# Encoding by a shuffle of distinct words

#: Bytes of text in a block: what one reassembling call holds, whatever the corpus.
BLOCK_BYTES = 24_000_000
BLOCK_DOCS = 20_000
#: Bytes that one gather of the reassembly makes at most, long documents aside; its indexes take some 24 times as many.
GATHER_BYTES = 1_000_000


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Byte strings and arrays of known types as one compressed cell."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(r) for r in raw], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(raw).to_bytes(4, "little") + head + b"".join(raw))


def _unpack(cell: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(cell)
    n = int.from_bytes(raw[:4], "little")
    end = np.cumsum(np.frombuffer(raw, "<i8", n, 4)) + 4 + 8 * n
    return [raw[b - s : b] for b, s in zip(end.tolist(), np.frombuffer(raw, "<i8", n, 4).tolist())]


def _varint(x: np.ndarray) -> bytes:
    """Non-negative numbers below 2**35, 7 bits a byte: frequent words have small numbers."""
    if len(x) > 1 << 20:
        return b"".join(_varint(x[i : i + (1 << 20)]) for i in range(0, len(x), 1 << 20))
    width = np.ones(len(x), np.int64)
    for k in (7, 14, 21, 28):
        width += x >= (1 << k)
    end = np.cumsum(width)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    begin = end - width
    for k in range(5):
        here = np.flatnonzero(width > k)
        if not len(here):
            break
        more = (width[here] > k + 1).astype(np.uint8) << 7
        out[begin[here] + k] = ((x[here] >> (7 * k)) & 127).astype(np.uint8) | more
    return out.tobytes()


def _unvarint(cell: bytes) -> np.ndarray:
    data = np.frombuffer(cell, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    end = np.flatnonzero(data < 128)
    begin = np.concatenate(([0], end[:-1] + 1))
    out = (data[begin] & 127).astype(np.int64)
    for k in range(1, int((end - begin).max()) + 1):
        here = np.flatnonzero(end - begin >= k)
        out[here] |= (data[begin[here] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _gather(table: np.ndarray, begin: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's pieces in the order of pick, end to end, and where each ends."""
    length = size[pick]
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return table[np.arange(total) + np.repeat(begin[pick] - (end - length), length)], end


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False, packed: bool = False, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ids and decoded bytes if asked for, or
    with token_ids, the ids as little-endian 32-bit integers, if packed.

    Rows of the word shuffle are packed: one for each block of documents and hash bucket of words,
    with the block's distinct words of that bucket; the positions of a block travel as the sequence
    of its word numbers. A bucket gathers the same word from all blocks and encodes it once.
    ``block_bytes`` of text make a block: larger ones shuffle a word less often and take more memory; more
    ``buckets`` make smaller sets of words that a task holds.

    Defined results: null and empty texts have no ids; repeated rows are encoded each for itself;
    an empty table gives no rows. A block is a run of documents in a task of docs' own partitioning,
    so docs should be a scan (or another input whose retried tasks see the same rows), as tables are.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern))  # a fixed vocabulary
    n_buckets = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    ids_type = T.ArrayType(id_type)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat = regex.compile(shared.value[1])
        task, n = TaskContext.get().partitionId(), 0

        def close(ids: list, codes: list[np.ndarray], index: dict[str, int]) -> pa.RecordBatch:
            nonlocal n
            sequence = np.concatenate(codes)
            order = np.argsort(-np.bincount(sequence, minlength=len(index)), kind="stable")  # frequent words first
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            words = list(index)
            words = [words[i].encode() for i in order.tolist()]
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % n_buckets
            by_bucket = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
            cells, buckets = [], []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = [words[i] for i in by_bucket[cut[b] : cut[b + 1]].tolist()]
                cells.append(_pack(np.array([len(w) for w in own], "<i4"), b"".join(own)))
                buckets.append(b)
            block = (task << 32) | n
            n += 1
            cells.append(_pack(_varint(number[sequence]), np.array([len(c) for c in codes], "<i8"), bucket.astype("<i4")))
            buckets.append(block % n_buckets)
            rows = len(cells)
            return pa.record_batch(
                [pa.array([block] * rows, pa.int64()), pa.array(buckets, pa.int32()), pa.array([False] * (rows - 1) + [True]), pa.array(cells, pa.binary()), pa.array([None] * (rows - 1) + [ids], pa.list_(arrow_id))],
                ["block", "bucket", "head", "cell", "ids"],
            )

        ids: list = []
        codes: list[np.ndarray] = []
        index: dict[str, int] = {}
        held = 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = pat.findall(t) if t else []
                for w in set(found).difference(index):
                    index[w] = len(index)
                ids.append(i)
                codes.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
                held += len(t) if t else 0
                if held >= block_bytes or len(ids) >= BLOCK_DOCS:
                    yield close(ids, codes, index)
                    ids, codes, index, held = [], [], {}, 0
        if ids:
            yield close(ids, codes, index)

    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("head", T.BooleanType()), T.StructField("cell", T.BinaryType()), T.StructField("ids", ids_type)])
    rows = docs.select("doc_id", "text").mapInArrow(lean(explode), shape)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _Joined(shared.value[0])
        known: dict[bytes, bytes] = {}  # ids as little-endian 32-bit integers
        last = None
        for batch in batches:
            cells = []
            for bucket, head, cell in zip(batch.column("bucket").to_pylist(), batch.column("head").to_pylist(), batch.column("cell").to_pylist()):
                # rows come sorted by bucket, a word's only one, so it is encoded once unless the bucket is huge
                if bucket != last or len(known) > MEMO_WORDS:
                    known, last = {}, bucket
                if head:
                    cells.append(cell)
                    continue
                sizes, plain = _unpack(cell)
                end = np.cumsum(np.frombuffer(sizes, "<i4"))
                own, start = [], 0
                for e in end.tolist():
                    w = plain[start:e]
                    start = e
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = b"".join(rank.ranks[p].to_bytes(4, "little") for p in merge_pairs(w, rank))
                    own.append(ids)
                cells.append(_pack(np.array([len(x) // 4 for x in own], "<i4"), b"".join(own)))
            yield pa.record_batch([batch.column("block"), batch.column("bucket"), batch.column("head"), pa.array(cells, pa.binary()), batch.column("ids")], ["block", "bucket", "head", "cell", "ids"])

    coded = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(encode), shape)
    fields = [T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    if packed:
        fields += [T.StructField("token_ids", T.BinaryType())]

    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # made once in each task

    def assemble(group: pa.Table) -> dict[str, list]:
        if not tables:
            # the token-byte table that decoding joins, and the decimal ids with a space before each
            by_id = [b""] * (max(shared.value[0].values()) + 1)
            for k, v in shared.value[0].items():
                by_id[v] = k
            tables.extend([_table(by_id), _table([b" %d" % i for i in range(len(by_id))])])
        plain, decimal = tables
        cells: dict[int, bytes] = {}
        for bucket, head, cell, own in zip(group.column("bucket").to_pylist(), group.column("head").to_pylist(), group.column("cell").to_pylist(), group.column("ids").to_pylist()):
            if head:
                doc_ids, (sequence, sizes, bucket_of) = own, _unpack(cell)
            else:
                cells[bucket] = cell
        bucket_of = np.frombuffer(bucket_of, "<i4")
        count, flat = np.zeros(len(bucket_of), np.int64), []
        by_bucket = np.argsort(bucket_of, kind="stable")
        at = 0
        for b in sorted(cells):
            counts, ids = _unpack(cells[b])
            counts = np.frombuffer(counts, "<i4")
            count[by_bucket[at : at + len(counts)]] = counts
            at += len(counts)
            flat.append(np.frombuffer(ids, "<i4"))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        begin = np.zeros(len(bucket_of), np.int64)
        begin[by_bucket] = np.cumsum(count[by_bucket]) - count[by_bucket]
        words, ends = _unvarint(sequence), np.cumsum(np.frombuffer(sizes, "<i8"))
        out: dict[str, list] = {f.name: [] for f in fields}
        out["doc_id"] = doc_ids
        first, n_docs = 0, len(ends)
        while first < n_docs:  # a few documents at a time
            start = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + GATHER_BYTES // 8, side="right")))
            tokens, token_end = _gather(flat, begin, count, words[start : int(ends[last - 1])])
            text, text_end = _gather(*plain, tokens)
            digits, digit_end = _gather(*decimal, tokens)
            text, digits = text.tobytes(), digits.tobytes()
            upto = lambda end, i: int(end[i - 1]) if i else 0
            t0 = 0
            for e in (ends[first:last] - start).tolist():
                t1 = upto(token_end, e)
                d = text[upto(text_end, t0) : upto(text_end, t1)]
                out["n_tokens"].append(t1 - t0)
                out["ids_sha256"].append(hashlib.sha256(digits[upto(digit_end, t0) + (t1 > t0) : upto(digit_end, t1)]).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(d).hexdigest())
                if with_ids:
                    out["ids"].append(tokens[t0:t1].tolist())
                    out["decoded"].append(d)
                if packed:
                    out["token_ids"].append(tokens[t0:t1].astype("<i4").tobytes())
                t0 = t1
            first = last
        return out

    return by_runs(coded, "block", assemble, T.StructType(fields))
