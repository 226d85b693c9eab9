"""Toxicity by compression distance.

Two zstandard dictionaries share one base trained on ordinary text; one is completed with more
ordinary text, the other with what labelled toxic text says and ordinary text doesn't. A window
that the toxic dictionary shortens more than the ordinary one is evidence; a document's windows are
summed up in four numbers, and a logistic curve fitted on labelled documents that the dictionaries
haven't seen turns these into a score.

Training uses a bounded sample of labelled rows (``SAMPLE``), each with its whole text, which never
reaches the driver: words are counted and features computed in parallel, and a bounded number of
pieces spread over each text (``PIECES``) makes the dictionaries. Scoring covers every window of every
text in parallel, with nothing but the dictionaries and the coefficients broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, lean

#: Training bounds: documents of each class at most, and pieces of each text that dictionaries are made of.
SAMPLE = {1: 2000, 0: 5000}
PIECES, PIECE_BYTES = 16, 256
WINDOW = 64  # bytes
BASE_BYTES, TOXIC_BYTES = 48_000, 8_192
#: A word marks toxic text if so many of the toxic documents have it, and so many times the ordinary share.
LEAST_SHARE, LEAST_DOCS, LEAST_LIFT = 0.02, 4, 8.0
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # of the features, then the constant


def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=5, target_length=16, strategy=zs.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    data = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=data, compression_params=params)


def _lengths(compressor: zs.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    if not windows:
        return np.zeros(0, np.int64)
    out = compressor.multi_compress_to_buffer(windows, threads=1)
    return np.fromiter((len(out[i]) for i in range(len(windows))), np.int64, len(windows))


def _trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a dictionary that zstandard trains; the samples themselves if they are too few for it."""
    plain = b"".join(samples)
    if len(plain) > 4 * size:
        try:
            return zs.train_dictionary(size + 1_000, samples, k=48, d=8).as_bytes()[-size:]
        except zs.ZstdError:
            pass
    return plain[-size:]


class Scorer:
    def __init__(self, model: Model):
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)
        self.weights = np.array(model.weights)

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: the best window's gain, the best three's, the share of windows that gain 3 bytes, the mean gain."""
        windows: list[bytes] = []
        counts = []
        for t in texts:
            b = t.lower().encode() if t else b""
            own = [b[i : i + WINDOW] for i in range(0, len(b), WINDOW)]
            windows += own
            counts.append(len(own))
        gain = _lengths(self.ordinary, windows) - _lengths(self.toxic, windows)
        out = np.zeros((len(texts), 4))
        at = 0
        for i, n in enumerate(counts):
            if n:
                g = gain[at : at + n]
                top = np.partition(g, max(0, n - 3))[-3:]
                out[i] = (g.max(), top.sum(), (g >= 3).mean(), g.mean())
                at += n
        return self.scale(out, np.array(counts))

    @staticmethod
    def scale(raw: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bounded inputs for the logistic curve; long texts get good windows by chance more often."""
        size = np.log1p(counts)
        return np.column_stack([np.tanh(raw[:, 0] / 10), np.tanh(raw[:, 1] / 20), np.sqrt(raw[:, 2]), np.tanh(raw[:, 3]), size / 10, (raw[:, 2] > 0.03).astype(float)])

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.features(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    x1 = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x1.shape[1])
    ridge = np.full(len(b), 1e-2)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        grad = x1.T @ (w * (p - y)) + ridge * b
        hess = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def spread_pieces(text: str) -> list[bytes]:
    """Pieces of a text: all of them, or PIECES at even distances from its beginning to its end."""
    b = text.lower().encode()
    n = -(-len(b) // PIECE_BYTES)
    picked = range(n) if n <= PIECES else [i * (n - 1) // (PIECES - 1) for i in range(PIECES)]
    return [b[i * PIECE_BYTES : (i + 1) * PIECE_BYTES] for i in picked]


def marking_words(learn: DataFrame) -> list[str]:
    """Words of the whole toxic texts that ordinary texts hardly have, rarest first; learn: (toxic, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                words = sorted(set(_WORD.findall(text.lower())))
                yield pa.record_batch([pa.array([label] * len(words), pa.int32()), pa.array(words, pa.string())], ["toxic", "word"])

    n = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}  # two rows
    least = max(min(LEAST_DOCS, n[1]), LEAST_SHARE * n[1])
    counts = learn.select("toxic", "text").mapInArrow(lean(each), "toxic int, word string").groupBy("word").agg(F.sum("toxic").alias("said"), F.sum(1 - F.col("toxic")).alias("usual"))
    lifted = (F.col("said") >= least) & (F.col("said") / n[1] >= LEAST_LIFT * (F.col("usual") + 0.5) / n[0])
    # the most frequent ones fill the dictionary: no more words than it has bytes
    marks = counts.where(lifted).orderBy(F.desc("said"), F.desc("word")).limit(TOXIC_BYTES).collect()
    return [r["word"] for r in marks[::-1]]


def fit(rows: DataFrame, totals: dict[int, int]) -> Model | None:
    """rows: (fold, toxic, text, o) of the training sample, o being its order; totals: rows of each label before sampling.

    Folds 1 to 3 make the dictionaries, fold 4 fits the curve. None without rows of both labels.
    """
    learn, check = rows.where(F.col("fold") != FOLDS - 1), rows.where(F.col("fold") == FOLDS - 1)
    if len(check.select("toxic").distinct().collect()) != 2:
        check = learn
    if len(learn.select("toxic").distinct().collect()) != 2:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [spread_pieces(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("o"), pa.array(pieces, pa.list_(pa.binary()))], ["o", "pieces"])

    # PIECES * PIECE_BYTES a document at most
    cuts = learn.where("toxic = 0").select("o", "text").mapInArrow(lean(cut), "o string, pieces array<binary>").collect()
    pieces = [bytes(p) for r in sorted(cuts) for p in r["pieces"]]
    own = (" " + " ".join(marking_words(learn)) + " ").encode()[-TOXIC_BYTES:]
    base = _trained(BASE_BYTES, pieces)
    more = _trained(max(len(own), 256), pieces[::-1])[-len(own) :]
    model = Model(base + more, base + own, ())
    blank = rows.sparkSession.sparkContext.broadcast(Model(model.ordinary, model.toxic, (0.0,) * 7))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(blank.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = scorer.features(part.column("text").to_pylist())
                yield pa.record_batch([part.column("o"), part.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["o", "toxic", "x"])

    got = sorted(check.select("o", "toxic", "text").mapInArrow(lean(measure), "o string, toxic int, x array<double>").collect())
    x, y = np.array([r["x"] for r in got]), np.array([float(r["toxic"]) for r in got])
    have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    w = np.where(y == 1, totals.get(1, 1) / have[1], totals.get(0, 1) / have[0])
    model.weights = _logistic(x, y, w * len(y) / w.sum())
    return model


def fold_column(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from labelled documents of folds 1 to 4 only (fold 0 is held out)."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.withColumn("fold", fold_column()).where("fold <> 0")
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    # the sample is chosen by id before texts are read: at most 7,000 ids
    chosen = None
    for label, most in SAMPLE.items():
        part = marked.where(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    bound_batches(docs.sparkSession)
    texts = docs.where("text is not null").select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("fold", "toxic", "text", F.md5("text").alias("o"))
    # repeated rows of an id could pass the bound; the sort also makes reruns agree
    rows = Scratch(docs.sparkSession).table(rows.orderBy("toxic", "o").limit(2 * sum(SAMPLE.values())))
    return fit(rows.repartition("o"), totals)


_SCORERS: dict[str, Scorer] = {}


def toxicity_scores(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or ``keep``) with score and predicted; without a model every score is 0.

    Defined results: null and empty texts have the features of a text without windows; repeated rows
    are scored each for itself; nulls elsewhere don't matter.
    """
    bound_batches(docs.sparkSession)
    names = keep or docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some 50 KB
    made = str(id(model)) + str(hash(model.weights) if model else 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None and made not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[made] = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("__text").to_pylist()
                scores = _SCORERS[made].score(texts) if shared.value is not None else np.zeros(len(texts))
                yield pa.record_batch([*[part.column(n) for n in names], pa.array(scores, pa.float64())], [*names, "__score"])

    out = T.StructType([*[docs.schema[n] for n in names], T.StructField("__score", T.DoubleType())])
    scored = docs.select(*names, F.col("text").alias("__text")).mapInArrow(lean(each), out)
    kept = [n for n in names if n not in ("score", "predicted")]
    return scored.select(*kept, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; null ids are not held out."""
    scored = toxicity_scores(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold_column() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
