"""Metric rows of trials from nested records, in one pass.

A record is one output of a method: per step the probabilities and vectors of the candidates, the vector
that they were merged to, and attention patterns. Each task adds up for every trial what entropies, pair
cosines, products of vectors and head means need; one row of sums a trial and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fits as ft
from . import vectors as ve

SCALARS = ("n", "ok", "ref_ok", "refs", "passes", "tokens", "entropy", "entropies", "conf", "confs", "vectors", "patterns", "similar", "similars")


def gram_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.sum(axis=0), x.T @ x


def participation(n: float, total: np.ndarray, gram: np.ndarray) -> float:
    """(sum of eigenvalues)^2 / sum of their squares of the covariance: trace squared over the squared Frobenius norm.
    1 below two vectors and without variance."""
    if n < 2:
        return 1.0
    cov = (gram - np.outer(total, total) / n) / (n - 1)
    norm = float((cov * cov).sum())
    return float(np.trace(cov)) ** 2 / norm if norm > 0 else 1.0


def participation_ratio(vectors: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """(by, ratio): participation ratio of each group's vectors. Each task adds up one D x D matrix a group."""
    types = {f.name: f.dataType for f in vectors.schema}
    keys = [T.StructField(c, types[c]) for c in by]
    array = T.ArrayType(T.DoubleType())
    partial = T.StructType([*keys, T.StructField("__n", T.LongType()), T.StructField("__total", array), T.StructField("__gram", array)])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for key, own in batch.groupby(by, dropna=False, sort=False):
                key = tuple(None if x != x else x for x in (key if isinstance(key, tuple) else (key,)))
                x = np.stack(own[column].to_numpy()).astype(float)
                total, gram = gram_sums(x)
                if key in held:
                    held[key] = [held[key][0] + len(x), held[key][1] + total, held[key][2] + gram]
                else:
                    held[key] = [len(x), total, gram]
        if held:
            yield pd.DataFrame({**{c: [k[i] for k in held] for i, c in enumerate(by)}, "__n": [v[0] for v in held.values()], "__total": [v[1] for v in held.values()], "__gram": [v[2].ravel() for v in held.values()]})

    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(batch["__total"].to_numpy()), axis=0)
        gram = np.zeros(len(total) ** 2)
        for one in batch["__gram"]:
            gram += one
        ratio = participation(float(batch["__n"].sum()), total, gram.reshape(len(total), -1))
        return pd.DataFrame({**{c: [batch[c].iloc[0]] for c in by}, "ratio": [ratio]})

    done = T.StructType([*keys, T.StructField("ratio", T.DoubleType())])
    return vectors.where(F.col(column).isNotNull()).select(*by, column).mapInPandas(each, partial).groupBy(*by).applyInPandas(merge, done)


def entropy_bits(p: np.ndarray) -> float:
    p = p[p > 1e-15]
    p = p / p.sum() if len(p) else p
    return float(-(p * np.log2(p)).sum())


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def confusability(vectors: np.ndarray, weights: np.ndarray) -> float:
    """Weighted mean cosine of candidate pairs; 0 without weight."""
    i, j = np.triu_indices(len(weights), 1)
    unit = _unit(vectors)
    w = weights[i] * weights[j]
    return float((w * (unit[i] * unit[j]).sum(axis=1)).sum() / w.sum()) if w.sum() >= 1e-10 else 0.0


def mean_pair_cosine(heads: np.ndarray) -> float:
    unit = _unit(heads)
    h = len(unit)
    s = unit.sum(axis=0)
    return float((s @ s - (unit * unit).sum()) / (h * (h - 1)))


class TrialSums:
    """What the records of a trial add up to."""

    def __init__(self) -> None:
        self.s = dict.fromkeys(SCALARS, 0.0)
        self.total = self.gram = self.heads = None
        self.ragged = False

    def add(self, r) -> None:
        s = self.s
        s["n"] += 1
        s["ok"] += r.ok or 0.0
        if r.ref_ok is not None and r.ref_ok == r.ref_ok:
            s["ref_ok"], s["refs"] = s["ref_ok"] + r.ref_ok, s["refs"] + 1
        s["passes"], s["tokens"] = s["passes"] + r.forward_passes, s["tokens"] + r.tokens
        probs = [np.asarray(p, float) for p in r.candidate_probs]
        for p in probs:
            if len(p) > 1:
                s["entropy"], s["entropies"] = s["entropy"] + entropy_bits(p), s["entropies"] + 1
        for p, v in zip(probs, r.candidate_embeddings):
            if v is not None and len(p) > 1:
                s["conf"], s["confs"] = s["conf"] + confusability(np.stack(v).astype(float), p), s["confs"] + 1
        if len(r.aggregated_embeddings):
            x = np.stack(r.aggregated_embeddings).astype(float)
            total, gram = gram_sums(x)
            self.total = total if self.total is None else self.total + total
            self.gram = gram if self.gram is None else self.gram + gram
            s["vectors"] += len(x)
        for a in r.attention:
            a = np.stack(a).astype(float)
            self.pattern(a, 1.0)
            if len(a) > 1:
                s["similar"], s["similars"] = s["similar"] + mean_pair_cosine(a), s["similars"] + 1

    def pattern(self, heads: np.ndarray, count: float) -> None:
        self.s["patterns"] += count
        if self.heads is None:
            self.heads = heads.copy()
        elif self.heads.shape == heads.shape:
            self.heads += heads
        else:
            self.ragged = True

    def row(self) -> dict:
        flat = lambda x: [] if x is None else x.ravel()
        return {**self.s, "total": flat(self.total), "gram": flat(self.gram), "heads": flat(self.heads), "head_count": 0 if self.heads is None else len(self.heads), "ragged": self.ragged}

    def merge(self, r) -> None:
        for c in SCALARS:
            if c != "patterns":
                self.s[c] += getattr(r, c)
        if len(r.total):
            d = len(r.total)
            self.total = r.total.copy() if self.total is None else self.total + r.total
            self.gram = r.gram.reshape(d, d).copy() if self.gram is None else self.gram + r.gram.reshape(d, d)
        self.ragged |= r.ragged
        if r.head_count:
            self.pattern(r.heads.reshape(r.head_count, -1), r.patterns)

    def metrics(self) -> dict:
        s = self.s
        mean = lambda x, n, empty: s[x] / s[n] if s[n] else empty
        if not s["patterns"]:
            head = 0.5
        elif self.ragged:  # patterns of different lengths: similarity step by step
            head = 1 - s["similar"] / s["similars"] if s["similars"] else 0.5
        else:
            head = 1 - mean_pair_cosine(self.heads / s["patterns"]) if len(self.heads) > 1 else 1.0
        return {
            "accuracy": s["ok"] / max(s["n"], 1), "r_dist": mean("entropy", "entropies", 0.0), "r_geom": participation(s["vectors"], self.total, self.gram) if s["vectors"] else 1.0,
            "d": s["ref_ok"] / s["refs"] - s["ok"] / s["n"] if s["refs"] else 0.0, "i_head": head, "i_conf": mean("conf", "confs", 0.0),
            "total_forward_passes": int(s["passes"]), "total_tokens": int(s["tokens"]), "outputs": int(s["n"]),
        }


COLUMNS = ["ok", "ref_ok", "forward_passes", "tokens", "candidate_probs", "candidate_embeddings", "aggregated_embeddings", "attention"]
METRICS = "accuracy double, r_dist double, r_geom double, d double, i_head double, i_conf double, total_forward_passes long, total_tokens long, outputs long"


def trial_metrics(records: DataFrame, by: list[str]) -> DataFrame:
    """One row a trial: accuracy, entropy of the candidates (r_dist), participation ratio of the merged vectors
    (r_geom), reference accuracy less accuracy (d), specialisation of heads (i_head), confusability of candidates
    (i_conf), forward passes, tokens and outputs.

    records: by, ok (score), ref_ok (null without a reference), forward_passes, tokens, candidate_probs (per step),
    candidate_embeddings (per step; a step may be null), aggregated_embeddings (per step), attention (per step heads x
    positions). Steps of one candidate count for neither entropy nor confusability. Nothing to average gives 0
    (r_dist, i_conf, d), 1 (r_geom) or 0.5 (i_head); one head gives 1.
    """
    types = {f.name: f.dataType for f in records.schema}
    keys = [T.StructField(c, types[c]) for c in by]
    array = T.ArrayType(T.DoubleType())
    partial = T.StructType([
        *keys, *[T.StructField(c, T.DoubleType()) for c in SCALARS], *[T.StructField(c, array) for c in ("total", "gram", "heads")],
        T.StructField("head_count", T.LongType()), T.StructField("ragged", T.BooleanType()),
    ])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, TrialSums] = {}
        for batch in batches:
            names = [batch[c] for c in by]
            for i, r in enumerate(batch.itertuples(index=False)):
                key = tuple(None if n.iloc[i] is None or n.iloc[i] != n.iloc[i] else n.iloc[i] for n in names)
                held.setdefault(key, TrialSums()).add(r)
        if held:
            yield pd.DataFrame([{**dict(zip(by, k)), **v.row()} for k, v in held.items()])[partial.names]

    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        sums = TrialSums()
        for r in batch.itertuples(index=False):
            sums.merge(r)
        return pd.DataFrame([{**{c: batch[c].iloc[0] for c in by}, **sums.metrics()}])

    done = T.StructType([*keys, *T._parse_datatype_string(METRICS).fields])
    return records.select(*by, *COLUMNS).mapInPandas(each, partial).groupBy(*by).applyInPandas(merge, done)


def fitted_trial_metrics(records: DataFrame, by: list[str], order: str, label: str, hidden: int = 256, epochs: int = 50) -> DataFrame:
    """``trial_metrics`` with the two measures that need a fit: i_sep, how well a linear probe of the merged vectors
    tells which candidate dominates, and r_it, bits that the column ``hidden`` (null: none) holds about the labels in
    bins per forward pass. ``order`` numbers the outputs of a trial; trials without steps of several candidates have
    i_sep 0.5, those without hidden vectors r_it 0."""
    steps = records.select(*by, F.col(order).alias("__o"), F.arrays_zip(F.col("candidate_probs").alias("p"), F.col("aggregated_embeddings").alias("x")).alias("s")).select(*by, "__o", F.posexplode("s").alias("__step", "s"))
    steps = steps.where((F.size("s.p") > 1) & F.col("s.x").isNotNull()).select(*by, (F.col("__o") * 1_000 + F.col("__step")).alias("__o"), F.col("s.x").alias("__v"), ve.dominant(F.col("s.p")).alias("__l"))
    inner = ve.label_bins(records.where(F.col("hidden").isNotNull()).select(*by, F.col("hidden").alias("__v"), F.col(label).alias("__l"), "forward_passes"), "__l")
    sep = ft.separability(steps, "__l", "__o", by, "__v").withColumnRenamed("separability", "i_sep")
    bits = ft.information_rate(inner, "bin", by, "__v", "forward_passes", hidden, epochs).withColumnRenamed("bits_per_unit", "r_it")
    out = trial_metrics(records, by)
    for more, empty in ((sep, 0.5), (bits, 0.0)):
        name = more.columns[-1]
        out = out.alias("a").join(more.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], "left").select("a.*", F.coalesce(F.col(f"b.{name}"), F.lit(empty)).alias(name))
    return out
