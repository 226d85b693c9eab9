"""Classifiers of grouped vectors, fitted by sums: a step reads the rows once, each task adds up what its rows give
for every group (and fold), and one row of sums a group and task is shuffled. The driver holds parameters only."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotry.plans.numbering import numbered
from ballotry.sources.shared import written

Key = tuple


def group_sums(rows: DataFrame, by: list[str], work: Callable[[Key, pd.DataFrame], np.ndarray]) -> dict[Key, np.ndarray]:
    """By group the sum of ``work(group, rows)`` over all batches of its rows; ``work`` gives a flat array whose length
    is that of the group's parameters."""
    types = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([*[T.StructField(c, types[c]) for c in by], T.StructField("__sums", T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[Key, np.ndarray] = {}
        for batch in batches:
            for key, own in batch.groupby(by, dropna=False, sort=False):
                key = _plain(key)
                got = work(key, own)
                held[key] = held[key] + got if key in held else got
        if held:
            yield pd.DataFrame({**{c: [k[i] for k in held] for i, c in enumerate(by)}, "__sums": list(held.values())})

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(batch["__sums"].iloc[0]))
        for one in batch["__sums"]:
            total += one
        return batch.iloc[:1].assign(__sums=[total])

    found = rows.mapInPandas(each, schema).groupBy(*by).applyInPandas(add, schema).collect()
    return {_plain(tuple(r[c] for c in by)): np.array(r["__sums"]) for r in found}


def _plain(key) -> Key:
    key = key if isinstance(key, tuple) else (key,)
    return tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in key)


def _matrix(own: pd.DataFrame) -> np.ndarray:
    return np.stack(own["__x"].to_numpy()).astype(float)


def _prepared(vectors: DataFrame, by: list[str], label: str, column: str, order: str | None) -> tuple[DataFrame, dict[Key, list], dict[Key, int]]:
    """A written table (by, vector, label, place in the label, rows of the label), labels and rows by group. Labels
    are few: a number a group that the driver can hold."""
    base = vectors.where(F.col(column).isNotNull() & F.col(label).isNotNull()).select(*by, F.transform(column, lambda x: x.cast("double")).alias("__x"), F.col(label).cast("string").alias("__y"), *([F.col(order).alias("__order")] if order else []))
    if order:
        base = numbered(base, [*by, "__y"], "__order", name="__at", size="__size").drop("__order")
    rows = written(base)
    labels: dict[Key, list] = {}
    sizes: dict[Key, int] = {}
    for r in rows.groupBy(*by, "__y").agg(F.count("*").alias("__n")).orderBy("__y").collect():
        key = _plain(tuple(r[c] for c in by))
        labels.setdefault(key, []).append(r["__y"])
        sizes[key] = sizes.get(key, 0) + r["__n"]
    return rows, labels, sizes


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def separability(vectors: DataFrame, label: str, order: str, by: list[str], column: str = "embedding", folds: int = 5, penalty: float = 1.0, steps: int = 30) -> DataFrame:
    """(by, separability): mean over stratified folds of the balanced accuracy of a multinomial logistic probe.

    Rows of a label go to folds in order of the numeric column ``order``. Newton steps with squared penalty on all but
    the intercepts; gradients and Hessians of all folds and groups come from one reading a step, and a step that makes
    the loss worse is halved. 0.5 below ten rows, 1 with one label; where no label has a row for each fold, the probe
    is fitted and judged on all rows.
    """
    spark = vectors.sparkSession
    rows, labels, sizes = _prepared(vectors, by, label, column, order)
    most = {_plain(tuple(r[c] for c in by)): r["__m"] for r in rows.groupBy(*by).agg(F.max("__size").alias("__m")).collect()}
    out = {k: 0.5 if sizes[k] < 10 else 1.0 for k in labels if sizes[k] < 10 or len(labels[k]) < 2}
    fitted = [k for k in labels if k not in out]
    parts = {k: min(folds, sizes[k] // 2) for k in fitted}
    parts = {k: 1 if n > most[k] else n for k, n in parts.items()}  # one part: fitted and judged on the same rows
    width = {}
    params: dict[Key, np.ndarray] = {}
    for r in rows.groupBy(*by).agg(F.max(F.size("__x")).alias("__d")).collect():
        key = _plain(tuple(r[c] for c in by))
        if key in fitted:
            width[key] = r["__d"] + 1
            params[key] = np.zeros((parts[key], len(labels[key]), width[key]))

    def folded(key: Key, own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.column_stack([_matrix(own), np.ones(len(own))])
        y = np.array([labels[key].index(v) for v in own["__y"]])
        return x, y, (own["__at"].to_numpy() * parts[key] // own["__size"].to_numpy())

    def sums(now: dict[Key, np.ndarray]) -> Callable[[Key, pd.DataFrame], np.ndarray]:
        def work(key: Key, own: pd.DataFrame) -> np.ndarray:
            if key not in now:
                return np.zeros(0)
            x, y, fold = folded(key, own)
            c, d, n = len(labels[key]), width[key], parts[key]
            got = np.zeros((n, 1 + c * d + (c * d) ** 2))
            for f in range(n):
                mine = (fold != f) | (n == 1)
                xf, yf = x[mine], y[mine]
                p = _softmax(xf @ now[key][f].T)
                got[f, 0] = -np.log(np.maximum(p[np.arange(len(yf)), yf], 1e-300)).sum()
                off = p.copy()
                off[np.arange(len(yf)), yf] -= 1
                got[f, 1 : 1 + c * d] = (off.T @ xf).ravel()
                hess = np.empty((c, d, c, d))
                for a in range(c):
                    for b in range(a, c):
                        w = p[:, a] * ((a == b) - p[:, b])
                        hess[a, :, b, :] = hess[b, :, a, :] = (xf * w[:, None]).T @ xf
                got[f, 1 + c * d :] = hess.ravel()
            return got.ravel()

        return work

    before: dict[Key, tuple[np.ndarray, np.ndarray]] = {}
    open_ = dict(params)
    for _ in range(steps):
        if not open_:
            break
        found = group_sums(rows, by, sums(open_))
        for key, now in list(open_.items()):
            n, c, d = now.shape
            got = found[key].reshape(n, -1)
            ridge = np.zeros((c, d))
            ridge[:, :-1] = penalty
            loss = got[:, 0] + 0.5 * (ridge * now**2).sum(axis=(1, 2))
            new = now.copy()
            for f in range(n):
                if key in before and loss[f] > before[key][1][f] + 1e-9:
                    new[f] = (now[f] + before[key][0][f]) / 2
                    loss[f] = before[key][1][f]
                    continue
                grad = got[f, 1 : 1 + c * d] + (ridge * now[f]).ravel()
                hess = got[f, 1 + c * d :].reshape(c * d, c * d) + np.diag(ridge.ravel()) + 1e-8 * np.eye(c * d)
                new[f] = now[f] - np.linalg.solve(hess, grad).reshape(c, d)
            kept = before[key][0] if key in before else now
            worse = np.array([key in before and loss[f] == before[key][1][f] for f in range(n)])
            before[key] = (np.where(worse[:, None, None], kept, now), loss)
            params[key] = open_[key] = new
            if np.abs(new - now).max() < 1e-6:
                del open_[key]

    def judge(key: Key, own: pd.DataFrame) -> np.ndarray:
        if key not in params:
            return np.zeros(0)
        x, y, fold = folded(key, own)
        got = np.zeros((parts[key], len(labels[key]), 2))
        for f in range(parts[key]):
            mine = fold == f
            hit = (x[mine] @ params[key][f].T).argmax(axis=1) == y[mine]
            for a in range(len(labels[key])):
                got[f, a] = hit[y[mine] == a].sum(), (y[mine] == a).sum()
        return got.ravel()

    if fitted:
        for key, got in group_sums(rows, by, judge).items():
            if key in params:
                hits = got.reshape(parts[key], len(labels[key]), 2)
                out[key] = float(np.mean([np.mean([h / n for h, n in fold if n]) for fold in hits if fold[:, 1].any()]))
    return _table(spark, vectors, by, out, "separability")


def _table(spark, vectors: DataFrame, by: list[str], values: dict[Key, float], name: str) -> DataFrame:
    types = {f.name: f.dataType for f in vectors.schema}
    return spark.createDataFrame([(*k, float(v)) for k, v in values.items()], T.StructType([*[T.StructField(c, types[c]) for c in by], T.StructField(name, T.DoubleType())]))


def information_rate(vectors: DataFrame, label: str, by: list[str], column: str = "embedding", budget: str | None = None, hidden: int = 256, epochs: int = 50, rate: float = 1e-3, seed: int = 7) -> DataFrame:
    """(by, bits_per_unit): lower bound on the information (bits) that vectors hold about a label, by the sum of the
    column ``budget`` (forward passes; at least 1), or as it is without.

    The bound is the mean log probability of the true label by a perceptron of two hidden layers, fitted on all rows
    by Adam steps over full gradients, plus the label's entropy; it is 0 at least, below ten rows or two rows a label,
    and with one label. An epoch reads the rows once for all groups.
    """
    spark = vectors.sparkSession
    rows, labels, sizes = _prepared(vectors, by, label, column, None)
    out = {k: 0.0 for k in labels}
    fitted = [k for k in labels if len(labels[k]) >= 2 and sizes[k] >= max(10, 2 * len(labels[k]))]
    dims = {_plain(tuple(r[c] for c in by)): r["__d"] for r in rows.groupBy(*by).agg(F.max(F.size("__x")).alias("__d")).collect()}
    shapes = {k: [(dims[k], hidden), (hidden,), (hidden, hidden), (hidden,), (hidden, len(labels[k])), (len(labels[k]),)] for k in fitted}
    params: dict[Key, np.ndarray] = {}
    for k in fitted:
        rng = np.random.default_rng(seed)
        fan = [dims[k], dims[k], hidden, hidden, hidden, hidden]
        params[k] = np.concatenate([rng.uniform(-1, 1, math.prod(s)) / math.sqrt(f) for s, f in zip(shapes[k], fan)])

    def layers(key: Key, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in shapes[key]])
        return [flat[e - math.prod(s) : e].reshape(s) for s, e in zip(shapes[key], ends)]

    def sums(now: dict[Key, np.ndarray], gradient: bool) -> Callable[[Key, pd.DataFrame], np.ndarray]:
        def work(key: Key, own: pd.DataFrame) -> np.ndarray:
            if key not in now:
                return np.zeros(0)
            w1, b1, w2, b2, w3, b3 = layers(key, now[key])
            total = np.zeros(1 + len(now[key]) * gradient)
            for begin in range(0, len(own), 1024):
                piece = own.iloc[begin : begin + 1024]
                x = _matrix(piece)
                y = np.array([labels[key].index(v) for v in piece["__y"]])
                h1 = np.maximum(x @ w1 + b1, 0)
                h2 = np.maximum(h1 @ w2 + b2, 0)
                p = _softmax(h2 @ w3 + b3)
                total[0] += np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                if gradient:
                    p[np.arange(len(y)), y] -= 1
                    d2 = (p @ w3.T) * (h2 > 0)
                    d1 = (d2 @ w2.T) * (h1 > 0)
                    total[1:] += np.concatenate([g.ravel() for g in (x.T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ p, p.sum(0))])
            return total

        return work

    first = {k: np.zeros(len(params[k])) for k in fitted}
    second = {k: np.zeros(len(params[k])) for k in fitted}
    for t in range(1, epochs + 1):
        if not fitted:
            break
        for k, got in group_sums(rows, by, sums(params, True)).items():
            if k in params:
                g = got[1:] / sizes[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    if fitted:
        entropy: dict[Key, float] = {}
        for r in rows.groupBy(*by, "__y").agg(F.count("*").alias("__n")).collect():
            k = _plain(tuple(r[c] for c in by))
            p = r["__n"] / sizes[k]
            entropy[k] = entropy.get(k, 0.0) - p * math.log2(p)
        spent = {_plain(tuple(r[c] for c in by)): r["__b"] for r in vectors.groupBy(*by).agg(F.sum(budget).alias("__b")).collect()} if budget else {}
        for k, got in group_sums(rows, by, sums(params, False)).items():
            if k in params:
                out[k] = max(0.0, got[0] / sizes[k] / math.log(2) + entropy[k]) / max(float(spent.get(k) or 1), 1.0)
    return _table(spark, vectors, by, out, "bits_per_unit")
