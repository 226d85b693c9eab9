"""Trial metrics, grouped fits, label bins and held-out weights against plain NumPy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotry.operators import fits as ft
from ballotry.operators import quality as ql
from ballotry.operators import trials as tr
from ballotry.operators import vectors as ve

VECTORS = "g string, id long, label string, x array<double>"


def balanced(truth, found):
    return np.mean([np.mean([f == t for t, f in zip(truth, found) if t == c]) for c in sorted(set(truth))])


def plain_probe(x, y, classes):
    """Penalised multinomial weights by many small gradient steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros((len(classes), x.shape[1]))
    hot = np.array([[float(v == c) for c in classes] for v in y])
    ridge = np.ones_like(w)
    ridge[:, -1] = 0
    for _ in range(20_000):
        p = ft._softmax(x @ w.T)
        w -= 0.01 * ((p - hot).T @ x + ridge * w) / 2
    return w


def test_separability_is_that_of_plain_probes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, spread in (("near", 1.5), ("far", 0.3)):
        for i in range(45):
            c = i % 3
            rows.append((g, i, "abc"[c], [float(v) for v in rng.normal([c, -c], spread)]))
    got = {r.g: r.separability for r in ft.separability(spark.createDataFrame(rows, VECTORS), "label", "id", ["g"], "x").collect()}
    for g in ("near", "far"):
        own = [r for r in rows if r[0] == g]
        place, sizes = {}, Counter(r[2] for r in own)
        seen = Counter()
        for r in own:
            place[r[1]] = seen[r[2]] * 5 // sizes[r[2]]
            seen[r[2]] += 1
        scores = []
        for fold in range(5):
            train, test = [r for r in own if place[r[1]] != fold], [r for r in own if place[r[1]] == fold]
            w = plain_probe(np.array([r[3] for r in train]), [r[2] for r in train], "abc")
            found = ["abc"[k] for k in (np.column_stack([np.array([r[3] for r in test]), np.ones(len(test))]) @ w.T).argmax(axis=1)]
            scores.append(balanced([r[2] for r in test], found))
        assert got[g] == pytest.approx(np.mean(scores), abs=1e-9)


def test_separability_of_few_rows(spark):
    rows = [("four", i, "ab"[i % 2], [float(i), 0.0]) for i in range(4)] + [("one", i, "a", [float(i), 1.0]) for i in range(12)]
    rows += [("rare", i, f"l{i % 6}", [float(i % 6 == c) * 9 for c in range(2)]) for i in range(12)] + [("null", 1, None, [1.0]), ("null", 2, "a", None)]
    got = {r.g: r.separability for r in ft.separability(spark.createDataFrame(rows, VECTORS), "label", "id", ["g"], "x").collect()}
    assert got["four"] == 0.5 and got["one"] == 1.0 and 0.4 < got["rare"] <= 1.0 and "null" not in got


def test_information_bound(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        c = i % 4
        rows.append(("told", i, str(c), [float(v) for v in np.eye(4)[c] * 8 + rng.normal(0, 0.1, 4)]))
        rows.append(("random", i, str(rng.integers(4)), [float(v) for v in rng.normal(0, 0.1, 4)]))
    rows += [("few", i, str(i % 2), [float(i)]) for i in range(9)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("passes", F.lit(2))
    got = {r.g: r.bits_per_unit for r in ft.information_rate(df, "label", ["g"], "x", hidden=32, rate=0.01).collect()}
    assert 1.8 < got["told"] <= 2.0 + 1e-9 and 0 <= got["random"] < 0.2 and got["few"] == 0
    spent = {r.g: r.bits_per_unit for r in ft.information_rate(df, "label", ["g"], "x", "passes", hidden=32, rate=0.01).collect()}
    assert spent["told"] == pytest.approx(got["told"] / 400)


RECORDS = "m string, ok double, ref_ok double, forward_passes long, tokens long, candidate_probs array<array<double>>, candidate_embeddings array<array<array<double>>>, aggregated_embeddings array<array<double>>, attention array<array<array<double>>>"


def plain_metrics(rows):
    cos = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a), 1e-12) / max(np.linalg.norm(b), 1e-12))
    ent, conf, agg, sims, heads = [], [], [], [], []
    for r in rows:
        for p in r[5]:
            if len(p) > 1:
                q = np.array([v for v in p if v > 1e-15])
                q = q / q.sum()
                ent.append(-(q * np.log2(q)).sum())
        for p, v in zip(r[5], r[6]):
            if v is not None and len(p) > 1:
                w = {(i, j): p[i] * p[j] for i in range(len(p)) for j in range(i)}
                conf.append(sum(w[k] * cos(v[k[0]], v[k[1]]) for k in w) / sum(w.values()) if sum(w.values()) >= 1e-10 else 0)
        agg += r[7]
        heads += r[8]
    pair = lambda a: np.mean([cos(a[i], a[j]) for i in range(len(a)) for j in range(len(a)) if i != j])
    if not heads:
        head = 0.5
    elif len({np.shape(a) for a in heads}) == 1:
        mean = np.mean(heads, axis=0)
        head = 1 - pair(mean) if len(mean) > 1 else 1.0
    else:
        sims = [pair(a) for a in heads if len(a) > 1]
        head = 1 - np.mean(sims) if sims else 0.5
    geom = 1.0
    if len(agg) > 1:
        values = np.linalg.eigvalsh(np.cov(np.array(agg).T))
        geom = values.sum() ** 2 / (values**2).sum()
    refs = [r[2] for r in rows if r[2] is not None]
    ok = np.mean([r[1] for r in rows])
    return (ok, np.mean(ent) if ent else 0, geom, np.mean(refs) - ok if refs else 0, head, np.mean(conf) if conf else 0, sum(r[3] for r in rows), sum(r[4] for r in rows), len(rows))


def test_trial_metrics_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    vec = lambda n: [[float(x) for x in rng.normal(size=3)] for _ in range(n)]
    rows = []
    for m in ("same", "ragged", "bare", "single"):
        for i in range(12):
            steps = 0 if m == "bare" else 1 + i % 3
            k = 1 if m == "single" else 4
            probs = [[float(x) for x in rng.dirichlet(np.ones(k))] for _ in range(steps)]
            heads = [[[float(x) for x in rng.random(5 + (m == "ragged") * (i + s))] for _ in range(1 if m == "single" else 3)] for s in range(steps)]
            rows.append((m, float(i % 2), None if m == "same" else float(i % 3 == 0), i, 10 * i, probs, [None if s == 1 else vec(k) for s in range(steps)], vec(steps), heads))
    rows.append(("zero", 1.0, 1.0, 1, 1, [[0.0, 0.0]], [vec(2)], vec(1), []))
    got = {r.m: tuple(r)[1:] for r in tr.trial_metrics(spark.createDataFrame(rows, RECORDS).repartition(5), ["m"]).collect()}
    assert len(got) == 5
    for m in ("same", "ragged", "bare", "single"):
        assert np.allclose(got[m], plain_metrics([r for r in rows if r[0] == m]))
    assert got["zero"][1] == 0 and got["zero"][5] == 0 and got["zero"][2] == 1 and got["zero"][4] == 0.5
    fitted = tr.fitted_trial_metrics(spark.createDataFrame(rows, RECORDS).withColumn("id", F.monotonically_increasing_id()).withColumn("hidden", F.get("aggregated_embeddings", F.lit(0))).withColumn("label", F.col("tokens") % 3), ["m"], "id", "label", 8, 3)
    extra = {r.m: (r.i_sep, r.r_it) for r in fitted.collect()}
    assert extra["bare"] == (0.5, 0.0) and extra["single"][0] == 0.5 and 0 <= extra["same"][0] <= 1 and extra["same"][1] >= 0


def test_participation_ratio(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    rows = [("a", [float(v) for v in r]) for r in x] + [("b", [1.0, 2.0])] + [("c", [1.0, 2.0])] * 3 + [("c", None)]
    got = {r.g: r.ratio for r in tr.participation_ratio(spark.createDataFrame(rows, "g string, v array<double>"), ["g"], "v").collect()}
    values = np.linalg.eigvalsh(np.cov(x.T))
    assert got["a"] == pytest.approx(values.sum() ** 2 / (values**2).sum()) and got["b"] == got["c"] == 1


def test_label_bins(spark):
    few = ve.label_bins(spark.createDataFrame([("a",), ("b",), (None,)], "l string"), "l")
    assert sorted((r.bin for r in few.collect()), key=str) == [None, "a", "b"]
    text = ve.label_bins(spark.createDataFrame([(f"word {i}",) for i in range(500)], "l string"), "l").collect()
    assert {int(r.bin) for r in text} <= set(range(20)) and len({r.bin for r in text}) > 15
    mixed = [str(i) for i in range(1000)] + [f"w{i}" for i in range(100)] + [None] * 5
    got = {r.l: r.bin for r in ve.label_bins(spark.createDataFrame([(v,) for v in mixed], "l string"), "l").collect()}
    edges = np.quantile(range(1000), np.linspace(0, 1, 21))[1:]
    off = [abs(int(got[str(v)]) - min(int(np.searchsorted(edges, v)), 19)) for v in range(1000)]
    assert max(off) <= 1 and sum(off) < 30 and got["w3"] == "0" and got[None] is None
    assert len({r.bin for r in ve.label_bins(spark.createDataFrame([(float(i),) for i in range(100)], "l double"), "l").collect()}) == 20


def test_label_bins_have_exact_edges(spark):
    rows = spark.range(30_000).selectExpr("(id * id * 7919) % 100003 % 9973 + id % 3 * 0.25D x").cache()
    xs = np.sort([r.x for r in rows.collect()])
    want = [xs[-(-len(xs) * i // 20) - 1] for i in range(1, 21)]
    assert ve.quantile_edges(rows, "x", 20) == want and ve.quantile_edges(rows, "x", 20, bucket_rows=1_000) == want
    assert ve.quantile_edges(rows.where("x < 0.3").limit(3), "x", 20, bucket_rows=1)[-1] < 0.3
    got = {r.bin: r["count"] for r in ve.label_bins(rows, "x").groupBy("bin").count().collect()}
    place = np.minimum(np.searchsorted(want, xs, "left"), 19)
    assert got == {str(b): int(n) for b, n in enumerate(np.bincount(place, minlength=20))}


def test_held_out_gls(spark):
    rng = random.Random(6)
    k, rows = 5, []
    for seed in range(3):
        for i in range(25):
            gold = str(rng.randrange(4))
            for p in range(k):
                answer = None if rng.random() < 0.1 else gold if rng.random() < 0.25 + 0.12 * p else str(rng.randrange(4))
                rows.append(("m", "t", "PT", seed, i, p, answer, int(answer == gold), gold))
    df = spark.createDataFrame(rows, "model string, task string, arm string, seed long, instance_id long, path long, answer string, y long, gold string")
    got = {(r.seed, r.ridge): r for r in ql.held_out_gls(df).collect()}
    assert len(got) == 12
    by = defaultdict(list)
    for r in rows:
        by[r[3], r[4]].append(r)
    for seed in range(3):
        train = np.array([[r[7] for r in v] for (s, _), v in by.items() if s != seed], float)
        g, s = train.mean(axis=0), np.cov(train.T)
        test = [v for (t, _), v in by.items() if t == seed]

        def vote(weights):
            right = 0
            for v in test:
                sums = {}
                for r, w in zip(v, weights):
                    if r[6] is not None:
                        sums[r[6]] = sums.get(r[6], 0) + w
                best = max(sums, key=lambda a: round(sums[a], 9)) if sums else None
                right += best == v[0][8]
            return 100 * right / len(test)

        mv, oracle = vote([1] * k), 100 * np.mean([any(r[7] for r in v) for v in test])
        for ridge in (0.1, 0.5, 1.0, 5.0):
            x = np.linalg.solve(s + ridge * np.eye(k), g)
            r = got[seed, ridge]
            assert (r.n_train, r.n_test) == (50, 25)
            assert math.isclose(r.mv_acc, mv) and math.isclose(r.oracle_acc, oracle) and math.isclose(r.gls_acc, vote(x / (g @ x))) and math.isclose(r.gain, r.gls_acc - mv, abs_tol=1e-9)
