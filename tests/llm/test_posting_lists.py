"""Neighbours against brute force, and recall with the production parameters."""

import numpy as np
import pytest

from ballotry.llm import posting_lists as pl


def brute(rows, k, every):
    ok = [(d, np.array(v)) for d, v in rows if d is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    seen = set()
    for i, (q, v) in enumerate(ok):
        if q % every or (q, v.tobytes()) in seen:
            continue
        seen.add((q, v.tobytes()))
        near = sorted((-float(v @ w), d) for j, (d, w) in enumerate(ok) if j != i and len(w) == len(v))[:k]
        out += [(q, r + 1, d, round(-s, 9)) for r, (s, d) in enumerate(near)]
    return sorted(out)


def table(seed, n=400, dim=6):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=dim) * rnd.choice([0.5, 1, 3])]) for i in range(n)]
    rows += [(1000 + i, rows[8][1]) for i in range(60)]  # a common vector
    rows += [(2000, None), (2020, []), (2040, [0.0] * dim), (2060, [float("nan")] * dim), (2080, [1.0, None] + [0.0] * (dim - 2)), (None, rows[0][1])]
    return rows + [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), rows[20], rows[20]]


@pytest.mark.parametrize("seed,size,part", [(1, 40, 4000), (2, 400, 15)])
def test_all_lists_give_brute_force(spark, monkeypatch, seed, size, part):
    monkeypatch.setattr(pl, "LIST_ROWS", size)
    monkeypatch.setattr(pl, "PART_ROWS", part)
    monkeypatch.setattr(pl, "PROBE_RATIO", 1e9)
    rows = table(seed)
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, copies string").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in pl.nearest_neighbours(df, 7, 20).collect())
    assert got == brute(rows, 7, 20)


def test_recall(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = pl.nearest_neighbours(df, 20, 100).toPandas().groupby("query_id").vec_id.apply(set)
    s = x[::100] @ x.T
    s[np.arange(60), np.arange(0, 6000, 100)] = -9
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[q * 100] & set(w.tolist())) / 20 for q, w in enumerate(want)]) >= 0.9


def test_graph_walk_finds_the_nearest():
    rnd = np.random.default_rng(4)
    graph = pl.CentroidGraph(rnd.normal(size=(200, 8)))
    for q in rnd.normal(size=(20, 8)):
        c, d = graph.nearest(q)
        assert c[0] == np.linalg.norm(graph.centres - q, axis=1).argmin() and (np.diff(d) >= 0).all()


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, pl.nearest_neighbours(df).select("query_id", "rank", "vec_id").collect()))
    assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert pl.nearest_neighbours(df.limit(0)).count() == 0


def separated(rnd, groups=5, size=480, flat=4, spread=0.05):
    """Unit vectors in groups far from each other; each group is a flat cloud of few dimensions."""
    x = np.concatenate([np.column_stack([np.tile(m, (size, 1)), spread * rnd.normal(size=(size, flat))]) for m in np.eye(groups)])
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_walk_reaches_every_group_of_centroids():
    x = separated(np.random.default_rng(5), size=50)
    graph = pl.CentroidGraph(x)
    for q in x[::10]:
        c, d = graph.nearest(q)
        assert len(c) == len(x) and np.allclose(d, np.sort(np.linalg.norm(x - q, axis=1)))


@pytest.mark.parametrize("hot", [0, 2400])
def test_recall_on_separated_clusters(spark, monkeypatch, hot):
    monkeypatch.setattr(pl, "LIST_ROWS", 18)  # more lists for each group than a centroid has links
    rnd = np.random.default_rng(6)
    x = separated(rnd, size=960)
    x = np.concatenate([x, np.repeat(x[:1], hot, axis=0)])[rnd.permutation(len(x) + hot)]  # copies: a third of all rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = pl.nearest_neighbours(df, 20, 40).toPandas()
    got = found.groupby("query_id").score.apply(list)
    queries = np.arange(0, len(x), 40).tolist()
    assert set(got.index) == set(queries) and set(found.groupby("query_id").size()) == {20}
    right = []
    for q in queries:
        s = np.delete(x @ x[q], q)
        right.append(np.mean(np.array(got[q]) >= np.sort(s)[-20] - 1e-9))
    assert np.mean(right) >= 0.9 and min(right) >= 0.5


def test_queries_go_on_until_they_have_k_rows(spark, monkeypatch):
    monkeypatch.setattr(pl, "LIST_ROWS", 4)
    x = separated(np.random.default_rng(7), size=8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert set(pl.nearest_neighbours(df, 20, 20).toPandas().groupby("query_id").size()) == {20}
