"""Links against brute force; bounds of the tree."""

import numpy as np
import pytest

from ballotry.llm import cover_tree as ct


def table(seed, n=300, dim=8):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(25, dim))
    rows = []
    for i in range(n):
        v = base[rnd.integers(25)] + rnd.normal(size=dim) * rnd.choice([0, 0.05, 0.3, 2])
        rows.append((i, [float(np.float32(x)) for x in v * rnd.choice([1.0, 3.0])]))
    rows += [(900, None), (901, []), (902, [0.0] * dim), (903, [1.0, None] + [0.0] * (dim - 2)), (904, [float("nan")] * dim), (905, [float("inf")] * dim)]
    rows += [(None, rows[0][1]), (906, rows[0][1]), (906, rows[0][1]), (907, [1.0, 0.0]), (908, [2.0, 0.0]), (909, rows[1][1]), (909, rows[2][1])]
    return rows


def brute(rows, cosine):
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: 0 for i in range(len(rows))}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, i in enumerate(ok):
        a = np.array(rows[i][1])
        for j in ok[:p]:
            b = np.array(rows[j][1])
            if len(a) == len(b) and a @ b >= cosine * np.linalg.norm(a) * np.linalg.norm(b) - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i in ok:
        low[root(i)] = min(low.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((d, links[i], low.get(root(i), d) if i in ok else d, True if d is None else d == (low[root(i)] if i in ok else d)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed,part,cosine", [(1, 3000, 0.9), (2, 20, 0.9), (3, 50, 0.99), (4, 40, 0.5)])
def test_links_equal_brute_force(spark, monkeypatch, seed, part, cosine):
    monkeypatch.setattr(ct, "PART_ROWS", part)
    rows = table(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    assert sorted(map(tuple, ct.near_duplicates(df, cosine).collect()), key=str) == brute(rows, cosine)


def test_levels_are_nested_and_cover():
    v = np.random.default_rng(5).normal(size=(200, 4))
    v = np.concatenate([v, v[:20] + 1e-4, v[:3]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    t = ct.CoverTree(v)
    for up, down in zip(t.centre, t.centre[1:]):
        assert set(up) <= set(down)
    assert sorted(t.leaf) == list(range(len(v))) and t.radius[-1].max() == 0
    tops = [r.max() for r in t.radius[:6]]
    assert all(b <= a / 1.99 or b < 1e-6 for a, b in zip(tops, tops[1:])) or all(b <= tops[0] / 2 ** (i + 1) + 1e-9 for i, b in enumerate(tops[1:]))


def test_empty_table(spark):
    assert ct.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_links_of_a_dense_cluster_take_bounded_memory():
    """All of 2 x 2,500 vectors link: 12.5 million pairs, more than may be held at once."""
    import tracemalloc

    rnd = np.random.default_rng(7)
    v = rnd.normal(size=8) + rnd.normal(size=(5000, 8)) * 0.02
    one, two = (ct.Block.of(np.arange(i, i + 2500), np.ones(2500, np.int64), v[i : i + 2500]) for i in (0, 2500))
    left, right = [one.pieces()], [two.pieces()]
    assert max(map(len, left[0])) <= 64 << 10
    tracemalloc.start()
    ids, links, span = ct.tile_links(left, right, 0.9)
    inner = ct.tile_links([*left, *right], None, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(links) == {2500} and len(span) == 4999 and set(inner[1]) == {4999} and len(inner[2]) == 4999
    assert peak < 60e6


@pytest.mark.parametrize("pairs,numbers", [(7, 50), (1000, 1 << 20)])
def test_bounded_lists_lose_no_pair(monkeypatch, pairs, numbers):
    monkeypatch.setattr(ct, "PAIRS", pairs)
    monkeypatch.setattr(ct, "NUMBERS", numbers)
    rows = [v for d, v in table(9, 200) if d is not None and d < 200]
    v = np.unique(np.array(rows), axis=0)
    cut = len(v) // 2
    parts = [ct.Block.of(np.arange(len(v))[s], np.ones(len(v[s]), np.int64), v[s]).pieces() for s in (slice(0, cut), slice(cut, None))]
    norm = np.linalg.norm(v, axis=1)
    near = (v @ v.T >= 0.9 * norm[:, None] * norm[None, :]) & ~np.eye(len(v), dtype=bool)
    ids, links, span = ct.tile_links(parts, None, 0.9)
    assert ids.tolist() == list(range(len(v))) and links.tolist() == near.sum(1).tolist()
    ids, links, _ = ct.tile_links(parts[:1], parts[1:], 0.9)
    assert links.tolist() == [*near[:cut, cut:].sum(1), *near[cut:, :cut].sum(1)]


def test_rounds_meet_every_pair_of_tiles(spark, monkeypatch):
    """Tiles of one and two blocks, each round dealt alone."""
    monkeypatch.setattr(ct, "PART_ROWS", 12)
    monkeypatch.setattr(ct, "ROUND_BYTES", 1)
    rows = table(11)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    for most in (1, 2):
        monkeypatch.setattr(ct, "TILE_BLOCKS", most)
        assert sorted(map(tuple, ct.near_duplicates(df, 0.9).collect()), key=str) == brute(rows, 0.9)
