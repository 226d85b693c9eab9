"""Correlations of prefixes against NumPy, and the fold evaluation's shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotry.operators import correlation as co
from ballotry.operators import inference as inf
from ballotry.operators import votes as vo

SCHEMA = "model string, task string, arm string, seed long, instance_id long, path long, gold string, answer string, truncated boolean, gen_len long, y long"


def sample(spark, n=60, k=32, seed=3):
    rng = np.random.default_rng(seed)
    hard = rng.random(n)
    y = (rng.random((n, k)) * 0.5 + hard[:, None] * 0.5 < 0.55).astype(int)
    y[:, 2] = 1  # a constant path
    rows = []
    for r in range(n):
        for j in range(k):
            answer = None if (r + j) % 29 == 0 else "g" if y[r, j] else f"w{rng.integers(3)}"
            y[r, j] = int(answer == "g")
            rows.append(("m", "t", "SC", r % 3, r // 3, j, "g", answer, False, 10 + j, int(y[r, j])))
    return spark.createDataFrame(rows, SCHEMA), y, rows


def rho(m):
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.corrcoef(m.T)
    return np.nanmean(c[np.triu_indices(len(c), 1)])


def plurality(rows, n, k):
    won = []
    for r in range(n):
        votes = {}
        for j in range(k):
            a = rows[r * 32 + j][7]
            if a is not None:
                votes[a] = votes.get(a, 0) + 1
        won.append(float(bool(votes) and max(votes, key=votes.get) == "g"))
    return np.mean(won)


def test_exact_k_at_every_prefix(spark):
    paths, y, rows = sample(spark)
    got = {r.kk: r for r in co.exact_k(paths).collect()}
    assert set(got) == {1, 2, 4, 8, 16, 32}
    for k, r in got.items():
        m = y[:, :k].astype(float)
        assert r.mean_path_acc == pytest.approx(m.mean()) and r.n == 60 and r.n_seeds == 3
        assert r.mv_acc == pytest.approx(plurality(rows, 60, k))
        if k > 1:
            want = rho(m)
            assert r.rho == pytest.approx(want) and r.keff == pytest.approx(k / (1 + (k - 1) * want)) and r.pct_ceiling == pytest.approx(r.keff * want)
        else:
            assert r.rho is None and r.keff == 1


def test_pair_sums_with_missing_paths(spark):
    paths, y, _ = sample(spark, 20)
    short = paths.where("not (instance_id = 0 and path >= 30)")
    got = {(r.i, r.j): r for r in co.pair_sums(vo.records(short)).collect()}
    assert len(got) == 32 * 31 // 2 and got[0, 1].n == 20 and got[0, 31].n == 17 and got[0, 1].sij == int((y[:, 0] * y[:, 1]).sum())


def test_more_than_63_paths_are_an_error(spark):
    rows = [("m", "t", "SC", 0, 0, j, "g", "g", False, 1, 1) for j in range(64)]
    with pytest.raises(Exception, match="63 paths"):
        vo.records(spark.createDataFrame(rows, SCHEMA)).collect()


def test_fold_evaluation_swaps_the_folds(spark):
    paths, y, _ = sample(spark, 90)
    a, b = sorted(inf.fold_evaluation(paths).collect(), key=lambda r: r.fold)
    assert (a.fold, b.fold) == ("A", "B") and a.n_pilot == b.n_eval and a.n_instances == 30
    assert a.held_mv_32 == b.same_mv_32 and a.reuse_deploy == b.fixed4


def test_a_hundred_paths(spark):
    rng = np.random.default_rng(8)
    votes = (rng.random((60, 100)) < 0.3 + 0.4 * rng.random((60, 1))).astype(int)
    rows = [("m", "t", "SC", r % 2, r, p, str(y), y, 5) for r, row in enumerate(votes.tolist()) for p, y in enumerate(row)]
    paths = spark.createDataFrame(rows, "model string, task string, arm string, seed long, instance_id long, path long, answer string, y long, gen_len long").repartition(6)
    got = {r.kk: r for r in co.exact_k(paths, (4, 64, 100), width=100).collect()}
    for k in (4, 64, 100):
        m = votes[:, :k].astype(float)
        r = np.corrcoef(m.T)[np.triu_indices(k, 1)]
        assert np.isclose(got[k].rho, np.nanmean(r)) and np.isclose(got[k].mean_path_acc, m.mean())
        assert np.isclose(got[k].binary_acc, np.mean((2 * m.sum(1) > k) + 0.5 * (2 * m.sum(1) == k)))
    cov = {(r.i, r.j): r.cov for r in co.slot_covariance(paths, width=100).collect()}
    assert len(cov) == 5050 and np.isclose(cov[3, 99], np.cov(votes.T)[3, 99])
    with pytest.raises(Exception, match="63 paths"):
        co.exact_k(paths, (4,)).collect()


def test_arm_statistics_derive_paths_once(spark):
    from .test_votes import counted, weighted

    paths, y, rows = sample(spark)
    df, n = counted(spark, paths)
    got = co.arm_statistics(df).first()
    assert n.value == len(rows)
    mine, mv, _, cv = weighted({"c": [dict(enumerate(r)) for r in y.tolist()]})["c"]
    assert got.k == 32 and got.rho == pytest.approx(rho(y.astype(float))) and got.p_bar == pytest.approx(y.mean())
    assert got.weighted_acc == pytest.approx(mine) and got.mv_acc == pytest.approx(mv) and got.slot_cv == pytest.approx(cv)
    s = y.sum(1)
    both, p = np.mean(s * (s - 1) / (32 * 31)), y.mean()
    assert got.c_hat == pytest.approx((both - p * p) / (p * (1 - p)))


def test_exact_k_derives_paths_once(spark):
    from .test_votes import counted

    paths, y, rows = sample(spark)
    df, n = counted(spark, paths)
    got = {r.kk: r for r in co.exact_k(df).collect()}
    assert n.value == len(rows)
    for k, r in got.items():
        s = y[:, :k].sum(1)
        assert r.binary_acc == pytest.approx(np.mean((2 * s > k) + 0.5 * (2 * s == k))) and r.tokens == pytest.approx(sum(10 + j for j in range(k)))
        accs = [y[i::3, :k].mean() for i in range(3)]
        assert r.seed_mean == pytest.approx(np.mean(accs)) and r.seed_std == pytest.approx(np.std(accs, ddof=1))
        p = y[:, :k].mean()
        if k > 1:
            both = np.mean(s * (s - 1) / (k * (k - 1)))
            assert r.agreement == pytest.approx(np.mean((s * (s - 1) + (k - s) * (k - s - 1)) / (k * (k - 1)))) and r.c_hat == pytest.approx((both - p * p) / (p * (1 - p)))


def test_prefix_ballots_equal_records(spark):
    """Missing paths, null answers and ties, in masks of one word and of three."""
    paths, _, _ = sample(spark, 40)
    some = paths.where("(instance_id + path) % 5 <> 0")
    far = some.withColumn("path", F.col("path") * 5)
    for df, ks, width in ((some, (1, 3, 8, 32), 63), (far, (1, 15, 64, 126, 160), 160)):
        want = vo.prefix_records(df, {str(k): F.lit(k) for k in ks}, width).select("seed", F.explode("prefixes").alias("p")).selectExpr("seed", "cast(p.name as long) kk", "p.k", "p.s", "cast(p.won as long) won", "p.tokens")
        want = want.groupBy("seed", "kk", "k", "s", "won").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
        got = vo.of_prefixes(vo.prefix_ballots(df, ks, width), ks, width).groupBy("seed", "kk", "k", "s", "won").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
