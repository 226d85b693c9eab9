"""Literal matrices with hand-computed values, and NumPy cross-checks."""

import numpy as np
import pytest

from ballotry.operators import correlation as co
from ballotry.operators import inference as inf
from ballotry.operators import votes as vo


def paths(spark, rows):
    data = [("m", "t", "SC", 0, r, k, str(y), int(y)) for r, row in enumerate(rows) for k, y in enumerate(row)]
    return spark.createDataFrame(data, "model string, task string, arm string, seed long, instance_id long, path long, answer string, y long")


@pytest.mark.parametrize("rows,mv", [(("110", "100", "111", "000"), 0.5), (("1100", "1110", "1000", "0000", "1111"), 0.5), (("10", "01"), 0.5)])
def test_majority_with_ties(spark, rows, mv):
    assert vo.majority_accuracy(vo.records(paths(spark, rows))).first().mv_acc == pytest.approx(mv)


def test_estimators_on_six_rows(spark):
    rows = ["1" * n + "0" * (8 - n) for n in (0, 3, 4, 5, 6, 8)]
    recs = vo.records(paths(spark, rows))
    m = np.array([[int(c) for c in r] for r in rows], float)
    assert vo.majority_accuracy(recs).first().mv_acc == pytest.approx((0 + 0 + 0.5 + 1 + 1 + 1) / 6)
    with np.errstate(invalid="ignore"):
        r = np.corrcoef(m.T)
    want = np.nanmean([r[i, j] for i in range(8) for j in range(i + 1, 8)])
    rho, c = co.pairwise_rho(recs).first().rho, co.pooled_c(recs).first().c_hat
    assert rho == pytest.approx(want) and abs(rho - c) > 1e-3
    assert co.pairwise_rho_join(paths(spark, rows)).first().rho == pytest.approx(rho)


def test_block_reasons(spark):
    rows = ["1" * n + "0" * (8 - n) for n in (0, 3, 4, 5, 6, 8)] * 4
    got = co.block_k_eff(vo.records(paths(spark, rows))).first()
    m = np.array([[int(c) for c in r] for r in rows], float)
    p = m.mean()
    assert got.reason is None and got.block_keff == pytest.approx(p * (1 - p) / m.mean(1).var(ddof=1))
    assert co.block_k_eff(vo.records(paths(spark, ["00000000"] * 24))).first().reason == "base accuracy"
    assert co.block_k_eff(vo.records(paths(spark, ["11111111"] * 24))).first().reason == "no correlation"
    assert co.block_k_eff(vo.records(paths(spark, rows[:6]))).first().reason == "too few rows"


def counted(spark, df):
    """df, and how many of its rows have been derived so far."""
    n = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            n.add(len(batch))
            yield batch

    return df.mapInPandas(each, df.schema), n


def weighted(cells):
    """Weighted accuracy, majority and slot variation of {cell: [{path: y}]} by hand."""
    out = {}
    for cell, recs in cells.items():
        w = {p: sum(r.get(p, 0) for r in recs) for p in {p for r in recs for p in r}}
        of = {p: sum(p in r for r in recs) for p in w}
        half = lambda won, all_: 0.0 if all_ == 0 else 1.0 if 2 * won > all_ else 0.5 if 2 * won == all_ else 0.0
        acc = np.array([w[p] / of[p] for p in w])
        mine = np.mean([half(sum(w[p] * y for p, y in r.items()), sum(w[p] for p in r)) for r in recs])
        out[cell] = (mine, np.mean([half(sum(r.values()), len(r)) for r in recs]), sum(w[p] in (0, of[p]) for p in w), acc.std() / acc.mean() if acc.mean() else 0.0)
    return out


@pytest.mark.parametrize("width,ids", [(63, list(range(6))), (63, [0, 7, 8, 15, 33, 62]), (130, [1, 62, 63, 64, 126, 129])])
def test_weighted_votes_derive_paths_once(spark, width, ids):
    """Ties, cells of wrong paths only, paths that are missing, and outcomes that many records share."""
    rng = np.random.default_rng(width + ids[1])
    cells = {(m, "t", a): [{p: int(rng.random() < q) for p in ids if p == ids[0] or rng.random() < 0.8} for _ in range(40)] for m in ("m", "n") for a, q in (("SC", 0.6), ("PT", 0.0))}
    data = [(*cell, r % 3, r, p, y) for cell, recs in cells.items() for r, rec in enumerate(recs) for p, y in rec.items()] + [(None, "t", "SC", 0, 0, ids[0], 1)]
    df, n = counted(spark, spark.createDataFrame(data, "model string, task string, arm string, seed long, instance_id long, path long, y long").repartition(4))
    got = {(r.model, r.task, r.arm): r for r in vo.weighted_majority(df, width).collect()}
    assert n.value == len(data)
    all_ = {(r.model, r.task, r.arm): r for r in vo.weighted_statistics(vo.ballots(df, width), width).collect()}
    want = weighted(cells)
    assert set(got) == set(want)
    for cell, (mine, mv, constant, cv) in want.items():
        assert got[cell].weighted_acc == pytest.approx(mine) and got[cell].mv_acc == pytest.approx(mv) and got[cell].gain_pp == pytest.approx(100 * (mine - mv))
        assert all_[cell].constant_slots == constant and all_[cell].slot_cv == pytest.approx(cv)


def test_first_paths_of_ballots(spark):
    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(["0", "1"], 9)) for _ in range(80)]
    df = paths(spark, rows)
    late = df.where("instance_id > 0 or path >= 4")  # no path of the first four
    got = vo.first_paths(vo.ballots(late), 4)
    assert {(r.k, r.s, r.mask): r.n for r in got.collect()} == {(r.k, r.s, r.mask): r["count"] for r in vo.records(vo.prefix(late, 4)).groupBy("k", "s", "mask").count().collect()}
    for a, b in ((co.pooled_c(got, weight="n"), co.pooled_c(vo.records(vo.prefix(late, 4)))), (co.pairwise_rho(got, weight="n"), co.pairwise_rho(vo.records(vo.prefix(late, 4)))), (co.block_k_eff(got, weight="n"), co.block_k_eff(vo.records(vo.prefix(late, 4))))):
        for x, y in zip(a.first()[3:], b.first()[3:]):
            assert x == (y if y is None or isinstance(y, str) else pytest.approx(y))
    same = co.block_k_eff(vo.ballots(paths(spark, ["110"] * 30)), weight="n").first()
    assert same.reason == co.block_k_eff(vo.records(paths(spark, ["110"] * 30))).first().reason
