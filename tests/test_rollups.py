"""Summaries of cells and the matching contract on literal rows."""

import pytest

from ballotry.operators import matching as ma
from ballotry.operators import quality as ql
from ballotry.plans import report as rp

ARM = "model string, task string, seed long, instance_id long, gold string, s long"


def test_weighted_summary_parts(spark):
    cells = [("a", 0.5, 0.3, 2.0, 0.6), ("b", 0.4, 0.1, -1.0, 0.2), ("c", 0.3, 0.225, 1.0, 0.3), ("d", 0.01, 0.9, 50.0, 0.0)]
    stats = spark.createDataFrame(cells, "model string, p_bar double, slot_cv double, gain_pp double, mv_acc double")
    got = {r.part: (r.n, r.mean_gain, r.high_cv_pct) for r in ql.weighted_summary(stats).collect()}
    assert got["all"][0] == 3 and got["high_cv"] == (1, 2.0, 100.0) and got["low_cv"] == (2, 0.0, 0.0)
    assert got["high_mv"] == (2, 1.5, 50.0) and got["low_mv"] == (1, -1.0, 0.0)


def test_extremes_take_the_first_and_last_name_of_equals(spark):
    cells = [("a", "t", "PT", 1.0, None), ("b", "t", "PT", 1.0, 2.0), ("c", "t", "PT", 0.5, None)]
    stats = spark.createDataFrame(cells, "model string, task string, arm string, gain_pp double, ratio double")
    got = {r.measure: (r.least_cell, r.most_cell) for r in ql.extremes(stats, ["gain_pp", "ratio"]).collect()}
    assert got == {"gain_pp": ("c/t/PT", "b/t/PT"), "ratio": ("b/t/PT", "b/t/PT")}


def test_roll_up_counts_exceptions(spark):
    cells = spark.createDataFrame([("m", "t", -2.0), ("n", "t", 0.0), ("m", "u", None)], "model string, task string, x double")
    got = {(r.task, r.model): (r.n, r.below, r.exceptions) for r in rp.roll_up(cells, "x").collect()}
    assert got[("t", None)] == (2, 1, 1) and got[(None, None)] == (2, 1, 1) and got[("u", None)] == (0, 0, 0)
    acc = spark.createDataFrame([("n", "t", "SC", 0.5), ("n", "t", "PT", 0.25)], "model string, task string, arm string, p_bar double")
    assert [tuple(r) for r in rp.exceptions(cells, "x", acc).collect()] == [("n", "t", 0.0, 0.5, 0.25)]


def test_matching_contract(spark):
    rows = [("m", "t", s, i, f"g{i}", 1) for s in (0, 1) for i in (0, 1)]
    good = spark.createDataFrame(rows, ARM)
    assert ma.require_matched(good, good, [0, 1], 2).count() == 4
    broken = {
        "only_sc=1": rows[1:], "repeated=1": [*rows, rows[0]], "other_gold=1": [(*rows[0][:4], None, 1), *rows[1:]],
        "only_pt=1": [*rows, ("m", "t", 1, 7, "g7", 1)], "wrong_seed=1": rows[1:], "other_seed=1": [*rows, ("m", "t", 9, 0, "g0", 1)],
    }
    for message, pt in broken.items():
        with pytest.raises(ValueError, match=message):
            ma.require_matched(spark.createDataFrame(pt, ARM), good, [0, 1], 2)


def test_extremes_derive_paths_once(spark, monkeypatch):
    from ballotry.queries import QUERIES
    from ballotry.queries import vectors as qv

    from .test_correlation import sample
    from .test_votes import counted

    paths, _, rows = sample(spark)
    df, n = counted(spark, paths)
    monkeypatch.setattr(qv, "P", lambda s, d: df)
    got = {r.measure: r for r in QUERIES["a26_extremes"](spark, "").collect()}
    assert n.value == len(rows) and set(got) == {"gain_pp", "slot_cv", "ratio"} and got["ratio"].least_cell == "m/t/SC"
