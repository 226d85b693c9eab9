"""Contracts of records, banks and cells, and report tables, on literal rows."""

import json

import pytest

from ballotry.operators import gate as ga
from ballotry.operators import matching as ma
from ballotry.plans import report as rp
from ballotry.sources import questions as qu
from ballotry.sources import records as re_

DONE = "model string, task string, seed long, instance_id long, n_answers long, K long, script_version string, temperature double, prompt_sha string"


def test_resume_compares_provenance_and_prompts(spark):
    rows = [("m", "t", 0, i, 32, 32, "v1", 0.7, f"h{i}") for i in range(4)]
    needed = spark.createDataFrame([("m", "t", 0, i) for i in range(6)], "model string, task string, seed long, instance_id long")
    prompts = spark.createDataFrame([("m", "t", i, f"h{i}") for i in range(3)], "model string, task string, instance_id long, prompt_sha string")
    expected = {"script_version": "v1", "temperature": 0.7}
    good = spark.createDataFrame(rows, DONE)
    assert sorted(r.instance_id for r in re_.resume(needed, good, 32, expected, prompts).collect()) == [4, 5]
    short = spark.createDataFrame([*rows[:3], (*rows[3][:4], 31, *rows[3][5:])], DONE)
    assert sorted(r.instance_id for r in re_.resume(needed, short, 32, expected, prompts).collect()) == [3, 4, 5]
    for at, value, message in ((5, 8, "K: 8 instead of 32"), (6, None, "script_version: None instead of v1"), (7, 0.9, "temperature: 0.9"), (8, "x", "prompt_sha: x instead of h1")):
        bad = [list(r) for r in rows]
        bad[1][at] = value
        with pytest.raises(ValueError, match=message):
            re_.resume(needed, spark.createDataFrame([tuple(r) for r in bad], DONE), 32, expected, prompts)
    other = [list(r) for r in rows]
    other[3][8] = "new"  # the current run doesn't ask this question
    assert re_.resume_mismatches(spark.createDataFrame([tuple(r) for r in other], DONE), expected, prompts).count() == 0


def test_question_banks(spark):
    plain = spark.createDataFrame([(1, "What?", "4", "x")], "id long, question string, answer string, level string")
    row = qu.question_bank(plain).first()
    assert (row.prompt, row.answer) == ("What?", "4") and json.loads(row.metadata)["level"] == "x"
    both = spark.createDataFrame([("p", "q"), (None, "q")], "prompt string, question string")
    assert [tuple(r)[:2] for r in qu.question_bank(both).collect()] == [("p", None), ("q", None)]
    chat = spark.createDataFrame([([("user", "Solve."), ("user", "more")], ("7",)), ([], (None,))], "prompt array<struct<role: string, content: string>>, reward_model struct<ground_truth: string>")
    assert [tuple(r)[:2] for r in qu.question_bank(chat, count=2).collect()] == [("Solve.", "7"), (None, None)]
    with pytest.raises(ValueError, match="2 questions instead of 30"):
        qu.question_bank(chat, count=30)
    with pytest.raises(ValueError, match="prompt or a question"):
        qu.question_bank(spark.createDataFrame([(1,)], "id long"))


def test_strict_cells(spark):
    def cell(name, ids, seeds=(0, 1), k=2):
        return [(name, "t", s, i, "a" if p else None, p == 0) for s in seeds for i in ids for p in range(k)]

    rows = cell("good", range(3)) + cell("gap", [0, 1, 3]) + cell("short", range(3), k=1) + cell("seed", range(3), seeds=(0, 5)) + cell("few", range(2))
    got = {r.model: r for r in ga.strict_cell(spark.createDataFrame(rows, "model string, task string, seed long, instance_id long, answer string, truncated boolean"), 2, 6, [0, 1], 3).collect()}
    assert {m for m, r in got.items() if r.ok} == {"good"} and got["good"].null_rate == got["good"].cut_rate == 0.5
    assert got["gap"].not_contiguous == 2 and got["short"].malformed == 6 and got["seed"].other_seeds == 1 and got["few"].records == 4


def test_base_accuracy_is_that_of_sampling(spark):
    rows = [("low", "SC", 1)] * 1 + [("low", "SC", 0)] * 99 + [("low", "PT", 1)] * 9 + [("edge", "SC", 1)] * 2 + [("edge", "SC", 0)] * 98 + [("edge", "PT", 0)] + [("none", "PT", 1)]
    paths = spark.createDataFrame([(m, "t", a, y) for m, a, y in rows], "model string, task string, arm string, y long")
    got = {r.model: r.excluded for r in ma.base_accuracy(paths).collect()}
    assert got == {"low": True, "edge": False, "none": True}
    cells = spark.createDataFrame([("low", "t"), ("edge", "t"), ("other", "t")], "model string, task string")
    assert [r.model for r in ma.valid_cells(cells, paths).collect()] == ["edge"]


def test_report_tables(spark):
    rows = [("a", "t", "d", -10.0, 1.0, 0.5, 0.4, 0.6, 0.7, 0.3), ("b", "t", "d", -20.0, 3.0, 0.3, 0.2, 0.5, 0.5, 0.5), ("a", "u", "e", None, None, None, None, 0.1, 0.2, 0.1)]
    cells = spark.createDataFrame(rows, "model string, task string, domain string, drho_pct double, dkeff double, rho_sc double, rho_pt double, mv_sc double, mv_pt double, diversity double")
    t = {r.task: r for r in rp.task_table(cells).collect()}
    assert (t["t"].n_models, t["t"].mean_drho, t["t"].mean_dkeff, t["t"].mean_diversity) == (2, -15.0, 2.0, 0.4) and t["u"].mean_drho is None
    d = {r.domain: r for r in rp.domain_table(cells).collect()}
    assert (d["d"].least_drho, d["d"].most_drho) == (-20.0, -10.0) and d["d"].mean_gain == pytest.approx(5.0) and d["e"].std_gain is None
