"""Bootstraps draw from every question of a cell, numbers are exact, and replicates are those of listed draws."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotry.operators import inference as inf
from ballotry.plans import replicates as rp
from ballotry.plans import resample as rs
from ballotry.plans.numbering import numbered
from ballotry.queries import QUERIES


@pytest.mark.parametrize("bucket_rows", [7, 100_000])
def test_numbers_follow_the_order(spark, bucket_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), i) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, "g string, v long, t long"), ["g"], "v", ["t"], size="m", bucket_rows=bucket_rows).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [(r.v, r.t) for r in sorted((r for r in got if r.g == g), key=lambda r: r.position)] == [(v, t) for _, v, t in own]
        assert {r.m for r in got if r.g == g} == {len(own)} and sorted(r.position for r in got if r.g == g) == list(range(len(own)))


def listed(m, k, reps, size):
    """The clusters that each replicate draws, one by one: dealt to blocks first, then within the block."""
    out = []
    for rep in range(reps):
        rep = np.int64(rep)
        blocks = Counter(int(rp.draw_index(rep, np.int64(d), 0, m)) // size for d in range(k)) if m > size else {0: k}
        out.append([b * size + int(rp.draw_index(rep, np.int64(j), b, min(size, m - b * size))) for b, n in blocks.items() for j in range(n)])
    return out


@pytest.mark.parametrize("draws", [None, 40])
@pytest.mark.parametrize("size,rows", [(4096, 200_000), (16, 9)])
def test_replicates_are_weighted_sums_of_listed_draws(spark, draws, size, rows):
    rng = random.Random(2)
    data = [(cell, q * 3, rng.randint(0, 5), float(q)) for cell, m in (("a", 50), ("b", 7), (None, 1)) for q in range(m) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(data, "cell string, question long, x long, y double")
    expand = lambda c: np.column_stack([np.ones(len(c["x"])), c["x"] * c["y"]])
    finish = lambda s: {"n": s[:, 0], "xy": s[:, 1]}
    got = rp.replicate_sums(df, ["cell"], ["question"], ["x", "y"], expand, finish, ["n", "xy"], 30, draws, size, rows).collect()
    for cell, m in (("a", 50), ("b", 7), (None, 1)):
        sums = np.array([[sum(1 for r in data if r[:2] == (cell, q * 3)), sum(r[2] * r[3] for r in data if r[:2] == (cell, q * 3))] for q in range(m)])
        own = {r.rep: (r.n, r.xy) for r in got if r.cell == cell}
        assert set(own) == set(range(-1, 30)) and np.allclose(own[-1], sums.sum(axis=0))
        for rep, drawn in enumerate(listed(m, draws or m, 30, size)):
            assert np.allclose(own[rep], sums[drawn].sum(axis=0))


def test_every_cluster_is_drawn_about_once(spark):
    drawn = Counter(q for rep in listed(300, 300, 200, 64) for q in rep)
    assert len(drawn) == 300 and 0.7 < min(drawn.values()) / 200 and max(drawn.values()) / 200 < 1.35


def test_mean_rho_is_that_of_the_matrix():
    rng = np.random.default_rng(3)
    votes = (rng.random((60, 6)) < 0.5 * rng.random((60, 1)) + 0.25).astype(float)
    votes[:, 4] = 1  # constant
    sums = rp.pair_products(votes).sum(axis=0)[None, :]
    r = np.corrcoef(votes[:, [0, 1, 2, 3, 5]].T)[np.triu_indices(5, 1)]
    assert np.isclose(rp.mean_pair_rho(np.array([60.0]), sums, 6)[0], r.mean())
    first = np.corrcoef(votes[:, :3].T)[np.triu_indices(3, 1)]
    assert np.isclose(rp.mean_pair_rho(np.array([60.0]), sums[:, rp.prefix_columns(3, 6)], 3)[0], first.mean())
    assert np.isnan(rp.mean_pair_rho(np.array([2.0]), np.array([[2.0, 2.0, 2.0]]), 2)[0])


def matched(spark, rows):
    return spark.createDataFrame(rows, "model string, task string, seed long, instance_id long, sc_mask long, pt_mask long")


def test_identical_arms_never_differ(spark):
    rng = random.Random(4)
    rows = [("m", "t", 0, i, x, x) for i in range(40) for x in [rng.choice([0, 3, 255, 254, 15, 240])]]
    got = inf.paired_rho_replicates(matched(spark, rows), 40).collect()
    assert len(got) == 41 and all(r.drho == 0 for r in got)


def test_records_of_other_lengths_are_an_error(spark):
    rows = [("m", "t", "SC", 0, i, p, "1", "1", 1, 10) for i in range(3) for p in range(31)]
    paths = spark.createDataFrame(rows, "model string, task string, arm string, seed long, instance_id long, path long, answer string, gold string, y long, gen_len long")
    with pytest.raises(Exception, match="32 paths"):
        inf.clustered_bootstrap(paths, 2).collect()


def test_a_plan_that_callers_bring(spark):
    clusters = spark.createDataFrame([("m", "t", i, 1.0, float(i)) for i in range(3)], "model string, task string, cluster_idx long, n double, v double")
    plan = spark.createDataFrame([(0, 0, 2), (0, 1, 2), (0, 2, 1), (1, 0, 0)], "rep long, draw long, cluster_idx long")
    got = {r.rep: (r.n, r.v) for r in rs.bootstrap_sums(clusters, plan, ["n", "v"]).collect()}
    assert got == {0: (3.0, 5.0), 1: (1.0, 0.0)}


def test_queries_use_all_questions(spark, tmp_path):
    # one cell of 130 questions
    orders = spark.range(650).select(F.col("id").alias("o_orderkey"), (F.col("id") % 13).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    reps = QUERIES["j08_resample_join"](spark, str(tmp_path))
    assert reps.count() == 1001
    point = reps.where("rep = -1").first().mv_all
    assert abs(reps.where("rep >= 0").agg(F.avg("mv_all")).collect()[0][0] - point) < 0.01
    sizes = {r.questions for r in QUERIES["i11_pilot_sensitivity"](spark, str(tmp_path)).collect()}
    assert sizes == {25, 50, 100, 200}
    assert QUERIES["i12_paired_rho_bootstrap"](spark, str(tmp_path)).collect()[0].draws > 0


def test_dealing_in_parts_of_the_cycle_counts_every_draw():
    sizes, draws, reps = [1000, 70], [1000, 3000], 12
    parts = [rp.dealt_counts(b, min(rp.MODULUS, b + (1 << 28)), sizes, draws, reps, 64) for b in range(0, rp.MODULUS, 1 << 28)]
    for c, (m, k) in enumerate(zip(sizes, draws)):
        got = np.zeros((reps, -(-m // 64)), np.int64)
        for part in parts:
            np.add.at(got, part[c][0], part[c][1])
        for rep in range(reps):
            assert (got[rep] == np.bincount(rp.draw_index(np.int64(rep), np.arange(k), 0, m) // 64, minlength=got.shape[1])).all()


def test_cells_of_a_size_share_draws():
    counts = np.array([[5, 900], [40, 0], [33_000, 7]])
    out = [np.zeros((2, 64)), np.zeros((2, 64)), np.zeros((2, 50))]
    rp.block_weights(3, counts, 2, [64, 64, 50], out)
    for c, size in enumerate((64, 64, 50)):
        for i in range(2):
            assert (out[c][i] == np.bincount(rp.draw_index(np.int64(3 + i), np.arange(counts[c, i]), 2, size), minlength=size)).all()


@pytest.mark.parametrize("bucket_rows", [7, 100_000])
def test_equal_rows_share_a_number(spark, bucket_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), rng.choice([None, 0, 1])) for _ in range(200)]
    got = numbered(spark.createDataFrame(rows, "g string, v long, t long"), ["g"], "v", ["t"], size="m", bucket_rows=bucket_rows, alike=True).collect()
    assert Counter((r.g, r.v, r.t) for r in got) == Counter(rows)
    for g in ("a", "b", None):
        keys = sorted({(v is not None, v or 0, t is not None, t or 0) for x, v, t in rows if x == g})
        for r in (r for r in got if r.g == g):
            assert (r.position, r.m) == (keys.index((r.v is not None, r.v or 0, r.t is not None, r.t or 0)), len(keys))


def test_paths_meet_their_cells_operating_point_where_they_are(spark):
    """Nothing of a cell's size is shuffled by cells, so no task holds all records of one."""
    import re

    from ballotry.sources.shared import with_cells, written

    rows = spark.range(500).selectExpr("concat('m', id % 1) model", "cast(id % 2 as string) task", "id instance_id").repartition(6, "model", "task", "instance_id")
    cells = written(spark.createDataFrame([("m0", "0", 1), ("m0", "1", 2)], "model string, task string, used int"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = with_cells(rows, cells, ["model", "task"])
        plan = met.groupBy("model", "task", "instance_id").agg(F.max("used").alias("used"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "BroadcastHashJoin" in plan
    assert {(r.task, r.used) for r in met.collect()} == {("0", 1), ("1", 2)} and met.count() == 500
