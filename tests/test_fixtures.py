"""The derived views are those of their SQL and dealt in parts that follow the data."""

from pyspark.sql import functions as F

from ballotry import fixtures as fx
from ballotry.operators import votes as vo
from ballotry.plans import numbering as nu


def orders(spark, folder, n):
    rows = spark.range(n).select((F.col("id") * 7 % 10007).alias("o_orderkey"), (F.col("id") % 13).alias("o_custkey"), F.concat((F.col("id") % 3 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority"), F.element_at(F.array(F.lit("O"), F.lit("F")), (F.col("id") % 2 + 1).cast("int")).alias("o_orderstatus"))
    rows.write.parquet(f"{folder}/orders.parquet")


def test_paths_are_those_of_the_sql(spark, tmp_path):
    orders(spark, tmp_path, 300)
    want = spark.sql(fx.PATHS.format(orders=fx.table(str(tmp_path), "orders"), range32="(select id path from range(32))"))
    got = fx.paths(spark, str(tmp_path))
    assert got.dtypes == want.dtypes and got.count() == 300 * 40
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_records_need_no_shuffle_of_paths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "PARTITION_ORDERS", 10)
    orders(spark, tmp_path, 300)
    paths = fx.paths(spark, str(tmp_path))
    homes = paths.select("model", "task", "instance_id", F.spark_partition_id().alias("home")).distinct()
    assert homes.count() == homes.drop("home").distinct().count() == 60
    assert homes.select("home").distinct().count() > 12  # 6 cells
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(vo.plurality(paths)) == shuffles(vo.bucket_ranks(paths)) == shuffles(paths) > 0


def test_runs_of_cuts_count_like_all_cuts(spark):
    for n in (0, 1, 2, 3, 10, 37):
        cuts = [float(2 * i) for i in range(n)]
        rows = spark.createDataFrame([(float(v),) for v in range(-1, 2 * n + 3)], "v double").select("v", nu._cuts_below(cuts, F.col("v")).alias("b")).collect()
        assert all(r.b == sum(c < r.v for c in cuts) for r in rows)


def test_files_of_a_cell_follow_the_orders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "PARTITION_ORDERS", 10)  # more partitions than files
    orders(spark, tmp_path, 300)
    for most, n in ((1_000_000, 1), (150, 2)):
        monkeypatch.setattr(fx, "FILE_ORDERS", most)
        folder = fx.record_files(spark, str(tmp_path))
        files = spark.read.text(folder).select("_metadata.file_name", "value")
        assert files.count() == 300 and files.select("file_name").distinct().count() == 6 * n


def test_key_sets_shuffle_a_row_a_record_and_side(spark, tmp_path):
    from ballotry.queries import QUERIES

    orders(spark, tmp_path, 300)
    got = QUERIES["u01_key_sets"](spark, str(tmp_path))
    gone = fx.paths(spark, str(tmp_path)).where("arm = 'SC' and instance_id % 41 = 0 and path = 31").count()
    assert {r.kind: r.n for r in got.collect()} == {"missing": gone, "common": 300 * 32 - gone} and gone > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "path#" in x]


def test_key_sets_are_those_of_set_operations(spark):
    from ballotry.operators import matching as ma

    a = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("x", None), (None, 1), (None, None), ("y", 5)], "r string, i long")
    b = spark.createDataFrame([("x", 2), ("x", None), (None, None), ("z", 1)], "r string, i long")
    for left, right in ((a, b), (b, a), (a, a.limit(0)), (a.limit(0), b)):
        got = {x.kind: x.n for x in ma.key_sets(left, right, ["r"], "i").collect()}
        assert got == {"missing": left.subtract(right).count(), "common": left.intersect(right).count()}
