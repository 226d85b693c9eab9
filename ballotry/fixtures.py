"""Views that the registered queries derive from the given tables.

Each is one SQL text that Spark and DuckDB both evaluate, with 64-bit integer arithmetic only, so
that results can be compared value by value. ``{range}`` and the table names differ by engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotry.plans.numbering import numbered
from ballotry.sources.records import nest_paths
from ballotry.sources.shared import new_folder

#: Sampled paths: 5 models x 3 tasks, two arms (SC with 32 paths, PT with 8) over the orders table.
RECORDS = """
with o as (select cast(substr(o_orderpriority, 1, 1) as bigint) m, o_orderpriority model, cast(ascii(o_orderstatus) as bigint) t, o_orderstatus task,
    cast(o_custkey as bigint) ck, cast(o_orderkey as bigint) ok,
    cast(row_number() over (partition by o_orderpriority, o_orderstatus order by o_orderkey) - 1 as bigint) rn from {orders}),
r as (select *, rn % 5 seed, cast((rn - rn % 5) / 5 as bigint) instance_id from o),
"""
FROM_RECORDS = """e as (select r.*, a.arm, p.path, (instance_id * 7919 + t * 104729 + m * 31) % 1000 d,
    (ok * 2654435 + (p.path + 1) * 40503 + p.path * ck * 977 + a.arm * 7577 * (p.path + 3)) % 1000 u
    from r cross join (select cast(0 as bigint) arm union all select cast(1 as bigint) arm) a cross join {range32} p where a.arm = 0 or p.path < 8),
y as (select *, case when (m = 1 and t = 80 and 2 * d + u < 60)
    or (not (m = 1 and t = 80) and (case when arm = 0 then 2 * d + u else d + 2 * u end) < 1400 + 60 * m - 6 * path * arm * m) then 1 else 0 end correct from e)
select model, task, case when arm = 0 then 'SC' else 'PT' end arm, seed, instance_id, path,
    cast((instance_id * 37) % 1000 as varchar(20)) gold,
    case when u % 50 = 0 then null when correct = 1 then cast((instance_id * 37) % 1000 as varchar(20))
         else cast((instance_id * 37 + 1 + u % 4) % 1000 as varchar(20)) end answer,
    u % 20 = 0 truncated, 100 + u gen_len, cast(case when u % 50 = 0 then 0 else correct end as bigint) y
from y
"""
PATHS = RECORDS + FROM_RECORDS

#: Resample plan: reps x draws, each with a cluster index below {m}.
PLAN = """
with z as (select rep, draw, ((rep + 1) * 48271 + (draw + 1) * 69621) % 1000003 z from {reps} cross join {draws}),
w as (select rep, draw, (z * z % 1000003) * 7919 % 1000003 v from z)
select rep, draw, (v * v + 31 * v) % 1000003 % {m} cluster_idx from w
"""

#: Texts that end in answer markers.
TRACES = """
select doc_id % 5 cell, doc_id, coalesce(text, '') || case doc_id % 8
    when 0 then chr(10) || '#### 1,' || lpad(cast(doc_id % 1000 as varchar(9)), 3, '0')
    when 1 then ' {slash}boxed{{' || cast(doc_id % 97 as varchar(9)) || '}}'
    when 2 then chr(10) || 'The final answer is ' || cast(doc_id % 89 as varchar(9)) || '.'
    when 3 then chr(10) || 'x = ' || cast(doc_id % 83 as varchar(9))
    when 4 then chr(10) || 'total: ' || cast(doc_id % 79 as varchar(9))
    when 5 then chr(10) || '#### yes' when 6 then chr(10) || 'Answer: (B)' else '' end trace,
    doc_id % 10 = 0 truncated,
    cast(case doc_id % 8 when 0 then 1000 + doc_id % 1000 when 1 then doc_id % 97 when 2 then doc_id % 89
         when 3 then doc_id % 83 when 4 then doc_id % 79 else doc_id end as varchar(20)) gold
from {documents}
"""


def table(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`"


#: Orders of a partition of ``paths``, about; each gives 40 paths.
PARTITION_ORDERS = 25_000
#: Orders for which each cell gets one more record file (some 100 MB).
FILE_ORDERS = 2_000_000


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view by question: all paths of one lie in one partition, and partitions follow the number of orders, so
    groups of a record or a question need no shuffle of paths. ``numbered`` is the view's row_number."""
    text = table(sf_dir, "orders")
    orders = spark.sql(f"select o_orderpriority model, o_orderstatus task, cast(substr(o_orderpriority, 1, 1) as bigint) m, cast(ascii(o_orderstatus) as bigint) t, cast(o_custkey as bigint) ck, cast(o_orderkey as bigint) ok from {text}")
    r = numbered(orders, ["model", "task"], "ok", name="rn").selectExpr("*", "rn % 5 seed", "cast((rn - rn % 5) / 5 as bigint) instance_id")
    n = max(2 * spark.sparkContext.defaultParallelism, -(-orders.count() // PARTITION_ORDERS))
    r = r.repartition(n, "model", "task", "instance_id")
    return spark.sql("with r as (select * from {records}),\n" + FROM_RECORDS.format(range32="(select id path from range(32))"), records=r)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACES.format(documents=table(sf_dir, "documents"), slash="\\\\"))


def record_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON-lines record files <model>__<task>.<n>.jsonl of the SC arm, one record a line; a cell has a file
    for each FILE_ORDERS orders of all cells. Records of even questions have the token cap in their provenance, the
    others at top level."""
    base = new_folder(spark)
    at_top = F.col("instance_id") % 2 == 1
    files_of_cell = -(-read(spark, sf_dir, "orders").count() // FILE_ORDERS) or 1
    rows = nest_paths(paths(spark, sf_dir).where("arm = 'SC'")).select(
        F.concat_ws("__", F.regexp_replace("model", " ", "_"), "task").alias("cell"),
        F.to_json(F.struct(
            F.col("model").alias("model_slug"), F.lit("sc").alias("method"), "task", F.size("answers").alias("K"), "seed", "instance_id", F.col("gold").alias("gold_answer"),
            F.col("answers").alias("all_answers"), "gen_lens", "truncated", F.when(at_top, 512).alias("max_tokens"), F.struct(F.when(~at_top, 256).alias("max_tokens")).alias("provenance"),
        )).alias("value"),
        F.pmod(F.hash("seed", "instance_id"), F.lit(files_of_cell)).alias("file"),
    )
    rows.repartition(64 * files_of_cell, "cell", "file").drop("file").write.partitionBy("cell").text(f"{base}/parts")
    # names are metadata: one rename a file
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{base}/records"))
    for folder in files.listStatus(path(f"{base}/parts")):
        name = folder.getPath().getName()
        if name.startswith("cell="):
            for n, part in enumerate(files.listStatus(folder.getPath())):
                files.rename(part.getPath(), path(f"{base}/records/{name[5:]}.{n}.jsonl"))
    return f"{base}/records"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same for DuckDB, as common table expressions.
PATHS_SQL = "paths as (" + PATHS.format(orders="orders", range32="(select range path from range(32))") + ")"
RECS_SQL = "recs as (select model, task, arm, seed, instance_id, count(*) k, sum(y)::bigint s, sum((1::bigint << path::int) * y)::bigint mask from paths group by all)"
TRACES_SQL = "traces as (" + TRACES.format(documents="documents", slash="\\") + ")"


def plan_sql(reps: int, draws: int, clusters: int) -> str:
    return "plan as (" + PLAN.format(reps=f"(select range rep from range({reps}))", draws=f"(select range draw from range({draws}))", m=clusters) + ")"
