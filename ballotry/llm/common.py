"""Shared helpers: intermediate tables in the cluster's shared folder, joins of checked size,
connected components, and streaming over the runs of a sorted key."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ballotry.sources.shared import new_folder

#: Bytes of a side that may be broadcast, and bytes that a counted row of a few numbers and an entry of its lists
#: take in a hash table.
BROADCAST_BYTES = 64 << 20
ROW_BYTES, ENTRY_BYTES = 160, 48
#: Arrow batches to Python workers: records and bytes at most, so that long texts don't add up.
BATCH_RECORDS, BATCH_BYTES = 1_000, 8 << 20
#: Rows and bytes of texts and lists after which results of runs go back to Spark: worker and executor hold them at once.
RESULT_ROWS, RESULT_BYTES = 20_000, 2 << 20

#: Spark's setting by which the shuffle files of an execution go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's defaults (10,000 rows) unless the session asks for fewer rows."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_RECORDS or int(spark.conf.get(rows)) <= 0:
        spark.conf.set(rows, str(BATCH_RECORDS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which the worker gives the memory that is free again back to the system. Spark keeps workers
    for later stages, and without this each holds what its largest task once took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library than glibc
            pass

    return run


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes those that no later step reads; what the returned DataFrame reads stays. Shuffle files of a step
    aren't read again once its table is written, but Spark keeps them until the driver collects its garbage; ``table``
    has them removed with the write.
    """

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark = spark
        self.root = new_folder(spark)
        self.paths: dict[int, str] = {}
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            if path := self.paths.pop(id(table), None):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, entries: int = 0) -> DataFrame:
    """Broadcast hint if the counted rows, and all entries of their lists together, are within the bound of bytes;
    beyond it Spark shuffles instead."""
    return F.broadcast(df) if rows * ROW_BYTES + entries * ENTRY_BYTES <= BROADCAST_BYTES else df


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id that edges (u, v) of long ids connect to each id.

    Each round maps every vertex to its smallest neighbour's smallest neighbour and contracts the
    edges, so that chains shrink geometrically. All steps are joins and aggregations; hot vertices
    are pre-aggregated before the shuffle, and skewed joins are left to adaptive execution.
    """
    e = scratch.table(
        edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    labels = None
    while True:
        if not e.take(1):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("m"))
        step = scratch.table(near)
        again = step.select(F.col("id").alias("m"), F.col("m").alias("root"))
        hop = scratch.table(step.join(again, "m").select("id", "root"))
        new = hop if labels is None else scratch.table(
            labels.withColumnRenamed("component", "at").join(hop.select(F.col("id").alias("at"), "root"), "at", "left").select("id", F.coalesce("root", "at").alias("component"))
        )
        if labels is None:
            new = hop.withColumnRenamed("root", "component")
        to = lambda end: hop.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
        e2 = scratch.table(
            e.join(to("u"), "u").join(to("v"), "v").where("u_root <> v_root").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct()
        )
        scratch.drop(e, step)
        e, labels = e2, new
    if labels is None:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys in batches that are sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        begin = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, k
        if begin < len(keys):
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def by_runs(df: DataFrame, key: str, work: Callable[[pa.Table], dict[str, list]], schema: str | StructType, partitions: int | None = None) -> DataFrame:
    """Apply ``work`` to all rows of each key. One sort and one Python call a partition, so that
    many small groups cost little; groups must be bounded by the caller. Results go back by the
    number of their rows and by their bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    wide = [(f.name, 8 if pa.types.is_list(f.type) else 1) for f in arrow if not pa.types.is_primitive(f.type)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = {name: [] for name in arrow.names}, 0, 0
        for group in runs(batches, key):
            got = work(group)
            for name, values in got.items():
                held[name].extend(values)
            n += len(next(iter(got.values())))
            size += sum(width * len(x) for name, width in wide for x in got[name] if x is not None)
            if n >= RESULT_ROWS or size >= RESULT_BYTES:
                batch = pa.record_batch([pa.array(held[f.name], f.type) for f in arrow], schema=arrow)
                held, n, size = {name: [] for name in arrow.names}, 0, 0
                del got
                yield batch
        if n:
            yield pa.record_batch([pa.array(held[f.name], f.type) for f in arrow], schema=arrow)

    dealt = df.repartition(partitions, key) if partitions else df.repartition(key)
    return dealt.sortWithinPartitions(key).mapInArrow(lean(each), schema)


#: Words of the contracts: runs of anything but 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
