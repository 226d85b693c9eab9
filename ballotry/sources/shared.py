"""The folder that all executors of a cluster see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of cells up to which it is broadcast (some 16 MB).
CELL_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a temporary folder on a local master, as in tests,
    and an error on a cluster, whose executors wouldn't share it."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have


def new_folder(spark: SparkSession) -> str:
    """A folder of one's own below it."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and later steps survive lost executors."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_cells(rows: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """rows with the other columns of a written table of one row a cell; nulls in ``on`` are equal. The table is counted
    and broadcast up to CELL_ROWS rows, so rows stay where they were dealt: few cells hold all rows, and a shuffle by
    them would gather each cell in one task."""
    few = F.broadcast(cells) if cells.count() <= CELL_ROWS else cells
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in on]
    return rows.alias("r").join(few.alias("c"), same).select("r.*", *[F.col(f"c.{c}") for c in cells.columns if c not in on])
