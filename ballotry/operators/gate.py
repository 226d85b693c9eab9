"""Quality gates: which cells are fit to be analysed, and why others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["model", "task"]


def uniform_provenance(records: DataFrame, fields: list[str]) -> DataFrame:
    """Number of different values of each field by cell; null counts as a value."""
    return records.groupBy(*CELL).agg(*[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("none given"))).alias(f) for f in fields])


def rates(paths: DataFrame, k: int) -> DataFrame:
    """Of each cell: records, malformed ones, and rates over records x k paths: extracted, lost with the
    cap hit, lost without, cap hits."""
    null, cut = F.col("answer").isNull(), F.col("truncated")
    recs = paths.groupBy(*CELL, "seed", "instance_id").agg(
        F.count("*").alias("n"), F.count_if(~null).alias("got"), F.count_if(null & cut).alias("loss"), F.count_if(null & ~cut).alias("silent"), F.count_if(cut).alias("cap"),
    )
    total = F.count("*") * F.lit(k)
    return recs.groupBy(*CELL).agg(
        F.count("*").alias("records"), F.count_if(F.col("n") != k).alias("malformed"), F.count_distinct("seed").alias("seeds"), F.count_distinct("instance_id").alias("instances"),
        *[(F.sum(c) / total).alias(f"{c}_rate") for c in ("got", "loss", "silent", "cap")],
    )


def protocol_gate(paths: DataFrame, asked: DataFrame | None = None, k: int = 32, least_instances: int = 100, least_seeds: int = 3, most_loss: float = 0.05) -> DataFrame:
    """One row a cell with the reasons against it; cap hits are reported and never count. Asked cells
    without records get one too."""
    r = rates(paths, k)
    if asked is not None:
        r = asked.join(r, CELL, "left")
    n = F.coalesce(F.col("records"), F.lit(0))
    reasons = F.array(
        F.when(n == 0, "No records"),
        F.when((n > 0) & (F.col("instances") < least_instances), F.concat(F.lit("Too few instances: "), F.col("instances").cast("string"))),
        F.when((n > 0) & (F.col("seeds") < least_seeds), F.concat(F.lit("Too few seeds: "), F.col("seeds").cast("string"))),
        F.when((n > 0) & (F.col("records") < F.col("instances") * F.col("seeds")), F.concat(F.lit("Incomplete grid: "), (F.col("instances") * F.col("seeds") - F.col("records")).cast("string"), F.lit(" missing"))),
        F.when(F.col("malformed") > 0, F.concat(F.lit("Malformed records: "), F.col("malformed").cast("string"))),
        F.when(F.col("loss_rate") > most_loss, "Harness loss above bound"),
    )
    out = r.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))
    return out.withColumn("admissible", F.size("reasons") == 0)


def strict_cell(paths: DataFrame, k: int, records: int, seeds: list[int], instances: int) -> DataFrame:
    """One row a cell: whether it holds exactly ``records`` records of k paths with the expected seeds and the ids 0 to
    ``instances`` - 1 in each, what is wrong otherwise, and rates of missing, empty and cut answers."""
    recs = paths.groupBy(*CELL, "seed", "instance_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("answer").isNull()).alias("null"), F.count_if(F.trim("answer") == "").alias("empty"), F.count_if("truncated").alias("cut"),
    )
    by_seed = recs.groupBy(*CELL, "seed").agg(
        F.count("*").alias("records"), F.count_if(F.col("n") != k).alias("malformed"), F.min("instance_id").alias("least"), F.max("instance_id").alias("most"), *[F.sum(c).alias(c) for c in ("n", "null", "empty", "cut")],
    )
    odd = ~F.col("seed").isin(seeds) | F.col("seed").isNull()
    # ids are different within a seed, so their number, least and most tell whether they are contiguous
    gaps = (F.col("records") != instances) | (F.col("least") != 0) | (F.col("most") != instances - 1)
    out = by_seed.groupBy(*CELL).agg(
        F.sum("records").alias("records"), F.count_if(~odd).alias("seeds"), F.count_if(odd).alias("other_seeds"), F.sum("malformed").alias("malformed"), F.count_if(gaps).alias("not_contiguous"),
        *[(F.sum(c) / F.sum("n")).alias(f"{c}_rate") for c in ("null", "empty", "cut")],
    )
    return out.withColumn("ok", (F.col("records") == records) & (F.col("seeds") == len(seeds)) & (F.col("other_seeds") == 0) & (F.col("malformed") == 0) & (F.col("not_contiguous") == 0))


def reporting_policy(gate: DataFrame) -> DataFrame:
    """Cells that fail by harness loss alone are admitted, with a flag."""
    only = (F.size("reasons") > 0) & F.forall("reasons", lambda x: F.startswith(x, F.lit("Harness loss")))
    return gate.withColumn("flagged", only).withColumn("admissible", F.col("admissible") | only)


def field_contract(records: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Records of each cell that break a field's expected value: top level and provenance must agree if present."""
    checks = [F.count_if(F.coalesce(F.col(f).cast("string") != v, F.lit(False)) | F.coalesce(F.col(f"p_{f}").cast("string") != v, F.lit(False)) | (F.col(f).isNull() & F.col(f"p_{f}").isNull())).alias(f) for f, v in expected.items()]
    return records.groupBy(*CELL).agg(*checks)


def seed_coverage(recs: DataFrame, n: int) -> DataFrame:
    """Per seed: count, expected, and the missing question ids as text."""
    got = recs.groupBy(*CELL, "seed").agg(F.sort_array(F.collect_set("instance_id")).alias("ids"))
    lost = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), F.col("ids"))
    return got.select(*CELL, "seed", F.size("ids").cast("long").alias("found"), F.lit(n).cast("long").alias("expected"), F.array_join(F.transform(lost, lambda x: x.cast("string")), ",").alias("missing"))


def matrix_contract(paths: DataFrame, k: int, least_rows: int = 2) -> DataFrame:
    """Cells as correctness matrices: rows, rows without exactly k paths, values other than 0 and 1, and whether all is well."""
    recs = paths.groupBy(*CELL, "arm", "seed", "instance_id").agg(F.count("*").alias("n"), F.count_if(~F.col("y").isin(0, 1)).alias("odd"))
    out = recs.groupBy(*CELL, "arm").agg(F.count("*").alias("rows"), F.count_if(F.col("n") != k).alias("wrong_k"), F.sum("odd").alias("not_binary"))
    return out.withColumn("ok", (F.col("rows") >= least_rows) & (F.col("wrong_k") == 0) & (F.col("not_binary") == 0))
