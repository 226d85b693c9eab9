"""Record sources: JSON lines with parallel lists per record, and their path tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Provenance fields of a record; all optional, and some writers put them at top level.
PROVENANCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("script_version", "extractor_version", "model_id", "prompt_sha", "scorer", "attn_implementation", "chat_template_flag", "template_family")]
    + [T.StructField(n, T.IntegerType()) for n in ("max_new_tokens", "max_tokens", "batch_paths")]
    + [T.StructField(n, T.DoubleType()) for n in ("temperature", "top_p")]
    + [T.StructField("reasoning", T.BooleanType())]
)
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("model_slug", "method", "task", "key", "gold_answer", "template_family", "attn_implementation")]
    + [T.StructField(n, T.IntegerType()) for n in ("K", "seed", "instance_id", "max_new_tokens", "max_tokens")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("all_answers", "all_traces", "slot_names")]
    + [T.StructField("gen_lens", T.ArrayType(T.IntegerType())), T.StructField("truncated", T.ArrayType(T.BooleanType()))]
    + [T.StructField(n, T.DoubleType()) for n in ("timestamp", "elapsed", "temperature")]
    + [T.StructField("provenance", PROVENANCE)]
)
_CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines files; blank lines are skipped and the first unparsable one fails the job."""
    schema = T.StructType([*RECORD.fields, T.StructField(_CORRUPT, T.StringType())])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    checked = F.when(F.col(_CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit("unparsable record: "), F.substring(_CORRUPT, 1, 80))).cast("int"))
    return raw.withColumn("K", F.coalesce(checked, F.col("K"))).drop(_CORRUPT)


def field(name: str) -> Column:
    """A provenance field: the value in provenance, else the one at top level."""
    return F.coalesce(F.col(f"provenance.{name}"), F.col(name))


def file_cells(records: DataFrame) -> DataFrame:
    """(model, task) of each file, parsed from its name <model>__<task>.jsonl, with its record count; a large
    cell may have several files, numbered <model>__<task>.<n>.jsonl."""
    name = F.col("_metadata.file_name")
    parts = [F.regexp_extract(name, r"^(.+)__([^.]+)(?:\.[0-9]+)?\.jsonl?$", i) for i in (1, 2)]
    return records.select(parts[0].alias("model"), parts[1].alias("task")).groupBy("model", "task").agg(F.count("*").alias("n"))


def candidate_cells(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked cells with the count found; those without a file stay, with a null count."""
    return asked.join(found, ["model", "task"], "left")


def explode_paths(records: DataFrame) -> DataFrame:
    """Parallel lists to path rows; positions that a list lacks are null."""
    lists = [c for c in ("answers", "gen_lens", "truncated") if c in records.columns]
    zipped = F.arrays_zip(*lists)
    rest = [c for c in records.columns if c not in lists]
    rows = records.select(*rest, F.posexplode(zipped).alias("path", "z"))
    one = {"answers": "answer", "gen_lens": "gen_len", "truncated": "truncated"}
    return rows.select(*rest, F.col("path").cast("long").alias("path"), *[F.col(f"z.{c}").alias(one[c]) for c in lists])


def nest_paths(paths: DataFrame) -> DataFrame:
    """Path rows to records with parallel lists, in path order."""
    key = ["model", "task", "arm", "seed", "instance_id"]
    row = F.struct("path", "answer", "gen_len", "truncated")
    nested = paths.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("r"), F.max("gold").alias("gold"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    return nested.select(*key, "gold", pick("answer").alias("answers"), pick("gen_len").alias("gen_lens"), pick("truncated").alias("truncated"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def load_legacy(rows: DataFrame, keys: list[str], order: list[str], method: str | None = None, seeds: list[int] | None = None) -> DataFrame:
    """Legacy records: filtered, those without a key rejected, then the first seen of each key."""
    kept = rows.where(F.col("key").isNotNull())
    if method is not None:
        kept = kept.where(F.col("method") == method)
    if seeds is not None:
        kept = kept.where(F.col("seed").isin(seeds))
    return first_seen(kept, keys, order)


RECORD_KEY = ["model", "task", "seed", "instance_id"]


def pending(needed: DataFrame, done: DataFrame, k: int) -> DataFrame:
    """Keys of the needed grid that have no complete record (k answers) yet."""
    complete = done.where(F.col("n_answers") == k).select(*RECORD_KEY).distinct()
    return needed.join(complete, RECORD_KEY, "left_anti")


def resume_mismatches(done: DataFrame, expected: dict[str, object], prompts: DataFrame | None = None) -> DataFrame:
    """(model, task, field, expected, found, records): what existing records say otherwise than the current run, a
    missing field included. ``prompts`` (model, task, instance_id, prompt_sha) are the current prompts' hashes; records
    of questions that it doesn't have aren't compared with it."""
    pairs = [F.struct(F.lit(f).alias("field"), F.lit(str(v)).alias("expected"), F.col(f).cast("string").alias("found")) for f, v in expected.items()]
    if prompts is not None:
        now = prompts.select("model", "task", "instance_id", F.col("prompt_sha").alias("__now"), F.lit(True).alias("__asked"))
        done = done.join(now, ["model", "task", "instance_id"], "left")
        pairs.append(F.when(F.col("__asked"), F.struct(F.lit("prompt_sha").alias("field"), F.col("__now").alias("expected"), F.col("prompt_sha").alias("found"))))
    rows = done.select("model", "task", F.explode(F.array(*pairs)).alias("p")).where("p is not null").select("model", "task", "p.*")
    return rows.where(~F.col("expected").eqNullSafe(F.col("found"))).groupBy("model", "task", "field", "expected", "found").agg(F.count("*").alias("records"))


def resume(needed: DataFrame, done: DataFrame, k: int, expected: dict[str, object], prompts: DataFrame | None = None) -> DataFrame:
    """``pending`` as a contract: an error that names fields if any existing record was made otherwise."""
    bad = resume_mismatches(done, {**expected, "K": k}, prompts).orderBy("model", "task", "field").limit(5).collect()  # a few for the message
    if bad:
        raise ValueError("existing records don't fit this run: " + "; ".join(f"{r.model}/{r.task} {r.field}: {r.found} instead of {r.expected} in {r.records}" for r in bad))
    return pending(needed, done, k)


def provenance_mismatches(records: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Fields of records that differ from the expected values: (field, expected, found, n)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("expected"), F.col(f).cast("string").alias("found")) for f, v in expected.items()])
    rows = records.select(F.explode(pairs).alias("p")).select("p.*")
    return rows.where(~F.col("expected").eqNullSafe(F.col("found"))).groupBy("field", "expected", "found").agg(F.count("*").alias("n"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, md5, bytes): MD5 of each file's bytes; files without bytes give no row, as Spark doesn't scan them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_name").alias("file"), F.md5("content").alias("md5"), F.length("content").cast("long").alias("bytes"))


def key_fingerprint(keys: DataFrame, by: list[str]) -> DataFrame:
    """MD5 of a cell's sorted (seed, instance) list, written [[seed, instance], ...]."""
    pairs = F.sort_array(F.collect_set(F.struct("seed", "instance_id")))
    text = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["seed"].cast("string"), F.lit(", "), x["instance_id"].cast("string"), F.lit("]"))), ", "), F.lit("]"))
    return keys.groupBy(*by).agg(pairs.alias("p")).select(*by, F.md5(text).alias("md5"))
