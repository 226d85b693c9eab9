"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and including it, in a
shuffled order, divided by the source's target. A global sort by finish time, cut where the total
budget is used up, then takes from all sources at rates in proportion to their targets. A second
pass over a source (a repeat) simply continues its virtual time.

The sort is never done in one task: orders are cut in buckets of the (uniform) shuffle key and of
the virtual time, sums of buckets give the running totals between them, and windows only work
inside a bucket. What is broadcast in the end is one row a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, small, text_or_empty


def size_column(text: str = "text") -> Column:
    """Words of a text; null and empty texts have 0."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def shuffle_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A reproducible random order: hexadecimal MD5 of the id and the text."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), text_or_empty(text)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes; a target stops at ``repeats`` times its source's size and the excess is shared again by
    weight. Sorted by cap over weight, source i is capped exactly if its cap is at most its share of
    what the capped ones before it leave, so one window over the sources gives the fixed point.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w.cast("long")).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    filled = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("source_size").over(everything).cast("double")
    by = by.withColumn("free", budget - before.cast("double")).withColumn("left", left)
    by = by.withColumn("open", F.col("cap").cast("double") * F.col("left") > F.col("free") * F.col("w"))
    # the first open source's level holds for all open ones
    first = F.min(F.when(F.col("open"), F.struct(F.row_number().over(filled).alias("i"), F.col("free"), F.col("left"))))
    by = by.withColumn("level", first.over(everything))
    target = F.when(F.col("open"), F.col("level.free") * F.col("w") / F.col("level.left")).otherwise(F.col("cap").cast("double"))
    return by.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, scratch: Scratch, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target, k1, ... kn): a document with key <= k_e is taken in pass e.

    ``sized`` has (source, key, size). Rows of equal source and key are taken together.
    """
    n = sized.count()
    buckets = max(1, math.isqrt(n))
    targets = scratch.table(source_targets(sized, weights, share, repeats))
    n_sources = targets.count()
    budget = share * float(targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    bucket = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets, 32)
    rows = sized.where("size > 0").withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(sums.select("source", "bucket", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = rows.groupBy("source", "bucket", "key").agg(F.sum("size").alias("size"))
    run = units.withColumn("run", F.sum("size").over(inside))
    t = small(targets, n_sources)
    o = offsets.withColumnRenamed("source", "o_source").withColumnRenamed("bucket", "o_bucket")
    run = run.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))).drop("o_source", "o_bucket")
    t = t.select(F.col("source").alias("t_source"), "source_size", "target")
    run = run.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    turn = F.explode(F.array(*[F.lit(e).cast("long") for e in range(repeats)])).alias("turn")
    finish = (F.col("offset") + F.col("run") + F.col("turn") * F.col("source_size")).cast("double") / F.col("target")
    queue = run.select("source", "key", "size", "offset", "run", "source_size", "target", turn)
    queue = queue.withColumn("finish", finish)
    step = F.floor(F.col("finish") * buckets).cast("long")
    queue = scratch.table(queue.select("source", "key", "size", "turn", "finish", step.alias("step")))
    by_step = queue.groupBy("step").agg(F.sum("size").alias("s"))
    total = by_step.select("step", "s", F.sum("s").over(Window.orderBy("step")).alias("upto"))
    crossing = total.where(F.col("upto") > budget).orderBy("step").limit(1).select("step", (F.col("upto") - F.col("s")).alias("before")).first()
    pass_key = [F.max(F.when(F.col("turn") == e, F.col("key"))).alias(f"k{e + 1}") for e in range(repeats)]
    if crossing is None:  # the budget covers everything
        taken = queue
    else:
        at, before = crossing
        order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = queue.where(F.col("step") == at).withColumn("upto", F.sum("size").over(order) + F.lit(before))
        edge = edge.where(F.col("upto") <= budget).drop("upto")
        taken = queue.where(F.col("step") < at).unionByName(edge)
    keys = taken.groupBy("source").agg(*pass_key).withColumnRenamed("source", "k_source")
    out = scratch.table(targets.join(keys, F.col("source").eqNullSafe(F.col("k_source")), "left").drop("k_source"))
    scratch.drop(offsets, queue, targets)
    return out


def apply_plan(docs: DataFrame, plan: DataFrame, key: Column, size: Column, n_sources: int, repeats: int = 2) -> DataFrame:
    """docs with size, source_size, target, passes (times taken) and taken (words taken)."""
    p = small(plan, n_sources).withColumnRenamed("source", "plan_source")
    out = docs.withColumn("mix_key", key).withColumn("size", size)
    out = out.join(p, out["source"].eqNullSafe(F.col("plan_source")), "left")
    passes = sum((F.coalesce((F.col("mix_key") <= F.col(f"k{e + 1}")).cast("long"), F.lit(0)) for e in range(repeats)), F.lit(0))
    out = out.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("taken", F.col("passes") * F.col("size")).drop("plan_source", "mix_key", *[f"k{e + 1}" for e in range(repeats)])


def weighted_fair_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    Defined results: null or empty texts have size 0 and are never taken; null sources form one
    source, last in order; repeated rows (same id, text and source) are taken together; an empty
    table gives no rows; other columns of docs don't matter.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.table(docs.select("doc_id", "source", shuffle_key().alias("key"), size_column().alias("size")))
    plan = mix_plan(sized, scratch, weights, share, repeats)
    out = apply_plan(sized, plan, F.col("key"), F.col("size"), plan.count(), repeats)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix itself: the rows of docs that it takes, a row twice if it takes it twice, with docs' columns."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.table(docs.select("source", shuffle_key().alias("key"), size_column().alias("size")))
    plan = mix_plan(sized, scratch, weights, share, repeats)
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("row"), "doc_id", "text", "source")
    out = apply_plan(inner, plan, shuffle_key(), size_column(), plan.count(), repeats).where("passes > 0")
    scratch.drop(sized)
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes")))).select(*[F.col("row")[x].alias(x) for x in names])


#: The same rows in DuckDB: whole-table windows instead of buckets.
MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
    md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) k from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint w, 2 * source_size cap from s),
f as (select *, row_number() over o i, (1.5::double * (sum(source_size) over ())::double) - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::double free,
    (sum(w) over (o rows between current row and unbounded following))::bigint lft from w window o as (order by cap::double / w, source nulls last)),
g as (select *, cap::double * lft > free * w is_open from f),
h as (select * from g where is_open order by i limit 1),
t as (select g.source, g.source_size, case when is_open then (select free from h) * w / (select lft from h) else cap::double end target from g),
c as (select d.*, t.source_size, t.target, sum(size) over (partition by d.source order by k range between unbounded preceding and current row) run
    from d join t on d.source is not distinct from t.source),
q as (select doc_id, source, k, size, e, (run + e * source_size)::double / target finish from c, (select unnest([0, 1]) e) where size > 0),
u as (select *, sum(size) over (order by finish, source nulls last, k, e rows unbounded preceding) upto from q),
x as (select doc_id, source, k, sum(case when upto <= 1.5::double * (select sum(source_size) from s)::double then size else 0 end)::bigint taken from u group by all)
select c.doc_id, c.size, c.source_size, c.target, coalesce(x.taken, 0)::bigint taken
from c left join x on c.doc_id is not distinct from x.doc_id and c.source is not distinct from x.source and c.k = x.k
"""
