"""Audit of the order in which filters are applied.

All k! orders of k filters are the paths of the lattice of subsets: an order walks from the empty set
to the full one, and the edge (S, f) is "f is applied when S has been". What an edge removes depends
on S and f alone, so k 2^(k-1) edges hold what k! orders do. Paths are counted forward (orders that
reach S) and backward (orders that leave it for the full set); an edge lies on forward(S) times
backward(S + f) orders, which weights its removals for the Shapley sums, and each order's steps are
read from the same edges.

Documents are reduced to a histogram of (part, failed filters, quality, toxicity) before the lattice:
its rows don't grow with the documents. Texts never leave the scan: duplicates meet by their SHA-256.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The name of the filter that removes texts which a smaller id has already.
REPEATED = "E"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_failures(text: Column) -> list[tuple[str, Column]]:
    """The failure conditions that a text alone decides, in the order of their letters."""
    words = words_of(text)
    return [
        ("A", F.size(words) < 100),
        ("B", 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)),
        ("C", 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(text).cast("long")),
        ("D", text.rlike(r"[#$%&*|]")),
    ]


@cache
def lattice(k: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """Edges (set before, filter, orders through it) of the lattice of k filters, and the orders."""
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for s in range(full + 1):
        for f in range(k):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in range(full, -1, -1):
        for f in range(k):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    edges = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]
    return edges, [list(order) for order in permutations(range(k))]


def failure_histogram(docs: DataFrame, labels: DataFrame, failures: list[tuple[str, Column]], repeated: bool = True) -> DataFrame:
    """(part, mask, good, toxic, n): documents by language, failed filters (bit i: the i-th condition, the last
    bit: repeated texts) and labels. ``failures`` are conditions on a column ``text`` without nulls."""
    flags = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(failures)]
    mask = sum(flags[1:], flags[0]) if flags else F.lit(0)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    narrow = base.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("h") if repeated else F.lit(None).cast("binary").alias("h"))
    # rows without an id have no label: a number of their text spreads them over the join
    narrow = narrow.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("part", "mask", "h"), F.lit(4096))).otherwise(F.lit(0)))
    rows = narrow.groupBy("doc_id", "spread", "part", "mask", "h").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marked = rows.join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").select(
        "doc_id", "part", "mask", "h", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    keys = ["part", "mask", "good", "toxic"]
    if not repeated:
        return marked.groupBy(*keys).agg(F.sum("n").alias("n"))
    # of each text: its documents by part, mask and labels, with the smallest id among them, how many rows have that
    # id, and how many rows have no id; a hot text leaves each task as a few rows
    has_id = F.col("doc_id").isNotNull()
    by_text = marked.groupBy("h", *keys).agg(
        F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("n_null"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    firsts = F.struct(F.col("first.doc_id").alias("doc_id"), *keys, F.col("n"), F.col("n_null"), F.col("first.n").alias("at_first"))
    texts = by_text.groupBy("h").agg(F.min("first.doc_id").alias("smallest"), F.collect_list(firsts).alias("kinds"))
    bit = 1 << len(failures)
    kinds = texts.select("smallest", F.inline("kinds"))
    unique = F.col("n_null") + F.when(F.col("doc_id") == F.col("smallest"), F.col("at_first")).otherwise(F.lit(0))
    split = kinds.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), unique.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") + F.col("n_null") - unique).alias("n")),
    )))
    return split.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"))


def edge_table(histogram: DataFrame, k: int) -> DataFrame:
    """(part, before, f, orders and counts) of every edge of the lattice, zeros included."""
    edges, _ = lattice(k)
    every = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(n).cast("long").alias("orders")) for s, f, n in edges])
    rows = histogram.select("part", "mask", "good", "toxic", "n", F.inline(every))
    fails, alive = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0))).cast("long")
    return rows.groupBy("part", "before", "f", "orders").agg(
        count(alive & ~fails).alias("kept"), count(alive & fails).alias("removed"), count(~alive & fails).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(alive & fails & F.col("good")).alias("good_lost"), count(alive & fails & F.col("toxic")).alias("toxic_lost"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame, failures: list[tuple[str, Column]] | None = None, repeated: str | None = REPEATED) -> DataFrame:
    """One row per part (language), order of the filters and step: what the step keeps and removes, what it would have
    removed had earlier filters not done so, what only its filter removes, the labelled documents that it loses, and
    its filter's removals summed over all orders. ``failures`` are at most eight named conditions on ``text``;
    ``repeated`` names the filter of repeated texts, None leaves it out.

    Defined results: null languages are the empty one; null texts are empty; equal texts of one id don't repeat each
    other, a row without an id neither repeats nor is repeated and has no label; of several labels of an id one
    suffices; a condition that is null doesn't fail; an empty table gives no rows; other columns don't matter.
    """
    failures = text_failures(F.col("text")) if failures is None else failures
    names = [name for name, _ in failures] + ([repeated] if repeated else [])
    k = len(names)
    if not 1 <= k <= 8:
        raise ValueError("orders of one to eight filters can be listed")
    edges = edge_table(failure_histogram(docs, labels, failures, repeated is not None), k)
    per_filter = edges.groupBy("part", "f").agg(F.collect_list(F.struct("before", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")).alias("sets"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    weighted = per_filter.select("part", "f", "shapley", F.inline("sets"))
    steps = [
        (sum(1 << g for g in order[:i]), f, "".join(names[g] for g in order), i + 1)
        for order in lattice(k)[1] for i, f in enumerate(order)
    ]
    # k k! rows fixed by the number of filters
    spark = docs.sparkSession
    walks = F.broadcast(spark.createDataFrame(steps, "before int, f int, filter_order string, step int"))
    return weighted.join(walks, ["before", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley")
    )


#: The same in DuckDB: every order replayed on the documents' failures.
AUDIT_SQL = r"""
with d as (select doc_id::bigint doc_id, coalesce(lang, '') part, coalesce(text, '') text from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from d),
s as (select doc_id, part, case when len(ws) < 100 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when min(doc_id) over (partition by text) < doc_id then 'E' else '' end fails from w),
l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
h as (select part, fails, coalesce(good, 0) good, coalesce(toxic, 0) toxic, count(*) n from s left join l using (doc_id) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from f a, f b, f c, f d, f e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
q as (select filter_order, range::int step, filter_order[range] x, filter_order[1:range - 1] earlier from o, range(1, 6)),
r as (select part, filter_order, step, x, n, good, toxic, contains(fails, x) own, fails = x only_own,
    len(list_intersect(string_split(earlier, ''), string_split(fails, ''))) > 0 and earlier <> '' and fails <> '' gone from h, q),
t as (select part, filter_order, step, x,
    coalesce(sum(n) filter (not gone and not own), 0)::bigint kept, coalesce(sum(n) filter (not gone and own), 0)::bigint removed,
    coalesce(sum(n) filter (gone and own), 0)::bigint redundant, coalesce(sum(n) filter (only_own), 0)::bigint unique_fails,
    coalesce(sum(n) filter (not gone and own and good = 1), 0)::bigint good_lost, coalesce(sum(n) filter (not gone and own and toxic = 1), 0)::bigint toxic_lost
    from r group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, x))::bigint shapley from t
"""
