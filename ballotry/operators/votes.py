"""Votes over the sampled paths of a record.

A path table has one row for each (model, task, arm, seed, instance_id, path) with the answer and
its correctness ``y``. Binary votes need only the number of correct paths, so one aggregation to
records carries them all; plurality votes group by answer bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotry.sources.shared import with_cells, written

CELL = ["model", "task", "arm"]
RECORD = [*CELL, "seed", "instance_id"]


#: Paths of a word of a mask.
WORD_PATHS = 63
#: Ballots of a task, about: their files are small, so a task by bytes would have too many.
TASK_BALLOTS = 200_000


def _words(width: int, vote: Column | None = None) -> list[Column]:
    """Bits of the correct paths (or of those that ``vote`` is 1 for) in words of 63; paths from ``width`` on are an error."""
    vote = F.col("y") if vote is None else vote
    out = []
    for begin in range(0, width, WORD_PATHS):
        at = F.col("path").cast("int") - begin
        bit = F.when((at >= 0) & (at < WORD_PATHS), F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(at, F.lit(0)) % 64) * vote).otherwise(F.lit(0).cast("long"))
        out.append(F.sum(F.when(F.col("path") < max(width, WORD_PATHS), bit).otherwise(F.raise_error(F.lit(f"vote masks hold {max(width, WORD_PATHS)} paths")).cast("long"))))
    return out


def records(paths: DataFrame, width: int = WORD_PATHS) -> DataFrame:
    """One row a record: k paths, s correct ones, and their bit mask: a number for up to 63 paths, for a larger
    ``width`` an array of words. More paths than that are an error."""
    words = _words(width)
    return paths.groupBy(*RECORD).agg(F.count("*").alias("k"), F.sum("y").alias("s"), (words[0] if len(words) == 1 else F.array(*words)).alias("mask"))


def prefix_records(paths: DataFrame, upto: dict[str, Column], width: int = WORD_PATHS) -> DataFrame:
    """One row a record: paths, mask as in ``records``, and for each named bound on path a struct (name, k paths, s correct ones,
    won: whether the plurality answer is correct, tokens). Missing answers don't vote, ties go to the answer that came first."""
    first = {n: F.col("path") < bound for n, bound in upto.items()}
    own = []
    for n, inside in first.items():
        own += [F.count_if(inside).alias(f"k_{n}"), F.sum(F.when(inside, F.col("y")).otherwise(0)).alias(f"s_{n}"), F.sum(F.when(inside, F.col("gen_len")).otherwise(0)).alias(f"t_{n}")]
    by_answer = paths.groupBy(*RECORD, "answer").agg(F.count("*").alias("paths"), *[w.alias(f"m_{i}") for i, w in enumerate(_words(width))], F.min("path").alias("first"), F.max("y").alias("y"), *own)
    parts = []
    for n in first:
        votes = F.when(F.col("answer").isNotNull() & (F.col(f"k_{n}") > 0), F.struct(F.col(f"k_{n}"), -F.col("first")))
        won = F.coalesce(F.max_by("y", votes), F.lit(0)).cast("double")
        parts.append(F.struct(F.lit(n).alias("name"), F.sum(f"k_{n}").alias("k"), F.sum(f"s_{n}").alias("s"), won.alias("won"), F.sum(f"t_{n}").alias("tokens")))
    words = [F.sum(f"m_{i}") for i in range(len(_words(width)))]
    return by_answer.groupBy(*RECORD).agg(F.sum("paths").alias("paths"), (words[0] if len(words) == 1 else F.array(*words)).alias("mask"), F.array(*parts).alias("prefixes"))


def _packed(words: list[Column]) -> Column:
    return words[0] if len(words) == 1 else F.array(*words)


def _bit(mask: Column, path: Column, width: int) -> Column:
    """Whether a mask has a path: 1 or 0."""
    at = path.cast("int")
    word, at = (mask, at) if width <= WORD_PATHS else (F.get(mask, F.floor(at / WORD_PATHS).cast("int")), at % WORD_PATHS)
    return F.call_function("shiftright", word, at).bitwiseAND(F.lit(1).cast("long"))


def ballots(paths: DataFrame, width: int = WORD_PATHS) -> DataFrame:
    """How many records n of a cell have each outcome: k paths, s correct ones, the mask of these as in ``records`` and
    the mask of the paths that are there. It is a written table: paths are derived once for all that is read from it,
    and a record's paths come down to one row, many records to one. Rows without a model, task or arm have no cell."""
    recs = paths.dropna(subset=CELL).groupBy(*RECORD).agg(
        F.count("*").alias("k"), F.sum("y").alias("s"), _packed(_words(width)).alias("mask"), _packed(_words(width, F.lit(1).cast("long"))).alias("there")
    )
    return dealt(written(recs.groupBy(*CELL, "k", "s", "mask", "there").agg(F.count("*").alias("n"))))


def dealt(b: DataFrame) -> DataFrame:
    """A written table of ballots in partitions that follow their number, those of a cell in some of them."""
    tasks = max(b.sparkSession.sparkContext.defaultParallelism, -(-b.count() // TASK_BALLOTS))
    return b.repartition(tasks, *CELL, F.pmod(F.hash("mask", "there"), F.lit(tasks)))


def prefix_ballots(paths: DataFrame, ks: tuple[int, ...], width: int = WORD_PATHS) -> DataFrame:
    """Ballots by seed, as in ``ballots``, with bit i of ``won`` for a plurality answer of the first ks[i] paths that is
    correct, as in ``prefix_records``, and the tokens of these paths, ``tokens_i``, added up over the n records."""
    inside = [F.sum(F.when(F.col("path") < k, F.col("gen_len")).otherwise(0)) for k in ks]
    mine = lambda vote=None: _packed(_words(width, vote))
    by_answer = paths.dropna(subset=CELL).groupBy(*RECORD, "answer").agg(
        mine().alias("mask"), mine(F.lit(1).cast("long")).alias("there"), F.min("path").alias("first"), F.max("y").alias("y"), *[x.alias(f"tokens_{i}") for i, x in enumerate(inside)]
    )
    # the most votes, then the earliest first path, then whether it is correct: one number
    votes = [paths_below(F.col("there"), k, width) for k in ks]
    rank = [F.when(F.col("answer").isNotNull() & (n > 0), F.shiftleft(n, 32) + (F.lit((1 << 31) - 1) - F.col("first")) * 2 + F.col("y")) for n in votes]
    words = -(-width // WORD_PATHS)
    both = lambda m: F.sum(m) if words == 1 else F.array(*[F.sum(F.get(m, F.lit(i))) for i in range(words)])
    recs = by_answer.groupBy(*RECORD).agg(both("mask").alias("mask"), both("there").alias("there"), *[F.max(r).alias(f"best_{i}") for i, r in enumerate(rank)], *[F.sum(f"tokens_{i}").alias(f"tokens_{i}") for i in range(len(ks))])
    won = sum((F.shiftleft(F.coalesce(F.col(f"best_{i}"), F.lit(0)).bitwiseAND(F.lit(1).cast("long")), i) for i in range(len(ks))), F.lit(0).cast("long"))
    recs = recs.select(*CELL, "seed", "mask", "there", won.alias("won"), *[f"tokens_{i}" for i in range(len(ks))])
    counted = recs.groupBy(*CELL, "seed", "mask", "there", "won").agg(F.count("*").alias("n"), *[F.sum(f"tokens_{i}").alias(f"tokens_{i}") for i in range(len(ks))])
    return dealt(written(counted))


def of_prefixes(b: DataFrame, ks: tuple[int, ...], width: int = WORD_PATHS) -> DataFrame:
    """``prefix_ballots`` with a row for each of ks: paths k, correct ones s, won, the tokens of all n records."""
    one = [
        F.struct(
            F.lit(k).cast("long").alias("kk"), paths_below(F.col("there"), k, width).alias("k"), paths_below(F.col("mask"), k, width).alias("s"),
            F.shiftright("won", i).bitwiseAND(F.lit(1).cast("long")).alias("won"), F.col(f"tokens_{i}").alias("tokens"),
        )
        for i, k in enumerate(ks)
    ]
    return b.select(*CELL, "seed", "n", F.explode(F.array(*one)).alias("p")).select(*CELL, "seed", "n", "p.*")


def paths_below(mask: Column, k: int, width: int) -> Column:
    """How many of the first k paths a mask has."""
    words = [mask] if width <= WORD_PATHS else [F.get(mask, F.lit(i)) for i in range(-(-width // WORD_PATHS))]
    low = [(1 << min(WORD_PATHS, max(0, k - i * WORD_PATHS))) - 1 for i in range(len(words))]
    return sum((F.bit_count(w.bitwiseAND(F.lit(x).cast("long"))) for w, x in zip(words, low) if x), F.lit(0)).cast("long")


def slot_sums(b: DataFrame, width: int = WORD_PATHS) -> DataFrame:
    """(cell, path, w, of): of the ballots that have a path their number and that of those it is correct in. Bytes of the
    masks are counted first, then their bits."""
    n = F.col("n")
    masks, there = ([F.get(m, F.lit(i)) for i in range(-(-width // WORD_PATHS))] if width > WORD_PATHS else [F.col(m)] for m in ("mask", "there"))
    byte = lambda word, at: F.shiftright(word, at).bitwiseAND(F.lit(255).cast("long"))
    each = F.array(*[F.struct(F.lit(i * WORD_PATHS + at).alias("base"), byte(m, at).alias("m"), byte(t, at).alias("t")) for i, (m, t) in enumerate(zip(masks, there)) for at in range(0, WORD_PATHS, 8)])
    by_byte = b.select(*CELL, "n", F.explode(each).alias("x")).where("x.t <> 0").groupBy(*CELL, "x.base", "x.m", "x.t").agg(F.sum(n).alias("n"))
    bit = lambda x: n * F.call_function("shiftright", F.col(x), F.col("i")).bitwiseAND(F.lit(1).cast("long"))
    bits = by_byte.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    return bits.groupBy(*CELL, (F.col("base") + F.col("i")).alias("path")).agg(F.sum(bit("m")).alias("w"), F.sum(bit("t")).alias("of")).where("of > 0")


def first_paths(b: DataFrame, k: int) -> DataFrame:
    """The ballots of the first k paths, at most 63; records without any have none."""
    low = F.lit((1 << k) - 1).cast("long")
    mask, there = F.col("mask").bitwiseAND(low), F.col("there").bitwiseAND(low)
    cut = b.select(*CELL, F.bit_count(there).cast("long").alias("k"), F.bit_count(mask).cast("long").alias("s"), mask.alias("mask"), there.alias("there"), "n").where("k > 0")
    return cut.groupBy(*CELL, "k", "s", "mask", "there").agg(F.sum("n").alias("n"))


def weighted_mean(x: Column, n: Column) -> Column:
    """Mean of x, each n times; nulls don't count."""
    return F.sum(n * x) / F.sum(F.when(x.isNotNull(), n))


def prefix(paths: DataFrame, k: int) -> DataFrame:
    """The first k paths of each record."""
    return paths.where(F.col("path") < k)


def majority(s: Column, k: Column) -> Column:
    """1 if more than half of the paths are correct, 1/2 at a tie, else 0; 0 without paths."""
    return F.when(k == 0, F.lit(0.0)).when(2 * s > k, F.lit(1.0)).when(2 * s == k, F.lit(0.5)).otherwise(F.lit(0.0))


def majority_accuracy(recs: DataFrame, by: list[str] = CELL) -> DataFrame:
    return recs.groupBy(*by).agg(F.avg(majority(F.col("s"), F.col("k"))).alias("mv_acc"))


def path_accuracy(paths: DataFrame, by: list[str] = CELL) -> DataFrame:
    return paths.groupBy(*by).agg(F.avg("y").alias("p_bar"))


def seed_accuracy(paths: DataFrame) -> DataFrame:
    """Mean and sample standard deviation over seeds of the accuracy within each."""
    seeds = paths.groupBy(*CELL, "seed").agg(F.avg("y").alias("acc"))
    return seeds.groupBy(*CELL).agg(F.avg("acc").alias("acc_mean"), F.stddev_samp("acc").alias("acc_std"))


def plurality(paths: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Each record's winning bucket: most votes, ties to the bucket that came first; null answers don't
    vote. The winner's first raw answer is returned, and the number of distinct buckets."""
    votes = paths.withColumn("bucket", F.col("answer") if bucket is None else bucket).where("bucket is not null")
    counted = votes.groupBy(*RECORD, "bucket").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.min_by("answer", "path").alias("raw"), F.max("gold").alias("gold"))
    best = F.struct("n", (-F.col("first")).alias("f"))
    return counted.groupBy(*RECORD).agg(F.max_by("raw", best).alias("winner"), F.max("n").alias("votes"), F.count("*").alias("n_buckets"), F.max("gold").alias("gold"))


def bucket_counts(paths: DataFrame) -> DataFrame:
    """Map of answer to votes by record."""
    counted = paths.where("answer is not null").groupBy(*RECORD, "answer").agg(F.count("*").alias("n"))
    return counted.groupBy(*RECORD).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("answer", "n")))).alias("counts"))


def running_votes(paths: DataFrame) -> DataFrame:
    """Correct paths up to each path: every prefix at once."""
    w = Window.partitionBy(*RECORD).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paths.select(*RECORD, "path", F.sum("y").over(w).alias("s"), (F.col("path") + 1).alias("k"))


def bucket_ranks(paths: DataFrame) -> DataFrame:
    """Buckets of a record by votes, ties by first occurrence."""
    counted = paths.where("answer is not null").groupBy(*RECORD, "answer").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    w = Window.partitionBy(*RECORD).orderBy(F.desc("n"), "first")
    return counted.withColumn("tie_rank", F.row_number().over(w))


def slot_accuracy(paths: DataFrame) -> DataFrame:
    return paths.groupBy(*CELL, "path").agg(F.avg("y").alias("acc"), F.sum("y").alias("hits"))


def slot_variation(paths: DataFrame) -> DataFrame:
    """Constant slots and the population coefficient of variation of slot accuracies, 0 at mean 0."""
    n = paths.groupBy(*CELL, "path").agg(F.avg("y").alias("acc"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    mean = F.avg("acc")
    return n.groupBy(*CELL).agg(
        F.count_if(F.col("lo") == F.col("hi")).alias("constant_slots"),
        F.when(mean == 0, F.lit(0.0)).otherwise(F.stddev_pop("acc") / mean).alias("slot_cv"),
        F.sort_array(F.collect_list(F.struct("path", "acc"))).alias("slots"),
    )


def weighted_statistics(b: DataFrame, width: int = WORD_PATHS) -> DataFrame:
    """Of ballots, a row a cell: accuracy of votes weighted by slot accuracy (as integer hits, so that ties are exact), of
    the plain majority, the gain in points, constant slots and slot variation as in ``slot_variation``."""
    n = F.col("n")
    slots = written(slot_sums(b, width))
    cells = written(slots.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("path", "w"))).alias("slots")))
    votes = lambda m: F.aggregate("slots", F.lit(0).cast("long"), lambda t, x: t + x["w"] * _bit(F.col(m), x["path"], width))
    recs = with_cells(b, cells, CELL).select(*CELL, "s", "k", "n", votes("mask").alias("won"), votes("there").alias("all"))
    mine = F.when(F.col("all") == 0, F.lit(0.0)).otherwise(majority(F.col("won"), F.col("all")))
    out = recs.groupBy(*CELL).agg(weighted_mean(mine, n).alias("weighted_acc"), weighted_mean(majority(F.col("s"), F.col("k")), n).alias("mv_acc"))
    out = out.withColumn("gain_pp", 100 * (F.col("weighted_acc") - F.col("mv_acc")))
    mean = F.avg("acc")
    spread = slots.withColumn("acc", F.col("w") / F.col("of")).groupBy(*CELL).agg(
        F.count_if((F.col("w") == 0) | (F.col("w") == F.col("of"))).alias("constant_slots"), F.when(mean == 0, F.lit(0.0)).otherwise(F.stddev_pop("acc") / mean).alias("slot_cv")
    )
    return out.join(spread, CELL)


def weighted_majority(paths: DataFrame, width: int = WORD_PATHS) -> DataFrame:
    """Accuracy of votes weighted by slot accuracy (as integer hits, so that ties are exact), and the
    gain over the plain majority in points. Records of more than 63 paths need their largest number of paths as ``width``."""
    return weighted_statistics(ballots(paths, width), width).drop("constant_slots", "slot_cv")


def pruned_majority(paths: DataFrame, n_drop: int = 2) -> DataFrame:
    """Majority accuracy without the n worst slots (ties drop the lower slot)."""
    slots = paths.groupBy(*CELL, "path").agg(F.sum("y").alias("hits"))
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy("hits", "path"))
    kept = slots.withColumn("r", rank).where(F.col("r") > n_drop).select(*CELL, "path")
    return majority_accuracy(records(paths.join(kept, [*CELL, "path"]))).withColumnRenamed("mv_acc", "pruned_acc")


def oracle_accuracy(recs: DataFrame) -> DataFrame:
    """Share of records with any correct path, and how far the majority stays below it."""
    out = recs.groupBy(*CELL).agg(F.avg((F.col("s") >= 1).cast("double")).alias("oracle_acc"), F.avg(majority(F.col("s"), F.col("k"))).alias("mv_acc"))
    return out.withColumn("headroom", F.col("oracle_acc") - F.col("mv_acc"))


def answer_diversity(paths: DataFrame) -> DataFrame:
    """Mean share of distinct answers (lower case, trimmed; a missing one counts as the word none)."""
    text = F.lower(F.trim(F.coalesce(F.col("answer"), F.lit("None"))))
    recs = paths.groupBy(*RECORD).agg((F.count_distinct(text) / F.count("*")).alias("share"))
    return recs.groupBy(*CELL).agg(F.avg("share").alias("diversity"))


def run_summary(paths: DataFrame) -> DataFrame:
    """Per seed and in total (null seed): records, tokens a path, cap hits, vote and path accuracy."""
    recs = paths.groupBy(*RECORD).agg(F.sum("y").alias("s"), F.count("*").alias("k"), F.sum("gen_len").alias("tokens"), F.count_if("truncated").alias("cut"))
    return recs.rollup(*CELL, "seed").agg(
        F.grouping_id().alias("level"), F.count("*").alias("instances"), (F.sum("tokens") / F.sum("k")).alias("tokens_per_path"), F.sum("cut").alias("cap_hits"),
        F.avg(majority(F.col("s"), F.col("k"))).alias("vote_acc"), (F.sum("s") / F.sum("k")).alias("path_acc"),
    ).where("level <= 1").drop("level")


def prefix_tokens(paths: DataFrame, k: int) -> DataFrame:
    """Mean tokens of a record's first k paths."""
    recs = prefix(paths, k).groupBy(*RECORD).agg(F.sum("gen_len").alias("tokens"))
    return recs.groupBy(*CELL).agg(F.avg("tokens").alias("mean_tokens"))
