"""Question banks as table transforms, and their expansion to prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One family of eight prompt templates; a bank may bring its own table (family, slot, template).
TEMPLATES = (
    "Answer the question.\n{question}", "Think step by step.\n{question}", "{question}\nLet us reason carefully.", "Question: {question}\nAnswer:",
    "You are an expert. {question}", "Solve this:\n{question}", "{question}\nGive reasons first.", "Consider the following.\n{question}",
)


def question_bank(rows: DataFrame, prompt: str | None = None, answer: Column | None = None, count: int | None = None) -> DataFrame:
    """(prompt, answer, metadata): the other columns as a JSON object.

    The prompt is the named column, else ``prompt`` or, where that is missing or null, ``question``; a chat (an array
    of role and content) gives its first content. The answer is the given one, else ``reward_model.ground_truth``,
    ``answer``, or null. Another number of rows than ``count`` is an error.
    """
    types = dict(rows.dtypes)
    names = [prompt] if prompt else [c for c in ("prompt", "question") if c in types]
    if not names:
        raise ValueError("a question bank has a prompt or a question column")
    text = F.coalesce(*[F.try_element_at(c, F.lit(1))["content"] if types[c].startswith("array<struct") else F.col(c) for c in names])
    if answer is None:
        answer = F.col("reward_model")["ground_truth"] if types.get("reward_model", "").startswith("struct") else F.col("answer") if "answer" in types else F.lit(None)
    if count is not None and (found := rows.count()) != count:
        raise ValueError(f"{found} questions instead of {count}")
    rest = [c for c in rows.columns if c not in names]
    return rows.select(text.alias("prompt"), answer.cast("string").alias("answer"), F.to_json(F.struct(*rest)).alias("metadata"))


def after_hashes(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, "####"), -1))


def context_block(turns: DataFrame, by: str, order: str, title: str, text: str) -> DataFrame:
    """One text a group: `- title: text` lines in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, title, text)))
    return turns.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r[title], F.lit(": "), r[text])), "\n").alias("context"))


def short_contexts(turns: DataFrame, by: str, order: str, text: str, n: int = 3, chars: int = 500, fallback: str = "no context") -> DataFrame:
    """The first n texts of a group, cut to so many characters; a fallback where there are none."""
    rows = F.sort_array(F.collect_list(F.when(F.col(text) != "", F.struct(order, text))))
    got = F.transform(F.slice(rows, 1, n), lambda r: F.substring(r[text], 1, chars))
    return turns.groupBy(by).agg(got.alias("c")).select(by, F.when(F.size("c") > 0, F.array_join("c", "\n")).otherwise(F.lit(fallback)).alias("context"))


def lettered(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.chr(F.lit(65) + i), F.lit(") "), x)), "\n")


def gold_letter(labels: Column, key: Column) -> Column:
    place = F.array_position(labels, key)
    return F.when(place > 0, F.chr(F.lit(64) + place))


def references(spans: Column) -> tuple[Column, Column]:
    """Gold and aliases: the first reference, and the others."""
    return F.try_element_at(spans, F.lit(1)), F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1)))


def expand_prompts(questions: DataFrame, suffix: str = "\nEnd with the answer.", templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """Eight rows a question: its text in each template of the family, with the answer-format suffix."""
    all_ = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(t).alias("template")) for i, t in enumerate(templates)])
    rows = questions.withColumn("t", F.explode(all_))
    return rows.select("item_id", F.col("t.slot").alias("slot"), F.concat(F.replace(F.col("t.template"), F.lit("{question}"), F.col("text")), F.lit(suffix)).alias("prompt"))


def fingerprint(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)
