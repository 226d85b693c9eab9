"""Answers from generated text: ordered rules as Column expressions.

Each chain is a coalesce of rules. Explicit markers count on a cut-off text too; rules that read
unfinished prose give null there. "Last" is the last match of a pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import strip, thousands_free

# Patterns that define the answers.
NUM = r"-?[$]?[0-9][0-9,]*(?:[.][0-9]+)?"
#: A number as the chain of today reads it: digits and commas, then a decimal part.
LOOSE = r"-?[0-9,]+\.?[0-9]*"
DECLARES = r"(?i)\b(?:final\s+)?answer\b\s*(?:is\b|=|:)\s*"
#: Declarations before a yes or no, and before an option letter.
DECLARES_WORD = r"\b(?:final\s+)?answer\b\s*(?:is\b|=|:)\s*"
DECLARES_LETTER = r"\b(?:final\s+answer|answer|correct(?:\s+answer)?)\b\s*(?:is\b|=|:)\s*"
#: Verdicts of small-label tasks: what declares one, and the labels.
PARITY = r"(?:answer|parity|result|conclusion)\s*(?:is|:)\s*(even|odd)"
SORTED = r"(?:answer|result|sorted\s*(?:list|array)?)\s*(?:is|:)?\s*(\[[0-9,\s]+\])"
NUMBER_LIST = r"(\[[0-9]+(?:\s*,\s*[0-9]+)*\])"
BRACKETS = r"(?:answer|sequence|result|conclusion)\s*(?:is|:)\s*(invalid|valid|not\s+valid|balanced|not\s+balanced|unbalanced)"
FENCE = r"(?s)```(?:python|json)?[ \t]*\r?\n"
STOPS = ("<|return|>", "<|end|>")
# Chat-turn markers that leak into generated text, tried in this order.
LEAKS = (r"\nuser\n", r"\nUser:", r"\n<\|im_start\|>", r"\nassistant\n", r"\n<\|eot_id\|>")
LEAD_IN = r"(?i)^(?:the\s+final\s+answer\s+is|the\s+answer\s+is|it\s+is)\b\s*[:,-]?\s*"


def last(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(x), use), 1)


def filled(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.trim(x))


def strip_reasoning(text: Column) -> Column:
    """Text after the last </think>, else before a <think> that doesn't begin it."""
    return F.when(F.contains(text, F.lit("</think>")), strip(F.substring_index(text, "</think>", -1))).when(F.locate("<think>", text) > 1, strip(F.substring_index(text, "<think>", 1))).otherwise(text)


def strip_leaks(text: Column) -> Column:
    """Text before the first leaked chat turn."""
    for marker in LEAKS:
        text = F.regexp_replace(text, rf"(?is){marker}.*", "")
    return strip(text)


def strip_artifacts(text: Column) -> Column:
    """Reasoning, then leaked chat turns cut off."""
    return strip_leaks(strip_reasoning(text))


def final_segment(text: Column, end: str = "</think>", stops: tuple[str, ...] = STOPS) -> Column:
    """What follows the last end tag of the reasoning, up to the first stop marker; null without the tag."""
    rest = F.substring_index(text, end, -1)
    for stop in stops:
        rest = F.substring_index(rest, stop, 1)
    return F.when(F.contains(text, F.lit(end)), F.btrim(rest, F.lit(" \t\r")))


def boxed(text: Column) -> Column:
    """Content of the last \\boxed{...} if its braces are balanced, at any depth; else null."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
    grown = lambda step: F.when(step == "{", 1).when(step == "}", -1).otherwise(0)
    walk = lambda at, step: F.when(at["depth"] == 0, at).otherwise(F.struct((at["depth"] + grown(step)).alias("depth"), (at["size"] + F.char_length(step)).alias("size")))

    def inside(rest: Column) -> Column:
        end = F.aggregate(F.regexp_extract_all(rest, F.lit(r"([{}]|[^{}]+)"), F.lit(1)), start, walk)
        return bound(end, lambda e: F.when(e["depth"] == 0, strip(F.substring(rest, F.lit(1), e["size"] - 1))))

    return bound(F.when(F.contains(text, F.lit("\\boxed{")), F.substring_index(text, "\\boxed{", -1)), inside)


def tidy_number(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, "$,", ""), r"[.]$", "")


def tidy_loose(x: Column) -> Column:
    """Commas and one final full stop removed."""
    return F.regexp_replace(strip(F.replace(x, F.lit(","), F.lit(""))), r"\.$", "")


def number_answer(text: Column, cut: Column) -> Column:
    """Last number in the last box (or all of it), last ####, last declared answer, then on whole texts result or
    total, `= x` at a line's end, last number. Thousands separators and artefacts are removed first."""

    def of_clean(plain: Column, clean: Column) -> Column:
        box = lambda b: F.coalesce(last(b, rf"({LOOSE})"), F.when(b != "", b))
        rules = [bound(F.coalesce(boxed(clean), boxed(plain)), box), last(clean, rf"####\s*({LOOSE})"), last(clean, rf"(?i)\b(?:final\s+answer|answer)\b\s*(?:is\b|=|:)\s*\$?({LOOSE})")]
        prose = [last(clean, rf"(?i)\b(?:result|total)\b\s*(?:is\b|=|:)\s*\$?({LOOSE})"), last(clean, rf"(?m)=\s*\$?({LOOSE})\s*$"), last(clean, rf"({LOOSE})")]
        return tidy_loose(F.coalesce(*rules, F.when(~cut, F.coalesce(*prose))))

    def of_plain(plain: Column) -> Column:
        clean = bound(strip_artifacts(plain), lambda c: F.when(F.char_length(c) < 2, strip_leaks(plain)).otherwise(c))
        return bound(clean, lambda c: of_clean(plain, c))

    return bound(thousands_free(text), of_plain)


def number_answer_old(text: Column) -> Column:
    """First ####, first of answer, result or total, last number."""
    return tidy_number(F.coalesce(first(text, rf"####[ \t]*({NUM})"), first(text, rf"(?i)(?:answer|result|total)[ \t]*(?:is|=|:)?[ \t]*({NUM})"), last(text, rf"({NUM})")))


def clean_and_box(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the text without artefacts and of its last box, or else that of the whole text."""
    return bound(strip_artifacts(text), lambda clean: bound(F.coalesce(boxed(clean), boxed(text)), lambda box: use(clean, box)))


def yes_no_answer(text: Column, cut: Column) -> Column:
    """Last yes or no in the last box, last after ####, last declared, a leading one, and on whole texts the last."""
    word = r"(?i)\b(yes|no)\b"

    def rules(clean: Column, box: Column) -> Column:
        found = [last(box, word), last(clean, rf"(?i)####\s*\b(yes|no)\b"), last(clean, rf"(?i){DECLARES_WORD}\b(yes|no)\b"), first(clean, r"(?i)^(yes|no)\b")]
        return F.initcap(F.coalesce(*found, F.when(~cut, last(clean, word))))

    return clean_and_box(text, rules)


def span_answer(text: Column, cut: Column, words: int = 15, placeholders: bool = True) -> Column:
    """Box, last usable ####, last usable declaration; on whole texts the last usable words after therefore, thus
    or so, then the last line. Spans are short, but for the last line; ``placeholders`` tells whether a
    repeated prompt (#### or <answer>) counts."""

    def usable_text(t: Column) -> Column:
        good = t != ""
        if not placeholders:
            bare = strip(F.regexp_replace(t, r"^####\s*", ""))
            good &= (F.lower(bare) != "<answer>") & ~bare.rlike(r"^(?:####\s*)*$")
        return good

    def short(t: Column) -> Column:
        return F.when(usable_text(t) & (F.size(F.split(t, r"\s+")) <= words), t)

    def led(x: Column) -> Column:
        return strip(F.rtrim(strip(F.regexp_replace(strip(x), LEAD_IN, "")), F.lit(".")))

    def of_clean(clean: Column) -> Column:
        usable = lambda x: bound(led(x), short)

        def last_usable(pattern: str) -> Column:
            found = F.transform(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)), usable)
            return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(-1))

        line = bound(led(F.substring_index(clean, "\n", -1)), lambda t: F.when(usable_text(t), t))
        prose = F.coalesce(last_usable(r"(?i)\b(?:therefore|thus|so)\b\s*,?\s*([^\n]+?)(?:\.|$)"), line)
        return F.coalesce(usable(F.coalesce(boxed(clean), boxed(text))), last_usable(r"####\s*([^\n]+)"), last_usable(rf"{DECLARES}([^\n]+)"), F.when(~cut, prose))

    return bound(strip_artifacts(text), of_clean)


def letter_answer(text: Column, cut: Column, letters: str = "ABCD") -> Column:
    """Last option letter in the last box, last after ####, last declared, a leading one, and on whole texts the last.
    Up to the declaration the case doesn't matter."""
    one = rf"\b([{letters}])\b"

    def rules(clean: Column, box: Column) -> Column:
        found = [last(box, f"(?i){one}"), last(clean, rf"(?i)####\s*\(?{one}"), last(clean, rf"(?i){DECLARES_LETTER}\(?{one}"), first(clean, rf"^([{letters}])\b")]
        return F.upper(F.coalesce(*found, F.when(~cut, last(clean, one))))

    return clean_and_box(text, rules)


def without_code_marks(literal: Column) -> Column:
    """A literal without the balanced code fences and backticks around it; marks that aren't balanced stay."""

    def step(c: Column) -> Column:
        ticks = F.char_length(c) - F.char_length(F.ltrim(c, F.lit("`")))
        same = (ticks > 0) & (ticks == F.char_length(c) - F.char_length(F.rtrim(c, F.lit("`")))) & (2 * ticks <= F.char_length(c))
        only = (c != "") & (F.ltrim(c, F.lit("`")) == "")
        fenced = c.rlike(FENCE + r".*```\z") & c.startswith("```")
        inner = F.regexp_extract(c, rf"\A{FENCE}(.*?)(?:\r?\n)?```\z", 1)
        return (
            F.when(fenced & c.rlike(rf"\A{FENCE}(.*?)(?:\r?\n)?```\z"), strip(inner))
            .when(only, F.when(F.char_length(c) % 2 == 0, F.lit("")).otherwise(c))
            .when(same, strip(F.substring(c, ticks + 1, F.char_length(c) - 2 * ticks)))
            .otherwise(c)
        )

    # each step takes two backticks or more
    steps = lambda c: F.sequence(F.lit(0), F.floor(F.regexp_count(c, F.lit("`")) / 2).cast("int"))
    peeled = bound(strip(literal), lambda c: F.aggregate(steps(c), c, lambda now, _: bound(now, step)))
    return bound(peeled, lambda c: F.when(c != "", c))


def literal_answer(text: Column) -> Column:
    """What follows the last ####: a fenced block, or else the rest of the line, without code marks."""

    def of_rest(rest: Column) -> Column:
        block = F.regexp_extract(rest, rf"\A({FENCE}.*?(?:\r?\n)?```)", 1)
        return without_code_marks(F.when(block != "", block).otherwise(F.substring_index(rest, "\n", 1)))

    def of_clean(clean: Column) -> Column:
        rest = F.regexp_replace(F.substring_index(clean, "####", -1), r"\A\s+", "")
        return F.when(F.contains(clean, F.lit("####")), bound(rest, of_rest))

    return bound(strip_artifacts(text), of_clean)


def label_answer(text: Column, kind: str) -> Column:
    """Verdict of a small-label task: ``parity`` (even, odd), ``sorted`` (a list of numbers) or ``brackets`` (valid,
    invalid). The first declared one, else the last that occurs, else the whole text."""
    lower = strip(F.lower(text))

    def of(low: Column) -> Column:
        if kind == "parity":
            return F.coalesce(first(low, PARITY), last(low, r"\b(even|odd)\b"))
        if kind == "sorted":
            return F.replace(F.coalesce(first(low, SORTED), last(text, NUMBER_LIST)), F.lit(" "), F.lit(""))
        declared = first(low, BRACKETS)
        found = F.coalesce(declared, last(low, r"\b(invalid|unbalanced|valid|balanced)\b"))
        return F.when(found.isin("valid", "balanced"), "valid").when(found.isNotNull(), "invalid")

    return F.coalesce(bound(lower, of), strip(text))


def code_block(text: Column) -> Column:
    """Content of the last fenced block."""
    return last(text, r"(?s)```[a-zA-Z]*\n(.*?)```")


def extract(task: Column, text: Column, cut: Column, rules: dict[str, str]) -> Column:
    """Dispatch by task; blank is null."""
    chains = {
        "number": lambda: number_answer(text, cut), "yesno": lambda: yes_no_answer(text, cut), "span": lambda: span_answer(text, cut), "short": lambda: span_answer(text, cut, placeholders=False),
        "letter": lambda: letter_answer(text, cut), "letter_of_five": lambda: letter_answer(text, cut, "ABCDE"), "letter_of_two": lambda: letter_answer(text, cut, "AB"), "literal": lambda: literal_answer(text),
        "boxed": lambda: boxed(strip_artifacts(text)), "code": lambda: F.when(~cut, strip(text)),
    }
    out = F.lit(None).cast("string")
    for name, rule in rules.items():
        out = F.when(task == name, chains[rule]()).otherwise(out)
    return filled(out)
