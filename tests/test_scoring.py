"""Scoring and extraction rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from ballotry.functions import extraction as ex
from ballotry.functions import scoring as sc


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r[1:]) for r in sorted(df.select("i", *columns).collect())]


def test_thousands_and_clean_numbers(spark):
    cases = {
        r"1{,}234": ("1234", "1234"), r"2{,}3": (r"2{,}3", r"2{}3"), r"1\,234{,}5": (r"1\,234{,}5", r"1\234{}5"), r"1\;234\!567": ("1234567", "1234567"),
        r"x 12~345 y": ("x 12345 y", "x 12345 y"), r"1\ 000.": ("1000.", "1000"), "1,200": ("1,200", "1200"), "1234{,}567{,}": ("1234567{,}", "1234567{}"), " 5. ": (" 5. ", "5"),
    }
    t = F.col("t")
    got = values(spark, list(cases), sc.thousands_free(t), sc.clean_number(t))
    assert got == list(cases.values())


def test_numbers_match(spark):
    t = F.col("t")
    got = values(spark, ["1,200", "1200.", None, "0", "1200.0004", "1200.01"], sc.numbers_match(t, F.lit("1200")))
    assert [x for x, in got] == [True, True, False, False, True, False]
    assert values(spark, ["2{,}3"], sc.numbers_match(t, F.lit("23"))) == [(False,)]


@pytest.mark.parametrize("text,want", [
    (r"\boxed{5} then \boxed{6", None), (r"so \boxed{a{b{c{d{e}}}}f} end", "a{b{c{d{e}}}}f"), (r"\boxed{1} and \boxed{ 2 }", "2"), ("none", None), (r"\boxed{}", ""), (None, None),
])
def test_boxed(spark, text, want):
    assert values(spark, [text], ex.boxed(F.col("t"))) == [(want,)]


@pytest.mark.parametrize("text,cut,want", [
    (r"\boxed{3 + 4 = 7}", False, "7"), (r"\boxed{x}", False, "x"), (r"#### 1{,}234", True, "1234"), ("the answer is 12. Then 13", True, "12"), ("total: 5\nso 6", False, "5"),
    ("a = 4\nb = 9 \nno", False, "9"), ("7 then 8", True, None), ("7 then 8.", False, "8"), ("<think>1</think>\n2\nUser: 3", False, "2"), ("#### 4\n#### 5", False, "5"), ("", False, None),
])
def test_number_answer(spark, text, cut, want):
    assert values(spark, [text], ex.number_answer(F.col("t"), F.lit(cut))) == [(want,)]


@pytest.mark.parametrize("text,cut,want", [
    ("The answer is it is: Rome.", False, "Rome"), ("#### Paris\n#### " + "w " * 20, True, "Paris"), ("so, Berlin. And", False, "Berlin"), ("a\nThe final answer is Oslo..", True, "Oslo"),
    ("line\nlast line of words.", False, "last line of words"), ("line", True, None), (r"\boxed{ it is Rome }", True, "Rome"),
])
def test_span_answer(spark, text, cut, want):
    assert values(spark, [text], ex.span_answer(F.col("t"), F.lit(cut))) == [(want,)]


def test_placeholders(spark):
    got = values(spark, ["#### <answer>", "#### ####", "#### Rome"], ex.span_answer(F.col("t"), F.lit(True), placeholders=False))
    assert got == [(None,), (None,), ("Rome",)]


@pytest.mark.parametrize("text,cut,want", [
    ("the answer is b", False, "B"), ("B. because A is wrong", False, "B"), ("B. because A is wrong", True, "B"), (r"\boxed{\text{D}} not A", False, "D"), ("answer: C\nUser: answer: A", False, "C"),
    ("correct answer: (d)", True, "D"), ("correct is A", True, "A"), ("#### (c)", True, "C"), ("I think B or C", True, None), ("I think B or C", False, "C"), ("a or b", False, None), ("<think>A</think>\nB", False, "B"), (r"\boxed{none} answer = A", True, "A"), ("", False, None),
])
def test_letter_answer(spark, text, cut, want):
    assert values(spark, [text], ex.letter_answer(F.col("t"), F.lit(cut))) == [(want,)]


def test_letters_of_other_alphabets(spark):
    t = F.col("t")
    assert values(spark, ["answer: E", "answer: C"], ex.letter_answer(t, F.lit(True), "ABCDE"), ex.letter_answer(t, F.lit(True), "AB")) == [("E", None), ("C", None)]


@pytest.mark.parametrize("text,cut,want", [
    ("<think>x</think>\nNo, because", True, "No"), (r"\boxed{\text{yes}}", True, "Yes"), ("The final answer is NO", True, "No"), ("#### yes\n#### no", True, "No"), ("it may be yes or no", True, None), ("it may be no or yes", False, "Yes"),
    ("answer: yes\nUser: answer: no", False, "Yes"), ("nobody", False, None), (r"\boxed{maybe} yes", False, "Yes"),
])
def test_yes_no_answer(spark, text, cut, want):
    assert values(spark, [text], ex.yes_no_answer(F.col("t"), F.lit(cut))) == [(want,)]


@pytest.mark.parametrize("text,want", [
    ("####\n```python\n[1, 2]\n```", "[1, 2]"), ("#### 5\nUser: #### 6", "5"), ("#### `a", "`a"), ("#### `'x'`", "'x'"), ("#### ``[1]``\nrest", "[1]"), ("none", None), ("####", None), ("#### ``", None), ("#### ```", "```"),
    ("#### ```json\n`{}`\n``` tail", "{}"), ("#### 1\n#### [2, 3] ", "[2, 3]"), ("#### ```\r\n'a'\r\n```", "'a'"), ("#### `a` + `b`", "a` + `b"),
])
def test_literal_answer(spark, text, want):
    assert values(spark, [text], ex.literal_answer(F.col("t"))) == [(want,)]


@pytest.mark.parametrize("kind,text,want", [
    ("parity", "The parity is odd. The answer is even.", "odd"), ("parity", "Even, odd, so EVEN", "even"), ("parity", " neither ", "neither"), ("parity", "answer: even\nUser: answer: odd", "even"),
    ("sorted", "The sorted list: [3, 1, 9] not [1, 2]", "[3,1,9]"), ("sorted", "first [2, 1] then [1 , 2]", "[1,2]"), ("sorted", "no list", "no list"),
    ("brackets", "The sequence is not valid", "invalid"), ("brackets", "conclusion: unbalanced", "invalid"), ("brackets", "It looks balanced", "valid"), ("brackets", "valid? no: invalid", "invalid"), ("brackets", "?", "?"),
])
def test_label_answer(spark, kind, text, want):
    assert values(spark, [text], ex.label_answer(F.col("t"), kind)) == [(want,)]


def test_final_segment(spark):
    t = F.col("t")
    got = values(spark, ["a</think> x\n <|return|>y", "a</think>b</think>c<|end|>d<|return|>", "none", "</think> "], ex.final_segment(t))
    assert [x for x, in got] == ["x\n", "c", None, ""]


def test_a_placeholder_as_the_last_line(spark):
    t = F.col("t")
    got = values(spark, ["so it ends.\n#### <answer>", "Oslo\n####"], ex.span_answer(t, F.lit(False), placeholders=False))
    assert got == [("it ends",), (None,)]


def test_dispatch(spark):
    rules = {"b": "yesno", "w": "letter_of_two", "p": "code", "t": "short"}
    df = spark.createDataFrame([("b", "answer: no", False), ("w", "A", False), ("p", " x = 1 ", False), ("p", "x", True), ("t", "#### <answer>", True), ("z", "5", False)], "k string, t string, c boolean")
    assert [r.v for r in df.select(ex.extract(F.col("k"), F.col("t"), F.col("c"), rules).alias("v")).collect()] == ["No", "A", "x = 1", None, None, None]
