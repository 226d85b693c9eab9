import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ballotry.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, good int, n int"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every order replayed, document by document."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    smallest = {}
    for i, text, *_ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    failed = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = words(t)
        bad = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and smallest[t] < i,
        }
        good, toxic = (any(j == i and i is not None and m[c] == 1 for j, *m in labels) for c in (0, 1))
        failed.append((lang or "", {k for k, v in bad.items() if v}, good, toxic))
    out, removed_by = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in failed}:
            alive = [d for d in failed if d[0] == part]
            everyone = list(alive)
            for step, x in enumerate(order, 1):
                gone = [d for d in alive if x in d[1]]
                alive = [d for d in alive if x not in d[1]]
                fails = [d for d in everyone if x in d[1]]
                removed_by[part, x] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), len(fails) - len(gone), sum(d[1] == {x} for d in everyone), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: tuple(v + [removed_by[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_paths_are_counted_forward_and_backward():
    edges, orders = fa.lattice(4)
    assert len(edges) == 4 * 8 and len(orders) == 24
    for s, f, n in edges:
        assert n == sum({*order[: order.index(f)]} == {g for g in range(4) if s >> g & 1} for order in orders)


def test_equals_replayed_orders(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [
        (1, long, "en", 7, 7), (2, long, "de", 7, 7), (2, long, "de", 7, 7), (3, long + " #", "en", 7, 7), (4, None, "en", 7, 7), (5, "", None, 7, 7), (6, " \t", "", 7, 7), (7, "ONE TWO", "en", 7, 7),
        (8, "w " * 30_000, "en", 7, 7), (None, long, "en", 7, 7), (None, long, "en", 7, 7), (9, long, None, 7, 7), (1, long, "en", 7, 7), (10, "x y " * 60 + "ABC$", "de", 7, 7), (11, "ONE TWO", "en", 7, 7),
    ]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (7, 1, 1), (11, 1, 0), (None, 1, 1), (99, 1, 1)]
    got = rows(fa.interaction_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels) and len(got) == 600 * 3
    assert all(sum(v[6] for k, v in got.items() if k[:2] == ("en", "ABCDE")) / 120 == n - kept for n, kept in [(9, got["en", "ABCDE", 5][0])])


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "x"), (2, "ab", "x"), (3, None, "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    got = rows(fa.interaction_audit(docs, labels, [("p", F.col("text").contains("a")), ("q", F.col("text").contains("b"))], None))
    assert got == {("x", "pq", 1): (1, 2, 0, 1, 0, 0, 3), ("x", "pq", 2): (1, 0, 1, 0, 0, 0, 1), ("x", "qp", 1): (2, 1, 0, 0, 0, 0, 1), ("x", "qp", 2): (1, 1, 1, 1, 0, 0, 3)}
    with pytest.raises(ValueError):
        fa.interaction_audit(docs, labels, [], None)


def test_empty_table(spark):
    assert fa.interaction_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
