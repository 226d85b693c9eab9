"""The join against brute force over all pairs."""

import random
import re

import pytest

from ballotry.llm import ngram_join as nj
from ballotry.llm.shingles import ngram_sets, text_buffer

import pyarrow as pa


def grams(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = [grams(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if rows[i][0] == rows[j][0] or a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(s), None if d is None else low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows, base = [], []
    for i in range(n):
        if base and rnd.random() < 0.6:
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                k = rnd.randrange(len(w) + 1)
                w[k : k + rnd.choice([0, 1])] = [rnd.choice(words)] if rnd.random() < 0.7 else []
        else:
            w = rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 5, 12, 20, 40, 90, 200]))
        base.append(w)
        rows.append((i * 7 % 1009, rnd.choice([" ", "\n", "\t "]).join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows


def test_sets_equal_plain_python():
    texts = [None, "", " \n", "One", "a B\x0bc  d", "é É ß", "x " * 5, "a b c a b c a b c"]
    flat, at = ngram_sets(*text_buffer(pa.array(texts)), 3)
    assert [int(n) for n in at[1:] - at[:-1]] == [len(grams(t, 3)) for t in texts]


@pytest.mark.parametrize("seed,block,percent,width", [(1, 400, 90, 3), (2, 5, 90, 3), (3, 3, 80, 5), (4, 400, 100, 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block, percent, width):
    monkeypatch.setattr(nj, "BLOCK_ROWS", block)
    monkeypatch.setattr(nj, "BLOCK_COLUMNS", 16)
    rows = corpus(seed)
    rows += [(None, "a b c d"), (None, "a b c d"), (5000, None), (5001, ""), rows[0], (rows[1][0], "other words than before here"), (5002, "other words than before here")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n string").repartition(3)
    got = sorted(map(tuple, nj.ngram_components(df, width, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, width, percent)


def test_empty_table(spark):
    assert nj.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_component_keeps_unlike_rows_of_an_id(spark):
    say = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(7, None), (7, say("a")), (7, say("b")), (8, say("a")), (9, say("b") + " more"), (9, ""), (10, say("c")), (10, say("c")), (None, say("a")), (11, " \n")]
    docs = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, version string, n int")
    got = nj.one_of_each_component(docs, 5, 80)
    assert got.columns == docs.columns
    want = [(7, None), (7, say("a")), (7, say("b")), (9, ""), (10, say("c")), (None, say("a")), (11, " \n")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_very_long_texts_and_tied_sizes(spark):
    long = [f"t{i}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-50])), (3, " ".join(long[:50_000])), (4, "a b c d e f"), (5, "a b c d e f"), (6, "A B C D E f")]
    got = {r.doc_id: r.component_id for r in nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4}
