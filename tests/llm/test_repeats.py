"""Repeats against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ballotry.llm import repeats as rp


def brute(rows, length):
    windows = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for b in raws:
        windows.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raws):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if windows[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, max(0, len(p) // 3))
            parts += [p[a : len(p) - rnd.randint(0, 30)], word()]
        rows.append((i, " ".join(parts)))
    rows += [rows[3], (900, rows[4][1]), (901, "ab" * 300), (902, "x" * 500), (903, None), (904, ""), (None, rows[5][1]), (905, "abcde" * 41 + "q"), (906, "short")]
    return rows


@pytest.mark.parametrize("seed,length,bucket", [(1, 60, 2000), (2, 60, 2), (3, 40, 2000), (4, 100, 3), (5, 400, 2000)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, length, bucket):
    monkeypatch.setattr(rp, "BUCKET_CONTEXTS", bucket)
    monkeypatch.setattr(rp, "CUT_LESS", 8)
    monkeypatch.setattr(rp, "SORT_BYTES", 3000)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, g int, context string").repartition(3)
    assert sorted(map(tuple, rp.suffix_dedup(df, length).collect()), key=str) == brute(rows, length)


@pytest.mark.parametrize("seed,length", [(6, 60), (7, 100)])
def test_colliding_hashes_of_the_whole_job(spark, monkeypatch, seed, length):
    """Spans under four hashes only, copies dealt to several buckets: whatever is claimed wrongly is decided again."""
    plain = rp.span_hash
    monkeypatch.setattr(rp, "span_hash", lambda prefix, begin, end: plain(prefix, begin, end) & np.uint64(3))
    monkeypatch.setattr(rp, "CUT_LESS", 8)
    monkeypatch.setattr(rp, "BUCKET_CONTEXTS", 3)
    monkeypatch.setattr(rp, "BUCKET_COPIES", 12)
    rows = corpus(seed, 40) + [(1000 + i, "one passage that many rows hold " * 5 + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, rp.suffix_dedup(df, length).collect()), key=str) == brute(rows, length)


def test_spans_of_several_lengths():
    data = np.frombuffer(b"abcdefgh-abcdefgh-abcdefgx-" + b"0123456789ab|0123456789ab|0123456789zz|", np.uint8)
    at = np.array([0, 9, 18, 27, 40, 53])
    size = np.array([8, 8, 8, 12, 12, 12])
    got = rp.repeated_suffixes(data, at, np.array([0, 0, 0, 1, 1, 1]), size)
    assert got.tolist() == [True, True, False, True, True, False]


def test_suffix_order_and_collisions(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    at = np.arange(0, 2900)
    segment = at // 300
    want = sorted(range(len(at)), key=lambda i: (segment[i], data[at[i] : at[i] + 30].tobytes()))
    order = rp.sort_suffixes(data, rp.prefix_hashes(data), at, segment, 30)
    key = lambda i: (segment[i], data[at[i] : at[i] + 30].tobytes())
    assert [key(i) for i in order] == [key(i) for i in want] and sorted(order.tolist()) == list(range(len(at)))
    plain = rp.repeated_suffixes(data, at, segment, 12)
    monkeypatch.setattr(rp, "prefix_hashes", lambda d: np.zeros(len(d) + 1, np.uint64))  # all hashes collide
    assert (rp.repeated_suffixes(data, at, segment, 12) == plain).all()


def test_query_returns_the_remaining_texts(spark, tmp_path):
    """Passages of 400 bytes or more are gone from unrelated texts, shorter ones and texts without any are whole."""
    from ballotry.llm.queries import op3_suffix_dedup

    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghé") for _ in range(7)) for _ in range(n))
    long, short = words(80), words(45)
    assert len(short.encode()) < 400 < len(long.encode())
    ends = "ßàßàßà"  # two of them share a byte, which goes with the passage
    rows = [(i, f"{words(30)}{i}{p}{ends[i]}{words(30)}") for i, p in enumerate([long, long, short, short, "", ""])]
    rows += [(6, None), (7, ""), (8, rows[4][1]), (9, rows[0][1][:40])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = op3_suffix_dedup(spark, str(tmp_path))
    got = {x.doc_id: x for x in df.collect()}
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    assert sorted((tuple(x)[:5] for x in got.values()), key=str) == brute(rows, 400)
    assert all(got[i].text == rows[i][1].replace(long + ends[i], "") for i in (0, 1))
    assert all(got[i].text == rows[i][1] for i in (2, 3, 5, 6, 7, 9))
    assert got[4].text == got[8].text == ""


def test_empty_table(spark):
    assert rp.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_columns_stay_whatever_their_names(spark):
    passage = "the same words in both of them " * 20
    rows = [(1, "one|" + passage, 5, "x", None), (2, passage + "|two", None, "y", 1), (3, None, 7, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r long, runs string, place long")
    got = {x.doc_id: x for x in rp.without_repeats(docs, 100).collect()}
    assert {i: (x.r, x.runs, x.place) for i, x in got.items()} == {r[0]: r[2:] for r in rows}
    assert [got[i]["__rest"] for i in (1, 2, 3)] == ["one|", "|two", None]


def test_shuffle_files_go_once_a_table_is_written(spark):
    import glob
    import time

    from ballotry.llm.common import Scratch

    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, scratch = files(), Scratch(spark)
    scratch.table(spark.range(20_000).selectExpr("id % 5000 k", "id").groupBy("k").sum("id"))
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_texts_are_cut_after_the_shuffles_of_their_ranges(spark, monkeypatch):
    """The job that shuffles texts shuffles nothing but their lists beside them, and tables of spans are gone by then."""
    import os

    from ballotry.llm.common import Scratch

    seen, paths, plain = [], [], Scratch.table

    def table(self, df):
        if "context" in df.columns and "claim" in df.columns:
            plan = df._jdf.queryExecution().executedPlan().toString()
            seen.append((plan.count("Exchange "), [c for p, c in paths if os.path.isdir(p)]))
        out = plain(self, df)
        paths.append((self.paths[id(out)], df.columns))
        return out

    monkeypatch.setattr(Scratch, "table", table)
    rows = corpus(8)
    got = rp.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 60)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 60)
    assert seen and all(n <= 2 and not any("some" in columns for columns in left) for n, left in seen)
