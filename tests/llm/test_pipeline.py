"""Each stage of the pipeline on its own input, against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from ballotry.llm import mixing, tokens  # noqa: E402
from tests.llm.test_ngram_join import brute as components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rnd = random.Random(5)
    say = lambda n: " ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        t = say(rnd.randint(5, 160))
        bad = i % 4 == 0
        if bad:
            w = t.split()
            for _ in range(8):
                w.insert(rnd.randrange(len(w)), rnd.choice(["wretchplague", "grimfester", "vilequack"]))
            t = " ".join(w)
        rows.append([i, t])
        if i < 200:
            labels.append((i, 1, int(bad)))
    passage = say(60)
    for i in range(241, 249):
        rows.append([i, f"{say(30)} {passage} {say(20)}"])
    rows += [[300 + j, rows[j][1]] for j in (1, 2, 3)] + [[310, rows[5][1] + " and so"], [320, None], [321, ""], [None, say(9)], [1, rows[1][1]]]
    return [(d, t, "en", [None, "a", "b", "c"][k % 4], len(t or "")) for k, (d, t) in enumerate(rows)], labels


def test_stages(spark, tmp_path):
    rows, labels = documents()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = [docs.collect()]
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{i}")
        docs = spark.read.parquet(f"{sf}/{i}")
        inputs.append(docs.collect())
    start, clean, single, cut, mixed, encoded = inputs
    # 9: toxic documents go, others stay
    toxic = {r.doc_id for r in start if r.text and "wretchplague" in r.text or r.text and "grimfester" in r.text or r.text and "vilequack" in r.text}
    left = {r.doc_id for r in clean}
    assert len(toxic & left) <= 0.1 * len(toxic) and len({r.doc_id for r in start} - toxic - left) <= 3
    assert len([1 for r in clean if r.doc_id is None]) == 1
    # 1: one of each group, by brute force
    unlike = list(dict.fromkeys((r.doc_id, r.text) for r in clean))  # repeated ids with other texts are other documents
    of = components([(None if d is None else i, t) for i, (d, t) in enumerate(sorted(unlike, key=lambda x: (x[0] is None, x[0] or 0)))], 5, 80)
    order = sorted(unlike, key=lambda x: (x[0] is None, x[0] or 0))
    assert Counter(r.doc_id for r in single) == Counter([order[i][0] for i, _, c in of if i is not None and i == c] + [None])
    # 3: no repeated passage remains, and nothing else goes
    windows = Counter()
    for r in single:
        b = (r.text or "").encode()
        windows.update(b[k : k + cp.PASSAGE_BYTES] for k in range(len(b) - cp.PASSAGE_BYTES + 1))
    want = {}
    for r in single:
        b = (r.text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - cp.PASSAGE_BYTES + 1):
            if windows[b[k : k + cp.PASSAGE_BYTES]] > 1:
                gone[k : k + cp.PASSAGE_BYTES] = [True] * cp.PASSAGE_BYTES
        want[r.doc_id] = None if r.text is None else bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text or "") for r in cut)
    # 8: rows as often as the SQL of the mix takes them
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [[r.doc_id, r.text, r.source] for r in cut])
    taken = {d: t // s for d, s, _, _, t in con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.MIX_SQL})").fetchall() if s and t}
    assert Counter(r.doc_id for r in mixed) == Counter(taken)
    # 7: the library's ids, and the text back
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text for r in mixed}
    assert len(encoded) == len(mixed)
    for r in encoded:
        ids = lib.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and bytes(r.token_ids) == b"".join(t.to_bytes(4, "little") for t in ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_and_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert cp.run(spark, sf).count() == 0
