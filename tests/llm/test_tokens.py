"""Token counts and encoding against the libraries that the contracts name."""

import hashlib

import pytest

tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from ballotry.llm import tokens as tk  # noqa: E402

TEXTS = [
    None, "", " ", "Hello  world\n\n  it's 1234 fine!!", "a<|endoftext|>b <|endoftext|>", "ünïcödé ßtraße 漢字かな 🙂🙂", "x" * 3000,
    "the " * 5000, "\t\ttabs\r\nand 'll 've words", "zero\x00byte    nbsp", "Hello  world\n\n  it's 1234 fine!!",
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, n_tokens string")


def test_counts_equal_the_library(spark):
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in tk.token_counts(docs(spark), P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert got[None].n_bytes == 5


def test_ids_equal_the_library_and_decode_to_the_text(spark):
    ranks = tk.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = tk.encode_decode(docs(spark).repartition(3), ranks, P.PATTERN, with_ids=True).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = lib.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_many_blocks_and_small_gathers(spark, monkeypatch):
    monkeypatch.setattr(tk, "GATHER_BYTES", 80)
    ranks = tk.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"the the the the the cat {i} sat" for i in range(40)]
    rows = tk.encode_decode(docs(spark, texts).coalesce(2), ranks, P.PATTERN, with_ids=True, block_bytes=50).collect()
    assert {r.doc_id: list(r.ids) for r in rows if r.doc_id is not None} == {i: lib.encode_ordinary(t) for i, t in enumerate(texts)}


def test_empty_table(spark):
    none = docs(spark).limit(0)
    assert tk.token_counts(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert tk.encode_decode(none, tk.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN).count() == 0


def test_whole_token_proof(spark):
    rank, vocab, special = tk.load_merges(P.path("byte_bpe_50k.json"))
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = set(tk.whole_tokens(rank, vocab))
    assert special == ["<|endoftext|>"] and len(whole) > 40_000
    letters = {b: c for c, b in tk.byte_alphabet().items()}
    for w in sorted(whole)[::997]:
        assert len(lib.model.tokenize("".join(letters[b] for b in w.encode()))) == 1


@pytest.mark.parametrize("piece", ["ab", "loremipsumdolör"])
def test_long_words_equal_both_libraries(piece):
    """A megabyte without a space is one pre-token."""
    word = (piece * (1 << 20))[: 1 << 20]
    ranks = tk.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    got = [ranks[p] for p in tk.merge_pairs(word.encode(), tk._Joined(ranks))]
    assert b"".join(tk.merge_pairs(word.encode(), tk._Joined(ranks))) == word.encode()
    short = word[:4_000]  # the library takes quadratic time in the length of a pre-token
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [ranks[p] for p in tk.merge_pairs(short.encode(), tk._Joined(ranks))] == lib.encode_ordinary(short) and len(got) > 1
    rank, _, _ = tk.load_merges(P.path("byte_bpe_50k.json"))
    counts = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert len(tk.merge_pairs(word.encode(), rank)) == len(counts.encode(word, add_special_tokens=False).ids)


def test_results_of_runs_go_back_by_bytes():
    import pyarrow as pa
    from pyspark.sql import types as T

    from ballotry.llm import common

    class Dealt:
        """A frame of one partition, whose tasks run at once."""

        repartition = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, task, schema):
            return list(task(iter([pa.record_batch([pa.array(range(40)), pa.array(range(40))], ["k", "x"])])))

    work = lambda group: {"k": group.column("k").to_pylist(), "cell": [b"x" * 1_000_000] * group.num_rows}
    got = common.by_runs(Dealt(), "k", work, T.StructType([T.StructField("k", T.LongType()), T.StructField("cell", T.BinaryType())]))
    assert [k for batch in got for k in batch.column("k").to_pylist()] == list(range(40))
    assert max(batch.nbytes for batch in got) < 4_000_000
