"""Training reads whole texts."""

import random

from ballotry.llm import toxicity as tx


def say(rnd, n):
    return " ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_pieces_reach_the_end_of_a_text():
    long = " ".join(str(i) for i in range(20_000))
    got = tx.spread_pieces(long)
    assert len(got) == tx.PIECES and long.encode().endswith(got[-1]) and long.encode().startswith(got[0])
    assert b"".join(tx.spread_pieces("short " * 50)) == b"short " * 50 and tx.spread_pieces("") == []


def test_words_late_in_long_texts_are_learned(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(120):
        text, bad = say(rnd, 4_200), i % 3 == 0
        assert len(text) > 20_000
        rows.append((i, text + (" " + " ".join(rnd.choice(["wretchplague", "grimfester", "vilequack"]) for _ in range(30)) if bad else " " + say(rnd, 30))))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b"wretchplague" in model.toxic and b"wretchplague" not in model.ordinary
    got = {r.doc_id: r.predicted for r in tx.toxicity_scores(docs, model).collect()}
    assert sum(got[i] == bad for i, bad in labels) >= 114


def test_one_label_gives_no_model(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    assert tx.train(docs, spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")) is None
