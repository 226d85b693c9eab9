from ballotry.streaming import ingest as st


def test_each_key_once_over_restarts(spark, tmp_path):
    rows = spark.createDataFrame([(i, None, i % 3, "a", float(i)) for i in range(20)], st.EVENTS)
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows.coalesce(1).write.json(folder)
    st.ingest(st.once_by_key(st.arriving(spark, folder), "event_id"), out, ck)
    rows.where("event_id < 5").coalesce(1).write.mode("append").json(folder)
    (tmp_path / "in" / "torn.json").write_text('{"event_id": 99, "user')
    st.ingest(st.once_by_key(st.arriving(spark, folder), "event_id"), out, ck)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(20))


def test_summary_keeps_one_row_a_group_over_restarts_and_replays(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    key = ["model_slug", "task", "seed"]
    rows = lambda a, b: spark.createDataFrame([("m", "t", i % 2, i, [i, 1]) for i in range(a, b)], st.RECORDS)

    def run():
        stream = st.once_by_key(st.arriving(spark, folder, st.RECORDS, files_per_trigger=1), [*key, "instance_id"])
        st.live_summary(stream.withColumn("tokens", stream.gen_lens[0]), key, "tokens", out, ck)
        return {r.seed: (r.n, r.total) for r in st.read_summary(spark, out, key).collect()}

    for step in range(5):
        rows(10 * step, 10 * step + 12).coalesce(1).write.mode("append").json(folder)  # two of the next step's too
        want = range(10 * step + 12)
        assert run() == {s: (sum(i % 2 == s for i in want), float(sum(i for i in want if i % 2 == s))) for s in (0, 1)}
    assert run() == run()
    state = spark.read.parquet(out)
    assert state.count() <= 2 * 2  # two slots of two groups
    # a batch that is run again gives the same state
    newest = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    before = run()
    (tmp_path / "ck" / "commits" / str(newest)).unlink()
    crc = tmp_path / "ck" / "commits" / f".{newest}.crc"
    if crc.exists():
        crc.unlink()
    assert run() == before
