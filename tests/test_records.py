"""Record files: blank lines, unparsable lines, names, fields."""

import hashlib

import pytest

from ballotry.sources import records as re_


def test_scan_names_and_fields(spark, tmp_path):
    (tmp_path / "big_model__maths.jsonl").write_text('{"K": 1, "seed": 0, "instance_id": 0, "max_tokens": 7}\n\n{"K": 1, "seed": 0, "instance_id": 1, "max_tokens": 7, "provenance": {"max_tokens": 9}}\n')
    (tmp_path / "big_model__maths.1.jsonl").write_text('{"K": 2, "seed": 1, "instance_id": 0}\n')
    (tmp_path / "small__qa.jsonl").write_text('{"K": 1, "seed": 0, "instance_id": 0}\n')
    rows = re_.read_records(spark, str(tmp_path))
    assert rows.count() == 4
    assert {(r.model, r.task): r.n for r in re_.file_cells(rows).collect()} == {("big_model", "maths"): 3, ("small", "qa"): 1}
    assert sorted(r[0] or 0 for r in rows.select(re_.field("max_tokens")).collect()) == [0, 0, 7, 9]


def test_one_unparsable_line_is_an_error(spark, tmp_path):
    (tmp_path / "m__t.jsonl").write_text('{"K": 1}\n{"K": \n')
    with pytest.raises(Exception, match="unparsable record"):
        re_.read_records(spark, str(tmp_path)).collect()


def test_file_fingerprints(spark, tmp_path):
    files = {"a__t.jsonl": b'{"K": 1}\n', "b__t.jsonl": b"", "c__t.jsonl": b'{"K": 1}\n'}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file: (r.md5, r.bytes) for r in re_.fingerprints(spark, str(tmp_path)).collect()}
    assert got == {name: (hashlib.md5(content).hexdigest(), len(content)) for name, content in files.items() if content}


def test_fingerprint_query_covers_every_record_file(spark):
    from ballotry.queries.registry import QUERIES
    import ballotry.queries  # noqa: F401

    sf_dir = "/root/testdata/sf0.001"
    prints = QUERIES["s09b_file_fingerprints"](spark, sf_dir).collect()
    cells = QUERIES["s01_record_scan"](spark, sf_dir).collect()
    assert {r.file.split(".")[0] for r in prints} == {f"{r.model.replace(' ', '_')}__{r.task}" for r in cells}
    assert all(r.bytes > 0 and len(r.md5) == 32 for r in prints)
