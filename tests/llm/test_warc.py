import base64
import gzip
import hashlib
import os
import random

import pyarrow as pa
import pytest

from ballotry.llm import warc as wa
from ballotry.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, digest int, payload int"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read(data):
    return list(wa.salvage(wa.Source(pa.BufferReader(data), len(data))))


def some(n, size=200):
    rng = random.Random(n)
    return [wa.page_record(i, f"http://x/{i}", bytes(rng.choice(b"ab<p>\r\n ") for _ in range(size)), wa.record_id(i), None, None, "2020-01-01T00:00:00Z") for i in range(n)]


def ids(got):
    return [int(r.get("x-page-id")) for r in got if isinstance(r, wa.Record)]


def gaps(got):
    return [(g.begin, g.end) for g in got if isinstance(g, wa.Gap)]


@pytest.mark.parametrize("member", [wa.compressed, lambda r: r])
def test_records_after_damage_are_recovered(member):
    parts = [member(r) for r in some(9)]
    at = [sum(map(len, parts[:i])) for i in range(10)]
    whole = b"".join(parts)
    assert ids(read(whole)) == list(range(9)) and gaps(read(whole)) == []
    for damage in (
        whole[: at[3] + 20] + b"\xff" * 40 + whole[at[3] + 60 :],  # bytes of a record overwritten
        whole[: at[3]] + b"\x00" * 20 + whole[at[3] + 20 :],  # its version line or member header
        whole[: at[3] + 60] + whole[at[4] - 30 :],  # bytes lost
        whole[: at[4] - 1] + b"!" + whole[at[4] :],  # its last byte
    ):
        got = read(damage)
        assert ids(got) == [0, 1, 2, 4, 5, 6, 7, 8]
        assert gaps(got) == [(at[3], at[4] - len(whole) + len(damage))]
    got = read(b"junk" + whole + whole[: len(parts[0]) // 2])
    assert ids(got) == list(range(9)) and gaps(got) == [(0, 4), (len(whole) + 4, len(whole) + 4 + len(parts[0]) // 2)]
    assert read(b"") == [] and gaps(read(b"nothing here")) == [(0, 12)]


def test_a_whole_frame_is_skipped_as_a_whole():
    """A record that a damaged record's payload holds isn't taken for one of the archive's."""
    inner = some(1)[0]
    outer = wa.page_record(7, None, b"<p>" + inner + b"</p>", wa.record_id(7), None, None, "d")
    last = wa.page_record(8, None, b"x", wa.record_id(8), None, None, "d")
    bad = outer.replace(b"</p>", b"</q>")
    assert ids(read(outer + last)) == [7, 8] and ids(read(bad + last)) == [8] and gaps(read(bad + last)) == [(0, len(bad))]
    assert ids(read(wa.compressed(bad) + wa.compressed(last))) == [8]


def test_other_writers():
    records = some(5, 300_000)
    one = gzip.compress(b"".join(records))  # all records in one member
    assert ids(read(one)) == list(range(5))
    cut = read(one[: len(one) // 2])
    assert 0 < len(ids(cut)) < 5 and len(gaps(cut)) == 1
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <x>\r\nX-Page-ID:\r\n 4\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert ids(read(bare)) == [4] and read(bare)[0].block == b"ok"
    wrong = gzip.compress(bare)[:-8] + b"\0" * 8  # without digests the member's checksum decides
    assert ids(read(wrong)) == []
    other = bare.replace(b"Content-Length: 2", b"Content-Length: 99999999")
    assert ids(read(other + bare)) == [4] and gaps(read(other + bare)) == [(0, len(other))]


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    first, out = {}, []
    for i in order:
        page, _, html, *_ = rows[i]
        data = (html or "").encode()
        kind = "revisit" if data in first else "response"
        to = first.setdefault(data, page) if kind == "revisit" else None
        first.setdefault(data, page)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, to))
    return sorted(out, key=str)


def test_spark_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(200)]), rng.choice([None, "http://a/ü b", "u"]), rng.choice([None, "", "<p>é</p>", "<p>2</p>\r\n\r\nWARC/1.1\r\n", f"<i>{i}"]), 1, 1) for i in range(300)]
    rows += [(1000, "u", "long " * 200_000, 1, 1), (1001, "u", "long " * 200_000, 1, 1), (5, "u", "same", 1, 1), (5, "u", "same", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in wa.archive_pages(df).collect()), key=str)
    assert got == brute(rows)
    assert wa.archive_pages(df.limit(0)).count() == 0
    alone = wa.archive_pages(df, least_bytes=5).where("record_type = 'revisit' and payload_bytes < 5").count()
    assert alone == 0


def test_archives_are_bounded_and_salvaged(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh <>") for _ in range(3000)), 1, 1) for i in range(400)]
    archives = wa.write_archives(spark.createDataFrame(rows, SCHEMA), Scratch(spark), archive_bytes=40_000)
    made = archives.collect()
    assert len(made) > 8 and all(r.bytes < 45_000 for r in made) and sum(r.records for r in made) == 400
    for r in made:
        path = r.path.removeprefix("file://")
        data = open(path, "rb").read()
        assert len(data) == r.bytes == os.path.getsize(path)
        text = gzip.decompress(data)  # any gzip reader opens it
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Type: response") == r.records
    hurt = made[0].path.removeprefix("file://")
    data = bytearray(open(hurt, "rb").read())
    data[5000:5010] = b"\0" * 10
    open(hurt, "wb").write(data)
    got = wa.read_archives(archives).collect()
    pages = {r.page_id: r.payload.decode() for r in got if r.record_type == "response"}
    lost = [r for r in got if r.record_type == "gap"]
    assert len(pages) == 399 and all(rows[i][2] == html for i, html in pages.items())
    assert len(lost) == 1 and lost[0].path == made[0].path and lost[0].offset <= 5000 < lost[0].gap_end
