import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from ballotry.llm import mixing

WEIGHTS = (3, 1, 2)


def plain_targets(by):
    """Targets of the sources with sizes ``by``, by filling up round after round."""
    names = sorted((s for s in by if s is not None)) + [s for s in by if s is None]
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = Fraction(3, 2) * sum(by.values()), {}, list(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * by[s]]
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: Fraction(2 * by[s]) for s in full}
        open_ = [s for s in open_ if s not in full]
    return target


def brute(rows):
    """Sorted rows of the contract's columns: one queue over all passes of all documents."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, text, source, *_ in rows:
        by[source] += size(text)
    target = plain_targets(by)
    units = defaultdict(int)
    for i, text, source, *_ in rows:
        units[source, hashlib.md5(f"{'' if i is None else i}:{text or ''}".encode()).hexdigest()] += size(text)
    queue, run = [], defaultdict(int)
    for (source, key), n in sorted(units.items(), key=lambda u: (str(u[0][0]), u[0][1])):
        if n:
            run[source] += n
            queue += [(float(run[source] + e * by[source]) / float(target[source]), source is None, source or "", key, e, n) for e in (0, 1)]
    used, taken, budget = 0, defaultdict(int), 1.5 * sum(by.values())
    for _, none, source, key, _, n in sorted(queue):
        used += n
        if used <= budget:
            taken[None if none else source, key] += 1
    out = []
    for i, text, source, *_ in rows:
        key = hashlib.md5(f"{'' if i is None else i}:{text or ''}".encode()).hexdigest()
        out.append((i, size(text), by[source], float(target[source]), size(text) * taken[source, key]))
    return sorted(out, key=str)


def documents(n=240):
    sources = ["web", "web", "web", "books", "code", None, "wiki", "é"]
    rows = [(i, "word " * (i * 37 % 53), sources[i * 7 % 8], "mine", 5) for i in range(n)]
    rows += [(7, "a repeated row", "web", "mine", 5)] * 3 + [(8, "same id", "books", "x", 1), (8, "another, longer text", "books", "x", 1)]
    rows += [(900, None, "web", "x", 1), (901, "", "code", "x", 1), (902, " \t\n", None, "x", 1), (None, "no id at all", "web", "x", 1)]
    return rows + [(903, "long " * 60_000, "books", "x", 1)]


SCHEMA = "doc_id long, text string, source string, target string, size int"


@pytest.mark.parametrize("rows", [documents(), documents(40)[:30], [(1, "a b", "s", "t", 1)], [(1, None, None, "t", 1)]])
def test_mix_equals_one_queue(spark, rows):
    got = mixing.weighted_fair_mix(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, got.collect()), key=str)
    want = brute(rows)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert all(r[4] <= 2 * r[1] for r in got)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.weighted_fair_mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def test_mixed_rows_are_those_taken(spark):
    extra = SCHEMA + ", mix_key long, passes long, row string"
    rows = [(*r, 3, 4, "r") for r in documents(120)]
    docs = spark.createDataFrame(rows, extra)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    want = []
    taken = {(r.doc_id, r.size): r.taken for r in mixing.weighted_fair_mix(docs).collect()}
    for r in rows:
        n = len((r[1] or "").split())
        want += [r] * (taken[r[0], n] // n if n else 0)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
