import hashlib
import random
import re
import zlib
from itertools import groupby

from ballotry.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, cost int"
NAMES = ["conv_id", *cv.COUNTS, "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit, repaired) over all edits of rows (role, text, must_delete, truncated), tried one by one."""
    best = [3 * len(rows), "D" * len(rows), []]

    def go(i, cost, audit, out, run):
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (cost, audit) < (best[0], best[1]):
            best[:] = cost, audit, list(out)
        if run < 3:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", out + [(role, "")], run + 1)
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(i + 1, cost + 3, audit + "D", out, 0)
            if not must:
                go(i + 1, cost + cut, audit + "K", out + [(role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + cut, audit + "R", out + [(new, text)], 0)

    go(0, 0, "", [], 0)
    return best


def brute(rows, damage):
    got = []
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        after = []
        for _, turn, role, text, *_ in own:
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20 if damage else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in after:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, out = cheapest([(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(after, faults)])
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        hashed = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        got.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashed))
    return sorted(got, key=str)


def test_search_equals_all_edits():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "c!"]), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randint(0, 5))]
        one = cv.Repair()
        decided = []
        for role, text, must, cut in rows:
            one.row(role, text.encode(), must, cut)
            decided += one.decided
            one.decided = []
        cost = one.finish()
        decided += one.decided
        want = cheapest(rows)
        assert [cost, "".join(e for e, *_ in decided)] == want[:2], rows
        assert [(r.decode(), t.decode()) for _, r, t in decided if r is not None] == want[2], rows


def test_memory_holds_what_is_undecided():
    rng = random.Random(6)
    one, most = cv.Conversation(), 0
    for i in range(20_000):
        one.add(i, rng.choice(["user", "assistant", "assistant", "system"]), f"text {i}".encode(), rng.choice([0, 0, 0, 1, 2, 3]))
        most = max(most, one.repair.undecided())
    (_, _, _, _, _, cost, audit, _), _ = one.finish()
    assert most < 200 and len(audit.replace("I", "")) == 20_000 and cost > 0


def random_rows(rng, n):
    text = lambda: rng.choice(["Yes.", "No", "a b!", "", " \t", None, "Why?", "x. y", "é.\n"])
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(0, 4)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text(), 1))
    return rows


def test_spark_equals_brute_force(spark):
    rows = random_rows(random.Random(7), 150)
    df = spark.createDataFrame(rows, SCHEMA)
    for damage in (False, True):
        got = sorted((tuple(r[c] for c in NAMES) for r in cv.repair(df, damage).collect()), key=str)
        assert got == brute(rows, damage)


def test_turns_hot_conversation_and_empty(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"Line {i}." + "x" * (200_000 if i == 500 else 0) + ".", 1) for i in range(3000)]
    rows += [(2, 0, "assistant", "Hello.", 1), (3, 0, "user", "Same.", 1), (3, 0, "user", "Same.", 1), (3, 1, "assistant", "End", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    by = {r.conv_id: r for r in cv.repair(df).collect()}
    assert by[1].audit == "K" * 3000 and by[1].cost == 0 and by[2].audit == "IK" and by[3].audit == "KDK" and (by[3].cost, by[3].truncated, by[3].duplicate) == (4, 1, 1)
    turns = sorted(map(tuple, cv.repaired_turns(df).collect()))
    assert [t[2:] for t in turns if t[0] == 1] == [r[2:4] for r in rows[:3000]] and turns[3000:3002] == [(2, 1, "user", ""), (2, 2, "assistant", "Hello.")]
    for c in (1, 3):
        text = "\n".join(f"{r}:{t}" for i, _, r, t in turns if i == c)
        assert by[c].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert cv.repair(df.limit(0)).count() == 0 and cv.repair(spark.createDataFrame([(1, None, None, None, 1)], SCHEMA)).first().audit == "D"
