"""Repair of conversations by the cheapest edits that make their roles alternate.

A conversation is a stream of rows (role, text). Edits are K (keep), R (rerole), D (delete) and I
(insert an empty turn); they must give role initials ``(s?(ua)+)?``. A Viterbi search holds for each
of four states (nothing yet, after the system turn, after a user's, after an assistant's) the
cheapest edits so far, of equals the ASCII-least.

The survivors are leaves of a tree of back pointers whose nodes count their children. As soon as all
survivors descend from one child of the root, that edit is decided: it is emitted and the root moves
on. So memory holds what is undecided, not the conversation; ties are compared over the complete
undecided edits, from where two survivors part. Survivors that can't win any more (``prune``) are
dropped, as the one that has deleted everything so far would otherwise never join the others.

Spark deals and sorts the rows: one shuffle by (conversation, role, text) finds repeated rows, one
by conversation orders them. A conversation is one stream in one task, since a hash over its
repaired rows is sequential; a task reads rows, and never holds all rows of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, lean

#: What edits cost beside keeping, and what a truncated row costs unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of an initial, by the state before it; and the role that the next turn gets.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
EXPECTED = {NOTHING: (USER, b"user"), SYSTEM: (USER, b"user"), USER: (ASSISTANT, b"assistant"), ASSISTANT: (USER, b"user")}
LEGAL = frozenset({"su", "ua", "au"})


class Node:
    """An edit, the turn that it leaves (None: none), and the edits before it."""

    __slots__ = ("up", "edit", "role", "text", "depth", "refs", "kids", "held")

    def __init__(self, up: Node | None, edit: str, role: bytes | None = None, text: bytes | None = None):
        self.up, self.edit, self.role, self.text = up, edit, role, text
        self.depth = up.depth + 1 if up else 0
        self.refs, self.kids, self.held = 0, [], False


def less(a: Node, b: Node) -> bool:
    """Whether the edits up to a come before those up to b: compared from where they part."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.up
        else:
            right.append(b.edit)
            b = b.up
    return left[::-1] < right[::-1]


Survivor = tuple[int, Node] | None


def better(one: Survivor, other: Survivor) -> Survivor:
    if one is None or other is None:
        return one or other
    if one[0] != other[0]:
        return one if one[0] < other[0] else other
    return one if less(one[1], other[1]) else other


class Repair:
    """The search over one conversation. ``decided`` collects (edit, role, text) that no later row can change."""

    def __init__(self) -> None:
        self.root = Node(None, "")
        self.root.held = True
        self.live: list[Survivor] = [(0, self.root), None, None, None]
        self.root.refs = 1
        self.decided: list[tuple[str, bytes | None, bytes | None]] = []

    def inserted(self) -> list[Survivor]:
        """The survivors, or other survivors with inserted turns where that is better."""
        got = list(self.live)
        for before in (NOTHING, SYSTEM, ASSISTANT):
            if self.live[before]:
                cost, node = self.live[before]
                if got[USER] is None or cost + INSERT <= got[USER][0]:
                    got[USER] = better(got[USER], (cost + INSERT, Node(node, "I", b"user", b"")))
        if got[USER]:
            cost, node = got[USER]
            if got[ASSISTANT] is None or cost + INSERT <= got[ASSISTANT][0]:
                got[ASSISTANT] = better(got[ASSISTANT], (cost + INSERT, Node(node, "I", b"assistant", b"")))
        return got

    def row(self, role: str, text: bytes, must_delete: bool, truncated: bool) -> None:
        new: list[Survivor] = [None] * 4
        extra, own = TRUNCATED if truncated else 0, role.encode()
        for state, survivor in enumerate(self.inserted()):
            if survivor is None:
                continue
            cost, node = survivor
            new[state] = better(new[state], (cost + DELETE, Node(node, "D")))
            if must_delete:
                continue
            to = NEXT.get((state, role[:1]))
            if to is not None:
                new[to] = better(new[to], (cost + extra, Node(node, "K", own, text)))
            to, name = EXPECTED[state]
            new[to] = better(new[to], (cost + REROLE + extra, Node(node, "R", name, text)))
        self.replace(self.prune(new))

    @staticmethod
    def prune(new: list[Survivor]) -> list[Survivor]:
        """Without survivors that cost more than doing from the state after an assistant's turn what they may still do:
        the same, but that a system turn kept later must be deleted."""
        reach = [s[0] + more for s, more in ((new[ASSISTANT], 0), (new[USER], INSERT)) if s]
        if reach:
            if new[SYSTEM] and new[SYSTEM][0] > min(reach):
                new[SYSTEM] = None
            if new[NOTHING] and new[NOTHING][0] > min(reach) + DELETE:
                new[NOTHING] = None
        return new

    def replace(self, new: list[Survivor]) -> None:
        for survivor in filter(None, new):
            node = survivor[1]
            node.refs += 1
            while not node.held:  # the first reference to a new node counts at its parent too
                node.held = True
                node.up.refs += 1
                node.up.kids.append(node)
                node = node.up
        for survivor in filter(None, self.live):
            node = survivor[1]
            node.refs -= 1
            while node.refs == 0 and node is not self.root:
                up, node.up = node.up, None
                up.kids.remove(node)
                up.refs -= 1
                node = up
        self.live = new
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids.pop()
            self.root.up = None
            self.decided.append((self.root.edit, self.root.role, self.root.text))
            self.root.role = self.root.text = None

    def finish(self) -> int:
        """Decide all edits; their cost."""
        got = self.inserted()
        cost, node = better(got[NOTHING], got[ASSISTANT])
        rest = []
        while node is not self.root:
            rest.append((node.edit, node.role, node.text))
            node = node.up
        self.decided += rest[::-1]
        return cost

    def undecided(self) -> int:
        """Nodes held."""
        todo, n = [self.root], 0
        while todo:
            n += 1
            todo += todo.pop().kids
        return n


class Conversation:
    """Counts and repaired turns of one conversation, row by row."""

    def __init__(self) -> None:
        self.repair, self.hash, self.turns = Repair(), hashlib.sha256(), 0
        self.audit: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.least = self.most = self.last_role = None

    def add(self, turn: int | None, role: str, text: bytes, fault: int) -> list[tuple[bytes, bytes]]:
        """Faults: 1 blank, 2 duplicate, 3 truncated, 0 none. Returns the repaired turns that are decided now."""
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.numbers = turn, self.numbers + 1
        self.blank, self.duplicate, self.truncated = self.blank + (fault == 1), self.duplicate + (fault == 2), self.truncated + (fault == 3)
        if self.last_role is not None and self.last_role[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.last_role = role
        self.repair.row(role, text, fault in (1, 2), fault == 3)
        return self.take()

    def take(self) -> list[tuple[bytes, bytes]]:
        out = []
        for edit, role, text in self.repair.decided:
            self.audit.append(edit)
            if role is not None:
                self.hash.update(b"\n" + role if self.turns else role)
                self.hash.update(b":")
                self.hash.update(text)
                self.turns += 1
                out.append((role, text))
        self.repair.decided.clear()
        if len(self.audit) > 10_000:
            self.audit = ["".join(self.audit)]
        return out

    def finish(self) -> tuple[tuple, list[tuple[bytes, bytes]]]:
        cost = self.repair.finish()
        rest = self.take()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.numbers
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.hash.hexdigest()), rest


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of every row: a twentieth each is dropped (copies 0), emptied, robbed of its
    sentence ends, repeated (copies 2) or given to the user, by a checksum of conversation and turn. Null roles and
    texts, and null ids and turns in the checksum, count as one space."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind"))
    return base.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 0, F.lit(0)).when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with the first fault of each: 1 blank, 2 role and text seen earlier in
    the conversation, 3 the last character isn't one of ``.!?``; 0 none. Rows without copies see nothing."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(".", "!", "?")
    # rows that can't be duplicates (blank or dropped) don't meet in one group
    apart = F.when(blank | (F.col("copies") == 0), F.xxhash64("turn") % 1024)
    place = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "apart").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("is_blank"), 1).when(F.col("place") > 1, 2).when(~F.col("ends"), 3).otherwise(0)
    got = rows.withColumn("is_blank", blank).withColumn("ends", ends).withColumn("apart", apart).withColumn("place", place)
    return got.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _stream(rows: DataFrame, turns: bool) -> DataFrame:
    """One row a conversation, or one row a repaired turn."""
    summary = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]) if turns else summary
    flush_bytes = 4 << 20

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, held, size, position = None, None, [], 0, 0

        def keep(decided: list[tuple[bytes, bytes]]) -> None:
            nonlocal size, position
            if turns:
                for role, text in decided:
                    position += 1
                    held.append((at, position, role.decode(), text.decode()))
                    size += len(text) + 64

        def close() -> None:
            nonlocal size, position
            got, rest = one.finish()
            keep(rest)
            if not turns:
                held.append((at, *got))
                size += len(got[6]) + 200
            position = 0

        def ready() -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")]
            for conv, turn, role, text, copies, fault in zip(*columns):
                if one is None or conv != at:
                    if one is not None:
                        close()
                    at, one = conv, Conversation()
                for again in range(copies):
                    keep(one.add(turn, role, text, fault if not again or fault == 1 else 2))
                if size > flush_bytes:
                    yield ready()
                    held, size = [], 0
        if one is not None:
            close()
        if held:
            yield ready()

    sql = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in out)
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "fault")
    return dealt.withColumn("text", F.col("text").cast("binary")).mapInArrow(lean(each), sql)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"), F.lit(1).alias("copies"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position from 1, role, text): the repaired conversations of rows (conv_id, turn, role, text)."""
    bound_batches(rows.sparkSession)
    return _stream(with_faults(_plain(rows)), True)


def repair(rows: DataFrame, damage: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Defined results: rows go by turn, null turns first, and within a turn by role and text; rows that are equal in all
    are adjacent and all but the first are duplicates; null roles and texts are one space; null ids are one
    conversation; of a conversation that ``damage`` leaves nothing of the counts are zero, the audit is empty and the
    hash that of the empty string; an empty table gives no rows; other columns don't matter.
    """
    bound_batches(rows.sparkSession)
    return _stream(with_faults(damaged(rows) if damage else _plain(rows)), False)


#: The same in DuckDB: the search as a recursion over positions that keeps the cheapest of each state.
REPAIR_SQL = r"""
with recursive tbl as (select list(c order by i) t from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i))),
b as (select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') key from conversations),
k as (select b.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 kind from b, tbl),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text,
    unnest(case kind when 0 then []::int[] when 3 then [1, 2] else [1] end) copy from k),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) place,
    regexp_extract_all(text, '[^\x20\x09-\x0D]')[-1] final, lag(role) over (partition by conv_id order by turn nulls first, role, text, copy) before from d),
r as (select conv_id, turn, role, text, i, before, case when final is null then 1 when place > 1 then 2 when final not in ('.', '!', '?') then 3 else 0 end fault from o),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (fault = 1) blank, count(*) filter (fault = 2) duplicate,
    count(*) filter (fault = 3) truncated, count(*) filter (i > 1 and before[1] || role[1] not in ('su', 'ua', 'au')) illegal, count(*) n from r group by conv_id),
ins(st, ins, added, mid) as (values (0, '', '', 0), (1, '', '', 1), (2, '', '', 2), (3, '', '', 3), (0, 'I', 'u', 2), (1, 'I', 'u', 2), (3, 'I', 'u', 2), (2, 'I', 'a', 3), (0, 'II', 'ua', 3), (1, 'II', 'ua', 3)),
step(mid, e, init, nxt, c) as (values (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
    (0, 'R', '', 2, 2), (1, 'R', '', 2, 2), (2, 'R', '', 3, 2), (3, 'R', '', 2, 2), (0, 'D', '', 0, 3), (1, 'D', '', 1, 3), (2, 'D', '', 2, 3), (3, 'D', '', 3, 3)),
v as (select conv_id, 0::bigint i, 0 st, 0::bigint cost, '' audit, []::varchar[] turns from c
    union all
    select conv_id, i, st, m.cost, m.audit, m.turns from (
        select v.conv_id, r.i, step.nxt st, min({'cost': v.cost + 2 * length(ins.ins) + step.c + (fault = 3 and e <> 'D')::bigint, 'audit': v.audit || ins.ins || e,
            'turns': v.turns || case ins.added when 'u' then ['user:'] when 'a' then ['assistant:'] when 'ua' then ['user:', 'assistant:'] else []::varchar[] end
                || case e when 'K' then [role || ':' || text] when 'R' then [case nxt when 2 then 'user:' else 'assistant:' end || text] else []::varchar[] end}) m
        from v join r on r.conv_id is not distinct from v.conv_id and r.i = v.i + 1 join ins on ins.st = v.st join step on step.mid = ins.mid
        where (e <> 'K' or role[1] = init) and (fault not in (1, 2) or e = 'D') group by v.conv_id, r.i, step.nxt)),
f as (select c.conv_id, min({'cost': cost + 2 * length(ins.ins), 'audit': audit || ins.ins, 'turns': turns || case ins.added when 'u' then ['user:'] when 'a' then ['assistant:'] when 'ua' then ['user:', 'assistant:'] else []::varchar[] end}) m
    from c join v on v.conv_id is not distinct from c.conv_id and v.i = c.n join ins on ins.st = v.st where ins.mid in (0, 3) group by c.conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
    coalesce(m.cost, 0)::bigint cost, coalesce(m.audit, '') audit, sha256(coalesce(array_to_string(m.turns, chr(10)), '')) repaired_sha256
from (select distinct conv_id::bigint conv_id from conversations) a left join c on c.conv_id is not distinct from a.conv_id left join f on f.conv_id is not distinct from a.conv_id
"""
