"""Scoring and extraction over texts derived from orders, documents and the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballotry import fixtures as fx
from ballotry.functions import extraction as ex
from ballotry.functions import scoring as sc
from ballotry.operators.tokens import token_f1

from .registry import query, sql

#: Predictions and golds in several spellings of a number.
PAIRS = """select o_orderkey id, o_orderstatus task, case o_orderkey % 9 when 0 then cast(n as varchar(20)) when 1 then cast(n as varchar(20)) || '.'
    when 2 then cast(n1 as varchar(20)) || ',' || lpad(cast(n % 1000 as varchar(20)), 3, '0') when 3 then cast(n as varchar(20)) || '.0005' when 4 then 'The Answer, an apple!'
    when 5 then ' ' || cast(n as varchar(20)) || ' ' when 6 then cast(n1 as varchar(20)) || '{{,}}' || lpad(cast(n % 1000 as varchar(20)), 3, '0') when 7 then null else 'Yes. ' end pred,
  case when o_orderkey % 9 = 4 then 'answer  apple' when o_orderkey % 9 = 8 then 'yes' else cast(n as varchar(20)) end gold
from (select *, cast((n - n % 1000) / 1000 as bigint) n1 from (select o_orderkey, o_orderstatus, o_custkey * 7 % 5000 + 1000 n from {orders}))"""
PAIRS_SQL = "pairs as (" + PAIRS.format(orders="orders") + ")"
#: Numbers with separators are taken whole, and joined again if each later group has three digits.
_SEP = r"(?:\{{,\}}|\\[,;! ]|~)"
STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
THOUSANDS = "array_to_string(list_transform(regexp_extract_all({0}, '[0-9]+(?:" + _SEP + "[0-9]+)*|[^0-9]+'), lambda t: case when regexp_full_match(t, '[0-9]+(?:" + _SEP + "[0-9]{{3}})+') then regexp_replace(t, '" + _SEP + "', '', 'g') else t end), '')"
CLEAN = STRIP.format("regexp_replace(" + STRIP.format("replace(" + THOUSANDS + ", ',', '')") + r", '\.$', '')")
NUMB = "case when regexp_matches({0}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({0} as double) end"
PUNCT = "'" + sc.PUNCTUATION.replace("'", "''") + "'"
SQUEEZE = r"trim(regexp_replace({0}, '[ \t\r\n\f]+', ' ', 'g'))"
SQUAD = SQUEEZE.format(r"regexp_replace(translate(lower({0}), " + PUNCT.replace("{", "{{").replace("}", "}}") + r", ''), '\b(a|an|the)\b', ' ', 'g')")
HOTPOT = SQUEEZE.format(r"translate(regexp_replace(lower({0}), '\b(a|an|the)\b', ' ', 'g'), " + PUNCT.replace("{", "{{").replace("}", "}}") + ", '')")


def pred():
    return F.col("pred")


def gold():
    return F.col("gold")


def trace():
    return F.col("trace")


def cut():
    return F.col("truncated")


def pairs(spark, sf):
    return spark.sql(PAIRS.format(orders=fx.table(sf, "orders")))


def _n(x):
    return NUMB.format(CLEAN.format(x))


query("f01_clean_number", sql([PAIRS_SQL], f"select id, {CLEAN.format('pred')} x from pairs", "id, x"))(lambda s, d: pairs(s, d).select("id", sc.clean_number(pred()).alias("x")))
NUMERIC = f"coalesce(case when {_n('pred')} is not null and {_n('gold')} is not null then abs({_n('pred')} - {_n('gold')}) < 1e-3::double else {CLEAN.format('pred')} = {CLEAN.format('gold')} end, false)"
query("f02_numbers_match", sql([PAIRS_SQL], f"select id, {NUMERIC} ok from pairs", "id, ok"))(lambda s, d: pairs(s, d).select("id", sc.numbers_match(pred(), gold()).alias("ok")))
query("f03_thousands_free", sql([PAIRS_SQL], f"select id, {THOUSANDS.format('pred')} x from pairs", "id, x"))(lambda s, d: pairs(s, d).select("id", sc.thousands_free(pred()).alias("x")))
query("f04_squad_text", sql([PAIRS_SQL], f"select id, {SQUAD.format('pred')} x from pairs union all select doc_id, {SQUAD.format('text')} from documents", "id, x"))(
    lambda s, d: pairs(s, d).select("id", sc.squad_text(pred()).alias("x")).unionAll(fx.read(s, d, "documents").select("doc_id", sc.squad_text(F.col("text"))))
)
query("f05_hotpot_text", sql([PAIRS_SQL], f"select id, {HOTPOT.format('pred')} x from pairs union all select doc_id, {HOTPOT.format('text')} from documents", "id, x"))(
    lambda s, d: pairs(s, d).select("id", sc.hotpot_text(pred()).alias("x")).unionAll(fx.read(s, d, "documents").select("doc_id", sc.hotpot_text(F.col("text"))))
)
#: Every document as a prediction for one benchmark item.
DOCPAIR = "dp as (select d.doc_id, d.text pred, b.text gold from documents d join (select *, row_number() over (order by item_id) - 1 rn, count(*) over () n from benchmark) b on d.doc_id % b.n = b.rn)"
F1 = r"""tk as (select doc_id, unnest(regexp_extract_all(lower(pred), '[\p{L}\p{N}_]+')) t, 1 a, 0 b from dp union all select doc_id, unnest(regexp_extract_all(lower(gold), '[\p{L}\p{N}_]+')), 0, 1 from dp),
tc as (select doc_id, t, sum(a) a, sum(b) b from tk group by all), ts as (select doc_id, sum(a) np, sum(b) ng, sum(least(a, b)) o from tc group by all),
f as (select dp.*, case when coalesce(np, 0) = 0 and coalesce(ng, 0) = 0 then 1.0::double when coalesce(np, 0) = 0 or coalesce(ng, 0) = 0 then 0.0::double else 2.0::double * o / (np + ng) end f1 from dp left join ts using (doc_id))"""


def doc_pairs(s, d):
    from pyspark.sql import Window

    b = fx.read(s, d, "benchmark").select(F.col("text").alias("gold"), (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("rn"), F.count("*").over(Window.partitionBy()).alias("n"))
    n = b.count()
    docs = fx.read(s, d, "documents").select("doc_id", F.col("text").alias("pred"), (F.col("doc_id") % n).alias("rn"))
    return docs.join(b.drop("n"), "rn").drop("rn")


query("f06_token_f1", sql([DOCPAIR, F1], "select * from f", "doc_id", "f1"))(lambda s, d: token_f1(doc_pairs(s, d), "doc_id", pred(), gold()))
query("f07_span_correct", sql([DOCPAIR, F1], f"select doc_id, {HOTPOT.format('pred')} = {HOTPOT.format('gold')} or f1 >= 0.5::double ok from f", "doc_id, ok"))(
    lambda s, d: (lambda x: x.join(token_f1(x, "doc_id", pred(), gold()), "doc_id").select("doc_id", ((sc.hotpot_text(pred()) == sc.hotpot_text(gold())) | (F.col("f1") >= 0.5)).alias("ok")))(doc_pairs(s, d))
)
query("f08_span_contained", sql([DOCPAIR, F1], f"select doc_id, contains({HOTPOT.format('pred')}, {HOTPOT.format('gold')}) or f1 >= 0.5::double ok from f", "doc_id, ok"))(
    lambda s, d: (lambda x: x.join(token_f1(x, "doc_id", pred(), gold()), "doc_id").select("doc_id", (sc.SCORERS["contained"](pred(), gold()) | (F.col("f1") >= 0.5)).alias("ok")))(doc_pairs(s, d))
)
YN = r"lower(trim(regexp_replace(trim({0}), '[!-/:-@\[-`{{-~]+$', '')))"
query("f09_yes_no", sql([PAIRS_SQL], f"select id, {YN.format('pred')} x, lower(trim(regexp_replace(trim(pred), '[.!?;,]+$', ''))) legacy from pairs", "id, x, legacy"))(lambda s, d: pairs(s, d).select("id", sc.yes_no(pred()).alias("x"), sc.yes_no(pred(), True).alias("legacy")))
query("f10_letter", sql([PAIRS_SQL], "select id, coalesce(upper(trim(pred)) = upper(trim(gold)), false) ok from pairs", "id, ok"))(lambda s, d: pairs(s, d).select("id", sc.SCORERS["letter"](pred(), gold()).alias("ok")))
def _not(x):
    v = f"round({_n(x)}, 3)"
    return f"coalesce(case when {v} = floor({v}) then floor({v})::bigint::varchar else {v}::varchar end, {SQUAD.format(x)})"


query("f11_number_or_text", sql([PAIRS_SQL], f"select id, coalesce({_not('pred')} = {_not('gold')}, false) ok, coalesce({SQUAD.format('pred')} = {SQUAD.format('gold')}, false) alias_ok from pairs", "id, ok, alias_ok"))(
    lambda s, d: pairs(s, d).select("id", sc.SCORERS["number_or_text"](pred(), gold()).alias("ok"), sc.SCORERS["alias"](pred(), gold()).alias("alias_ok"))
)
query("f12_stored_bucket", sql([fx.PATHS_SQL], "select model, task, arm, count(*) filter (coalesce(answer = gold, false)) hits, count(*) filter (regexp_matches(answer, '^P+$')) passes from paths group by all", "model, task, arm, hits, passes"))(
    lambda s, d: fx.paths(s, d).groupBy("model", "task", "arm").agg(F.count_if(sc.SCORERS["stored"](F.col("answer"), F.col("gold"))).alias("hits"), F.count_if(F.col("answer").rlike("^P+$")).alias("passes"))
)
RULES = {"F": "numeric", "O": "alias", "P": "yesno"}
BUCKET = f"case task when 'F' then coalesce(round({_n('pred')}, 3)::varchar, {CLEAN.format('pred')}) when 'O' then {SQUAD.format('pred')} else {YN.format('pred')} end"
query("f13_vote_bucket", sql([PAIRS_SQL], f"select id, case when trim(b) <> '' then b end bucket from (select id, {BUCKET} b from pairs)", "id, bucket"))(lambda s, d: pairs(s, d).select("id", sc.bucket(F.col("task"), pred(), RULES).alias("bucket")))
query("f14_exact", sql([PAIRS_SQL], "select id, coalesce(lower(trim(pred)) = lower(trim(gold)), false) ok from pairs", "id, ok"))(lambda s, d: pairs(s, d).select("id", sc.SCORERS["exact"](pred(), gold()).alias("ok")))
NT = lambda x: NUMB.format(f"trim({x})")
query("f15_answers_match", sql([PAIRS_SQL], f"select id, coalesce(case when {NT('pred')} is not null and {NT('gold')} is not null then abs({NT('pred')} - {NT('gold')}) < 1e-3::double else trim(pred) = trim(gold) end, false) ok from pairs", "id, ok"))(lambda s, d: pairs(s, d).select("id", sc.answers_match(pred(), gold()).alias("ok")))
query("f16_gold_bucket", sql([PAIRS_SQL], f"select id, case when task = 'F' then {SQUAD.format('gold')} else trim(replace(gold, ',', '')) end bucket from pairs", "id, bucket"))(lambda s, d: pairs(s, d).select("id", sc.gold_bucket(F.col("task"), gold(), {"F": "alias"}).alias("bucket")))
query("f17_score_by_task", sql([PAIRS_SQL], f"select task, count(*) n, count(*) filter (case task when 'F' then {NUMERIC} when 'O' then coalesce({SQUAD.format('pred')} = {SQUAD.format('gold')}, false) else coalesce({YN.format('pred')} = {YN.format('gold')}, false) end) hits from pairs group by all", "task, n, hits"))(
    lambda s, d: pairs(s, d).groupBy("task").agg(F.count("*").alias("n"), F.count_if(sc.score(F.col("task"), pred(), gold(), RULES)).alias("hits"))
)

# ------------------------------------------------------------------------------- extraction

N = ex.NUM
def _last(p, x="trace", g=1):
    return f"regexp_extract_all({x}, '{p}', {g})[-1]"


def _first(p, x="trace", g=1):
    return f"regexp_extract_all({x}, '{p}', {g})[1]"


def _tidy(x):
    return f"regexp_replace(translate({x}, '$,', ''), '[.]$', '')"


def _think(x):
    return f"case when contains({x}, '</think>') then {STRIP.format(f"string_split({x}, '</think>')[-1]")} when instr({x}, '<think>') > 1 then {STRIP.format(f"string_split({x}, '<think>')[1]")} else {x} end"


def _leaks(x):
    for marker in ex.LEAKS:
        x = f"regexp_replace({x}, '(?is){marker}.*', '')"
    return STRIP.format(x)


def _box(x):
    """Pieces up to a brace after the last box, their depths, and the text before the first depth of 0."""
    rest = f"string_split({x}, '\\boxed{{')[-1]"
    steps = f"regexp_extract_all({rest}, '[^{{}}]*[{{}}]')"
    depth = f"list_transform({steps}, lambda p, i: 1 + list_sum(list_transform({steps}[1:i], lambda q: case when q[-1] = '{{' then 1 else -1 end)))"
    size = f"list_sum(list_transform({steps}[1:list_position({depth}, 0)], lambda q: len(q)))"
    return f"case when contains({x}, '\\boxed{{') and list_position({depth}, 0) > 0 then {STRIP.format(f'substr({rest}, 1, ({size} - 1)::bigint)')} end"


#: traces with thousands separators removed (norm), artefacts removed from these (cn) and from the trace (ct), and boxes.
TX = [
    fx.TRACES_SQL,
    f"x1 as (select *, {THOUSANDS.format('trace')} norm from traces)",
    f"x2 as (select *, {_think('norm')} th, {_think('trace')} tt from x1)",
    f"x3 as (select *, {_leaks('th')} c0, {_leaks('tt')} ct from x2)",
    f"x4 as (select *, case when len(c0) < 2 then {_leaks('norm')} else c0 end cn from x3)",
    f"x5 as (select *, {_box('cn')} b1, {_box('norm')} b2, {_box('ct')} b3, {_box('trace')} bx from x4)",
    "tx as (select *, coalesce(b1, b2) bn, coalesce(b3, bx) bt from x5)",
]
BOXQ = "bx"
L = ex.LOOSE


def _loose(x):
    return rf"regexp_replace({STRIP.format(f"replace({x}, ',', '')")}, '\.$', '')"


NUMQ = _loose(
    f"coalesce({_last(f'({L})', 'bn')}, nullif(bn, ''), {_last(rf'####\s*({L})', 'cn')}, {_last(rf'(?i)\b(?:final\s+answer|answer)\b\s*(?:is\b|=|:)\s*\$?({L})', 'cn')}, "
    f"case when not truncated then coalesce({_last(rf'(?i)\b(?:result|total)\b\s*(?:is\b|=|:)\s*\$?({L})', 'cn')}, {_last(rf'(?m)=\s*\$?({L})\s*$', 'cn')}, {_last(f'({L})', 'cn')}) end)"
)


def _cap(x):
    return f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"


def _plain(x):
    """Letters beyond ASCII as z: words end at other characters in Spark, and at ASCII ones only in DuckDB."""
    return f"regexp_replace({x}, '[ªµºÀ-ÖØ-öø-ˁͰ-ͽΆ-ҁҊ-ԯא-תء-ي一-鿿ぁ-ヿ가-힣]', 'z', 'g')"


TX += [f"ty as (select *, {_plain('ct')} u, {_plain('bt')} ub from tx)"]
YES_NO = r"\b(yes|no)\b"
YNQ = _cap(f"coalesce({_last('(?i)' + YES_NO, 'ub')}, {_last(r'(?i)####\s*' + YES_NO, 'u')}, {_last('(?i)' + ex.DECLARES_WORD + YES_NO, 'u')}, {_first(r'(?i)^(yes|no)\b', 'u')}, case when not truncated then {_last('(?i)' + YES_NO, 'u')} end)")
ONE = r"\b([ABCD])\b"
LETQ = f"upper(coalesce({_last('(?i)' + ONE, 'ub')}, {_last(r'(?i)####\s*\(?' + ONE, 'u')}, {_last('(?i)' + ex.DECLARES_LETTER + r'\(?' + ONE, 'u')}, {_first(r'^([ABCD])\b', 'u')}, case when not truncated then {_last(ONE, 'u')} end))"
LINE = f"string_split(regexp_replace(string_split(ct, '####')[-1], '^\\s+', ''), chr(10))[1]"
LITQ = f"case when contains(ct, '####') then nullif(case when regexp_full_match({LINE}, '`+.*`+') and len({LINE}) - len(ltrim({LINE}, '`')) = len({LINE}) - len(rtrim({LINE}, '`')) then {STRIP.format(f"trim({LINE}, '`')")} else {STRIP.format(LINE)} end, '') end"
LOW = f"{STRIP.format('lower(trace)')}"
LABQ = f"coalesce({_first(ex.PARITY, LOW)}, {_last('\\b(even|odd)\\b', _plain(LOW))}, {STRIP.format('trace')})"


def tr(name, column, expression):
    query(name, sql(TX, f"select doc_id, {expression} x from ty", "doc_id, x"))(lambda s, d: fx.traces(s, d).select("doc_id", column().alias("x")))


tr("e01_strip_artifacts", lambda: ex.strip_artifacts(trace()), "ct")
tr("e02_final_segment", lambda: ex.final_segment(F.regexp_replace(F.regexp_replace(trace(), "####", "</think>"), "yes", "<|return|>")), "case when contains(trace, '####') then trim(string_split(string_split(string_split(replace(trace, 'yes', '<|return|>'), '####')[-1], '<|return|>')[1], '<|end|>')[1], ' ' || chr(9) || chr(13)) end")
tr("e03_boxed", lambda: ex.boxed(trace()), BOXQ)
tr("e03b_boxed_stripped", lambda: ex.boxed(ex.strip_artifacts(trace())), "b3")
tr("e04_number_answer", lambda: ex.number_answer(trace(), cut()), NUMQ)
tr("e05_number_answer_old", lambda: ex.number_answer_old(trace()), _tidy(f"coalesce({_first(f'####[ \\t]*({N})')}, {_first(f'(?i)(?:answer|result|total)[ \\t]*(?:is|=|:)?[ \\t]*({N})')}, {_last(f'({N})')})"))
tr("e06_yes_no_answer", lambda: ex.yes_no_answer(trace(), cut()), YNQ)
def _lead(x):
    return STRIP.format(rf"rtrim({STRIP.format(f"regexp_replace({STRIP.format(x)}, '{ex.LEAD_IN}', '')")}, '.')")


def _use(x):
    return f"case when {_lead(x)} <> '' and len(string_split_regex({_lead(x)}, '\\s+')) <= 15 then {_lead(x)} end"


def _uses(p):
    return f"list_filter(list_transform(regexp_extract_all(ct, '{p}', 1), lambda m: {_use('m')}), lambda m: m is not null)[-1]"


SPANQ = f"coalesce({_use('bt')}, {_uses(r'####\s*([^\n]+)')}, {_uses(ex.DECLARES + r'([^\n]+)')}, case when not truncated then coalesce({_uses(r'(?i)\b(?:therefore|thus|so)\b\s*,?\s*([^\n]+?)(?:\.|$)')}, nullif({_lead("string_split(ct, chr(10))[-1]")}, '')) end)"
tr("e07_span_answer", lambda: ex.span_answer(trace(), cut()), SPANQ)
tr("e08_letter_answer", lambda: ex.letter_answer(trace(), cut()), LETQ)
tr("e09_literal_answer", lambda: ex.literal_answer(trace()), LITQ)
CELLS = {"0": "number", "1": "yesno", "2": "letter", "3": "span", "4": "boxed"}
tr("e10_extract_by_task", lambda: ex.extract(F.col("cell").cast("string"), trace(), cut(), CELLS), f"nullif(trim(case cell when 0 then {NUMQ} when 1 then {YNQ} when 2 then {LETQ} when 3 then {SPANQ} else b3 end), '')")
tr("e11_label_answer", lambda: ex.label_answer(trace(), "parity"), LABQ)
BRACK = f"coalesce({_first(ex.BRACKETS, LOW)}, {_last('\\b(invalid|unbalanced|valid|balanced)\\b', _plain(LOW))})"
tr("e11b_bracket_verdict", lambda: ex.label_answer(trace(), "brackets"), f"coalesce(case when {BRACK} in ('valid', 'balanced') then 'valid' when {BRACK} is not null then 'invalid' end, {STRIP.format('trace')})")
tr("e11c_sorted_list", lambda: ex.label_answer(F.concat(trace(), F.lit("\nsorted list: [3, "), F.col("gold"), F.lit("]")), "sorted"), f"coalesce(replace({_first(ex.SORTED, 'lower(trace || chr(10) || $$sorted list: [3, $$ || gold || $$]$$)')}, ' ', ''), '')")
tr("e12_code_block", lambda: ex.code_block(F.concat(trace(), F.lit("\n```py\n"), F.col("gold"), F.lit("\n```\n"))), "regexp_extract_all(trace || chr(10) || '```py' || chr(10) || gold || chr(10) || '```' || chr(10), '(?s)```[a-zA-Z]*\\n(.*?)```', 1)[-1]")
query("e13_reextraction_audit", sql([*TX, f"x as (select cell, gold, {_tidy(f'coalesce({_first(f'####[ \\t]*({N})')}, {_first(f'(?i)(?:answer|result|total)[ \\t]*(?:is|=|:)?[ \\t]*({N})')}, {_last(f'({N})')})')} old, {NUMQ} new from tx)"],
    "select cell, count(*) paths, count(*) filter (old is distinct from new) changed, count(*) filter (old is null) null_before, count(*) filter (new is null) null_after, avg(coalesce(old = gold, false)::int) acc_before, avg(coalesce(new = gold, false)::int) acc_after from x group by all", "cell, paths, changed, null_before, null_after", "acc_before, acc_after"))(
    lambda s, d: fx.traces(s, d).select("cell", "gold", ex.number_answer_old(trace()).alias("old"), ex.number_answer(trace(), cut()).alias("new")).groupBy("cell").agg(
        F.count("*").alias("paths"), F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("changed"), F.count_if(F.col("old").isNull()).alias("null_before"), F.count_if(F.col("new").isNull()).alias("null_after"),
        F.avg(F.coalesce(F.col("old") == F.col("gold"), F.lit(False)).cast("double")).alias("acc_before"), F.avg(F.coalesce(F.col("new") == F.col("gold"), F.lit(False)).cast("double")).alias("acc_after"))
)
