"""Sources, matching, gates and reports over the sampled paths and the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballotry import fixtures as fx
from ballotry.functions import scoring as sc
from ballotry.operators import correlation as co
from ballotry.operators import gate as ga
from ballotry.operators import matching as ma
from ballotry.operators import votes as vo
from ballotry.plans import report as rp
from ballotry.sources import questions as qu
from ballotry.sources import records as re_
from ballotry.sources.shared import new_folder

from .registry import query, sql
from .votes import CELL, DELTA, EXACT, MV, PR, RECS8, RHO, P

#: SC records with faults: some lack a path, some are repeated.
BROKEN = "select model, task, arm, seed, instance_id, path, gold, answer, truncated, gen_len, y from {p} where arm = 'SC' and not (instance_id % 41 = 0 and path = 31)"
BROKEN_SQL = "broken as (" + BROKEN.format(p="paths") + ")"


def broken(s, d):
    return P(s, d).where("arm = 'SC' and not (instance_id % 41 = 0 and path = 31)")


def sc_recs(s, d):
    """SC records with repeats where the question divides by 53."""
    r = vo.records(P(s, d).where("arm = 'SC'"))
    return r.unionAll(r.where("instance_id % 53 = 0"))


SCR = "scr as (select * from recs where arm = 'SC' union all select * from recs where arm = 'SC' and instance_id % 53 = 0)"
ASKED = "asked as (select distinct model, task from paths union all select '9-NONE', 'F')"


def asked(s, d):
    return P(s, d).select("model", "task").distinct().unionAll(s.sql("select '9-NONE' model, 'F' task"))


FILED = "replace(model, ' ', '_')"


def filed(s, d):
    return re_.read_records(s, fx.record_files(s, d))


query("s01_record_scan", sql(PR, "select model, task, count(*) records, sum(k)::bigint paths, count(distinct seed) seeds from recs where arm = 'SC' group by all", "model, task, records, paths, seeds"))(
    lambda s, d: filed(s, d).groupBy(F.col("model_slug").alias("model"), "task").agg(F.count("*").alias("records"), F.sum(F.size("all_answers")).alias("paths"), F.count_distinct("seed").alias("seeds"))
)
query("s02_candidate_cells", sql([*PR, ASKED], f"select {FILED} model, task, n from asked left join (select model, task, count(*) n from recs where arm = 'SC' group by all) using (model, task)", "model, task, n"))(
    lambda s, d: re_.candidate_cells(re_.file_cells(filed(s, d)), asked(s, d).withColumn("model", F.regexp_replace("model", " ", "_")))
)
query("s03_field_resolution", sql(PR, "select model, task, seed, instance_id, case when instance_id % 2 = 1 then 512 else 256 end max_tokens from recs where arm = 'SC'", "model, task, seed, instance_id, max_tokens"))(
    lambda s, d: filed(s, d).select(F.col("model_slug").alias("model"), "task", F.col("seed").cast("long").alias("seed"), F.col("instance_id").cast("long").alias("instance_id"), re_.field("max_tokens").alias("max_tokens"))
)
query("s04_legacy_first_seen", sql([*PR], "select model, task, seed, instance_id, s from (select *, row_number() over (partition by model, task, seed, instance_id order by line) r from (select *, case when instance_id % 97 = 0 then null else instance_id end key, case when arm = 'SC' then 1 else 0 end line from recs) where key is not null and seed in (0, 1, 2)) where r = 1", "model, task, seed, instance_id, s"))(
    lambda s, d: re_.load_legacy(vo.records(P(s, d)).withColumn("key", F.when(F.col("instance_id") % 97 != 0, F.col("instance_id"))).withColumn("line", F.when(F.col("arm") == "SC", 1).otherwise(0)), ["model", "task", "seed", "instance_id"], ["line"], seeds=[0, 1, 2]).select("model", "task", "seed", "instance_id", "s")
)
query("s05_question_bank", "select text prompt, text || '!' answer, '{\"item_id\":' || item_id || '}' metadata from benchmark")(lambda s, d: qu.question_bank(fx.read(s, d, "benchmark"), "text", F.concat("text", F.lit("!"))))
query("s06a_final_answer", sql([fx.TRACES_SQL], "select doc_id, trim(string_split(trace, '####')[-1]) answer from traces", "doc_id, answer"))(lambda s, d: fx.traces(s, d).select("doc_id", qu.after_hashes(F.col("trace")).alias("answer")))
query("s06b_context_block", "select conv_id, string_agg('- ' || role || ': ' || text, chr(10) order by turn, role, text) context from conversations group by conv_id")(lambda s, d: qu.context_block(fx.read(s, d, "conversations"), "conv_id", "turn", "role", "text"))
query("s06c_short_contexts", "select conv_id, coalesce(string_agg(left(text, 500), chr(10) order by turn, text) filter (r <= 3 and text <> ''), 'no context') context from (select *, row_number() over (partition by conv_id order by text = '', turn, text) r from conversations) group by conv_id")(lambda s, d: qu.short_contexts(fx.read(s, d, "conversations"), "conv_id", "turn", "text"))
OPT = "o as (select conv_id, list(text order by turn, role, text) opts from conversations group by conv_id)"


def options(s, d):
    c = fx.read(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.transform("t", lambda x: x["text"]).alias("opts"))


query("s06d_lettered_options", sql([OPT], "select conv_id, array_to_string(list_transform(opts, lambda x, i: chr(64 + i::int) || ') ' || x), chr(10)) block from o", "conv_id, block"))(lambda s, d: options(s, d).select("conv_id", qu.lettered(F.col("opts")).alias("block")))
query("s06e_gold_letter", sql([OPT], "select conv_id, chr(64 + list_position(opts, opts[-1])::int) letter from o", "conv_id, letter"))(lambda s, d: options(s, d).select("conv_id", qu.gold_letter(F.col("opts"), F.element_at("opts", -1)).alias("letter")))
query("s06f_references", sql([OPT], "select conv_id, opts[1] gold, array_to_string(opts[2:], '|') aliases, repeat('P', len(opts)) assertions from o", "conv_id, gold, aliases, assertions"))(
    lambda s, d: options(s, d).select("conv_id", qu.references(F.col("opts"))[0].alias("gold"), F.array_join(qu.references(F.col("opts"))[1], "|").alias("aliases"), F.repeat(F.lit("P"), F.size("opts")).alias("assertions"))
)
TPL = "tpl as (select * from (values " + ", ".join(f"({i}, '" + t.replace("\n", "' || chr(10) || '") + "')" for i, t in enumerate(qu.TEMPLATES)) + ") v(slot, template))"
PROMPT = "select item_id, slot, replace(template, '{question}', text) || chr(10) || 'End with the answer.' prompt from benchmark cross join tpl"
query("s07_prompt_expansion", sql([TPL], PROMPT, "item_id, slot, prompt"))(lambda s, d: qu.expand_prompts(fx.read(s, d, "benchmark")))
query("s08_prompt_fingerprint", sql([TPL], f"select item_id, slot, left(sha256(prompt), 16) fp from ({PROMPT})", "item_id, slot, fp"))(lambda s, d: qu.expand_prompts(fx.read(s, d, "benchmark")).select("item_id", "slot", qu.fingerprint(F.col("prompt")).alias("fp")))
query("s09_key_fingerprint", sql(PR, "select model, task, md5('[' || string_agg('[' || seed || ', ' || instance_id || ']', ', ' order by seed, instance_id) || ']') md5 from recs where arm = 'SC' group by all", "model, task, md5"))(lambda s, d: re_.key_fingerprint(vo.records(P(s, d)).where("arm = 'SC'"), ["model", "task"]))
# the bytes of the files that a run would read: no SQL, as only Spark writes them
query("s09b_file_fingerprints")(lambda s, d: re_.fingerprints(s, fx.record_files(s, d)))
query("s10_pending_keys", sql([*PR, BROKEN_SQL], "select distinct model, task, seed, instance_id from recs where arm = 'PT' and (model, task, seed, instance_id) not in (select (model, task, seed, instance_id) from broken group by model, task, seed, instance_id having count(*) = 32)", "model, task, seed, instance_id"))(
    lambda s, d: re_.pending(vo.records(P(s, d)).where("arm = 'PT'").select(*ma.KEY).distinct(), broken(s, d).groupBy(*ma.KEY).agg(F.count("*").alias("n_answers")), 32)
)
DONE = "dn as (select model, task, seed, instance_id, count(*) K, case when instance_id % 9 = 4 then 'v2' else 'v1' end script_version, left(md5('q' || instance_id), 16) prompt_sha from broken group by all), pr as (select distinct model, task, instance_id, left(md5('q' || case when instance_id % 13 = 5 then instance_id + 1 else instance_id end), 16) prompt_sha from recs where arm = 'SC' and instance_id % 3 = 0)"


def hashed(i):
    return F.left(F.md5(F.concat(F.lit("q"), i.cast("string")).cast("binary")), F.lit(16))


def done_records(s, d):
    i = F.col("instance_id")
    return broken(s, d).groupBy(*ma.KEY).agg(F.count("*").alias("K")).withColumn("script_version", F.when(i % 9 == 4, "v2").otherwise("v1")).withColumn("prompt_sha", hashed(i)).withColumn("n_answers", F.col("K"))


def current_prompts(s, d):
    i = F.col("instance_id")
    return P(s, d).where("arm = 'SC' and instance_id % 3 = 0").select("model", "task", "instance_id").distinct().withColumn("prompt_sha", hashed(F.when(i % 13 == 5, i + 1).otherwise(i)))


query("s10b_resume_mismatches", sql([*PR, BROKEN_SQL, DONE], "select model, task, 'script_version' field, 'v1' expected, script_version found, count(*) records from dn where script_version <> 'v1' group by all union all select model, task, 'K', '32', K::varchar, count(*) from dn where K <> 32 group by all union all select model, task, 'prompt_sha', pr.prompt_sha, dn.prompt_sha, count(*) from dn join pr using (model, task, instance_id) where pr.prompt_sha <> dn.prompt_sha group by all", "model, task, field, expected, found, records"))(
    lambda s, d: re_.resume_mismatches(done_records(s, d), {"script_version": "v1", "K": 32}, current_prompts(s, d))
)
query("s10c_resume", sql([*PR, BROKEN_SQL], "select distinct model, task, seed, instance_id from recs where arm = 'PT' and (model, task, seed, instance_id) not in (select (model, task, seed, instance_id) from broken group by model, task, seed, instance_id having count(*) = 32)", "model, task, seed, instance_id"))(
    lambda s, d: re_.resume(vo.records(P(s, d)).where("arm = 'PT'").select(*ma.KEY).distinct(), done_records(s, d).where("K = 32").withColumn("script_version", F.lit("v1")), 32, {"script_version": "v1"})
)
query("p03_filters", sql(PR, "select model, task, arm, seed, count(*) n from recs where seed in (1, 3) and task = 'F' and arm = 'SC' group by all", f"{CELL}, seed, n"))(lambda s, d: vo.records(P(s, d).where("seed in (1, 3) and task = 'F' and arm = 'SC'")).groupBy(*vo.CELL, "seed").agg(F.count("*").alias("n")))
VALID = "bx as (select model, task, avg(y) filter (arm = 'SC') p_sc, avg(y) filter (arm = 'PT') p_pt from paths group by all), ba as (select *, coalesce(p_sc < 0.02, true) excluded from bx), va as (select model, task from ba where not excluded)"
query("p04_base_exclusion", sql([fx.PATHS_SQL, VALID], "select * from ba", "model, task, excluded", "p_sc, p_pt"))(lambda s, d: ma.base_accuracy(P(s, d)))
FOLDS = """q as (select distinct model, task, instance_id from recs), qp as (select *, row_number() over (partition by model, task order by (instance_id * 7919 + 2026) % 1000003, instance_id) pos, count(*) over (partition by model, task) m from q),
folds as (select model, task, instance_id, case when pos <= greatest(1, least(m - 1, floor(m * 0.5))) then 'A' else 'B' end fold from qp)"""
query("p05_two_folds", sql([*PR, FOLDS], "select * from folds", "model, task, instance_id, fold"))(lambda s, d: ma.two_folds(vo.records(P(s, d))))
query("p06_leave_one_seed_out", sql(PR, "select model, task, arm, test_seed, case when seed = test_seed then 'test' else 'train' end part, count(*) n, sum(s)::bigint hits from recs cross join (select distinct seed test_seed from recs) group by all", f"{CELL}, test_seed, part, n, hits"))(
    lambda s, d: ma.leave_one_seed_out(vo.records(P(s, d))).groupBy(*vo.CELL, "test_seed", "part").agg(F.count("*").alias("n"), F.sum("s").alias("hits"))
)
query("p07_first_instances", sql(PR, "select model, task, instance_id from (select *, row_number() over (partition by model, task order by instance_id) r from (select distinct model, task, instance_id from recs)) where r <= 20", "model, task, instance_id"))(lambda s, d: ma.first_instances(vo.records(P(s, d)), 20))
query("u01_key_sets", sql([*PR, BROKEN_SQL], "select 'missing' kind, count(*) n from (select distinct model, task, seed, instance_id, path from paths where arm = 'SC' except select model, task, seed, instance_id, path from broken) union all select 'common', count(*) from (select distinct model, task, seed, instance_id, path from paths where arm = 'SC' intersect select model, task, seed, instance_id, path from broken)", "kind, n"))(
    lambda s, d: ma.key_sets(P(s, d).where("arm = 'SC'"), broken(s, d), ma.KEY, "path")
)
query("u02_union_arms", sql(PR, "select seed, count(*) n from (select seed from recs where arm = 'SC' union all select seed from recs where arm = 'PT') group by all", "seed, n"))(lambda s, d: (lambda r: r.where("arm = 'SC'").unionByName(r.where("arm = 'PT'")).groupBy("seed").agg(F.count("*").alias("n")))(vo.records(P(s, d))))
query("u03_distinct", sql(PR, "select model, task, arm, count(distinct seed) seeds, count(distinct instance_id) instances, count(distinct answer) answers from paths group by all", f"{CELL}, seeds, instances, answers"))(
    lambda s, d: P(s, d).groupBy(*vo.CELL).agg(F.count_distinct("seed").alias("seeds"), F.count_distinct("instance_id").alias("instances"), F.count_distinct("answer").alias("answers"))
)
ARMS = """pt as (select model, task, seed, instance_id, max(gold) gold, sum(y)::bigint s from paths where arm = 'PT' group by all),
sa as (select model, task, seed, instance_id, max(gold) gold, sum(y)::bigint s from paths where arm = 'SC' and path < 8 group by all)"""


def arms(s, d):
    p = P(s, d)
    return ma.arm_records(p, "PT"), ma.arm_records(p, "SC")


query("j01_matched_arms", sql([fx.PATHS_SQL, ARMS], "select model, task, seed, instance_id, pt.gold gold_pt, pt.s s_pt, sa.gold gold_sc, sa.s s_sc from pt join sa using (model, task, seed, instance_id) where pt.gold = sa.gold", "model, task, seed, instance_id, gold_pt, s_pt, gold_sc, s_sc"))(lambda s, d: ma.matched_arms(*arms(s, d)))
query("j01b_match_violations", sql([*PR, ARMS, SCR], "select model, task, count(*) filter (b.n is null) only_pt, count(*) filter (a.n is null) only_sc, count(*) filter (a.n > 1 or b.n > 1) repeated from (select model, task, seed, instance_id, count(*) n from pt where instance_id % 7 <> 0 group by all) a full join (select model, task, seed, instance_id, count(*) n from scr where instance_id % 11 <> 0 group by all) b using (model, task, seed, instance_id) group by all", "model, task, only_pt, only_sc, repeated"))(
    lambda s, d: ma.match_violations(arms(s, d)[0].where("instance_id % 7 <> 0"), sc_recs(s, d).where("instance_id % 11 <> 0").withColumn("gold", F.lit(None).cast("string"))).drop("other_gold")
)
query("j02_matched_canonical", sql([fx.PATHS_SQL, ARMS], "select model, task, seed, instance_id, pt.s s_pt, sa.s s_sc from pt join sa using (model, task, seed, instance_id)", "model, task, seed, instance_id, s_pt, s_sc"))(
    lambda s, d: (lambda a: ma.matched_arms(a[0].withColumn("gold", F.concat("gold", F.lit("."))), a[1], sc.BUCKETS["numeric"]).drop("gold_pt", "gold_sc"))(arms(s, d))
)
query("j03_unmatched", sql([fx.PATHS_SQL, ARMS], "select model, task, seed, instance_id, 'left' side from pt where instance_id % 7 <> 0 and instance_id % 11 = 0 union all select model, task, seed, instance_id, 'right' from sa where instance_id % 11 <> 0 and instance_id % 7 = 0", "model, task, seed, instance_id, side"))(
    lambda s, d: (lambda a: ma.unmatched(a[0].where("instance_id % 7 <> 0"), a[1].where("instance_id % 11 <> 0"), ma.KEY))(arms(s, d))
)
query("j04_grid_report", sql([*PR, SCR], "select model, task, count(*) filter (c > 1) repeated, 4 * 100 - count(*) filter (seed < 4 and instance_id < 100) missing, count(*) filter (not (seed < 4 and instance_id < 100)) unexpected from (select model, task, seed, instance_id, count(*) c from scr group by all) group by all", "model, task, repeated, missing, unexpected"))(lambda s, d: ma.grid_report(sc_recs(s, d), [0, 1, 2, 3], 100))
query("j06_record_question", sql(PR, "select item_id, count(*) n, sum(s)::bigint hits from recs join benchmark on instance_id = item_id group by all", "item_id, n, hits"))(
    lambda s, d: vo.records(P(s, d)).join(fx.read(s, d, "benchmark"), F.col("instance_id") == F.col("item_id")).groupBy("item_id").agg(F.count("*").alias("n"), F.sum("s").alias("hits"))
)
query("j07_alias_bucket", r"select item_id, case when p in (g, u, f) then g else p end bucket from (select item_id, lower(trim(case item_id % 3 when 0 then upper(text) when 1 then array_to_string(string_split(text, ' ')[1:5], ' ') else 'other' end)) p, lower(trim(text)) g, lower(trim(upper(text))) u, lower(trim(array_to_string(string_split(text, ' ')[1:5], ' '))) f from benchmark)")(
    lambda s, d: (lambda five: fx.read(s, d, "benchmark").select("item_id", ma.alias_bucket(F.when(F.col("item_id") % 3 == 0, F.upper("text")).when(F.col("item_id") % 3 == 1, five).otherwise(F.lit("other")), F.col("text"), F.array(F.upper("text"), five), lambda x: F.lower(F.trim(x))).alias("bucket")))(F.array_join(F.slice(F.split("text", " "), 1, 5), " "))
)
query("j11_dimension_join", sql([fx.PATHS_SQL, RECS8, RHO, DELTA], "select case task when 'F' then 'finished' when 'O' then 'open' else 'partial' end domain, count(*) n, avg(drho_pct) mean_drho, avg(dmv) mean_dmv from delta group by all", "domain, n", "mean_drho, mean_dmv"))(
    lambda s, d: (lambda x, dim: x.join(F.broadcast(dim), "task").groupBy("domain").agg(F.count("*").alias("n"), F.avg("drho_pct").alias("mean_drho"), F.avg("dmv").alias("mean_dmv")))(co.arm_delta(P(s, d)), s.createDataFrame([("F", "finished"), ("O", "open"), ("P", "partial")], "task string, domain string"))
)
query("g01_uniform_provenance", sql([fx.PATHS_SQL], "select model, task, count(distinct coalesce(arm, '')) arm, count(distinct coalesce(gold, '')) gold, count(distinct coalesce(answer, 'none given')) answer from paths group by all", "model, task, arm, gold, answer"))(lambda s, d: ga.uniform_provenance(P(s, d), ["arm", "gold", "answer"]))
RATES = """gr as (select model, task, seed, instance_id, count(*) n, count(answer) got, count(*) filter (answer is null and truncated) loss, count(*) filter (answer is null and not truncated) silent, count(*) filter (truncated) cap from broken group by all),
rt as (select model, task, count(*) records, count(*) filter (n <> 32) malformed, count(distinct seed) seeds, count(distinct instance_id) instances, sum(got)::double / (count(*) * 32) got_rate, sum(loss)::double / (count(*) * 32) loss_rate, sum(silent)::double / (count(*) * 32) silent_rate, sum(cap)::double / (count(*) * 32) cap_rate from gr group by all)"""
GATE = """gt as (select asked.*, rt.* exclude (model, task), list_filter([case when coalesce(records, 0) = 0 then 'No records' end, case when instances < 210 then 'Too few instances: ' || instances end, case when seeds < 3 then 'Too few seeds: ' || seeds end,
case when records < instances * seeds then 'Incomplete grid: ' || (instances * seeds - records) || ' missing' end, case when malformed > 0 then 'Malformed records: ' || malformed end, case when loss_rate > 0.001::double then 'Harness loss above bound' end], lambda x: x is not null) reasons from asked left join rt using (model, task))"""
query("g02_malformed", sql([fx.PATHS_SQL, BROKEN_SQL, RATES], "select model, task, records, malformed from rt", "model, task, records, malformed"))(lambda s, d: ga.rates(broken(s, d), 32).select("model", "task", "records", "malformed"))
query("g03_rates", sql([fx.PATHS_SQL, BROKEN_SQL, RATES], "select * from rt", "model, task, seeds, instances", "got_rate, loss_rate, silent_rate, cap_rate"))(lambda s, d: ga.rates(broken(s, d), 32).drop("records", "malformed"))
query("g04_protocol_gate", sql([fx.PATHS_SQL, BROKEN_SQL, ASKED, RATES, GATE], "select model, task, array_to_string(reasons, '; ') reasons, len(reasons) = 0 admissible from gt", "model, task, reasons, admissible"))(
    lambda s, d: ga.protocol_gate(broken(s, d), asked(s, d), least_instances=210, most_loss=0.001).select("model", "task", F.array_join("reasons", "; ").alias("reasons"), "admissible")
)
query("g05_reporting_policy", sql([fx.PATHS_SQL, "broken as (select * from paths where arm = 'SC' and (model <> '1-URGENT' or path < 31))", ASKED, RATES, GATE.replace("210", "2").replace("case when records < instances * seeds then 'Incomplete grid: ' || (instances * seeds - records) || ' missing' end", "null")], "select model, task, (len(reasons) = 0 or len(list_filter(reasons, lambda x: x not like 'Harness loss%')) = 0) admissible, (len(reasons) > 0 and len(list_filter(reasons, lambda x: x not like 'Harness loss%')) = 0) flagged from gt", "model, task, admissible, flagged"))(
    lambda s, d: ga.reporting_policy(ga.protocol_gate(P(s, d).where("arm = 'SC' and (model <> '1-URGENT' or path < 31)"), asked(s, d), least_instances=2, most_loss=0.001).withColumn("reasons", F.filter("reasons", lambda x: ~F.startswith(x, F.lit("Incomplete")))).withColumn("admissible", F.size("reasons") == 0)).select("model", "task", "admissible", "flagged")
)
STRICT = """g1 as (select model, task, seed, instance_id, count(*) n, count(*) filter (answer is null) nu, count(*) filter (trim(answer) = '') em, count(*) filter (truncated) cu from broken group by all),
g2 as (select model, task, seed, count(*) records, count(*) filter (n <> 32) malformed, min(instance_id) lo, max(instance_id) hi, sum(n) n, sum(nu) nu, sum(em) em, sum(cu) cu from g1 group by all),
g3 as (select model, task, sum(records)::bigint records, count(*) filter (seed < 5) seeds, count(*) filter (seed >= 5) other_seeds, sum(malformed)::bigint malformed, count(*) filter (records <> 200 or lo <> 0 or hi <> 199) not_contiguous, sum(nu) / sum(n) null_rate, sum(em) / sum(n) empty_rate, sum(cu) / sum(n) cut_rate from g2 group by all)"""
query("g06_strict_cell", sql([fx.PATHS_SQL, BROKEN_SQL, STRICT], "select *, records = 1000 and seeds = 5 and other_seeds = 0 and malformed = 0 and not_contiguous = 0 ok from g3", "model, task, records, seeds, other_seeds, malformed, not_contiguous, ok", "null_rate, empty_rate, cut_rate"))(
    lambda s, d: ga.strict_cell(broken(s, d), 32, 1000, [0, 1, 2, 3, 4], 200)
)
query("g07_field_contract", sql([fx.PATHS_SQL], "select model, task, count(*) filter (coalesce(gold <> '37', false) or coalesce(answer <> '37', false) or (gold is null and answer is null)) gold from paths group by all", "model, task, gold"))(lambda s, d: ga.field_contract(P(s, d).withColumn("p_gold", F.col("answer")), {"gold": "37"}))
query("g08_seed_coverage", sql(PR, "select model, task, seed, count(distinct instance_id) found, 210::bigint expected, array_to_string(list_filter(range(210), lambda x: not list_contains(list(distinct instance_id), x)), ',') missing from recs where arm = 'SC' group by all", "model, task, seed, found, expected, missing"))(lambda s, d: ga.seed_coverage(vo.records(P(s, d)).where("arm = 'SC'"), 210))
query("g09_matrix_contract", sql([fx.PATHS_SQL, BROKEN_SQL], "select model, task, arm, count(*) n_rows, count(*) filter (n <> 32) wrong_k, sum(odd)::bigint not_binary, count(*) >= 2 and count(*) filter (n <> 32) = 0 and sum(odd) = 0 ok from (select model, task, arm, seed, instance_id, count(*) n, count(*) filter (y not in (0, 1)) odd from broken group by all) group by all", f"{CELL}, n_rows, wrong_k, not_binary, ok"))(lambda s, d: ga.matrix_contract(broken(s, d), 32).withColumnRenamed("rows", "n_rows"))
query("k02_strict_json", sql(PR, f"select '{{\"model\":\"' || model || '\",\"task\":\"' || task || '\",\"arm\":\"' || arm || '\",\"n\":' || count(*) || ',\"none\":null}}' json from recs group by model, task, arm", "json"))(
    lambda s, d: rp.strict_json(vo.records(P(s, d)).groupBy(*vo.CELL).agg(F.count("*").alias("n")).withColumn("none", F.lit(float("nan"))))
)
EXACT_ROW = "mean_path_acc, mv_acc, agreement, rho, keff, ceiling, pct_ceiling"


def exact_csv(s, d):
    folder = new_folder(s)
    columns = ["model", "task", "kk", "n", "n_seeds", *EXACT_ROW.split(", ")]
    rp.write_csv(co.exact_k(P(s, d).where("arm = 'SC'")), columns, folder)
    return s.read.option("header", True).schema("model string, task string, kk long, n long, n_seeds long, " + ", ".join(f"{c} double" for c in columns[5:])).csv(folder)


query("k01_exact_csv", sql([*PR, RHO, EXACT], "select * from exact where arm = 'SC'", "model, task, kk, n, n_seeds", EXACT_ROW))(exact_csv)
query("k04_markdown_table", sql([*PR], "select 0::bigint line, '| model | task | arm | records |' text union all select 1, '|---|---|---|---|' union all select 1 + row_number() over (order by model, task, arm), '| ' || model || ' | ' || task || ' | ' || arm || ' | ' || count(*) || ' |' from recs group by model, task, arm", "line, text"))(
    lambda s, d: rp.markdown_table(vo.records(P(s, d)).groupBy(*vo.CELL).agg(F.count("*").alias("records")), [*vo.CELL, "records"], vo.CELL)
)
DOMAINS = {"F": "finished", "O": "open", "P": "partial"}
query("o01_canonical_order", sql(PR, "select domain, task, model, row_number() over (order by domain, task, model) position from (select distinct case task when 'F' then 'finished' when 'O' then 'open' else 'partial' end domain, task, model from recs)", "domain, task, model, position"))(
    lambda s, d: rp.canonical_order(vo.records(P(s, d)).select("task", "model").distinct(), DOMAINS, ["domain", "task", "model"])
)
query("k03_report_lines", sql(PR, f"select printf('%-16s %s %s %5d', model, task, arm, count(*)) line from recs group by model, task, arm", "line"))(lambda s, d: rp.report_lines(vo.records(P(s, d)).groupBy(*vo.CELL).agg(F.count("*").alias("n")), "%-16s %s %s %5d", ["model", "task", "arm", "n"]))
DOMAIN = "dd as (select *, case task when 'F' then 'finished' when 'O' then 'open' else 'partial' end domain from delta)"


def domain_deltas(s, d):
    names = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    return ma.valid_cells(co.arm_cells(P(s, d)), P(s, d)).withColumn("domain", names[F.col("task")])


ROLLED = "count(drho_pct) n, avg(drho_pct) mean, min(drho_pct) least, max(drho_pct) most, stddev_samp(drho_pct) std, count(*) filter (drho_pct < 0) below, count(*) filter (drho_pct >= 0) exceptions"
query("a24_roll_up", sql([fx.PATHS_SQL, RECS8, RHO, DELTA, DOMAIN, VALID], f"select task, domain, model, {ROLLED} from dd join va using (model, task) group by grouping sets ((task), (domain), (model), ())", "task, domain, model, n, below, exceptions", "mean, least, most, std"))(
    lambda s, d: rp.roll_up(domain_deltas(s, d).drop("rho_sc", "rho_pt", "mv_sc", "mv_pt"), "drho_pct", ("task", "domain", "model"))
)
# cells whose effective votes don't fall
query("a24b_exceptions", sql([fx.PATHS_SQL, RECS8, RHO, DELTA, VALID], "select model, task, dkeff, p_sc, p_pt from delta join ba using (model, task) where dkeff >= 0 and not excluded", "model, task", "dkeff, p_sc, p_pt"))(
    lambda s, d: rp.exceptions(domain_deltas(s, d), "dkeff", vo.path_accuracy(P(s, d)))
)
ARMED = """av as (select model, task, avg(x) diversity from (select model, task, seed, instance_id, count(distinct lower(trim(coalesce(answer, 'None'))))::double / count(*) x from paths where arm = 'SC' and path < 8 group by all) group by all),
ac as (select dd.*, rs rho_sc, rp rho_pt, ms mv_sc, mp mv_pt, diversity from dd join aw using (model, task) join va using (model, task) join av using (model, task))"""


def armed(s, d):
    diversity = vo.answer_diversity(vo.prefix(P(s, d).where("arm = 'SC'"), 8)).drop("arm")
    return domain_deltas(s, d).join(diversity, ["model", "task"])


query("a24c_task_table", sql([fx.PATHS_SQL, RECS8, RHO, DELTA, DOMAIN, VALID, ARMED], "select task, any_value(domain) domain, count(*) n_models, avg(drho_pct) mean_drho, avg(dkeff) mean_dkeff, avg(rho_sc) mean_rho_sc, avg(rho_pt) mean_rho_pt, avg(diversity) mean_diversity from ac group by task", "task, domain, n_models", "mean_drho, mean_dkeff, mean_rho_sc, mean_rho_pt, mean_diversity"))(lambda s, d: rp.task_table(armed(s, d)))
query("a24d_domain_table", sql([fx.PATHS_SQL, RECS8, RHO, DELTA, DOMAIN, VALID, ARMED], "select domain, count(*) n_cells, avg(drho_pct) mean_drho, min(drho_pct) least_drho, max(drho_pct) most_drho, 100 * avg(mv_sc) mv_sc, 100 * avg(mv_pt) mv_pt, avg(100 * (mv_pt - mv_sc)) mean_gain, stddev_samp(100 * (mv_pt - mv_sc)) std_gain from ac group by domain", "domain, n_cells", "mean_drho, least_drho, most_drho, mv_sc, mv_pt, mean_gain, std_gain"))(lambda s, d: rp.domain_table(armed(s, d)))


def csv_round_trip(df, columns, schema):
    folder = new_folder(df.sparkSession)
    rp.write_csv(df, columns, folder)
    return df.sparkSession.read.option("header", True).schema(schema).csv(folder)


query("k01b_gate_csv", sql([fx.PATHS_SQL, BROKEN_SQL, ASKED, RATES, GATE], "select model, task, array_to_string(reasons, '; ') reasons, len(reasons) = 0 admissible, records, malformed from gt", "model, task, reasons, admissible, records, malformed"))(
    lambda s, d: csv_round_trip(ga.protocol_gate(broken(s, d), asked(s, d), least_instances=210, most_loss=0.001).withColumn("reasons", F.array_join("reasons", "; ")), ["model", "task", "records", "malformed", "admissible", "reasons"], "model string, task string, records long, malformed long, admissible boolean, reasons string").na.fill("", ["reasons"])
)
