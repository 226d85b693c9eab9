"""Aggregations of votes and their correlation over the sampled paths of the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballotry import fixtures as fx
from ballotry.operators import correlation as co
from ballotry.operators import votes as vo
from ballotry.sources import records as re_

from .registry import query, sql

CELL = "model, task, arm"
PR = [fx.PATHS_SQL, fx.RECS_SQL]
MV = "case when k = 0 then 0.0::double when 2 * s > k then 1.0::double when 2 * s = k then 0.5::double else 0.0::double end"
RHO = """pm as (select model, task, arm, mask, count(*)::bigint c, max(k) k from recs group by all),
pi as (select pm.*, i.path i, j.path j, (mask >> i.path::int) & 1 a, (mask >> j.path::int) & 1 b from pm, (select range path from range(32)) i, (select range path from range(32)) j where i.path < j.path and j.path < k),
ps as (select model, task, arm, i, j, sum(c)::double n, sum(c * a)::double si, sum(c * b)::double sj, sum(c * a * b)::double sij from pi group by all),
pr as (select *, case when n * si - si * si > 0 and n * sj - sj * sj > 0 then (n * sij - si * sj) / sqrt((n * si - si * si) * (n * sj - sj * sj)) end r from ps),
rho as (select model, task, arm, avg(r) rho, count(r) pairs from pr group by all)"""
RECS8 = "recs as (select model, task, arm, seed, instance_id, count(*) k, sum(y)::bigint s, sum((1::bigint << path::int) * y)::bigint mask from paths where path < 8 group by all)"
POOLED = """pc as (select model, task, arm, avg(case when k > 1 then (s * (s - 1))::double / (k * (k - 1)) end) bo, sum(s)::double / sum(k) p_bar from recs group by all),
c as (select model, task, arm, p_bar, case when p_bar * (1 - p_bar) > 0 then (bo - p_bar * p_bar) / (p_bar * (1 - p_bar)) end c_hat from pc)"""
SLOTS = "sl as (select model, task, arm, path, sum(y)::bigint w, avg(y) acc, min(y) lo, max(y) hi from paths group by all)"


def P(spark, sf):
    return fx.paths(spark, sf)


def R(spark, sf, k=None):
    p = fx.paths(spark, sf)
    return vo.records(p if k is None else vo.prefix(p, k))


query("a01_path_accuracy", sql(PR, "select model, task, arm, avg(y) p_bar from paths group by all", CELL, "p_bar"))(lambda s, d: vo.path_accuracy(P(s, d)))
query("a02_seed_accuracy", sql(PR, "select model, task, arm, avg(a) acc_mean, stddev_samp(a) acc_std from (select model, task, arm, seed, avg(y) a from paths group by all) group by all", CELL, "acc_mean, acc_std"))(lambda s, d: vo.seed_accuracy(P(s, d)))
query("a03_prefix_tokens", sql(PR, "select model, task, arm, avg(t) mean_tokens from (select model, task, arm, seed, instance_id, sum(gen_len) t from paths where path < 4 group by all) group by all", CELL, "mean_tokens"))(lambda s, d: vo.prefix_tokens(P(s, d), 4))
query("a04_majority_accuracy", sql(PR, f"select model, task, arm, avg({MV}) mv_acc from recs group by all", CELL, "mv_acc"))(lambda s, d: vo.majority_accuracy(R(s, d)))
query("a05_record_majority", sql(PR, f"select model, task, arm, seed, instance_id, {MV} mv from recs", "model, task, arm, seed, instance_id", "mv"))(
    lambda s, d: R(s, d).select(*vo.RECORD, vo.majority(F.col("s"), F.col("k")).alias("mv"))
)

_BUCKETS = "b as (select model, task, arm, seed, instance_id, answer, count(*) n, min(path) first, max(gold) gold from paths where answer is not null group by all)"
query("a06_plurality_vote", sql([*PR, _BUCKETS], "select model, task, arm, seed, instance_id, answer winner, n votes, cnt n_buckets, gold, answer = gold correct from (select *, count(*) over w cnt, row_number() over (partition by model, task, arm, seed, instance_id order by n desc, first) r from b window w as (partition by model, task, arm, seed, instance_id)) where r = 1", "model, task, arm, seed, instance_id, winner, votes, n_buckets, gold, correct"))(
    lambda s, d: vo.plurality(P(s, d)).withColumn("correct", F.col("winner") == F.col("gold"))
)
query("a07_bucket_counts", sql([*PR, _BUCKETS], "select model, task, arm, seed, instance_id, string_agg(answer || '=' || n, ',' order by answer) counts from b group by all", "model, task, arm, seed, instance_id, counts"))(
    lambda s, d: vo.bucket_counts(P(s, d)).withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))
)
query("a08_pairwise_rho", sql([*PR, RHO], "select * from rho", f"{CELL}, pairs", "rho"))(lambda s, d: co.pairwise_rho(R(s, d)))
query("j05_path_pair_join", sql([fx.PATHS_SQL, RECS8, RHO], "select * from rho", f"{CELL}, pairs", "rho"))(lambda s, d: co.pairwise_rho_join(vo.prefix(P(s, d), 8)))
query("a09_agreement", sql(PR, "select model, task, arm, avg(case when k > 1 then (s * (s - 1) + (k - s) * (k - s - 1))::double / (k * (k - 1)) end) agreement from recs group by all", CELL, "agreement"))(lambda s, d: co.agreement(R(s, d)))
query("a10_pooled_c", sql([*PR, POOLED], "select * from c", CELL, "p_bar, c_hat"))(lambda s, d: co.pooled_c(R(s, d)))
query("a11_k_eff", sql([*PR, RHO, POOLED], "select c.model, c.task, c.arm, 32 / (1 + 31 * rho) keff, case when c_hat > 0 then 32 / (1 + 31 * c_hat) end keff_strict, case when c_hat > 0 then 1 / c_hat end ceiling, case when c_hat > 0 then 100 * c_hat * 32 / (1 + 31 * c_hat) end pct_ceiling from c join rho using (model, task, arm)", CELL, "keff, keff_strict, ceiling, pct_ceiling"))(
    lambda s, d: (lambda r: co.pooled_c(r).join(co.pairwise_rho(r), vo.CELL).select(
        *vo.CELL, co.k_eff(F.lit(32), F.col("rho")).alias("keff"), co.k_eff(F.lit(32), F.col("c_hat"), True).alias("keff_strict"), co.ceiling(F.col("c_hat")).alias("ceiling"),
        (100 * co.k_eff(F.lit(32), F.col("c_hat"), True) / co.ceiling(F.col("c_hat"))).alias("pct_ceiling")))(R(s, d))
)
EXACT = """ks as (select unnest([1, 2, 4, 8, 16, 32])::bigint kk),
rk as (select kk, model, task, arm, seed, instance_id, count(*) k, sum(y)::bigint s, sum(gen_len) tokens from paths, ks where path < kk group by all),
bk as (select kk, model, task, arm, seed, instance_id, answer, count(*) n, min(path) first, max(y) y from paths, ks where path < kk and answer is not null group by all),
wk as (select kk, model, task, arm, seed, instance_id, y::double won from (select *, row_number() over (partition by kk, model, task, arm, seed, instance_id order by n desc, first) r from bk) where r = 1),
ek as (select kk, model, task, arm, sum(s)::double / sum(k) mean_path_acc, avg(coalesce(won, 0)) mv_acc, avg(case when 2 * s > k then 1.0::double when 2 * s = k then 0.5::double else 0.0::double end) binary_acc, count(*) n, count(distinct seed) n_seeds, avg(tokens) tokens,
  avg(case when k > 1 then (s * (s - 1) + (k - s) * (k - s - 1))::double / (k * (k - 1)) end) agreement, avg(case when k > 1 then (s * (s - 1))::double / (k * (k - 1)) end) bo from rk left join wk using (kk, model, task, arm, seed, instance_id) group by all),
sk as (select kk, model, task, arm, avg(a) seed_mean, stddev_samp(a) seed_std from (select kk, model, task, arm, seed, sum(s)::double / sum(k) a from rk group by all) group by all),
hk as (select kk, model, task, arm, avg(r) rho from pr, ks where j < kk group by all),
xk as (select ek.*, seed_mean, seed_std, rho, case when mean_path_acc * (1 - mean_path_acc) > 0 then (bo - mean_path_acc * mean_path_acc) / (mean_path_acc * (1 - mean_path_acc)) end c_hat,
  case when kk = 1 then 1.0::double when rho > 0 then kk / (1 + (kk - 1) * rho) end keff, case when rho > 0 then 1 / rho end ceiling from ek join sk using (kk, model, task, arm) left join hk using (kk, model, task, arm)),
exact as (select *, keff / ceiling pct_ceiling from xk)"""
EXACT_FLOATS = "mean_path_acc, mv_acc, binary_acc, tokens, seed_std, agreement, c_hat, rho, keff, ceiling, pct_ceiling"
query("a12_exact_k", sql([*PR, RHO, EXACT], "select * from exact", f"{CELL}, kk, n, n_seeds", EXACT_FLOATS))(lambda s, d: co.exact_k(P(s, d)).drop("seed_mean"))
query("a13_slot_variation", sql([fx.PATHS_SQL, SLOTS], "select model, task, arm, count(*) filter (lo = hi) constant_slots, case when avg(acc) = 0 then 0.0::double else stddev_pop(acc) / avg(acc) end slot_cv from sl group by all", f"{CELL}, constant_slots", "slot_cv"))(lambda s, d: vo.slot_variation(P(s, d)).drop("slots"))
WMV = """wr as (select model, task, arm, seed, instance_id, sum(w * y)::bigint won, sum(w)::bigint tot, sum(y)::bigint s, count(*) k from paths join sl using (model, task, arm, path) group by all),
wm as (select model, task, arm, avg(case when tot = 0 then 0.0::double when 2 * won > tot then 1.0::double when 2 * won = tot then 0.5::double else 0.0::double end) weighted_acc, avg(case when 2 * s > k then 1.0::double when 2 * s = k then 0.5::double else 0.0::double end) mv_acc from wr group by all)"""
query("a14_weighted_majority", sql([fx.PATHS_SQL, SLOTS, WMV], "select *, 100 * (weighted_acc - mv_acc) gain_pp from wm", CELL, "weighted_acc, mv_acc, gain_pp"))(lambda s, d: vo.weighted_majority(P(s, d)))
query("a15_pruned_majority", sql([fx.PATHS_SQL, SLOTS], f"select model, task, arm, avg({MV}) pruned_acc from (select model, task, arm, seed, instance_id, count(*) k, sum(y)::bigint s from paths join (select *, row_number() over (partition by model, task, arm order by w, path) r from sl) using (model, task, arm, path) where r > 2 group by all) group by all", CELL, "pruned_acc"))(lambda s, d: vo.pruned_majority(P(s, d)))
BLOCK = """bk as (select model, task, arm, count(*) n_rows, max(k) k, sum(s)::double / sum(k) p_bar, var_samp(s::double / k) v from recs group by all),
br as (select *, case when n_rows < 20 then 'too few rows' when p_bar < 0.02::double then 'base accuracy' when rho is null then 'no correlation' when rho <= -1.0::double / (k - 1) then 'negative correlation' when v <= 0 then 'no variance' end reason from bk left join rho using (model, task, arm))"""
query("a16_block_k_eff", sql([fx.PATHS_SQL, RECS8, RHO, BLOCK], "select model, task, arm, reason, case when reason is null then p_bar * (1 - p_bar) / v end block_keff, case when reason is null then p_bar * (1 - p_bar) / v / (k / (1 + (k - 1) * rho)) end ratio from br", f"{CELL}, reason", "block_keff, ratio"))(lambda s, d: co.block_k_eff(R(s, d, 8)))
query("a17_slot_covariance", sql([fx.PATHS_SQL], "select a.model, a.task, a.arm, a.path i, b.path j, avg(a.y) mean_i, avg(b.y) mean_j, covar_samp(a.y, b.y) cov from paths a join paths b using (model, task, arm, seed, instance_id) where a.path <= b.path and b.path < 8 group by all", f"{CELL}, i, j", "mean_i, mean_j, cov"))(lambda s, d: co.slot_covariance(vo.prefix(P(s, d), 8)))
query("a19_oracle_headroom", sql(PR, f"select model, task, arm, avg((s >= 1)::int) oracle_acc, avg({MV}) mv_acc, avg((s >= 1)::int) - avg({MV}) headroom from recs group by all", CELL, "oracle_acc, mv_acc, headroom"))(lambda s, d: vo.oracle_accuracy(R(s, d)))
query("a20_answer_diversity", sql(PR, "select model, task, arm, avg(x) diversity from (select model, task, arm, seed, instance_id, count(distinct lower(trim(coalesce(answer, 'None'))))::double / count(*) x from paths group by all) group by all", CELL, "diversity"))(lambda s, d: vo.answer_diversity(P(s, d)))
query("a21_run_summary", sql(PR, f"select model, task, arm, seed, count(*) instances, sum(t)::double / sum(k) tokens_per_path, sum(cut)::bigint cap_hits, avg({MV}) vote_acc, sum(s)::double / sum(k) path_acc from (select model, task, arm, seed, instance_id, sum(y)::bigint s, count(*) k, sum(gen_len) t, count(*) filter (truncated) cut from paths group by all) group by grouping sets ((model, task, arm, seed), (model, task, arm))", f"{CELL}, seed, instances, cap_hits", "tokens_per_path, vote_acc, path_acc"))(lambda s, d: vo.run_summary(P(s, d)))
query("a22_arm_statistics", sql([*PR, RHO, POOLED, SLOTS, WMV, "sv as (select model, task, arm, case when avg(acc) = 0 then 0.0::double else stddev_pop(acc) / avg(acc) end slot_cv from sl group by all)", "kk as (select model, task, arm, max(k) k from recs group by all)"],
    "select *, 100 * (weighted_acc - mv_acc) gain_pp, k / (1 + (k - 1) * rho) keff_rho, case when c_hat > 0 then k / (1 + (k - 1) * c_hat) end keff_c from c join rho using (model, task, arm) join wm using (model, task, arm) join sv using (model, task, arm) join kk using (model, task, arm)", f"{CELL}, k", "mv_acc, rho, p_bar, c_hat, weighted_acc, gain_pp, slot_cv, keff_rho, keff_c"))(lambda s, d: co.arm_statistics(P(s, d)))
DELTA = f"""am as (select model, task, arm, avg({MV}) mv from recs group by all),
aw as (select model, task, max(case when arm = 'SC' then rho end) rs, max(case when arm = 'PT' then rho end) rp, max(case when arm = 'SC' then mv end) ms, max(case when arm = 'PT' then mv end) mp from rho join am using (model, task, arm) group by all),
delta as (select model, task, case when abs(rs) > 0.01::double then 100 * (rp - rs) / abs(rs) end drho_pct, 8 / (1 + 7 * rp) - 8 / (1 + 7 * rs) dkeff, mp - ms dmv from aw)"""
query("a23_arm_delta", sql([fx.PATHS_SQL, RECS8, RHO, DELTA], "select * from delta", "model, task", "drho_pct, dkeff, dmv"))(lambda s, d: co.arm_delta(P(s, d)))
query("a30_seed_groups", sql(PR, "select model, task, arm, seed, count(*) n, sum(s)::bigint hits from recs where k = case when arm = 'SC' then 32 else 8 end group by all", f"{CELL}, seed, n, hits"))(
    lambda s, d: R(s, d).where(F.col("k") == F.when(F.col("arm") == "SC", 32).otherwise(8)).groupBy(*vo.CELL, "seed").agg(F.count("*").alias("n"), F.sum("s").alias("hits"))
)
query("a33_path_totals", sql(PR, "select model, task, arm, count(*) n_paths, count(*) filter (answer is null) n_null, count(*) filter (trim(answer) = '') n_empty, count(*) filter (truncated) n_truncated, count(*) filter (answer is null)::double / count(*) null_rate, count(*) filter (truncated)::double / count(*) truncated_rate from paths group by all", f"{CELL}, n_paths, n_null, n_empty, n_truncated", "null_rate, truncated_rate"))(
    lambda s, d: P(s, d).groupBy(*vo.CELL).agg(
        F.count("*").alias("n_paths"), F.count_if(F.col("answer").isNull()).alias("n_null"), F.count_if(F.trim("answer") == "").alias("n_empty"), F.count_if("truncated").alias("n_truncated"),
        (F.count_if(F.col("answer").isNull()) / F.count("*")).alias("null_rate"), (F.count_if("truncated") / F.count("*")).alias("truncated_rate"))
)
query("w01_running_votes", sql(PR, "select model, task, arm, seed, instance_id, path, sum(y) over (partition by model, task, arm, seed, instance_id order by path rows unbounded preceding)::bigint s, path + 1 k from paths", f"{CELL}, seed, instance_id, path, s, k"))(lambda s, d: vo.running_votes(P(s, d)))
query("w02_bucket_tie_rank", sql([*PR, _BUCKETS], "select model, task, arm, seed, instance_id, answer, n, first, row_number() over (partition by model, task, arm, seed, instance_id order by n desc, first)::int tie_rank from b", f"{CELL}, seed, instance_id, answer, n, first, tie_rank"))(lambda s, d: vo.bucket_ranks(P(s, d)))
query("w05_slot_rank", sql([fx.PATHS_SQL, SLOTS], "select model, task, arm, path, w hits, row_number() over (partition by model, task, arm order by w, path)::int slot_rank from sl", f"{CELL}, path, hits, slot_rank"))(
    lambda s, d: (lambda x: x.select(*vo.CELL, "path", "hits", F.row_number().over(vo.Window.partitionBy(*vo.CELL).orderBy("hits", "path")).alias("slot_rank")))(vo.slot_accuracy(P(s, d)))
)
query("p02_prefix", sql([fx.PATHS_SQL, RECS8], "select * from recs", f"{CELL}, seed, instance_id, k, s, mask"))(lambda s, d: R(s, d, 8))
query("p01_record_paths", sql([fx.PATHS_SQL, "l as (select model, task, arm, seed, instance_id, list(answer order by path) answers, list(gen_len order by path) lens from paths group by all)"], "select model, task, arm, seed, instance_id, p.path, answers[p.path + 1] answer, lens[p.path + 1] gen_len from l, (select range path from range(32)) p where p.path < len(answers)", f"{CELL}, seed, instance_id, path, answer, gen_len"))(
    lambda s, d: re_.explode_paths(re_.nest_paths(P(s, d))).select(*vo.RECORD, "path", "answer", "gen_len")
)
