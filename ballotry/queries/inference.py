"""Closed forms, resampling and rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballotry import fixtures as fx
from ballotry.functions import closed_forms as cf
from ballotry.functions import tails as ta
from ballotry.operators import correlation as co
from ballotry.operators import inference as inf
from ballotry.operators import matching as ma
from ballotry.operators import votes as vo
from ballotry.plans import replicates as rp

from .registry import query, sql
from .votes import DELTA, MV, POOLED, PR, RECS8, RHO, P

CM = "model, task"
BB = "list_sum(list_transform(range({k} + 1), lambda i: exp(lgamma({k} + 1.0::double) - lgamma(i + 1.0::double) - lgamma({k} - i + 1.0::double) + lgamma(i + a) + lgamma({k} - i + b) - lgamma({k} + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)) * case when 2 * i > {k} then 1.0::double when 2 * i = {k} then 0.5::double else 0.0::double end))"
BI = "list_sum(list_transform(range({k} + 1), lambda i: exp(lgamma({k} + 1.0::double) - lgamma(i + 1.0::double) - lgamma({k} - i + 1.0::double) + i * ln({p}) + ({k} - i) * ln(1 - {p})) * case when 2 * i > {k} then 1.0::double when 2 * i = {k} then 0.5::double else 0.0::double end))"
SC = "sc as (select model, task, seed, instance_id, path, y, gen_len from paths where arm = 'SC')"


def sc(s, d):
    return P(s, d).where("arm = 'SC'")


query("i01_beta_binomial", sql([*PR, POOLED, "ab as (select *, p_bar * (1 - c_hat) / c_hat a, (1 - p_bar) * (1 - c_hat) / c_hat b from c where c_hat > 0)"], f"select c.model, c.task, c.arm, case when c.p_bar < 1 then {BB.format(k=8)} end mv8, case when c.p_bar < 1 then {BB.format(k=32)} end mv32 from c left join ab using (model, task, arm)".replace("c.p_bar < 1", "a is not null"), "model, task, arm", "mv8, mv32"))(
    lambda s, d: co.pooled_c(vo.records(P(s, d))).select(*vo.CELL, cf.beta_binomial_majority(8, F.col("p_bar"), F.col("c_hat")).alias("mv8"), cf.beta_binomial_majority(32, F.col("p_bar"), F.col("c_hat")).alias("mv32"))
)
query("i02_binomial", sql([*PR, POOLED], f"select model, task, arm, {BI.format(k=8, p='p_bar')} mv8, {BI.format(k=32, p='p_bar')} mv32 from c", "model, task, arm", "mv8, mv32"))(
    lambda s, d: co.pooled_c(vo.records(P(s, d))).select(*vo.CELL, cf.binomial_majority(8, F.col("p_bar")).alias("mv8"), cf.binomial_majority(32, F.col("p_bar")).alias("mv32"))
)
KSTAR = "case when {c} > 0 and {c} < 1 then greatest(1, ceil(round((sqrt((1 - {c}) / {e}) - 1) / {c} + 1, 9))) else 1 end::bigint"
CLIP = "coalesce(greatest(1, least(32, ceil(round((sqrt((1 - greatest(0.05::double, least(0.99::double, {c}))) / {e}) - 1) / greatest(0.05::double, least(0.99::double, {c})) + 1, 9)))), 1)::bigint"
query("i03_k_star", sql([*PR, POOLED], f"select model, task, arm, {KSTAR.format(c='c_hat', e='0.025::double')} k_star, {CLIP.format(c='c_hat', e='0.025::double')} k_clipped from c", "model, task, arm, k_star, k_clipped"))(
    lambda s, d: co.pooled_c(vo.records(P(s, d))).select(*vo.CELL, cf.k_star(F.col("c_hat"), F.lit(0.025)).alias("k_star"), cf.k_star_clipped(F.col("c_hat"), F.lit(0.025)).alias("k_clipped"))
)
RECS4 = "recs as (select model, task, arm, seed, instance_id, count(*) k, sum(y)::bigint s, sum((1::bigint << path::int) * y)::bigint mask from paths where path < 4 and arm = 'SC' group by all)"
ADAPT = f"""ep as (select unnest([0.01::double, 0.025::double, 0.05::double, 0.1::double]) eps),
pt as (select model, task, rho, eps, {KSTAR.format(c='rho', e='eps')} k_star from rho, ep),
rn as (select model, task, path + 1 k, sum(y) over (partition by model, task, seed, instance_id order by path rows unbounded preceding) s from sc),
mk as (select model, task, k, avg({MV}) mv from rn group by all),
ad as (select pt.model, pt.task, pt.rho, pt.eps, pt.k_star, x.mv mv_k, z.mv mv_all, case when z.mv > 0 then x.mv / z.mv end retained, (pt.k_star + 4) / 32 net_cost from pt join mk x on pt.model = x.model and pt.task = x.task and least(pt.k_star, 32) = x.k join mk z on pt.model = z.model and pt.task = z.task and z.k = 32)"""
EPS = (0.01, 0.025, 0.05, 0.1)
query("i04_adaptive_k", sql([fx.PATHS_SQL, SC, RECS4, RHO, ADAPT], "select * from ad where eps = 0.025::double", f"{CM}, k_star", "rho, mv_k, mv_all, retained, net_cost"))(lambda s, d: inf.adaptive_k(sc(s, d)).drop("eps"))
query("i05_amortised_cost", sql([fx.PATHS_SQL, SC, RECS4, RHO, ADAPT], "select model, task, case when k_star < 32 then ceil(400.0::double / (32 - k_star)) end::bigint repay, (1000 * k_star + 400) / 32000 cost_1000 from ad where eps = 0.1::double", f"{CM}, repay", "cost_1000"))(
    lambda s, d: inf.adaptive_k(sc(s, d), (0.1,)).select("model", "task", cf.repay_queries(F.col("k_star")).alias("repay"), ((1000 * F.col("k_star") + 400) / 32000).alias("cost_1000"))
)
query("i06_eps_grid", sql([fx.PATHS_SQL, SC, RECS4, RHO, ADAPT], "select * from ad", f"{CM}, k_star", "eps, mv_k, retained, net_cost"))(lambda s, d: inf.adaptive_k(sc(s, d), EPS).drop("rho", "mv_all"))
FOLD = """q as (select distinct model, task, instance_id from sc), qp as (select *, row_number() over (partition by model, task order by (instance_id * 7919 + 2026) % 1000003, instance_id) pos, count(*) over (partition by model, task) m from q),
fo as (select model, task, instance_id, case when pos <= greatest(1, least(m - 1, floor(m * 0.5))) then 'A' else 'B' end fold from qp)"""
query("i07_held_out_calibration", sql([fx.PATHS_SQL, SC, FOLD, "rf as (select model, task, fold, seed, instance_id, count(*) k, sum(y)::bigint s, sum((1::bigint << path::int) * y)::bigint mask from sc join fo using (model, task, instance_id) where path < 4 group by all)",
    "recs as (select model, task, fold arm, seed, instance_id, k, s, mask from rf)", RHO, "fit as (select model, task, case when arm = 'A' then 'B' else 'A' end fold, rho, p from rho join (select model, task, arm, sum(s)::double / sum(k) p from recs group by all) using (model, task, arm))",
    f"ob as (select model, task, fold, kk, avg({MV}) observed from (select model, task, fold, kk, seed, instance_id, count(*) k, sum(y) s from sc join fo using (model, task, instance_id), (select unnest([4, 8, 16, 32])::bigint kk) where path < kk group by all) group by all)",
    "ab as (select *, p * (1 - rho) / rho a, (1 - p) * (1 - rho) / rho b from ob join fit using (model, task, fold))"],
    "select *, 100 * (predicted - observed) error_pp from (select model, task, fold, kk, observed, case when rho > 0 and rho < 1 and p > 0 and p < 1 then case kk when 4 then " + BB.format(k=4) + " when 8 then " + BB.format(k=8) + " when 16 then " + BB.format(k=16) + " else " + BB.format(k=32) + " end end predicted, case when p > 0 and p < 1 then case kk when 4 then " + BI.format(k=4, p="p") + " when 8 then " + BI.format(k=8, p="p") + " when 16 then " + BI.format(k=16, p="p") + " else " + BI.format(k=32, p="p") + " end end independent from ab)",
    f"{CM}, fold, kk", "observed, predicted, independent, error_pp"))(lambda s, d: inf.held_out_calibration(sc(s, d)))
MANY, PAIRED = 1_000, 10_000


def interval(*names):
    return ", ".join(f"quantile_cont({x}, 0.025) {x}_lo, quantile_cont({x}, 0.975) {x}_hi" for x in names)


def pair_sums_sql(mask, k, prefix, w=""):
    """Columns of the votes of a mask and of their pair products, summed: s0, s1, ... and s0_1, ..."""
    bit = lambda i: f"(({mask} >> {i}) & 1)"
    one = [f"sum({bit(i)})::double {prefix}{i}" for i in range(k)]
    return ", ".join(one + [f"sum({bit(i)} * {bit(j)})::double {prefix}{i}_{j}" for i in range(k) for j in range(i + 1, k)])


def pair_names(k, prefix):
    return [f"{prefix}{i}" for i in range(k)] + [f"{prefix}{i}_{j}" for i in range(k) for j in range(i + 1, k)]


def mean_rho_sql(k, prefix, n="n"):
    r = lambda a, b, ab: f"case when {n} * {a} - {a} * {a} > 0 and {n} * {b} - {b} * {b} > 0 then ({n} * {ab} - {a} * {b}) / sqrt(({n} * {a} - {a} * {a}) * ({n} * {b} - {b} * {b})) end"
    return "list_avg([" + ", ".join(r(f"{prefix}{i}", f"{prefix}{j}", f"{prefix}{i}_{j}") for i in range(k) for j in range(i + 1, k)) + "])"


NUMBERED = "dense_rank() over (partition by model, task order by instance_id) - 1 cluster_idx"
BOOT = f"""wo as (select kk, model, task, seed, instance_id, y::double won from (select *, row_number() over (partition by kk, model, task, seed, instance_id order by n desc, first) r from
  (select kk, model, task, seed, instance_id, answer, count(*) n, min(path) first, max(y) y from paths, (select unnest([4, 32])::bigint kk) where arm = 'SC' and path < kk and answer is not null group by all)) where r = 1),
r4 as (select model, task, seed, instance_id, sum((1::bigint << path::int) * y)::bigint mask from sc group by all),
cl as (select r4.*, {NUMBERED}, coalesce(p.won, 0) won4, coalesce(w.won, 0) won32 from r4 left join (select * from wo where kk = 4) p using (model, task, seed, instance_id) left join (select * from wo where kk = 32) w using (model, task, seed, instance_id)),
cs as (select model, task, cluster_idx, count(*)::double n, sum(won4) mv4, sum(won32) mv32, {pair_sums_sql("mask", 32, "s")} from cl group by all),
{rp.replicates_sql("wt", "cs", MANY)},
bs as (select model, task, rep, {", ".join(f"sum({x}) {x}" for x in ["n", "mv4", "mv32", *pair_names(32, "s")])} from wt join cs using (model, task, cluster_idx) group by all
  union all select model, task, -1 rep, {", ".join(f"sum({x}) {x}" for x in ["n", "mv4", "mv32", *pair_names(32, "s")])} from cs group by all),
rp as (select model, task, rep, {mean_rho_sql(4, "s")} c_pilot, {mean_rho_sql(32, "s")} c_all, mv4 / n mv_pilot, mv32 / n mv_all, 100 * (mv32 - mv4) / n diff from bs)"""
VOTES = ("c_pilot", "c_all", "mv_pilot", "mv_all", "diff")
SUMMED = lambda *names: ", ".join(f"max({x}) filter (rep < 0) {x}, quantile_cont({x}, 0.025) filter (rep >= 0) {x}_lo, quantile_cont({x}, 0.975) filter (rep >= 0) {x}_hi, count({x}) filter (rep >= 0) {x}_draws" for x in names)
query("i09_clustered_bootstrap", sql([fx.PATHS_SQL, SC, BOOT], f"select model, task, {SUMMED(*VOTES)} from rp group by all", ", ".join([CM, *[f"{x}_draws" for x in VOTES]]), ", ".join(f"{x}{e}" for x in VOTES for e in ("", "_lo", "_hi"))))(
    lambda s, d: inf.clustered_bootstrap(sc(s, d), MANY)
)
query("j08_resample_join", sql([fx.PATHS_SQL, SC, BOOT], "select * from rp", f"{CM}, rep", ", ".join(VOTES)))(lambda s, d: inf.vote_replicates(sc(s, d), MANY).withColumn("rep", F.col("rep").cast("int")))
PAIR = f"""r4 as (select model, task, seed, instance_id, sum(y)::bigint s, count(*) k, coalesce(sum(y) filter (path < ks), 0)::bigint sk, max(ks) ks from sc join (select model, task, least(k_star, 32) ks from pt where eps = 0.025::double) using (model, task) group by all),
cl as (select *, {NUMBERED}, {MV} mv, case when 2 * sk > ks then 1.0::double when 2 * sk = ks then 0.5::double else 0.0::double end mvk from r4),
cs as (select model, task, cluster_idx, count(*) n, sum(mvk) mvk, sum(mv) mv from cl group by all),
{rp.replicates_sql("wt", "cs", PAIRED)},
rp as (select model, task, rep, sum(mvk - mv) / sum(n) diff from cs join wt using (model, task, cluster_idx) group by all),
ci as (select model, task, {interval('diff')} from rp group by all)"""
query("i10_paired_difference", sql([fx.PATHS_SQL, SC, RECS4, RHO, ADAPT, PAIR], "select *, mv_k - mv_all diff from (select model, task, sum(mvk) / sum(n) mv_k, sum(mv) / sum(n) mv_all from cs group by all) join ci using (model, task) join (select model, task, k_star from pt where eps = 0.025::double) using (model, task)", f"{CM}, k_star", "mv_k, mv_all, diff, diff_lo, diff_hi"))(
    lambda s, d: inf.paired_difference(sc(s, d), PAIRED)
)
PILOTS = (25, 50, 100, 200)
query("i11_pilot_sensitivity", sql([fx.PATHS_SQL, SC, "r4 as (select model, task, seed, instance_id, sum((1::bigint << path::int) * y)::bigint mask from sc where path < 4 group by all)", f"cl as (select *, {NUMBERED} from r4)",
    f"cs as (select model, task, cluster_idx, count(*)::double n, {pair_sums_sql('mask', 4, 's')} from cl group by all)", *[rp.replicates_sql(f"wt{n}", "cs", 500, n) for n in PILOTS], "wt as (" + " union all ".join(f"select {n} questions, * from wt{n}" for n in PILOTS) + ")",
    "bs as (select questions, model, task, rep, " + ", ".join(f"sum({x}) {x}" for x in ["n", *pair_names(4, "s")]) + " from cs join wt using (model, task, cluster_idx) group by all)", f"bc as (select *, {mean_rho_sql(4, 's')} c from bs)", f"bk as (select *, {KSTAR.format(c='c', e='0.025::double')} ks from bc)"],
    "select questions::bigint questions, model, task, avg(c) c_mean, stddev_samp(c) c_std, 100 * stddev_samp(c) / avg(c) c_cv, avg(ks) k_mean, stddev_samp(ks) k_std, count(*) filter (c <= 0 or c >= 1) at_bound from bk group by all", f"{CM}, questions, at_bound", "c_mean, c_std, c_cv, k_mean, k_std"))(
    lambda s, d: inf.pilot_sensitivity(sc(s, d), PILOTS)
)


def matched_masks(s, d):
    r = vo.records(vo.prefix(P(s, d), 8))
    w = lambda a: F.max(F.when(F.col("arm") == a, F.col("mask")))
    m = r.groupBy("model", "task", "seed", "instance_id").agg(w("SC").alias("sc_mask"), w("PT").alias("pt_mask"))
    return m.where("sc_mask is not null and pt_mask is not null")


ARMS = ["n", *pair_names(8, "a"), *pair_names(8, "b")]
DRHO = f"""mm as (select model, task, seed, instance_id, max(mask) filter (arm = 'SC') ma, max(mask) filter (arm = 'PT') mb from recs group by all),
cs as (select dense_rank() over (order by model, task)::int cell, model, task, row_number() over (partition by model, task order by instance_id, seed) - 1 cluster_idx, 1.0::double n, {pair_sums_sql("ma", 8, "a").replace("sum(", "(")}, {pair_sums_sql("mb", 8, "b").replace("sum(", "(")} from mm where ma is not null and mb is not null),
{rp.replicates_sql("wt", "cs", PAIRED, cell="cell")},
bc as (select cell, rep, {", ".join(f"sum({x}) {x}" for x in ARMS)} from wt join cs using (cell, cluster_idx) group by all),
bp as (select model, task, bc.* from bc join (select distinct cell, model, task from cs) using (cell)),
br as (select model, task, rep, {mean_rho_sql(8, "a")} ra, {mean_rho_sql(8, "b")} rb from bp),
bd as (select model, task, rep, case when abs(ra) >= 0.01::double then 100 * (rb - ra) / abs(ra) end drho from br),
ci as (select model, task, count(drho) draws, {interval('drho')} from bd group by all)"""
query("i12_paired_rho_bootstrap", sql([fx.PATHS_SQL, RECS8, DRHO], "select * from ci", f"{CM}, draws", "drho_lo, drho_hi"))(lambda s, d: inf.paired_rho_bootstrap(matched_masks(s, d), PAIRED))
VALID = "va as (select model, task from paths where arm = 'SC' group by all having avg(y) >= 0.02)"
query("i13_bootstrap_summary", sql([fx.PATHS_SQL, RECS8, RHO, DELTA, DRHO, VALID], "select count(*) cells, median(drho_hi - drho_lo) width, quantile_cont(drho_hi - drho_lo, 0.25) width_25, quantile_cont(drho_hi - drho_lo, 0.75) width_75, count(*) filter (drho_lo > 0 or drho_hi < 0) excluding_zero, min(drho_pct) least, max(drho_pct) most from delta join ci using (model, task) join va using (model, task) where drho_pct is not null and drho_lo is not null", "cells, excluding_zero", "width, width_25, width_75, least, most"))(
    lambda s, d: inf.interval_summary(ma.valid_cells(co.arm_delta(P(s, d)), P(s, d)).withColumnRenamed("drho_pct", "drho"), inf.paired_rho_bootstrap(matched_masks(s, d), PAIRED), "drho")
)
WON = f"""fit as (select model, task, arm fold, p4, n_inst, n_seeds, rho, p4 <= 0 or p4 >= 1 or rho is null degenerate, case when p4 > 0 and p4 < 1 then rho end c from (select model, task, arm, sum(s)::double / sum(k) p4, count(distinct instance_id) n_inst, count(distinct seed) n_seeds from recs group by all) left join rho using (model, task, arm)),
pil as (select *, {CLIP.format(c='c', e='0.025::double')} k_star from fit),
km as (select model, task, unnest([1, 2, 4, 8, 16, 32])::bigint kk from pil union select model, task, k_star from pil),
pa as (select paths.*, kk from paths join km using (model, task) where arm = 'SC' and path < kk),
bk as (select kk, model, task, seed, instance_id, answer, count(*) n, min(path) first, max(y) y from pa where answer is not null group by all),
wk as (select kk, model, task, seed, instance_id, y from (select *, row_number() over (partition by kk, model, task, seed, instance_id order by n desc, first) r from bk) where r = 1),
rk as (select kk, model, task, seed, instance_id, case when 2 * sum(y) > count(*) then 1.0::double when 2 * sum(y) = count(*) then 0.5::double else 0.0::double end bin from pa group by all),
st as (select kk, model, task, fold, avg(coalesce(y, 0)) won, avg(bin) bin from rk left join wk using (kk, model, task, seed, instance_id) join fo using (model, task, instance_id) group by all),
sd as (select pil.*, {', '.join(f"(select won from st where st.model = pil.model and st.task = pil.task and st.fold = pil.fold and kk = {k}) won{k}" for k in (1, 2, 4, 8, 16, 32))},
  (select bin from st where st.model = pil.model and st.task = pil.task and st.fold = pil.fold and kk = 32) bin32 from pil),
xx as (select p.model, p.task, p.fold, p.n_inst + e.n_inst n_instances, p.n_seeds, p.n_inst n_pilot, e.n_inst n_eval, p.p4 pilot_acc, p.c c_pilot, p.degenerate, p.k_star, sp.won same_mv_k, p.won32 same_mv_32, se.won held_mv_k, e.won32 held_mv_32,
  {', '.join(f'e.won{k} fixed{k}' for k in (1, 2, 4, 8, 16, 32))}, e.bin32 held_binary_32, e.won4 reuse_same, p.won4 reuse_deploy, e.p4 ep, e.c ec
  from sd p join sd e on p.model = e.model and p.task = e.task and p.fold <> e.fold join st sp on sp.model = p.model and sp.task = p.task and sp.fold = p.fold and sp.kk = p.k_star join st se on se.model = p.model and se.task = p.task and se.fold = e.fold and se.kk = p.k_star),
xs as (select *, case when ec > 0 and ec < 1 and ep > 0 and ep < 1 then {BB.format(k=32)} end bb_same from (select *, ep * (1 - ec) / ec a, (1 - ep) * (1 - ec) / ec b from xx)),
xd as (select *, case when c_pilot > 0 and c_pilot < 1 and pilot_acc > 0 and pilot_acc < 1 then {BB.format(k=32)} end bb_deploy from (select * exclude (a, b), pilot_acc * (1 - c_pilot) / c_pilot a, (1 - pilot_acc) * (1 - c_pilot) / c_pilot b from xs)),
xi as (select *, case when ep > 0 and ep < 1 then {BI.format(k=32, p='ep')} end indep_same, case when pilot_acc > 0 and pilot_acc < 1 then {BI.format(k=32, p='pilot_acc')} end indep_deploy from xd)"""
GUESSES = [f"{k}_{w}" for k in ("reuse", "bb", "indep") for w in ("same", "deploy")]
query("i08_fold_evaluation", sql([fx.PATHS_SQL, SC, FOLD, "rf as (select model, task, fold, seed, instance_id, count(*) k, sum(y)::bigint s, sum((1::bigint << path::int) * y)::bigint mask from sc join fo using (model, task, instance_id) where path < 4 group by all)",
    "recs as (select model, task, fold arm, seed, instance_id, k, s, mask from rf)", RHO, WON], "select *, case when same_mv_32 > 0 then 100 * same_mv_k / same_mv_32 end same_retained, case when held_mv_32 > 0 then 100 * held_mv_k / held_mv_32 end held_retained, " + ", ".join(f"100 * abs({g} - {'held_mv_32' if g.startswith('reuse') else 'held_binary_32'}) {g}_err" for g in GUESSES) + " from xi",
    f"{CM}, fold, n_instances, n_seeds, n_pilot, n_eval, degenerate, k_star", "pilot_acc, c_pilot, same_mv_k, same_mv_32, same_retained, held_mv_k, held_mv_32, held_retained, fixed1, fixed2, fixed4, fixed8, fixed16, fixed32, held_binary_32, " + ", ".join([*GUESSES, *[f"{g}_err" for g in GUESSES]])))(lambda s, d: inf.fold_evaluation(sc(s, d)))
LD = "ld as (select d.n_chars, l.quality from documents d join labels l using (doc_id))"


def quality(s, d):
    return fx.read(s, d, "documents").join(fx.read(s, d, "labels"), "doc_id").select("n_chars", "quality")


query("w04_mid_ranks", sql([LD], "select n_chars, quality, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 rk from ld", "n_chars, quality", "rk"))(lambda s, d: inf.mid_ranks(quality(s, d), "n_chars").select("n_chars", "quality", F.col("rank").alias("rk")))
RANKED = "r as (select quality, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 rk, count(*) over (partition by n_chars) t from ld)"
UT = "ut as (select sum(rk) filter (quality = 1) - count(*) filter (quality = 1) * (count(*) filter (quality = 1) + 1) / 2 u, count(*) filter (quality = 1) n1, count(*) filter (quality = 0) n0, sum(t::double * t - 1) tie_term from r)"
query("i14_mann_whitney", sql([LD, RANKED, UT], "select * from ut", "n1, n0", "u, tie_term"))(lambda s, d: inf.mann_whitney(quality(s, d), "n_chars", "quality").drop("p"))
query("i14b_mann_whitney_p", sql([LD, RANKED, UT], f"select *, {ta.rank_sum_normal_sql('u', 'n1', 'n0', 'tie_term')} p from ut", "n1, n0", "u, tie_term, p"))(lambda s, d: inf.mann_whitney(quality(s, d), "n_chars", "quality"))
# all ways to choose the first group's ranks give the exact distribution of U
RANKS = """bo as (select model, task, -1 rep, case when abs(rs) >= 0.01::double then 100 * (rp - rs) / abs(rs) end drho from aw union all select model, task, rep, drho from bd),
bg as (select rep, case task when 'F' then 1 else 0 end g, drho v, count(*) filter (drho is null) over (partition by rep) missing, rank() over (partition by rep order by drho) + (count(*) over (partition by rep, drho) - 1) / 2 rk, count(*) over (partition by rep, drho) t from bo join va using (model, task) where task in ('F', 'O')),
bt as (select rep, max(missing) missing, sum(rk) filter (g = 1) - count(*) filter (g = 1) * (count(*) filter (g = 1) + 1) / 2 u, count(*) filter (g = 1) n1, count(*) filter (g = 0) n0, sum(t::double * t - 1) ties from bg group by rep),
nn as (select max(n1)::int n1, max(n0)::int n0 from bt),
su as (select list_sum(list_transform(range(n1 + n0), lambda i: case when (x >> i) & 1 = 1 then i + 1 else 0 end)) - n1 * (n1 + 1) / 2 u from nn, (select unnest(range((1 << (n1 + n0))::bigint))::bigint x from nn) where bit_count(x) = n1),
pe as (select bt.rep, least(1.0::double, 2 * avg((su.u >= greatest(bt.u, n1 * n0 - bt.u))::int)) pe from bt, su where missing = 0 and ties = 0 group by bt.rep, n1, n0),
pp as (select bt.*, coalesce(pe, case when missing = 0 then """ + ta.rank_sum_normal_sql("u", "n1", "n0", "ties") + """ end) p from bt left join pe using (rep))"""
query("i14c_replicated_rank_test", sql([fx.PATHS_SQL, RECS8, RHO, DELTA, DRHO, VALID, RANKS], "select max(u) filter (rep = -1 and missing = 0) u, max(p) filter (rep = -1) p, max(n1) n1, max(n0) n0, count(*) filter (rep >= 0 and missing = 0) used, count(*) filter (rep >= 0 and missing > 0) dropped, avg((p < 0.05::double)::int) filter (rep >= 0 and missing = 0) share from pp", "n1, n0, used, dropped", "u, p, share"))(
    lambda s, d: inf.replicated_rank_test(ma.valid_cells(inf.paired_rho_replicates(matched_masks(s, d), PAIRED), P(s, d)).withColumn("g", F.when(F.col("task") == "F", 1).when(F.col("task") == "O", 0)), "drho", "g", 0.05)
)
P_SQL = "case when n > 2 then " + ta.beta_sql("((n - 2) / 2.0::double)", "0.5::double", "(1 - r * r)") + " when n = 2 and r is not null then 1.0::double end"
query("i15_pearson", sql(PR, f"select *, {P_SQL} p from (select model, count(*) n, corr(s, instance_id) r from recs where arm = 'SC' group by all)", "model, n", "r, p"))(lambda s, d: inf.pearson(vo.records(P(s, d)).where("arm = 'SC'"), "s", "instance_id", ["model"]))
query("i16_spearman_slots", sql([fx.PATHS_SQL, "sl as (select model, task, seed, path, sum(y)::bigint h from paths where arm = 'PT' and seed in (0, 1) group by all)", "rk as (select *, rank() over (partition by model, task, seed order by h) + (count(*) over (partition by model, task, seed, h) - 1) / 2 r from sl)", "sr as (select a.model, a.task, count(*) n, case when stddev_pop(a.r) > 0 and stddev_pop(b.r) > 0 then corr(a.r, b.r) end r from rk a join rk b on a.model = b.model and a.task = b.task and a.path = b.path and a.seed = 0 and b.seed = 1 group by all)"], f"select *, {P_SQL} p from sr", f"{CM}, n", "r, p"))(
    lambda s, d: inf.spearman_slots(P(s, d).where("arm = 'PT'").groupBy("model", "task", "seed", "path").agg(F.sum("y").alias("hits")), 0, 1)
)
