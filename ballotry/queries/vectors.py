"""Vector tables, distortion, reports over cells, and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballotry import fixtures as fx
from ballotry.operators import correlation as co
from ballotry.operators import inference as inf
from ballotry.operators import fits as ft
from ballotry.operators import quality as ql
from ballotry.operators import trials as tr
from ballotry.operators import vectors as ve
from ballotry.operators import votes as vo
from ballotry.operators.tokens import token_f1
from ballotry.sources.shared import new_folder
from ballotry.streaming import ingest as st

from .registry import query, sql
from .scoring import DOCPAIR, F1, doc_pairs
from .inference import BB, BI, KSTAR
from .votes import BLOCK, DELTA, EXACT, MV, PR, RECS8, RHO, SLOTS, WMV, P


def E(s, d):
    return fx.read(s, d, "embeddings").where("embedding is not null and size(embedding) > 0")


def dbl(c="embedding"):
    return F.transform(c, lambda x: x.cast("double"))


EM = "em as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings where embedding is not null and len(embedding) > 0)"
SOFT = "sm as (select *, list_transform(ex, lambda x: x / list_sum(ex)) p from (select *, list_transform(e, lambda x: exp(x - list_max(e))) ex from em))"


def _h(p):
    return f"-list_sum(list_transform(list_filter({p}, lambda x: x > 1e-15), lambda x: x / list_sum(list_filter({p}, lambda z: z > 1e-15)) * log2(x / list_sum(list_filter({p}, lambda z: z > 1e-15)))))"


query("v01_entropy", sql([EM, SOFT], f"select vec_id, {_h('p')} bits from sm", "vec_id", "bits"))(lambda s, d: E(s, d).select("vec_id", ve.entropy_bits(ve.softmax(dbl())).alias("bits")))
TOP = "tp as (select *, list_transform(t, lambda x: x / list_sum(t)) tp from (select *, list_reverse_sort(p)[1:8] t from sm))"
query("o02_top_probabilities", sql([EM, SOFT, TOP], f"select vec_id, tp[1] first, tp[8] last, {_h('tp')} bits from tp", "vec_id", "first, last, bits"))(
    lambda s, d: E(s, d).select("vec_id", ve.top_probabilities(dbl(), 8).alias("t")).select("vec_id", F.element_at("t", 1).alias("first"), F.element_at("t", 8).alias("last"), ve.entropy_bits(F.col("t")).alias("bits"))
)
query("w07_dominant", sql([EM], "select vec_id, list_position(e, list_max(e))::bigint - 1 dominant from em", "vec_id, dominant"))(lambda s, d: E(s, d).select("vec_id", ve.dominant(dbl()).alias("dominant")))
UN = "un as (select vec_id, label, unnest(e) x, generate_subscripts(e, 1) i from em)"
query("v02_participation_ratio", sql([EM, UN, "cv as (select a.label, a.i, b.i j, covar_samp(a.x, b.x) c from un a join un b using (vec_id) group by all)"], "select label, sum(c) filter (i = j) ^ 2 / sum(c * c) ratio from cv group by label", "label", "ratio"))(lambda s, d: tr.participation_ratio(E(s, d), ["label"]))
CAND = "cd as (select vec_id // 5 output_id, vec_id % 5 slot, (1 + vec_id % 7)::double w, e from em)"
CONF = "cf as (select a.output_id, sum(a.w * b.w * list_cosine_similarity(a.e, b.e)) / sum(a.w * b.w) c from cd a join cd b on a.output_id = b.output_id and a.slot < b.slot group by all)"


def candidates(s, d):
    return E(s, d).select((F.col("vec_id") - F.col("vec_id") % 5).alias("o"), "vec_id", "embedding").select((F.col("o") / 5).cast("long").alias("output_id"), (F.col("vec_id") % 5).alias("slot"), (1 + F.col("vec_id") % 7).alias("w"), "embedding")


query("v03_confusability", sql([EM, CAND, CONF], "select output_id, coalesce(c, 0) confusability from (select distinct output_id from cd) left join cf using (output_id)", "output_id", "confusability"))(lambda s, d: ve.confusability(candidates(s, d), "output_id", "slot", "w"))
MEANS = "mv as (select label, list(m order by i) m from (select label, i, avg(x) m from un group by all) group by label)"
query("v04_head_specialisation", sql([EM, UN, MEANS], "select 1 - avg(list_cosine_similarity(a.m, b.m)) specialisation, count(*) pairs from mv a join mv b on a.label < b.label", "pairs", "specialisation"))(lambda s, d: ve.head_specialisation(E(s, d), "label"))
query("v05_separability")(lambda s, d: ft.separability(E(s, d).withColumn("part", F.lit("all")), "label", "vec_id", ["part"]))
query("v06_information_bound")(lambda s, d: ft.information_rate(E(s, d).withColumn("method", F.col("vec_id") % 2).withColumn("passes", 1 + F.col("vec_id") % 3), "label", ["method"], budget="passes"))
query("v06b_label_entropy", sql([EM], "select -sum(p * log2(p)) entropy, count(*) classes from (select count(*)::double / sum(count(*)) over () p from em group by label)", "classes", "entropy"))(lambda s, d: ve.label_entropy(E(s, d), "label"))
query("v07_label_bins", "with n as (select quantile_disc(n_chars, [" + ", ".join(f"{i / 20}" for i in range(1, 21)) + "]) q from documents) select bin, count(*) n from (select least(len(list_filter(q, lambda e: e < n_chars)), 19)::varchar bin from documents, n) group by bin")(
    lambda s, d: ve.label_bins(fx.read(s, d, "documents").select("n_chars"), "n_chars").groupBy("bin").agg(F.count("*").alias("n"))
)
query("v07b_text_label_bins", "select (('0x' || substr(md5(url), 1, 8))::bigint % 20)::varchar bin, count(*) n from pages where url is not null group by bin")(
    lambda s, d: ve.label_bins(fx.read(s, d, "pages").select("url"), "url").where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
)
query("v08_pooled_vectors", sql([EM, CAND, "ux as (select output_id, w, unnest(e) x, generate_subscripts(e, 1) i from cd)"], "select output_id, i - 1 i, sum(w * x) / sum(w) m from ux group by all", "output_id, i", "m"))(
    lambda s, d: ve.mean_vectors(candidates(s, d), ["output_id"], weight=F.col("w")).select("output_id", F.posexplode("mean").alias("i", "m")).withColumn("i", F.col("i").cast("long"))
)
query("v09_interference_summary", sql([EM, CAND, CONF], "select avg(coalesce(c, 0)) conf_mean, stddev_pop(coalesce(c, 0)) conf_std, avg((coalesce(c, 0) > 0.8)::int) conf_high, avg(1 - coalesce(c, 0)) sep_mean, avg((1 - coalesce(c, 0) < 0.4)::int) sep_low from (select distinct output_id from cd) left join cf using (output_id)", "", "conf_mean, conf_std, conf_high, sep_mean, sep_low"))(
    lambda s, d: ve.interference_summary(ve.confusability(candidates(s, d), "output_id", "slot", "w").withColumn("sep", 1 - F.col("confusability")), "confusability", "sep")
)
TRIAL = ["method", "k", "seed"]


def trials(s, d):
    """Nested records of trials: ten vectors are an output of two steps with five candidates each."""
    v = E(s, d).select(F.expr("vec_id div 10").alias("o"), F.expr("vec_id % 10 div 5").alias("step"), (F.col("vec_id") % 5).alias("slot"), (1 + F.col("vec_id") % 7).cast("double").alias("w"), dbl().alias("e"), "label")
    c = v.groupBy("o", "step").agg(F.sort_array(F.collect_list(F.struct("slot", "w", "e"))).alias("c"), F.sum("w").alias("all"), F.max("label").alias("label"))
    merged = F.transform(F.sequence(F.lit(0), F.size(F.col("c")[0]["e"]) - 1), lambda i: F.aggregate("c", F.lit(0.0), lambda t, x: t + x["w"] * F.get(x["e"], i)) / F.col("all"))
    heads = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda h: F.slice(F.col("c")[0]["e"], h * 16 + 1, 16))
    step = F.struct("step", F.transform("c", lambda x: x["w"] / F.col("all")).alias("p"), F.transform("c", lambda x: x["e"]).alias("v"), merged.alias("m"), heads.alias("h"))
    one = c.withColumn("s", step).groupBy("o").agg(F.sort_array(F.collect_list("s")).alias("s"), F.max("label").alias("label"))
    part = lambda x: F.transform("s", lambda e: e[x])
    return one.select(
        F.when(F.col("o") % 2 == 0, "soft").otherwise("tree").alias("method"), F.lit(5).cast("long").alias("k"), (F.col("o") % 3).alias("seed"), F.col("o").alias("output_id"), (F.col("o") % 3 == 0).cast("double").alias("ok"), (F.col("o") % 4 < 2).cast("double").alias("ref_ok"),
        (10 + F.col("o") % 5).alias("forward_passes"), (100 + F.col("o") % 50).alias("tokens"), part("p").alias("candidate_probs"), part("v").alias("candidate_embeddings"), part("m").alias("aggregated_embeddings"), part("h").alias("attention"),
        F.get(part("m"), F.size("s") - 1).alias("hidden"), "label",
    )


TRIALS = """tc as (select vec_id // 10 o, vec_id % 10 // 5 st, vec_id % 5 slot, (1 + vec_id % 7)::double w, e from em),
to_ as (select distinct o, case when o % 2 = 0 then 'soft' else 'tree' end method, 5::bigint k, o % 3 seed from tc),
tp as (select *, w / sum(w) over (partition by o, st) p, count(*) over (partition by o, st) c from tc),
te as (select o, st, -sum(p * log2(p)) h from tp where c > 1 group by all),
tf as (select a.o, a.st, sum(a.p * b.p * list_cosine_similarity(a.e, b.e)) / sum(a.p * b.p) cf from tp a join tp b on a.o = b.o and a.st = b.st and a.slot < b.slot group by all),
tu as (select o, st, i, sum(p * x) m from (select o, st, p, unnest(e) x, generate_subscripts(e, 1) i from tp) group by all),
tg as (select method, seed, i, j, covar_samp(x, y) c from (select a.o, a.i, b.i j, a.m x, b.m y from tu a join tu b on a.o = b.o and a.st = b.st) join to_ using (o) group by all),
tr as (select method, seed, sum(c) filter (i = j) ^ 2 / sum(c * c) r_geom from tg group by all),
th as (select o, st, (i - 1) // 16 h, (i - 1) % 16 pos, x from (select o, st, unnest(e) x, generate_subscripts(e, 1) i from (select *, row_number() over (partition by o, st order by slot) r from tp) where r = 1)),
tv as (select method, seed, h, list(x order by pos) v from (select method, seed, h, pos, avg(x) x from th join to_ using (o) group by all) group by all),
ti as (select a.method, a.seed, 1 - avg(list_cosine_similarity(a.v, b.v)) i_head from tv a join tv b on a.method = b.method and a.seed = b.seed and a.h < b.h group by all),
ta as (select method, k, seed, avg((o % 3 = 0)::int) accuracy, avg((o % 4 < 2)::int) - avg((o % 3 = 0)::int) d, sum(10 + o % 5)::bigint total_forward_passes, sum(100 + o % 50)::bigint total_tokens, count(*) outputs from to_ group by all),
tm as (select method, seed, avg(h) r_dist, avg(cf) i_conf from te join tf using (o, st) join to_ using (o) group by all),
tx as (select * from ta join tm using (method, seed) join tr using (method, seed) join ti using (method, seed))"""
query("v10_trial_metrics", sql([EM, TRIALS], "select * from tx", "method, k, seed, total_forward_passes, total_tokens, outputs", "accuracy, r_dist, r_geom, d, i_head, i_conf"))(lambda s, d: tr.trial_metrics(trials(s, d), TRIAL))
query("v10b_fitted_trial_metrics")(lambda s, d: tr.fitted_trial_metrics(trials(s, d), TRIAL, "output_id", "label", hidden=64))
KEY = ["model", "task", "seed", "instance_id"]
DIST = "me as (select model, task, seed, instance_id, max(y) filter (path = 0) ok, max(y) any_ok from paths where arm = 'PT' group by all), rf as (select model, task, seed, instance_id, case when 2 * sum(y) > 32 then 1.0::double when 2 * sum(y) = 32 then 0.5::double else 0.0::double end ref_ok from paths where arm = 'SC' group by all)"


def method(s, d):
    return P(s, d).where("arm = 'PT'").groupBy(*KEY).agg(F.max(F.when(F.col("path") == 0, F.col("y"))).alias("ok"), F.max("y").alias("any_ok"))


query("a27_distortion", sql([fx.PATHS_SQL, DIST], "select model, task, avg(ref_ok) - avg(ok) distortion, avg((ok = 0 and any_ok = 1)::int) coverage_failure, count(*) n from me join rf using (model, task, seed, instance_id) group by all", "model, task, n", "distortion, coverage_failure"))(
    lambda s, d: ql.distortion(method(s, d), vo.records(P(s, d).where("arm = 'SC'")).select(*KEY, vo.majority(F.col("s"), F.col("k")).alias("ok")), KEY)
)
query("j10_rerun_instability", sql([fx.PATHS_SQL, "r as (select model, task, instance_id, answer, count(*) c from paths where arm = 'PT' and path = 0 and answer is not null group by all)"], "select model, task, instance_id, case when sum(c) > 1 then 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) end instability from r group by all", "model, task, instance_id", "instability"))(
    lambda s, d: ql.rerun_instability(P(s, d).where("arm = 'PT' and path = 0"), ["model", "task", "instance_id"], "seed", "answer")
)
query("j09_method_reference", sql([fx.PATHS_SQL, DIST], "select model, task, seed, count(*) n, sum(ok)::bigint ok, sum(ref_ok) ref_ok from me join rf using (model, task, seed, instance_id) group by all", "model, task, seed, n, ok", "ref_ok"))(
    lambda s, d: method(s, d).join(vo.records(P(s, d).where("arm = 'SC'")).select(*KEY, vo.majority(F.col("s"), F.col("k")).alias("ref_ok")), KEY).groupBy("model", "task", "seed").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"), F.sum("ref_ok").alias("ref_ok"))
)
query("a28_mean_gain", sql([fx.PATHS_SQL, DIST], "select model, avg(ok) method_acc, avg(any_ok) any_acc from me group by all", "model", "method_acc, any_acc"))(lambda s, d: method(s, d).groupBy("model").agg(F.avg("ok").alias("method_acc"), F.avg("any_ok").alias("any_acc")))
query("a28_mean_f1", sql([DOCPAIR, F1], "select d.source, count(*) n, avg(f1) mean_f1 from f join documents d using (doc_id) group by all", "source, n", "mean_f1"))(
    lambda s, d: token_f1(doc_pairs(s, d), "doc_id", F.col("pred"), F.col("gold")).join(fx.read(s, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg("f1").alias("mean_f1"))
)
query("a29_compute_totals", sql([fx.PATHS_SQL], "select model, task, arm, count(*) passes, sum(gen_len)::bigint tokens from paths group by all", "model, task, arm, passes, tokens"))(lambda s, d: P(s, d).groupBy(*vo.CELL).agg(F.count("*").alias("passes"), F.sum("gen_len").alias("tokens")))
STATS = ["sv as (select model, task, arm, case when avg(acc) = 0 then 0.0::double else stddev_pop(acc) / avg(acc) end slot_cv from sl group by all)", "ws as (select *, 100 * (weighted_acc - mv_acc) gain_pp from wm join sv using (model, task, arm))"]


def stats(s, d):
    return vo.weighted_statistics(vo.ballots(P(s, d)))


PBAR = "pb as (select model, task, arm, avg(y) p_bar from paths group by all)"
PARTS = "pw as (select *, unnest(['all', case when slot_cv > 0.225 then 'high_cv' else 'low_cv' end, case when mv_acc >= 0.3 then 'high_mv' else 'low_mv' end]) part from ws join pb using (model, task, arm) where arm = 'PT' and p_bar >= 0.02)"
query("a25_weighted_summary", sql([fx.PATHS_SQL, SLOTS, WMV, *STATS, PBAR, PARTS],
    "select part, count(*) n, avg(gain_pp) mean_gain, avg(slot_cv) mean_cv, median(slot_cv) median_cv, 100 * avg((slot_cv > 0.225)::int) high_cv_pct from pw group by part", "part, n", "mean_gain, mean_cv, median_cv, high_cv_pct"))(
    lambda s, d: ql.weighted_summary(stats(s, d).join(vo.path_accuracy(P(s, d)), vo.CELL).where("arm = 'PT'"))
)
MEASURES = ["gain_pp", "slot_cv", "ratio"]
LONG = "lg as (" + " union all ".join(f"select '{m}' measure, model || '/' || task || '/' || arm cell, round({m}, 9) v from ws left join rt using (model, task, arm) where {m} is not null" for m in MEASURES) + ")"
RATIO = "rt as (select model, task, arm, case when reason is null then p_bar * (1 - p_bar) / v / (k / (1 + (k - 1) * rho)) end ratio from br)"
query("a26_extremes", sql([fx.PATHS_SQL, RECS8, RHO, BLOCK, RATIO, SLOTS, WMV, *STATS, LONG],
    "select measure, arg_min(cell, {'v': v, 'c': cell}) least_cell, min(v) least, arg_max(cell, {'v': v, 'c': cell}) most_cell, max(v) most from lg group by all", "measure, least_cell, most_cell", "least, most"))(
    lambda s, d: (lambda b: ql.extremes(vo.weighted_statistics(b).join(co.block_k_eff(vo.first_paths(b, 8), weight="n").select(*vo.CELL, "ratio"), vo.CELL, "left"), MEASURES))(vo.ballots(P(s, d)))
)
query("a31_diversity_table", sql([*PR, RHO, EXACT], "select model, task, kk, agreement, rho, keff, ceiling, 100 * pct_ceiling pct_ceiling, 100 * seed_mean p_mean, 100 * seed_std p_std, 100 * binary_acc mv, tokens from exact where arm = 'SC' and kk <> 2", "model, task, kk", "agreement, rho, keff, ceiling, pct_ceiling, p_mean, p_std, mv, tokens"))(
    lambda s, d: co.exact_k(P(s, d).where("arm = 'SC'"), (1, 4, 8, 16, 32)).selectExpr("model", "task", "kk", "agreement", "rho", "keff", "ceiling", "100 * pct_ceiling pct_ceiling", "100 * seed_mean p_mean", "100 * seed_std p_std", "100 * binary_acc mv", "tokens")
)
WIDE = "wd as (select model, task, arm, " + ", ".join(f"max({x}) filter (kk = {k}) {x}{k}" for k in (4, 8, 16, 32) for x in ("rho", "keff")) + ", max(mean_path_acc) filter (kk = 32) p_bar, 100 * max(binary_acc) filter (kk = 32) observed, max(ceiling) filter (kk = 32) ceiling, 100 * max(pct_ceiling) filter (kk = 32) pct_ceiling from exact where arm = 'SC' group by all)"
PRED = f"pd as (select *, case when rho32 > 0 and rho32 < 1 and p_bar > 0 and p_bar < 1 then 100 * {BB.format(k=32)} end predicted, case when p_bar > 0 and p_bar < 1 then 100 * {BI.format(k=32, p='p_bar')} end independent from (select *, p_bar * (1 - rho32) / rho32 a, (1 - p_bar) * (1 - rho32) / rho32 b from wd))"
query("a32_cross_model", sql([*PR, RHO, EXACT, WIDE, PRED], "select *, abs(observed - predicted) error_pp, abs(observed - independent) independent_error_pp from pd", "model, task, arm", ", ".join([*[f"{x}{k}" for k in (4, 8, 16, 32) for x in ("rho", "keff")], "p_bar, observed, ceiling, pct_ceiling, predicted, independent, error_pp, independent_error_pp"])))(
    lambda s, d: co.cross_model(P(s, d).where("arm = 'SC'"))
)
GLS = """sp as (select a.model, a.task, a.seed, a.path i, b.path j, count(*)::double n, sum(a.y)::double si, sum(b.y)::double sj, sum(a.y * b.y)::double sij from paths a join paths b using (model, task, arm, seed, instance_id) where arm = 'PT' group by all),
st as (select model, task, seed, i, j, sum(n) over w - n n, sum(si) over w - si si, sum(sj) over w - sj sj, sum(sij) over w - sij sij from sp window w as (partition by model, task, i, j)),
ms as (select model, task, seed, list(r order by i) m, list(g order by i) g from (select model, task, seed, i, list((sij - si * sj / n) / greatest(n - 1, 1) order by j) r, any_value(si / n) g from st where n > 0 group by all) group by all),
ge as (select model, task, seed, ridge, g, 0 step, list_transform(m, lambda r, i: list_transform(r, lambda x, j: case when i = j then x + ridge else x end) || [g[i]]) a from ms, (select unnest([0.1::double, 0.5::double, 1.0::double, 5.0::double]) ridge)
  union all select model, task, seed, ridge, g, step + 1, list_transform(a, lambda r, i: case when i = step + 1 then list_transform(r, lambda x: x / r[step + 1]) else list_transform(r, lambda x, j: x - r[step + 1] * a[step + 1][j] / a[step + 1][step + 1]) end) from ge where step < len(g)),
gw as (select model, task, seed, ridge, list_transform(x, lambda v: v / list_dot_product(g, x)) w from (select *, list_transform(a, lambda r: r[len(g) + 1]) x from ge where step = len(g))),
ga as (select model, task, seed, instance_id, ridge, answer, count(*) votes, min(path) first, max(y) y, round(sum(w[path + 1]), 9) wt from paths join gw using (model, task, seed) where arm = 'PT' group by all),
gr as (select model, task, seed, instance_id, ridge, coalesce(arg_max(y, {'w': wt, 'f': -first}) filter (answer is not null), 0) g, coalesce(arg_max(y, {'v': votes, 'f': -first}) filter (answer is not null), 0) mv, max(y) any_ok from ga group by all),
gt as (select model, task, seed, n::bigint n_train from st where i = 0 and j = 0),
gs as (select model, task, 'PT' arm, seed, ridge, n_train, count(*) n_test, 100 * avg(mv) mv_acc, 100 * avg(any_ok) oracle_acc, 100 * avg(g) gls_acc from gr join gt using (model, task, seed) group by all)"""
query("a18_gls_vote", sql([fx.PATHS_SQL, GLS], "select *, gls_acc - mv_acc gain, oracle_acc - mv_acc headroom from gs", "model, task, arm, seed, n_train, n_test", "ridge, mv_acc, oracle_acc, gls_acc, gain, headroom").replace("with ", "with recursive ", 1))(lambda s, d: ql.held_out_gls(P(s, d).where("arm = 'PT'")))
MVS = ", ".join(f"max(mv_acc) filter (kk = {k}) mv{k}" for k in (1, 2, 4, 8, 16, 32))
query("i17_cell_report", sql([*PR, RHO, EXACT, f"w as (select model, task, arm, max(mean_path_acc) filter (kk = 32) p_bar, max(rho) filter (kk = 4) rho_pilot, max(rho) filter (kk = 32) rho_all, max(keff) filter (kk = 32) keff, {MVS} from exact group by all)"], f"select *, {KSTAR.format(c='rho_pilot', e='0.025::double')} k_star from w join (select model, task, arm, count(*) filter (truncated) cut, count(*) filter (answer is null) missing from paths group by all) using (model, task, arm)", "model, task, arm, cut, missing, k_star", "p_bar, rho_pilot, rho_all, keff, mv1, mv2, mv4, mv8, mv16, mv32"))(
    lambda s, d: co.cell_report(P(s, d))
)

def _stream_folders(s, d):
    """Events as arriving JSON files in the shared folder, rows of every seventeenth id twice."""
    base = new_folder(s)
    ev = fx.read(s, d, "events").select("event_id", "ts", "user_id", "event_type", F.col("value").cast("double").alias("value"))
    ev.repartition(4).write.json(f"{base}/in")
    ev.where("event_id % 17 = 0").repartition(2).write.mode("append").json(f"{base}/in")
    return base


def _ingest(s, d):
    base = _stream_folders(s, d)
    st.ingest(st.once_by_key(st.arriving(s, f"{base}/in", files_per_trigger=2), "event_id"), f"{base}/out", f"{base}/ck")
    return s.read.schema(st.EVENTS).parquet(f"{base}/out")


query("t01_incremental_ingest", "select event_type, count(*) n, count(distinct event_id) keys from events group by all")(lambda s, d: _ingest(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("keys")))


def _live(s, d):
    """A summary by model, task and seed of arriving record files, records of every seventh question twice."""
    folder, base = fx.record_files(s, d), new_folder(s)
    s.read.schema(st.RECORDS).json(folder).where("instance_id % 7 = 0").repartition(2).write.mode("append").json(folder)
    key = ["model_slug", "task", "seed"]
    stream = st.once_by_key(st.arriving(s, folder, st.RECORDS, files_per_trigger=8), [*key, "instance_id"])
    st.live_summary(stream.withColumn("tokens", F.aggregate("gen_lens", F.lit(0).cast("long"), lambda t, x: t + x)), key, "tokens", f"{base}/sum", f"{base}/ck")
    return st.read_summary(s, f"{base}/sum", key)


query("t02_live_summary", sql([fx.PATHS_SQL], "select model model_slug, task, seed, count(distinct instance_id) n, sum(gen_len)::double total from paths where arm = 'SC' group by all", "model_slug, task, seed, n", "total"))(_live)
