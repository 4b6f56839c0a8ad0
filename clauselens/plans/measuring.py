"""Queries of the cut and metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts as C
from ..operators import metrics as M
from ..operators import resample as R
from ..operators import scoring as S
from .base import DOC_TOK, Tables, otsu_sql, poisson_sql, query, uniform_sql

EV = "WITH sc AS (SELECT event_type AS key, event_id AS id, value AS score FROM events)"
EXT = EV + ", pos AS (SELECT * FROM sc WHERE score > 0), e AS (SELECT key, min(score) AS lo, max(score) AS hi, count(*) AS n, avg(score) AS mu, stddev_pop(score) AS sd FROM pos GROUP BY key)"
LEV = EXT + ", l AS (SELECT key, score, count(*) AS c FROM pos GROUP BY ALL), pl AS (SELECT key, score, c, sum(c) OVER w - c AS f, sum(c) OVER w - 1 AS la, lag(score) OVER w AS ab FROM l WINDOW w AS (PARTITION BY key ORDER BY score DESC))"
GRID = [i / 10 for i in range(0, 11)]
GRID_SQL = "unnest([" + ", ".join(map(str, GRID)) + "])"


def _events(t: Tables):
    return t.events.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.col("value").alias("score"))


@query(EV + "," + otsu_sql("sc") + " SELECT key, round(cut, 6) AS cut FROM otsu_cut")
def otsu_cut_events(t):
    return C.otsu(_events(t)).select("key", F.round("cut", 6).alias("cut"))


@query(
    EXT + """, h AS (SELECT p.key, least(255, floor((score - lo) / ((hi - lo) / 256)))::INT AS bin, count(*) AS c FROM pos p JOIN e USING (key) WHERE hi > lo GROUP BY ALL),
pk AS (SELECT key, arg_max(bin, (c, -bin)) AS x0, max(c) AS y0, max(bin) AS x1, arg_max(c, bin) AS y1 FROM h GROUP BY key),
b AS (SELECT pk.*, unnest(range(x0, x1 + 1)) AS bin FROM pk WHERE x1 > x0), d AS (SELECT b.key, b.bin, abs((y1 - y0) * (b.bin - x0) - (x1 - x0) * (coalesce(c, 0) - y0)) AS d FROM b LEFT JOIN h ON b.key = h.key AND b.bin = h.bin),
m AS (SELECT key, arg_max(bin, (d, -bin)) AS bin FROM d GROUP BY key) SELECT key, round(lo + (hi - lo) / 256 * (bin + 1), 6) AS cut FROM m JOIN e USING (key)"""
)
def triangle_cut_events(t):
    return C.triangle(_events(t)).select("key", F.round("cut", 6).alias("cut"))


@query(
    LEV + """, r AS (SELECT pl.*, lo, hi, n, unnest(list_distinct([f, la])) AS i FROM pl JOIN e USING (key)), k AS (SELECT key, i, round(abs((lo - hi) * i - (n - 1) * (score - hi)), 9) AS d, CASE WHEN i > f THEN score ELSE coalesce(ab, score) END AS cut FROM r)
SELECT key, round(arg_max(cut, (d, -i)), 6) AS cut FROM k GROUP BY key"""
)
def kneedle_cut_events(t):
    return C.kneedle(_events(t)).select("key", F.round("cut", 6).alias("cut"))


@query(LEV + ", g AS (SELECT pl.key, ab, round(ab - score, 9) AS g, f FROM pl JOIN e USING (key) WHERE f >= greatest(1, floor(0.01 * n)) AND f < least(n, greatest(2, floor(0.5 * n)))) SELECT key, round(arg_max(ab, (g, -f)), 6) AS cut FROM g GROUP BY key")
def largest_gap_cut_events(t):
    return C.largest_gap(_events(t)).select("key", F.round("cut", 6).alias("cut"))


@query(EXT + ", c AS (SELECT key, unnest([0.0, 0.5, 1.0]) AS c, mu, sd FROM e) SELECT 'mean+' || c || 'sd' AS rule, key, round(mu + c * sd, 5) AS cut FROM c")
def mean_sd_cuts_events(t):
    return C.label_free_cuts(_events(t), ["mean+0.0sd", "mean+0.5sd", "mean+1.0sd"]).select("rule", "key", F.round("cut", 5).alias("cut"))


@query(LEV + ", q AS (SELECT key, unnest([{'r': 'top_q=0.05', 'q': 0.05}, {'r': 'top_q=0.10', 'q': 0.1}, {'r': 'top_q=0.25', 'q': 0.25}]) AS st, n FROM e) SELECT st.r AS rule, q.key, pl.score AS cut FROM q JOIN pl ON q.key = pl.key AND f < greatest(1, round_even(st.q * n, 0)) AND greatest(1, round_even(st.q * n, 0)) <= la + 1")
def top_quantile_cuts_events(t):
    return C.label_free_cuts(_events(t), ["top_q=0.05", "top_q=0.10", "top_q=0.25"])


@query(
    EXT.replace("WITH", "WITH RECURSIVE", 1)
    + """, r AS (SELECT key, mu AS cut, 0 AS k FROM e UNION ALL SELECT r.key, coalesce((avg(p.score) FILTER (p.score < r.cut) + avg(p.score) FILTER (p.score >= r.cut)) / 2, any_value(r.cut)), any_value(r.k) + 1 FROM r JOIN pos p ON p.key = r.key WHERE r.k < 100 GROUP BY r.key)
SELECT e.key, round(CASE WHEN lo = hi THEN 2.0 ELSE cut END, 6) AS cut FROM r JOIN e ON e.key = r.key WHERE k = 100"""
)
def isodata_cut_events(t):
    return C.isodata(_events(t)).select("key", F.round("cut", 6).alias("cut"))


@query(EXT + ", m AS (SELECT key, max(score) AS mx FROM sc GROUP BY key), s AS (SELECT sc.key, score / mx AS score FROM sc JOIN m USING (key)), g AS (SELECT " + GRID_SQL + " AS cut), k AS (SELECT DISTINCT key FROM s) SELECT k.key, g.cut, count(*) FILTER (score > 0 AND score >= cut) AS n FROM k, g, s WHERE s.key = k.key GROUP BY ALL")
def threshold_sweep_events(t):
    e = _events(t)
    top = e.groupBy("key").agg(F.max("score").alias("mx"))
    return C.sweep(e.join(top, "key").select("key", "id", (F.col("score") / F.col("mx")).alias("score")), GRID)


@query(EV + "," + otsu_sql("sc") + " SELECT sc.key, ep AS eps, count(*) FILTER (abs(score - cut) <= ep) AS n FROM sc JOIN otsu_cut USING (key), (SELECT unnest([0.5, 2.5, 10.0]) AS ep) GROUP BY ALL")
def cut_bystanders_events(t):
    e = _events(t)
    return C.bystanders(e, C.otsu(e), [0.5, 2.5, 10.0])


@query(
    EV + ", d AS (SELECT key || chr(1) || r AS key, id, score, unnest(range(" + poisson_sql("r::VARCHAR, id::VARCHAR") + ")) AS n FROM sc, (SELECT unnest(range(1, 11)) AS r) WHERE score > 0),"
    + otsu_sql("d") + " SELECT split_part(key, chr(1), 1) AS key, round(quantile_cont(cut, 0.05), 6) AS low, round(quantile_cont(cut, 0.5), 6) AS mid, round(quantile_cont(cut, 0.95), 6) AS high FROM otsu_cut GROUP BY ALL"
)
def cut_bootstrap_events(t):
    return R.cut_bootstrap(_events(t), C.otsu, 10).select("key", F.round("low", 6).alias("low"), F.round("mid", 6).alias("mid"), F.round("high", 6).alias("high"))


@query(
    """WITH s AS (SELECT event_type AS draw, user_id AS id, round(sum(value) / 400, 4) AS score FROM events GROUP BY ALL), g AS (SELECT """ + GRID_SQL + """ AS cut), dr AS (SELECT DISTINCT draw FROM s WHERE score > 0),
r AS (SELECT draw, id, cut FROM s, g WHERE score > 0 AND score >= cut), sz AS (SELECT cut, draw, count(*) AS n FROM r GROUP BY ALL), bo AS (SELECT x.cut, x.draw AS a, y.draw AS b, count(*) AS k FROM r x JOIN r y ON x.cut = y.cut AND x.id = y.id AND x.draw < y.draw GROUP BY ALL),
pr AS (SELECT x.draw AS a, y.draw AS b, cut FROM dr x, dr y, g WHERE x.draw < y.draw), j AS (SELECT pr.cut, coalesce(k, 0) AS k, coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(k, 0) AS u FROM pr LEFT JOIN bo USING (cut, a, b) LEFT JOIN sz sa ON sa.cut = pr.cut AND sa.draw = pr.a LEFT JOIN sz sb ON sb.cut = pr.cut AND sb.draw = pr.b),
m AS (SELECT cut, round(avg(CASE WHEN u > 0 THEN k / u ELSE 0 END), 12) AS ag FROM j GROUP BY cut), fl AS (SELECT draw, count(*) AS al FROM s WHERE score > 0 GROUP BY draw), v AS (SELECT g.cut, bool_and(coalesce(n, 0) = al) AS v FROM fl CROSS JOIN g LEFT JOIN sz ON sz.cut = g.cut AND sz.draw = fl.draw GROUP BY g.cut)
SELECT cut, round(ag, 6) AS agreement FROM m JOIN v USING (cut) WHERE NOT v ORDER BY ag DESC, cut LIMIT 1"""
)
def stability_cut_events(t):
    s = t.events.groupBy(F.col("event_type").alias("draw"), F.col("user_id").alias("id")).agg(F.round(F.sum("value") / 400, 4).alias("score"))
    return C.stability(s, GRID).select("cut", F.round("agreement", 6).alias("agreement"))


# --- labels as two judges over documents ----------------------------------------------------------

LAB = "WITH r AS (SELECT d.doc_id AS id, d.source, d.lang, d.n_chars, l.quality, l.toxic, d.n_chars > 1500 AS pred, l.quality = 1 AS gold FROM labels l JOIN documents d USING (doc_id))"
CELLS = ", c AS (SELECT lang, count(*) FILTER (pred AND gold) AS tp, count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (NOT pred AND gold) AS fn, count(*) FILTER (NOT pred AND NOT gold) AS tn FROM r GROUP BY lang)"
MCC = "CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END"


def _labelled(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars", "quality", "toxic", (F.col("n_chars") > 1500).alias("pred"), (F.col("quality") == 1).alias("gold"))


@query(LAB + CELLS + f", x AS (SELECT *, (tp + fn) / (tp + fp + fn + tn) AS p FROM c) SELECT lang, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round({MCC}, 6) AS mcc, round(2 * p / (1 + p), 6) AS floor_f1 FROM x")
def mcc_labels(t):
    s = M.scored(M.confusion(_labelled(t), "lang"))
    return s.select("lang", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mcc", "floor_f1")))


@query(LAB + ", lv AS (SELECT source, n_chars::DOUBLE AS score, count(*) FILTER (gold) AS p, count(*) FILTER (NOT gold) AS n FROM r GROUP BY ALL), u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS un FROM lv) SELECT source, round(sum(p * (un + n / 2.0)) / nullif(sum(p) * sum(n), 0), 6) AS auc FROM u GROUP BY source")
def auc_doc_length_quality(t):
    return M.auc(_labelled(t).withColumn("score", F.col("n_chars").cast("double")), "source").select("source", F.round("auc", 6).alias("auc"))


ROC = LAB + ", lv AS (SELECT lang, floor(n_chars / 500)::DOUBLE AS score, count(*) FILTER (gold) AS p, count(*) FILTER (NOT gold) AS n FROM r GROUP BY ALL), rc AS (SELECT lang, score, coalesce(sum(n) OVER w / nullif(sum(n) OVER (PARTITION BY lang), 0), 0) AS fpr, coalesce(sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY lang), 0), 0) AS tpr FROM lv WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"


def _roc(t: Tables):
    return M.roc(_labelled(t).withColumn("score", F.floor(F.col("n_chars") / 500).cast("double")), "lang")


@query(ROC + " SELECT lang, score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rc")
def roc_points(t):
    return _roc(t).select("lang", "score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(ROC + " SELECT lang, round(coalesce(max(tpr) FILTER (fpr <= 0.3), 0), 6) AS tpr FROM rc GROUP BY lang")
def tpr_at_fpr(t):
    return M.tpr_at(_roc(t), 0.3, "lang").select("lang", F.round("tpr", 6).alias("tpr"))


@query(LAB + " SELECT lang, round(coalesce(avg(pred::INT) FILTER (NOT gold), 0), 6) AS fpr, round(coalesce(avg(pred::INT) FILTER (gold), 0), 6) AS tpr FROM r GROUP BY lang")
def operating_point(t):
    return M.operating_point(_labelled(t), "lang").select("lang", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


CURVE_GRID = [0.0, 0.02, 0.05, 0.1, 0.2, 0.4]
CURVE = LAB + ", s AS (SELECT lang, least(1, n_chars / 20000) AS score, gold FROM r), g AS (SELECT unnest([" + ", ".join(map(str, CURVE_GRID)) + "]) AS cut), c AS (SELECT lang, cut, count(*) FILTER (score > 0 AND score >= cut AND gold) AS tp, count(*) FILTER (score > 0 AND score >= cut AND NOT gold) AS fp, count(*) FILTER (NOT (score > 0 AND score >= cut) AND gold) AS fn, count(*) FILTER (NOT (score > 0 AND score >= cut) AND NOT gold) AS tn FROM s, g GROUP BY ALL), cv AS (SELECT lang, cut, " + MCC + " AS mcc FROM c)"


def _curve(t: Tables):
    return M.mcc_curve(_labelled(t).withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 20000)), CURVE_GRID, "lang")


@query(CURVE + " SELECT lang, cut, round(mcc, 6) AS mcc FROM cv")
def mcc_curve(t):
    return _curve(t).select("lang", "cut", F.round("mcc", 6).alias("mcc"))


@query(CURVE + " SELECT lang, arg_max(cut, (round(mcc, 9), -cut)) AS cut, round(max(mcc), 6) AS mcc FROM cv GROUP BY lang")
def oracle_cuts(t):
    return M.oracle_cut(_curve(t), "lang").select("lang", "cut", F.round("mcc", 6).alias("mcc"))


@query(CURVE + ", tt AS (SELECT cut, sum(mcc) AS a FROM cv GROUP BY cut) SELECT lang, arg_max(cut, (round(a - mcc, 9), -cut)) AS cut FROM cv JOIN tt USING (cut) GROUP BY lang")
def lobo_cuts(t):
    return M.leave_one_out_cut(_curve(t), "lang")


@query(CURVE + " SELECT lang, round(min(mcc), 6) AS low, round(quantile_cont(mcc, 0.5), 6) AS mid, round(max(mcc), 6) AS high FROM cv WHERE cut BETWEEN 0.02 AND 0.2 GROUP BY lang")
def mcc_band(t):
    return _curve(t).where("cut between 0.02 and 0.2").groupBy("lang").agg(F.round(F.min("mcc"), 6).alias("low"), F.round(F.percentile("mcc", 0.5), 6).alias("mid"), F.round(F.max("mcc"), 6).alias("high"))


VOTES = LAB + ", v AS (SELECT 'quality' AS judge, id, quality AS verdict FROM r UNION ALL SELECT 'toxic', id, toxic FROM r UNION ALL SELECT 'length', id, pred::INT FROM r)"


def _votes(t: Tables):
    r = _labelled(t)
    return r.select("id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic", F.lit("length"), F.col("pred").cast("int"))).alias("judge", "verdict"))


@query(VOTES + ", y AS (SELECT * FROM v WHERE verdict >= 1), n AS (SELECT judge, count(*) AS n FROM y GROUP BY judge), b AS (SELECT x.judge AS a, y.judge AS b, count(*) AS k FROM y x JOIN y ON x.id = y.id AND x.judge < y.judge GROUP BY ALL) SELECT b.a, b.b, k AS \"both\", p.n + q.n - k AS either, round(k / (p.n + q.n - k), 6) AS jaccard FROM b JOIN n p ON p.judge = b.a JOIN n q ON q.judge = b.b")
def judge_agreement(t):
    return M.judge_pairs(_votes(t)).withColumn("jaccard", F.round("jaccard", 6))


@query(VOTES + ", g AS (SELECT id, count(*) FILTER (verdict >= 1) AS y, count(*) AS m FROM v GROUP BY id), x AS (SELECT judge, verdict >= 1 AS pred, y - (verdict >= 1)::INT = m - 1 AS gold FROM v JOIN g USING (id)), c AS (SELECT judge, count(*) FILTER (pred AND gold) AS tp, count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (NOT pred AND gold) AS fn, count(*) FILTER (NOT pred AND NOT gold) AS tn FROM x GROUP BY judge) SELECT judge, tp, fp, fn, tn, round(" + MCC + ", 6) AS mcc FROM c")
def judge_leave_one_out(t):
    return M.scored(M.confusion(M.pair_gold(_votes(t)), "judge")).select("judge", "tp", "fp", "fn", "tn", F.round("mcc", 6).alias("mcc"))


@query(VOTES + " SELECT judge FROM v GROUP BY judge HAVING NOT bool_or(verdict = 1)")
def binary_scale_judges(t):
    return M.binary_judges(_votes(t))


@query(VOTES + ", s AS (SELECT id, sum(verdict) AS score FROM v GROUP BY id) SELECT score::BIGINT AS score, count(*) AS n FROM s GROUP BY score")
def score_histogram(t):
    return _votes(t).groupBy("id").agg(F.sum("verdict").alias("score")).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query(VOTES + ", s AS (SELECT id, sum(verdict) AS score FROM v GROUP BY id), x AS (SELECT judge, verdict AS a, CASE WHEN score < 2 THEN 0 ELSE verdict END AS b FROM v JOIN s USING (id)) SELECT judge, count(*) FILTER (a >= 1) AS before, count(*) FILTER (b >= 1) AS after FROM x GROUP BY judge")
def truncation_cost(t):
    v = _votes(t)
    s = v.groupBy("id").agg(F.sum("verdict").alias("score"))
    x = v.join(s, "id").withColumn("b", F.when(F.col("score") < 2, 0).otherwise(F.col("verdict")))
    return x.groupBy("judge").agg(F.count(F.when(F.col("verdict") >= 1, 1)).alias("before"), F.count(F.when(F.col("b") >= 1, 1)).alias("after"))


ARI = "WITH c AS (SELECT lang AS a, source AS b, count(*)::DOUBLE AS c FROM documents GROUP BY ALL), ra AS (SELECT sum(c) AS c FROM c GROUP BY a), rb AS (SELECT sum(c) AS c FROM c GROUP BY b), s AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM c) AS pab, (SELECT sum(c * (c - 1) / 2) FROM ra) AS pa, (SELECT sum(c * (c - 1) / 2) FROM rb) AS pb, (SELECT sum(c) FROM c) AS n, (SELECT sum(c * ln(c)) FROM c) AS hab, (SELECT sum(c * ln(c)) FROM ra) AS ha, (SELECT sum(c * ln(c)) FROM rb) AS hb)"


@query(ARI + " SELECT n::BIGINT AS n, round((pab - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari, round(((ln(n) - ha / n) + (ln(n) - hb / n) - (ln(n) - hab / n)) / sqrt((ln(n) - ha / n) * (ln(n) - hb / n)), 6) AS nmi FROM s")
def ari_two_labelings(t):
    return M.labelling_agreement(t.documents, "lang", "source").select("n", F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


@query("WITH r AS (SELECT c_acctbal AS a, c_nationkey AS b FROM customer), x AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM r) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM x")
def rank_correlation(t):
    return M.spearman(t.customer.select(F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b")), "a", "b").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("WITH r AS (SELECT DISTINCT o_custkey % 50 AS item, o_orderstatus AS run, o_orderpriority AS name FROM orders), rs AS (SELECT item, count(DISTINCT run) AS runs FROM r GROUP BY item), sz AS (SELECT item, run, count(*) AS n FROM r GROUP BY ALL), p AS (SELECT a.item, a.run AS x, b.run AS y, a.n AS na, b.n AS nb FROM sz a JOIN sz b ON a.item = b.item AND a.run < b.run), k AS (SELECT p.*, (SELECT count(*) FROM r u JOIN r w ON u.item = w.item AND u.name = w.name WHERE u.item = p.item AND u.run = p.x AND w.run = p.y) AS k FROM p), m AS (SELECT item, avg(k / (na + nb - k)) AS m FROM k GROUP BY item), nm AS (SELECT item, name, count(DISTINCT run) AS c FROM r GROUP BY ALL) SELECT nm.item, any_value(runs)::INT AS runs, round(any_value(m.m), 6) AS mean_jaccard, round(avg((c = runs)::INT), 6) AS all_jaccard FROM nm JOIN rs USING (item) LEFT JOIN m USING (item) GROUP BY nm.item")
def run_set_agreement(t):
    r = t.orders.select((F.col("o_custkey") % 50).alias("item"), F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("name"))
    return M.run_agreement(r).select("item", "runs", F.round("mean_jaccard", 6).alias("mean_jaccard"), F.round("all_jaccard", 6).alias("all_jaccard"))


@query(LAB + ", w AS (SELECT source, count(*) AS n, count(*) FILTER (gold) AS k FROM r GROUP BY source), p AS (SELECT *, k / n AS p, 1.96 * 1.96 AS z FROM w) SELECT source, n, k, round((p + z / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 6) AS low, round((p + z / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 6) AS high FROM p")
def wilson_by_source(t):
    from ..functions.text import wilson

    g = _labelled(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gold"), 1)).alias("k"))
    w = g.withColumn("w", wilson(F.col("k"), F.col("n")))
    return w.select("source", "n", "k", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(LAB + ", x AS (SELECT pred AS candidate, gold, CASE WHEN pred THEN 1.0 ELSE 0.25 END AS p FROM r), s AS (SELECT count(*) FILTER (candidate AND gold) AS h, count(*) FILTER (candidate) AS c, coalesce(sum(1 / p) FILTER (NOT candidate AND gold), 0) AS m FROM x) SELECT round(h / c, 6) AS precision, round(h / (h + m), 6) AS recall FROM s")
def weighted_recall(t):
    x = _labelled(t).select(F.col("pred").alias("candidate"), "gold", F.when(F.col("pred"), 1.0).otherwise(0.25).alias("p"))
    return M.weighted_recall(x).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(LAB + ", g AS (SELECT lang, avg(toxic) FILTER (pred) - avg(toxic) FILTER (NOT pred) AS e, count(*) AS n FROM r GROUP BY lang) SELECT sum(n)::BIGINT AS n, round(sum(e * n) / sum(n), 6) AS effect FROM g WHERE e IS NOT NULL")
def stratified_flag_effect(t):
    x = _labelled(t).select(F.col("pred").alias("flag"), F.col("toxic").cast("double").alias("rate"), "lang")
    return M.flag_effect(x, "lang").select("n", F.round("effect", 6).alias("effect"))


def _growth(t: Tables):
    return M.growth(S.term_counts(t.documents, "doc_id", "text").groupBy("term").agg(F.min("id").alias("pos")))


GROW = f"WITH {DOC_TOK}, f AS (SELECT term, min(id) AS pos FROM tok GROUP BY term), c AS (SELECT pos, count(*) AS c FROM f GROUP BY pos), g AS (SELECT pos, (sum(c) OVER (ORDER BY pos))::BIGINT AS names FROM c)"


@query(GROW + " SELECT pos, names FROM g")
def growth_curve_tokens(t):
    return _growth(t)


@query(GROW + " SELECT round(regr_slope(ln(names), ln(pos + 1.0)), 6) AS slope FROM g")
def heaps_slope_tokens(t):
    return M.heaps_slope(_growth(t)).select(F.round("slope", 6).alias("slope"))


# --- resampling: draws are read from md5, which SQL has too ---------------------------------------

LOW_HIGH = "round(quantile_cont({x}, 0.025), 6) AS low, round(quantile_cont({x}, 0.975), 6) AS high"


@query(
    "WITH x AS (SELECT r, " + poisson_sql("r::VARCHAR, doc_id::VARCHAR") + " AS w, quality FROM labels, (SELECT unnest(range(1, 301)) AS r)), m AS (SELECT r, sum(w * quality) / nullif(sum(w), 0) AS m FROM x GROUP BY r) SELECT round((SELECT avg(quality) FROM labels), 6) AS mean, "
    + LOW_HIGH.format(x="m") + " FROM m"
)
def bootstrap_mean_quality(t):
    return _rounded(R.bootstrap_mean(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("x")), 300))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


def _cells(t: Tables):
    return _labelled(t).select(F.col("lang").alias("cell"), "id", "gold", F.col("pred").alias("a"), (F.col("n_chars") > 300).alias("b"))


def _mcc_sql(pred: str, w: str = "w") -> str:
    """Weighted confusion cells of a predicate inside an aggregate, as one MCC."""
    k = lambda p, g: f"coalesce(sum({w}) FILTER ({p}{pred} AND {g}gold), 0)::DOUBLE"
    tp, fp, fn, tn = k("", ""), k("", "NOT "), k("NOT ", ""), k("NOT ", "NOT ")
    d = f"({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn})"
    return f"CASE WHEN {d} > 0 THEN ({tp} * {tn} - {fp} * {fn}) / sqrt({d}) ELSE 0 END"


@query(
    LAB + ", c AS (SELECT lang AS cell, id, gold, pred AS a, n_chars > 300 AS b FROM r), x AS (SELECT c.*, i AS r, CASE WHEN i = 0 THEN 1 ELSE " + poisson_sql("i::VARCHAR, cell, id::VARCHAR") + " END AS w FROM c, (SELECT unnest(range(0, 201)) AS i)), g AS (SELECT cell, r, "
    + _mcc_sql("a") + " - (" + _mcc_sql("b") + ") AS d FROM x GROUP BY ALL), d AS (SELECT r, avg(d) AS d FROM g GROUP BY r) SELECT round((SELECT d FROM d WHERE r = 0), 6) AS delta, " + LOW_HIGH.format(x="d") + " FROM d WHERE r > 0"
)
def paired_bootstrap_mcc(t):
    return _rounded(R.paired_bootstrap(_cells(t), 200))


@query(
    LAB + ", c AS (SELECT lang AS cell, id, gold, pred AS a FROM r), x AS (SELECT c.*, i AS r, " + poisson_sql("i::VARCHAR, cell, id::VARCHAR") + " AS w0, " + poisson_sql("i::VARCHAR, cell, id::VARCHAR", 18) + " AS w1 FROM c, (SELECT unnest(range(1, 201)) AS i)), g AS (SELECT cell, r, "
    + _mcc_sql("a", "w0") + " - (" + _mcc_sql("a", "w1") + ") AS d FROM x GROUP BY ALL), d AS (SELECT r, avg(d) AS d FROM g GROUP BY r) SELECT round((quantile_cont(d, 0.975) - quantile_cont(d, 0.025)) / 2, 6) AS floor FROM d"
)
def noise_floor_mcc(t):
    return _rounded(R.noise_floor(_cells(t), 200))


def _auc_sql(rows: str, keys: str, weight: str = "1") -> str:
    """Common table expressions over {rows} (keys, score, gold) that end in auc (keys, auc)."""
    return (
        f"lv AS (SELECT {keys}, score, coalesce(sum({weight}) FILTER (gold), 0) AS p, coalesce(sum({weight}) FILTER (NOT gold), 0) AS n FROM {rows} GROUP BY ALL), un AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS un FROM lv), "
        f"auc AS (SELECT {keys}, sum(p * (un + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc FROM un GROUP BY ALL)"
    )


@query(
    LAB + ", x AS (SELECT i AS r, gold, CASE WHEN i = 0 THEN 1 ELSE " + poisson_sql("i::VARCHAR, id::VARCHAR") + " END AS w, unnest([{'s': 'a', 'v': n_chars::DOUBLE}, {'s': 'b', 'v': toxic::DOUBLE}]) AS y FROM r, (SELECT unnest(range(0, 101)) AS i)), z AS (SELECT r, gold, w, y.s AS side, y.v AS score FROM x WHERE w > 0), "
    + _auc_sql("z", "r, side", "w") + ", d AS (SELECT r, sum(CASE WHEN side = 'a' THEN auc ELSE -auc END) AS d FROM auc GROUP BY r HAVING count(auc) = 2) SELECT round((SELECT d FROM d WHERE r = 0), 6) AS delta, " + LOW_HIGH.format(x="d") + " FROM d WHERE r > 0"
)
def paired_auc_delta(t):
    return _rounded(R.paired_auc(_labelled(t).select("id", "gold", F.col("n_chars").cast("double").alias("a"), F.col("toxic").cast("double").alias("b")), 100))


@query(
    LAB + ", x AS (SELECT i AS r, j AS side, lang AS cell, gold, " + uniform_sql("i::VARCHAR, j::VARCHAR, lang, id::VARCHAR") + " AS score FROM r, (SELECT unnest(range(1, 51)) AS i), (SELECT unnest([0, 1]) AS j)), "
    + _auc_sql("x", "cell, r, side") + " SELECT r::INT AS r, round(avg(auc) FILTER (side = 0) - avg(auc) FILTER (side = 1), 6) AS delta FROM auc GROUP BY r"
)
def auc_null_deltas(t):
    return R.auc_null(_labelled(t).select(F.col("lang").alias("cell"), "id", "gold"), 50).select("r", F.round("delta", 6).alias("delta"))


@query(
    LAB + ", s AS (SELECT source, sum(quality) AS s, count(quality) AS c FROM r GROUP BY source), x AS (SELECT i AS r, s, c, " + poisson_sql("i::VARCHAR, source") + " AS w FROM s, (SELECT unnest(range(1, 201)) AS i)), m AS (SELECT r, sum(w * s) / nullif(sum(w * c), 0) AS m FROM x GROUP BY r) SELECT round((SELECT sum(s) / sum(c) FROM s), 6) AS mean, "
    + LOW_HIGH.format(x="m") + " FROM m"
)
def cluster_bootstrap_quality(t):
    return _rounded(R.cluster_bootstrap(_labelled(t).select(F.col("source").alias("cluster"), F.col("quality").cast("double").alias("x")), 200))


@query(
    LAB + ", s AS (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS k, avg(quality) FILTER (toxic = 1) AS seen FROM r), m AS (SELECT i, avg(quality) AS m FROM r, s, (SELECT unnest(range(1, 200)) AS i) WHERE " + uniform_sql("i::VARCHAR, id::VARCHAR") + " < k / n GROUP BY i) SELECT round((SELECT seen FROM s), 6) AS observed, round((1 + count(*) FILTER (m >= (SELECT seen FROM s))) / 200.0, 6) AS p FROM m"
)
def set_null_pvalue(t):
    v = _labelled(t)
    return _rounded(R.set_null(v.select("id", F.col("quality").cast("double").alias("x")), v.where("toxic = 1").select("id"), 199))


@query(
    f"WITH {DOC_TOK}, v AS (SELECT term AS name, count(*) AS n FROM tok GROUP BY term), m AS (SELECT name FROM v WHERE length(name) = 9), b AS (SELECT coalesce(sum(n), 0) AS b FROM v WHERE name IN (SELECT name FROM m)), x AS (SELECT s, name, n, coalesce(sum(n) OVER (PARTITION BY s ORDER BY md5('17:' || s || ':' || name), name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM v, (SELECT unnest(range(1, 4)) AS s) WHERE name NOT IN (SELECT name FROM m)) SELECT s::INT AS s, name, n FROM x, b WHERE u < b"
)
def matched_random_names(t):
    v = S.vocabulary(S.term_counts(t.documents, "doc_id", "text").withColumnRenamed("term", "name"), "tf").select("name", F.col("occurrences").alias("n"))
    return R.random_names(v, v.where(F.length("name") == 9), 3)


@query(LAB + ", ch AS (SELECT 1 AS q, id, n_chars / 1000.0 AS lex, quality::DOUBLE AS atom, toxic::DOUBLE AS kind FROM r), v AS (SELECT unnest([{'v': 'full', 'a': 1.0, 'b': 0.6, 'c': 0.2}, {'v': 'minus lex', 'a': 0.0, 'b': 0.6, 'c': 0.2}, {'v': 'minus atom', 'a': 1.0, 'b': 0.0, 'c': 0.2}, {'v': 'minus kind', 'a': 1.0, 'b': 0.6, 'c': 0.0}, {'v': 'lex only', 'a': 1.0, 'b': 0.0, 'c': 0.0}]) AS st) SELECT st.v AS variant, q, id, round(st.a * lex + st.b * atom + st.c * kind, 6) AS score FROM ch, v")
def channel_ablation(t):
    ch = _labelled(t).select(F.lit(1).alias("q"), "id", (F.col("n_chars") / 1000.0).alias("lex"), F.col("quality").cast("double").alias("atom"), F.col("toxic").cast("double").alias("kind"))
    return R.ablation(ch, ["lex", "atom", "kind"], {"lex": 1.0, "atom": 0.6, "kind": 0.2}).withColumn("score", F.round("score", 6))


@query()
def out_of_fold_quality(t):
    return R.out_of_fold(_labelled(t).select("id", "quality", "toxic", F.col("n_chars").cast("double").alias("n")), ["toxic", "n"], "quality", "id", 3).select("id", "fold", F.round("score", 6).alias("score"))


@query()
def principal_vectors_embeddings(t):
    return R.principal_vectors(t.embeddings, "vec_id", "embedding", 4).select("vec_id", F.transform("vec", lambda x: F.round(x, 5)).alias("vec"))
