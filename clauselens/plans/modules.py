"""Queries of the graph, module and deontic operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deontic as T
from ..operators import graphs as G

from ..operators import modules as Q
from ..operators import scoring as S
from .base import Tables, query

EDGE = "WITH e AS (SELECT o_orderkey AS id, o_orderkey % 400 AS nlo, o_orderkey % 400 + 3 AS nhi, (o_orderkey * 13) % 400 AS plo, (o_orderkey * 13) % 400 + 3 AS phi, o_orderstatus AS s FROM orders)"
OVER = "e.nlo <= f.nhi AND f.nlo <= e.nhi AND e.plo <= f.phi AND f.plo <= e.phi"


def _edges(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("id"), (k % 400).alias("nlo"), (k % 400 + 3).alias("nhi"), ((k * 13) % 400).alias("plo"), ((k * 13) % 400 + 3).alias("phi"), F.col("o_orderstatus").alias("s"))


@query(EDGE + f" SELECT id FROM e WHERE s = 'O' AND EXISTS (SELECT 1 FROM e f WHERE f.s = 'O' AND f.id <> e.id AND {OVER})")
def shadowed_edges(t):
    return G.shadowed(_edges(t).where("s = 'O'")).select("id")


@query(EDGE + f", a AS (SELECT * FROM e WHERE s = 'F'), b AS (SELECT * FROM e WHERE s = 'O') SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, round((SELECT count(*) FROM a e WHERE EXISTS (SELECT 1 FROM b f WHERE {OVER})) / (SELECT count(*) FROM a), 6) AS precision, round((SELECT count(*) FROM b e WHERE EXISTS (SELECT 1 FROM a f WHERE {OVER})) / (SELECT count(*) FROM b), 6) AS recall")
def graph_comparison(t):
    e = _edges(t)
    return G.compare(e.where("s = 'F'"), e.where("s = 'O'")).select("a", "b", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


SPAN = "WITH n AS (SELECT c_custkey AS id, c_custkey * 3 AS lo, CASE WHEN c_custkey % 97 = 0 THEN c_custkey * 3 - 1 ELSE c_custkey * 3 + c_nationkey END AS hi, c_mktsegment AS class FROM customer)"


LINES = 1 << 40


def _spans(t: Tables):
    """Closed line ranges; a few end before they begin."""
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), (k * 3).alias("lo"), F.when(k % 97 == 0, k * 3 - 1).otherwise(k * 3 + F.col("c_nationkey")).alias("hi"), F.col("c_mktsegment").alias("class"))


@query(
    SPAN + """, g AS (SELECT * FROM n WHERE hi >= lo), p AS (SELECT a.lo AS la, a.hi AS ha, b.lo AS lb, b.hi AS hb FROM g a JOIN g b ON a.id < b.id AND a.lo <= b.hi AND b.lo <= a.hi),
nd AS (SELECT o_custkey AS node, o_orderkey AS name FROM orders), pv AS (SELECT c_custkey AS node, c_custkey // 2 * 3 AS name FROM customer)
SELECT 'nodes' AS measure, count(*)::DOUBLE AS value FROM n UNION ALL SELECT 'bad ranges', count(*) FROM n WHERE hi < lo UNION ALL SELECT 'smallest span', min(hi - lo + 1) FROM g UNION ALL SELECT 'median span', quantile_cont(hi - lo + 1, 0.5) FROM g UNION ALL SELECT 'largest span', max(hi - lo + 1) FROM g
UNION ALL SELECT 'overlapping pairs', count(*) FROM p UNION ALL SELECT 'nested pairs', count(*) FROM p WHERE (la <= lb AND hb <= ha) OR (lb <= la AND ha <= hb) UNION ALL SELECT 'multi-provided names', count(*) FROM (SELECT name FROM pv GROUP BY name HAVING count(DISTINCT node) > 1)
UNION ALL SELECT 'dangling names', count(DISTINCT name) FROM nd WHERE name NOT IN (SELECT name FROM pv) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT name, nd.node, pv.node FROM nd JOIN pv USING (name)) UNION ALL SELECT 'covered lines', count(DISTINCT l) FROM (SELECT unnest(range(lo, hi + 1)) AS l FROM g)"""
)
def graph_statistics(t):
    needs = t.orders.select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("name"))
    provides = t.customer.select(F.col("c_custkey").alias("node"), (F.floor(F.col("c_custkey") / 2) * 3).alias("name"))
    return G.graph_statistics(_spans(t), needs, provides, LINES)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    SPAN + ", r AS (SELECT list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], class) AS r, class, unnest(range(lo, hi + 1)) AS l FROM n WHERE hi >= lo), o AS (SELECT l, arg_min(class, coalesce(r, 99)) AS class FROM r GROUP BY l), a AS (SELECT coalesce(class, 'unowned') AS class FROM (SELECT o_orderkey AS l FROM orders) LEFT JOIN o USING (l)) SELECT class, count(*) AS lines, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM a GROUP BY class"
)
def line_mass(t):
    return G.line_mass(_spans(t).where("hi >= lo"), {s: i for i, s in enumerate(SEGMENTS)}, t.orders.select(F.col("o_orderkey").alias("line_no"))).withColumn("share", F.round("share", 6))


@query("WITH v AS (SELECT p_brand AS b, p_type AS ty, p_size > 25 AS verdict FROM part), g AS (SELECT b, ty, count(*) AS n, count(*) FILTER (verdict) AS yes FROM v GROUP BY ALL) SELECT n, yes, yes > 0 AND yes < n AS unsat, count(*) AS classes FROM g GROUP BY ALL")
def satisfiability_census(t):
    v = t.part.select(F.col("p_partkey").alias("node"), "p_brand", "p_type", (F.col("p_size") > 25).alias("verdict"))
    return G.satisfiability_census(v).groupBy("n", "yes", "unsat").agg(F.count(F.lit(1)).alias("classes"))


@query("WITH r AS (SELECT DISTINCT o_custkey % 40 AS item, o_orderstatus AS run, o_orderpriority AS class, o_orderkey % 25 AS name FROM orders), p AS (SELECT a.item, a.run AS x, b.run AS y FROM (SELECT DISTINCT item, run FROM r) a JOIN (SELECT DISTINCT item, run FROM r) b ON a.item = b.item AND a.run < b.run), c AS (SELECT DISTINCT item, class, name FROM r), k AS (SELECT c.item, class, x, y, EXISTS (SELECT 1 FROM r WHERE r.item = c.item AND r.class = c.class AND r.name = c.name AND r.run = x) AS l, EXISTS (SELECT 1 FROM r WHERE r.item = c.item AND r.class = c.class AND r.name = c.name AND r.run = y) AS r FROM c JOIN p USING (item)), g AS (SELECT item, class, x, y, count(*) FILTER (l AND NOT r) AS a, count(*) FILTER (r AND NOT l) AS b FROM k GROUP BY ALL) SELECT class, sum(least(a, b))::BIGINT AS substituted, sum(b - least(a, b))::BIGINT AS added, sum(a - least(a, b))::BIGINT AS dropped FROM g GROUP BY class")
def class_instability(t):
    return G.instability(t.orders.select((F.col("o_custkey") % 40).alias("item"), F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("class"), (F.col("o_orderkey") % 25).alias("name")))


RANKED = "WITH r AS (SELECT c_nationkey AS q, c_custkey AS id, floor(greatest(c_acctbal, 0) / 1000) AS score, c_mktsegment AS kind, c_custkey AS pos FROM customer)"


def _ranked(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("id"), F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 1000).cast("double").alias("score"), F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("pos"))


@query(RANKED + " SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, CASE kind WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 99 END, pos) AS rank FROM r")
def salience_order(t):
    return Q.salience(_ranked(t), {"BUILDING": 0, "MACHINERY": 1}).select("q", "id", "rank")


@query(RANKED + ", s AS (SELECT q, kind AS section, avg(score) AS ss FROM r GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(ss, 6), section DESC) - 1 AS pl, count(*) OVER (PARTITION BY q) AS m FROM s) SELECT r.q, id, round((pl + score / 10) / (m + 1), 6) AS combined FROM r JOIN p ON r.q = p.q AND r.kind = p.section")
def section_lexicographic_rank(t):
    r = _ranked(t).withColumnRenamed("kind", "section")
    s = r.groupBy("q", "section").agg(F.round(F.avg("score"), 6).alias("section_score"))
    return Q.lexicographic(r.join(s, ["q", "section"]).withColumn("score", F.col("score") / 10)).select("q", "id", F.round("combined", 6).alias("combined"))


@query(RANKED + ", u AS (SELECT q, least(score, 4)::INT AS rung FROM r) SELECT q, d::INT AS depth, count(*) AS n FROM u, range(0, 5) t(d) WHERE rung <= d GROUP BY ALL")
def rung_depth_sweep(t):
    return Q.rung_sweep(_ranked(t).select("q", "id", F.least(F.col("score"), F.lit(4.0)).cast("int").alias("rung"))).select("q", "depth", "n")


@query(RANKED + ", s AS (SELECT q, kind AS section, round(avg(score), 6) AS score FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, section) AS rn FROM s) SELECT q, k::INT AS k, section FROM n, range(1, 4) t(k) WHERE rn <= k")
def section_union_sweep(t):
    return Q.section_sweep(_ranked(t).groupBy("q", F.col("kind").alias("section")).agg(F.round(F.avg("score"), 6).alias("score")), 3)


@query(RANKED + ", k AS (SELECT q, kind, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM r) SELECT q, round(avg((kind = 'BUILDING')::INT), 6) AS precision FROM k WHERE rank <= 8 GROUP BY q")
def topk_precision(t):
    r = S.ranked(_ranked(t).withColumnRenamed("score", "raw")).withColumn("gold", F.col("kind") == "BUILDING")
    return Q.top_precision(r, 8).withColumn("precision", F.round("precision", 6))


@query("WITH c AS (SELECT value / 500 AS cut FROM events) SELECT count(*) AS n, min(cut) AS low, max(cut) AS high, round(avg(cut), 6) AS mean, round(stddev_pop(cut), 6) AS sd, quantile_disc(cut, 0.05) AS q05, quantile_disc(cut, 0.5) AS q50, quantile_disc(cut, 0.95) AS q95 FROM c WHERE cut < 0.3")
def cut_band(t):
    return Q.band(t.events.select((F.col("value") / 500).alias("cut")), 0.3).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(RANKED + ", o AS (SELECT id AS c, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r), n AS (SELECT count(*) AS n FROM o), s AS (SELECT o_custkey AS c, o_orderkey % 500 AS p FROM orders), b AS (SELECT p, max(n - rank + 1)::DOUBLE AS score FROM s JOIN o USING (c), n GROUP BY p) SELECT u AS p, coalesce(score, 0) AS score FROM range(0, 520) t(u) LEFT JOIN b ON b.p = u")
def position_scores(t):
    r = S.ranked(_ranked(t).select(F.lit(0).alias("q"), "id", F.col("score").alias("raw")))
    return Q.position_scores(r.select(F.col("id").alias("c"), "rank"), t.orders.select(F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 500).alias("p")), t.spark.range(520).withColumnRenamed("id", "p"))


@query(RANKED + ", core AS (SELECT q, id FROM r WHERE score >= 9), el AS (SELECT DISTINCT q, kind FROM r WHERE score >= 9 AND q % 2 = 0) SELECT q, id FROM core UNION SELECT el.q, r.id FROM el JOIN r USING (kind)")
def typed_union_closure(t):
    r = _ranked(t)
    core = r.where("score >= 9").select("q", "id")
    elected = r.where("score >= 9 and q % 2 = 0").select("q", F.col("kind").alias("section")).distinct()
    return Q.union_closure(core, elected, r.select(F.col("kind").alias("section"), "id"))


@query(
    """WITH l AS (SELECT d.doc_id AS id, d.lang AS q, d.n_chars, l.quality = 1 AS gold FROM labels l JOIN documents d USING (doc_id)), m AS (SELECT 'long' AS module, q, n_chars::DOUBLE AS s, n_chars > 1500 AS p, gold FROM l UNION ALL SELECT 'short', q, -n_chars::DOUBLE, n_chars < 400, gold FROM l),
c AS (SELECT module, q, count(*) FILTER (p AND gold) AS tp, count(*) FILTER (p AND NOT gold) AS fp, count(*) FILTER (NOT p AND gold) AS fn, count(*) FILTER (NOT p AND NOT gold) AS tn FROM m GROUP BY ALL),
a AS (SELECT x.module, x.q, sum(CASE WHEN x.s > y.s THEN 1 WHEN x.s = y.s THEN 0.5 ELSE 0 END) / count(*) AS auc FROM m x JOIN m y ON x.module = y.module AND x.q = y.q AND x.gold AND NOT y.gold GROUP BY ALL)
SELECT module, q, tp, fp, fn, tn, round(auc, 6) AS auc FROM c LEFT JOIN a USING (module, q)"""
)
def module_comparison(t):
    l = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(F.col("lang").alias("q"), F.col("doc_id").alias("id"), "n_chars", "quality")  # noqa: E741
    n = F.col("n_chars").cast("double")
    modules = [Q.QueryModule("long", lambda: l.select("q", "id", n.alias("score")), lambda: l.where("n_chars > 1500")), Q.QueryModule("short", lambda: l.select("q", "id", (-n).alias("score")), lambda: l.where("n_chars < 400"))]
    return Q.compare_modules(modules, l.select("q", "id"), l.where("quality = 1")).select("module", "q", "tp", "fp", "fn", "tn", F.round("auc", 6).alias("auc"))


@query(
    """WITH r AS (SELECT c_nationkey % 2 AS side, CASE WHEN c_acctbal > 0 THEN 'agree' ELSE 'split' END AS stratum, c_custkey AS id FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY side, stratum ORDER BY md5('17:' || id), id) AS rn FROM r), q AS (SELECT * FROM p WHERE rn <= 20)
SELECT side, stratum, id FROM q QUALIFY row_number() OVER (PARTITION BY side ORDER BY CASE WHEN rn <= 10 THEN 0 ELSE 1 END, rn, stratum) <= 20"""
)
def stratified_draw(t):
    return Q.stratified_draw(t.customer.select((F.col("c_nationkey") % 2).alias("side"), F.when(F.col("c_acctbal") > 0, "agree").otherwise("split").alias("stratum"), F.col("c_custkey").alias("id")), 20)


@query()
def readback_trials(t):
    """A brand is a document, a type a section."""
    c = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), F.col("p_type").alias("section"), F.col("p_name").alias("kind"), F.concat("p_type", F.col("p_size") % 5).alias("signature"))
    return Q.readback_trials(c, 4)


@query("WITH b AS (SELECT s_suppkey AS q, s_suppkey % 1200 AS act, CASE s_nationkey % 3 WHEN 0 THEN 'does' WHEN 1 THEN 'avoids' ELSE 'permits' END AS form FROM supplier), d AS (SELECT DISTINCT o_orderkey % 1000 AS act, CASE o_orderstatus WHEN 'F' THEN 'forbid' ELSE 'oblige' END AS d FROM orders WHERE o_totalprice > 100000), j AS (SELECT q, b.act, CASE WHEN d IS NULL THEN 'silence' WHEN form = 'does' AND d = 'forbid' THEN 'act' WHEN form = 'avoids' AND d = 'oblige' THEN 'duality' WHEN form = 'permits' AND d = 'forbid' THEN 'permission' END AS kind FROM b LEFT JOIN d USING (act)) SELECT DISTINCT q, act, kind FROM j WHERE kind IS NOT NULL")
def behaviour_conflicts(t):
    b = t.supplier.select(F.col("s_suppkey").alias("q"), (F.col("s_suppkey") % 1200).alias("act"), F.when(F.col("s_nationkey") % 3 == 0, "does").when(F.col("s_nationkey") % 3 == 1, "avoids").otherwise("permits").alias("form"))
    d = t.orders.where("o_totalprice > 100000").select((F.col("o_orderkey") % 1000).alias("act"), F.when(F.col("o_orderstatus") == "F", "forbid").otherwise("oblige").alias("d"))
    return T.behaviour_conflicts(b, d)


@query("WITH e AS (SELECT c_custkey % 300 AS question, c_nationkey AS answer FROM customer WHERE c_acctbal > 0), o AS (SELECT c_custkey % 298 AS question, c_nationkey AS answer FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT question, 'no run' AS fault FROM (SELECT DISTINCT question FROM e) WHERE question NOT IN (SELECT question FROM o) UNION ALL SELECT question, 'missing ' || answer FROM e WHERE question IN (SELECT question FROM o) AND (question, answer) NOT IN (SELECT (question, answer) FROM o) UNION ALL SELECT question, 'unexpected ' || answer FROM o WHERE (question, answer) NOT IN (SELECT (question, answer) FROM e)")
def competency_faults(t):
    c = lambda rows, m: rows.select((F.col("c_custkey") % m).alias("question"), F.col("c_nationkey").alias("answer"))
    return T.competency(c(t.customer.where("c_acctbal > 0"), 300), c(t.customer.where("c_mktsegment <> 'BUILDING'"), 298))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS x, p_partkey // 3 AS y FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e), r AS (SELECT s_suppkey AS q, s_suppkey AS p FROM supplier UNION SELECT r.q, b.b FROM r JOIN b ON r.p = b.a) SELECT q, p FROM r")
def defeat_reachability(t):
    k = F.col("p_partkey")
    return T.defeat_reach(t.supplier.select(F.col("s_suppkey").alias("q"), F.col("s_suppkey").alias("p")), t.part.where(k % 5 != 0).select(k.alias("x"), F.floor(k / 3).alias("y")))


@query("WITH s AS (SELECT c_custkey AS id, c_acctbal / 100 AS n FROM customer) SELECT a.m AS measure, count(*) AS n FROM s, (SELECT unnest(['low', 'high']) AS m) a WHERE (a.m = 'low' AND n < 20) OR (a.m = 'high' AND n >= 20) GROUP BY ALL")
def tier_counts(t):
    return t.customer.select(F.when(F.col("c_acctbal") / 100 < 20, "low").otherwise("high").alias("measure")).groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
