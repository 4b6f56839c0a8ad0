"""Queries of the segmentation, join, rule, set and log operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..lineage import cut
from ..operators import joins as J
from ..operators import log as L
from ..operators import rules as R
from ..operators import segment as G
from ..operators import sets as D
from ..operators.components import components
from ..sources import loaders as O
from .base import Tables, query

LINES = "WITH l AS (SELECT doc_id AS id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


@query(LINES + " SELECT id, line_no::INT AS line_no, line FROM l")
def document_lines(t):
    return G.lines(t.documents)


@query(LINES + ", m AS (SELECT *, regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+') AS item, trim(line) = '' AS blank FROM l), p AS (SELECT *, coalesce(lag(blank) OVER w, true) OR item AS s FROM m WINDOW w AS (PARTITION BY id ORDER BY line_no)), b AS (SELECT *, sum((s AND NOT blank)::INT) OVER (PARTITION BY id ORDER BY line_no) AS block FROM p) SELECT id, block::BIGINT AS block, CASE WHEN arg_min(item, line_no) THEN 'list_item' ELSE 'paragraph' END AS kind, min(line_no)::INT AS start, string_agg(line, chr(10) ORDER BY line_no) AS text FROM b WHERE NOT blank GROUP BY id, block")
def document_blocks(t):
    return G.blocks(G.marked_lines(G.lines(t.documents)))


def _blocks(t: Tables):
    return G.blocks(G.marked_lines(G.lines(t.documents)))


@query("SELECT id, 'c' || lpad(block::VARCHAR, 4, '0') AS clause, kind, start, text AS quote FROM (" + LINES + ", m AS (SELECT *, regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+') AS item, trim(line) = '' AS blank FROM l), p AS (SELECT *, coalesce(lag(blank) OVER w, true) OR item AS s FROM m WINDOW w AS (PARTITION BY id ORDER BY line_no)), b AS (SELECT *, sum((s AND NOT blank)::INT) OVER (PARTITION BY id ORDER BY line_no) AS block FROM p) SELECT id, block::BIGINT AS block, CASE WHEN arg_min(item, line_no) THEN 'list_item' ELSE 'paragraph' END AS kind, min(line_no)::INT AS start, string_agg(line, chr(10) ORDER BY line_no) AS text FROM b WHERE NOT blank GROUP BY id, block)")
def clause_table(t):
    return G.clauses(_blocks(t))


@query("SELECT sum(length(text))::BIGINT AS chars, true AS whole FROM documents")
def character_accounting(t):
    rows = G.marked_lines(G.lines(t.documents))
    a = G.accounting(t.documents, G.blocks(rows), rows)
    total = t.documents.agg(F.sum(F.length("text")).alias("n"))
    return a.agg(F.sum("chars").alias("chars")).crossJoin(total).select("chars", (F.col("chars") == F.col("n")).alias("whole"))


@query("SELECT * FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS marker FROM documents)")
def inline_markers(t):
    return G.markers(t.documents, r"[0-9]{4,}").select("id", "marker")


@query("SELECT item_id AS id, 'q' || item_id AS name, 'not verbatim' AS fault FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id AND contains(d.text, b.text))")
def span_verification(t):
    spans = t.benchmark.select(F.col("item_id").alias("id"), F.concat(F.lit("q"), "item_id").alias("name"), F.col("text").alias("quote"))
    return G.span_faults(spans, t.documents)


@query("WITH d AS (SELECT DISTINCT o_custkey AS key, o_orderkey AS n FROM orders), i AS (SELECT key, n, n - row_number() OVER (PARTITION BY key ORDER BY n) AS g FROM d) SELECT key, min(n) AS lo, max(n) AS hi FROM i GROUP BY key, g")
def integer_runs(t):
    return G.runs_of(t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("n")), "key", "n")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations")
def preceding_turn(t):
    return G.preceding(t.conversations.withColumn("own", F.col("role")), "role", "conv_id", "own", "turn").select("conv_id", "turn", "role", "before")


@query("SELECT a.conv_id, a.turn, count(b.turn) AS near FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND b.turn <> a.turn AND abs(a.turn - b.turn) <= 2 GROUP BY ALL")
def neighbour_window(t):
    return G.neighbours(t.conversations, 2, "conv_id", "turn", "role").select("conv_id", "turn", F.size("near").cast("bigint").alias("near"))


# --- scalar functions over texts ------------------------------------------------------------------

def joined_sql(text: str = "text", part: int = 1) -> str:
    """join_text() in SQL."""
    bare = f"regexp_replace(coalesce({text}, ''), '\\[\\^[a-z0-9]+\\]', '', 'g')"
    plain = f"regexp_replace(regexp_replace({bare}, '\\[([^\\]]*)\\]\\(([^)]*)\\)', '\\{part}', 'g'), '\\*\\*|\\*|`', '', 'g')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


LINKED = "CASE item_id % 4 WHEN 0 THEN 'See [^a1] **the** [' || text || '](#s' || item_id || ') and [b](c)' WHEN 1 THEN replace(text, ' ', '  *') ELSE text END"


def _linked(t: Tables):
    """Benchmark items, some with links, footnote marks and emphasis."""
    i, x = F.col("item_id"), F.col("text")
    return t.benchmark.select(i, F.when(i % 4 == 0, F.concat(F.lit("See [^a1] **the** ["), x, F.lit("](#s"), i.cast("string"), F.lit(") and [b](c)"))).when(i % 4 == 1, F.replace(x, F.lit(" "), F.lit("  *"))).otherwise(x).alias("text"))


@query(f"WITH l AS (SELECT item_id, {LINKED} AS text FROM benchmark) SELECT item_id, {joined_sql()} AS norm FROM l")
def join_normaliser(t):
    return _linked(t).select("item_id", X.join_text(F.col("text")).alias("norm"))


@query(f"WITH l AS (SELECT item_id, {LINKED} AS text FROM benchmark), v AS (SELECT item_id, {joined_sql()} AS norm FROM l UNION SELECT item_id, {joined_sql(part=2)} FROM l) SELECT item_id, norm FROM v")
def link_renderings(t):
    return _linked(t).select("item_id", F.explode(X.link_variants(F.col("text"))).alias("norm"))


@query(f"WITH l AS (SELECT item_id, {LINKED} AS text FROM benchmark), m AS (SELECT item_id, unnest(CASE WHEN item_id % 4 = 0 THEN [text, 'See **the** ' || split_part(split_part(text, '**the** [', 2), '](#s', 1) || ' and c', 'See **the** #s' || item_id || ' and b', 'See **the** #s' || item_id || ' and c'] ELSE [text] END) AS text FROM l) SELECT DISTINCT item_id, {joined_sql()} AS norm FROM m")
def mixed_link_renderings(t):
    return _linked(t).select("item_id", F.explode(X.mixed_link_variants(F.col("text"))).alias("norm"))


def _modal(words):
    return "|".join(words)


@query(
    "WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all(t, '\\b(?:{_modal(w)})\\b')) AS {k}" for k, w in X.MODAL_TIERS.items())
    + " FROM d"
)
def modal_profiles(t):
    return t.documents.select("doc_id", X.modal_profile(F.col("text")).alias("m")).select("doc_id", "m.*")


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("WITH v AS (SELECT event_id AS id, event_type AS judge, (json_extract(props, '$.k')::INT) % 4 AS verdict FROM events) SELECT id, judge, verdict FROM v WHERE verdict < 3")
def verdict_maps(t):
    v = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("{'"), "event_type", F.lit("': "), (F.from_json("props", "k int")["k"] % 4).cast("string"), F.lit("}")).alias("verdicts"))
    return O.votes(v)


@query("SELECT o_orderkey, sha256(o_orderstatus || chr(1) || o_orderpriority) AS sha FROM orders")
def content_hashes(t):
    return t.orders.select("o_orderkey", X.content_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("sha"))


# --- containment ----------------------------------------------------------------------------------

NJOIN = f"""WITH p0 AS (SELECT doc_id AS p, {joined_sql()} AS pt, source FROM documents UNION SELECT doc_id, {joined_sql(part=2)}, source FROM documents), p AS (SELECT * FROM p0 WHERE pt <> ''),
c0 AS (SELECT item_id AS c, {joined_sql()} AS ct FROM benchmark UNION SELECT item_id, {joined_sql(part=2)} FROM benchmark), c AS (SELECT * FROM c0 WHERE ct <> ''), pr AS (SELECT DISTINCT p, c FROM p JOIN c ON contains(pt, ct))"""


def _pairs(t: Tables):
    return J.contained(t.documents.select(F.col("doc_id").alias("p"), "text"), t.benchmark.select(F.col("item_id").alias("c"), "text"))


@query(NJOIN + " SELECT p, c FROM pr")
def containment_contamination(t):
    return _pairs(t)


@query(NJOIN + f", s AS (SELECT CASE WHEN d.doc_id IN (SELECT p FROM pr) THEN 'matched' WHEN length({joined_sql()}) < 14 THEN 'degenerate_quote_refused' WHEN doc_id % 10 = 3 THEN 'example_block' WHEN source IS NULL THEN 'unknown' WHEN lang = 'en' THEN 'verbatim_but_unsegmented' ELSE 'not_verbatim_in_source' END AS stratum FROM documents d) SELECT stratum, count(*) AS n FROM s GROUP BY stratum")
def containment_accounting(t):
    u = t.documents.select(F.col("doc_id").alias("p"), "text", "source", "lang")
    why = J.unmatched_stratum(F.length(X.join_text(F.col("text"))) < 14, F.col("p") % 10 == 3, F.col("source").isNotNull(), F.col("lang") == "en")
    return J.join_accounting(u, _pairs(t), why)


@query(NJOIN + " SELECT DISTINCT p FROM pr WHERE c % 2 = 0")
def lift_semi_join(t):
    return J.lifted(_pairs(t), t.benchmark.where("item_id % 2 = 0").select(F.col("item_id").alias("c")))


@query(NJOIN + ", b AS (SELECT p, max(c / 10.0) AS s FROM pr GROUP BY p) SELECT d.doc_id AS p, coalesce(s, 0) AS score FROM documents d LEFT JOIN b ON b.p = d.doc_id")
def passage_scores(t):
    scores = t.benchmark.select(F.col("item_id").alias("c"), (F.col("item_id") / 10.0).alias("score"))
    return J.lifted_scores(t.documents.select(F.col("doc_id").alias("p")), _pairs(t), scores)


GUARD = f"""WITH p0 AS (SELECT doc_id AS p, {joined_sql()} AS pt, source AS pa FROM documents UNION ALL SELECT item_id + 10000000, left({joined_sql()}, 20 + item_id % 30), 'src' || item_id % 20 FROM benchmark), p AS (SELECT * FROM p0 WHERE length(pt) >= 14),
c AS (SELECT item_id AS c, {joined_sql()} AS ct, 'src' || item_id % 20 AS ca FROM benchmark WHERE item_id % 7 <> 0),
x AS (SELECT p, c, pa, ca, NOT contains(pt, ct) AS part FROM p JOIN c ON contains(pt, ct) OR contains(ct, pt)), r AS (SELECT *, pa IN (SELECT ca FROM c) AS restricted FROM x), k AS (SELECT * FROM r WHERE NOT restricted OR pa = ca),
g AS (SELECT p, count(*) AS m, bool_and(part) AS part FROM k GROUP BY p)"""


@query(GUARD + " SELECT k.p, k.c, k.restricted FROM k JOIN g USING (p) WHERE NOT (m > 1 AND g.part)")
def containment_guarded(t):
    """Whole documents and parts of benchmark items as passages; every seventh item is a heading in disguise."""
    i = F.col("item_id")
    some = t.benchmark.select((i + 10_000_000).alias("p"), F.substring(X.join_text(F.col("text")), F.lit(1), (i % 30 + 20).cast("int")).alias("text"), F.concat(F.lit("src"), i % 20).alias("anchor"))
    p = t.documents.select(F.col("doc_id").alias("p"), "text", F.col("source").alias("anchor")).union(some)
    c = t.benchmark.select(i.alias("c"), F.when(i % 7 == 0, F.lit("**In short**")).otherwise(F.col("text")).alias("text"), F.concat(F.lit("src"), i % 20).alias("anchor"), F.when(i % 7 == 0, "meta").alias("kind"))
    return J.guarded_containment(p, c)


# --- intervals, alignment, edges ------------------------------------------------------------------


@query("SELECT a.o_orderkey AS ida, b.o_orderkey AS idb FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderkey < b.o_orderkey + 500 AND b.o_orderkey < a.o_orderkey + 500")
def interval_overlaps(t):
    i = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 500).alias("hi"))
    return J.interval_overlaps(i, i, 1000).where("ida < idb")


ALIGN = "WITH a AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS line FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS line FROM lineitem WHERE l_linenumber % 2 = 0), sa AS (SELECT node AS na, count(*) AS ca FROM a GROUP BY ALL), sb AS (SELECT node AS nb, count(*) AS cb FROM b GROUP BY ALL), k AS (SELECT a.node AS na, b.node AS nb, count(*) AS k FROM a JOIN b USING (line) GROUP BY ALL), j AS (SELECT na, nb, k / (ca + cb - k) AS jaccard FROM k JOIN sa USING (na) JOIN sb USING (nb))"


def _aligned(t: Tables):
    x = lambda odd: t.lineitem.where(f"l_linenumber % 2 = {odd}").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("line"))
    return J.line_alignment(x(1), x(0), 0.5)


@query(ALIGN + " SELECT na, nb, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.5")
def line_set_alignment(t):
    return _aligned(t).withColumn("jaccard", F.round("jaccard", 6))


@query()
def alignment_matching(t):
    """A maximum matching inside each connected group of aligned nodes."""
    pairs = cut(_aligned(t).select(F.col("na").alias("a"), F.col("nb").alias("b")))
    group = components(pairs.select((F.col("a") * 2).alias("u"), (F.col("b") * 2 + 1).alias("v"))).select((F.col("node") / 2).cast("bigint").alias("a"), F.col("root").alias("g"), (F.col("node") % 2).alias("side"))
    return J.maximum_matching(pairs.join(group.where("side = 0").select("a", "g"), "a").select("g", "a", "b"), "g")


NEEDS = "WITH nd AS (SELECT DISTINCT o_custkey AS node, (o_orderkey * 7) % 900 AS name FROM orders), pv AS (SELECT p_partkey AS node, p_partkey % 600 AS name FROM part)"


def _needs(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("node"), ((F.col("o_orderkey") * 7) % 900).alias("name")).distinct(), t.part.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 600).alias("name"))


@query(NEEDS + " SELECT DISTINCT name, nd.node AS needer, pv.node AS provider FROM nd JOIN pv USING (name)")
def graph_edges(t):
    return J.edges(*_needs(t))


@query(NEEDS + " SELECT name, count(DISTINCT node) AS needed_by FROM nd WHERE name NOT IN (SELECT name FROM pv) GROUP BY name")
def dangling_edges(t):
    return J.dangling(*_needs(t))


@query(NEEDS + " SELECT DISTINCT node, name FROM nd JOIN pv USING (node, name)")
def graph_self_loops(t):
    return R.self_loops(*_needs(t))


@query(NEEDS + ", en AS (SELECT DISTINCT o_custkey AS node FROM orders WHERE o_custkey % 4 = 0), r AS (SELECT name FROM pv GROUP BY name HAVING count(DISTINCT node) <= 4), j AS (SELECT pv.node, nd.node AS needer, name FROM nd JOIN en USING (node) JOIN pv USING (name) JOIN r USING (name)) SELECT node, count(DISTINCT needer) AS consumers, count(DISTINCT name) AS names FROM j WHERE node NOT IN (SELECT node FROM en) GROUP BY node HAVING count(DISTINCT needer) >= 2 OR count(DISTINCT name) >= 2")
def input_dependency_channel(t):
    n, p = _needs(t)
    return J.input_providers(n, p, t.orders.where("o_custkey % 4 = 0").select(F.col("o_custkey").alias("node")).distinct(), 4)


EDGE = "WITH e AS (SELECT o_orderkey AS id, o_orderkey % 400 AS nlo, o_orderkey % 400 + 3 AS nhi, (o_orderkey * 13) % 400 AS plo, (o_orderkey * 13) % 400 + 3 AS phi, o_orderstatus AS s FROM orders)"


def _edge_rows(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("id"), (k % 400).alias("nlo"), (k % 400 + 3).alias("nhi"), ((k * 13) % 400).alias("plo"), ((k * 13) % 400 + 3).alias("phi"), F.col("o_orderstatus").alias("s"))


@query(EDGE + " SELECT id FROM e WHERE s = 'F' AND EXISTS (SELECT 1 FROM e f WHERE f.s = 'O' AND e.nlo <= f.nhi AND f.nlo <= e.nhi AND e.plo <= f.phi AND f.plo <= e.phi)")
def edge_overlap_match(t):
    e = _edge_rows(t)
    return J.edge_overlap(e.where("s = 'F'"), e.where("s = 'O'")).select("id")


# --- rules ----------------------------------------------------------------------------------------

NORMS = """WITH n AS (SELECT p_partkey AS norm, p_partkey // 8 AS act, CASE WHEN p_size % 2 = 0 THEN 'oblige' ELSE 'forbid' END AS modality, p_size % 3 AS tier FROM part),
c AS (SELECT norm, unnest(list_distinct(['x' || norm % 5, 'y' || norm % 7])) AS atom FROM n), x AS (SELECT 'x' || i AS a, 'x' || (i + 1) AS b FROM range(0, 3) t(i)),
d AS (SELECT norm, 'd' AS defeater, 'y' || (norm + 1) % 7 AS atom FROM n WHERE norm % 3 = 0), u AS (SELECT norm, list_sort(list(atom)) AS cond FROM c GROUP BY norm)"""
CONFLICT = NORMS + """, pr AS (SELECT a.norm AS n1, b.norm AS n2, least(a.tier, b.tier) AS tier, a.tier <> b.tier AS resolved, list_sort(list_distinct(list_concat(ua.cond, ub.cond))) AS w FROM n a JOIN n b ON a.act = b.act AND a.modality = 'oblige' AND b.modality = 'forbid' JOIN u ua ON ua.norm = a.norm JOIN u ub ON ub.norm = b.norm),
ok AS (SELECT * FROM pr WHERE NOT EXISTS (SELECT 1 FROM x WHERE list_contains(w, a) AND list_contains(w, b)) AND NOT EXISTS (SELECT 1 FROM d WHERE d.norm IN (n1, n2) AND list_contains(w, atom)))"""


def _conflicts(t: Tables):
    s = t.spark
    n = t.part.select(F.col("p_partkey").alias("norm"), F.floor(F.col("p_partkey") / 8).alias("act"), F.when(F.col("p_size") % 2 == 0, "oblige").otherwise("forbid").alias("modality"), (F.col("p_size") % 3).alias("tier"))
    c = n.select("norm", F.explode(F.array(F.concat(F.lit("x"), F.col("norm") % 5), F.concat(F.lit("y"), F.col("norm") % 7))).alias("atom"))
    d = n.where("norm % 3 = 0").select("norm", F.lit("d").alias("defeater"), F.concat(F.lit("y"), (F.col("norm") + 1) % 7).alias("atom"))
    x = s.createDataFrame([(f"x{i}", f"x{i + 1}") for i in range(3)], "a string, b string")
    return R.conflicts(n, c, d, x, s.createDataFrame([], "a bigint, b bigint"))


@query(CONFLICT + " SELECT n1, n2, array_to_string(w, ',') AS witness, tier, resolved FROM ok")
def conflict_pairs_literal(t):
    return _conflicts(t).select("n1", "n2", F.array_join("witness", ",").alias("witness"), "tier", "resolved")


@query(CONFLICT + " SELECT n1, n2, 'When ' || array_to_string(w, ' and ') || ', ' || n1 || ' and ' || n2 || ' cannot both be met.' AS prose FROM ok")
def conflict_prose(t):
    return _conflicts(t).select("n1", "n2", R.witness_prose(F.col("n1").cast("string"), F.col("n2").cast("string"), F.col("witness")).alias("prose"))


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey <> n_regionkey), r AS (SELECT a, b, 1 AS hops FROM e UNION SELECT r.a, e.b, hops + 1 FROM r JOIN e ON r.b = e.a WHERE hops < 8) SELECT a, b, min(hops)::INT AS hops FROM r GROUP BY ALL")
def closure_region_nation(t):
    return R.reachable(t.nation.where("n_nationkey <> n_regionkey").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")), 8)


KERN = "WITH a AS (SELECT DISTINCT o_custkey % 60 AS p, CASE o_orderstatus WHEN 'F' THEN 'forbid' WHEN 'O' THEN 'oblige' ELSE 'permit' END AS d, o_orderkey % 12 AS act FROM orders WHERE o_orderkey < 300)"


def _kernel(t: Tables):
    d = F.when(F.col("o_orderstatus") == "F", "forbid").when(F.col("o_orderstatus") == "O", "oblige").otherwise("permit")
    a = t.orders.select((F.col("o_custkey") % 60).alias("p"), d.alias("d"), (F.col("o_orderkey") % 12).alias("act")).distinct()
    b = a.select(F.col("p").alias("x")).distinct().join(a.select(F.col("p").alias("y")).distinct(), F.expr("x < y and (x + y) % 3 = 0"))
    return a, b


@query()
def deontic_statuses(t):
    return R.standing(*_kernel(t))


@query("WITH s AS (SELECT DISTINCT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), e AS (SELECT * FROM s WHERE b IS NOT NULL) SELECT a, b FROM e")
def transition_table(t):
    """What follows what for one user."""
    return t.events.select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b")).where("b is not null").distinct()


@query("WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part), e AS (SELECT y.name AS child, x.name AS parent FROM n x JOIN n y ON contains(y.name, '_') AND regexp_replace(y.name, '^[^_]+_', '') = x.name WHERE split_part(y.name, '_', 1) NOT IN ('red')) SELECT child, parent FROM e WHERE parent IN (SELECT parent FROM e GROUP BY parent HAVING count(DISTINCT child) >= 2)")
def containment_edges(t):
    n = t.part.select(F.translate("p_name", " ", "_").alias("name")).union(t.part.select(F.element_at(F.split("p_name", " "), 2))).distinct()
    return R.containment_edges(n, ["red"])


@query("WITH f AS (SELECT 'negative balance' AS \"check\", 'hard' AS severity, c_custkey::VARCHAR AS \"where\" FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no orders', 'review', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'huge discount', 'review', l_orderkey::VARCHAR FROM lineitem WHERE l_discount > 0.09) SELECT * FROM f")
def lint_findings(t):
    c = t.customer
    return R.findings(("negative balance", "hard", c.where("c_acctbal < 0").select("c_custkey")), ("no orders", "review", c.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")), ("huge discount", "review", t.lineitem.where("l_discount > 0.09").select("l_orderkey")))


@query("SELECT lower(regexp_replace('part ' || p_partkey || ' of ' || p_brand, '\\d+', '<n>', 'g')) AS cause, count(*) AS n FROM part GROUP BY ALL")
def finding_clusters(t):
    return t.part.select(X.message_cause(F.concat(F.lit("part "), "p_partkey", F.lit(" of "), "p_brand")).alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT i AS mask FROM range(0, 64) t(i)) SELECT mask, bit_count(mask)::INT AS n FROM m WHERE (mask & 3) <> 3 AND (mask & 12) <> 12")
def situation_enumeration(t):
    s, _ = R.situations(t.spark, list("abcdef"), [("a", "b"), ("c", "d")])
    return s.select("mask", F.size("atoms").alias("n"))


@query("WITH m AS (SELECT i AS mask, (i % 3 = 0)::INT AS derived FROM range(0, 64) t(i)), p AS (SELECT k AS atom, a.mask AS m1, b.mask AS m2 FROM m a, m b, range(0, 6) t(k) WHERE xor(a.mask, b.mask) = (1 << k) AND a.mask < b.mask AND a.derived <> b.derived) SELECT atom::INT AS atom, min({'m1': m1, 'm2': m2}).m1 AS m1, min({'m1': m1, 'm2': m2}).m2 AS m2 FROM p GROUP BY atom")
def mcdc_covering_set(t):
    return R.covering_set(t.spark.range(64).select(F.col("id").alias("mask"), (F.col("id") % 3 == 0).cast("int").alias("derived")), 6)


# --- sets, snapshots, samples ---------------------------------------------------------------------

SNAP = "WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 50 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 60 <> 0)"


@query(SNAP + " SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.s IS DISTINCT FROM b.s")
def snapshot_diff_orders(t):
    a = t.orders.where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = t.orders.where("o_orderkey % 60 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return D.diff(D.freeze(a, ["k"]), D.freeze(b, ["k"]), ["k"])


@query("WITH a AS (SELECT c_custkey AS k, c_acctbal AS s, 1000.0 AS c FROM customer), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 2 ELSE c_acctbal END AS s, 1500.0 AS c FROM customer), j AS (SELECT k, a.s AS sa, b.s AS sb, a.s > 0 AND a.s >= a.c AS pa, b.s > 0 AND b.s >= b.c AS pb FROM a JOIN b USING (k)) SELECT k, CASE WHEN pb THEN 'gained' ELSE 'lost' END AS direction, CASE WHEN sa <> sb THEN 'both' ELSE 'threshold_drift' END AS cause FROM j WHERE pa <> pb")
def prediction_flips(t):
    k, s = F.col("c_custkey"), F.col("c_acctbal")
    return D.flips(t.customer.select(k.alias("k"), s.alias("score"), F.lit(1000.0).alias("cut")), t.customer.select(k.alias("k"), F.when(k % 3 == 0, s / 2).otherwise(s).alias("score"), F.lit(1500.0).alias("cut")), ["k"])


@query("WITH o AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS name FROM lineitem WHERE l_linenumber <> 2), w AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS name FROM lineitem WHERE l_linenumber <> 1), p AS (SELECT * FROM w EXCEPT SELECT * FROM o), m AS (SELECT * FROM o EXCEPT SELECT * FROM w), x AS (SELECT id, 1 AS g, 0 AS l, (name NOT IN (SELECT name FROM o))::INT AS v FROM p UNION ALL SELECT id, 0, 1, 0 FROM m) SELECT id, sum(g)::BIGINT AS gained, sum(l)::BIGINT AS lost, sum(v)::BIGINT AS novel FROM x GROUP BY id")
def vocabulary_drift(t):
    x = lambda n: t.lineitem.where(f"l_linenumber <> {n}").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("name"))
    return D.drift(x(2), x(1))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def newest_wins_orders(t):
    return D.newest(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1")
def best_artifact(t):
    return D.least_severe(t.orders.select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey")


EQ = "WITH s AS (SELECT l_orderkey AS id, sha256(array_to_string(list_sort(list(DISTINCT '2:' || l_returnflag || l_linestatus)), ',')) AS signature FROM lineitem GROUP BY id), g AS (SELECT signature, min(id) AS first, count(*) AS n FROM s GROUP BY signature)"


def _classes(t: Tables):
    return D.equivalence(t.lineitem.select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("name")))


@query(EQ + ' SELECT signature, "first", n FROM g')
def equivalence_classes(t):
    return _classes(t)


@query(EQ + " SELECT sum(n)::BIGINT AS items, count(*) AS classes, round(count(*) / sum(n), 9) AS ceiling, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS collided FROM g")
def separability_census(t):
    return D.separability(_classes(t)).withColumn("ceiling", F.round("ceiling", 9))


@query("WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT *, 97.0 * n / sum(n) OVER () AS sh FROM s), y AS (SELECT *, floor(sh) AS b, 97 - sum(floor(sh)) OVER () AS lf FROM x) SELECT stratum, n, (b + (row_number() OVER (ORDER BY round(sh - b, 9) DESC, stratum) <= lf)::INT)::BIGINT AS k FROM y")
def largest_remainder(t):
    return D.allocate(t.customer.groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count(F.lit(1)).alias("n")), 97).select("stratum", "n", F.col("k").cast("bigint").alias("k"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, (row_number() OVER w)::INT AS draw FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY md5('17:' || c_custkey), c_custkey) QUALIFY row_number() OVER w <= 10")
def strat_sample_customers(t):
    return D.stratified(t.customer, "c_mktsegment", "c_custkey", 10)


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer) ORDER BY turn, c_mktsegment LIMIT 23")
def round_robin_sample(t):
    return D.round_robin(t.customer, "c_mktsegment", "c_custkey", 23).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 25)::BIGINT AS batch FROM customer")
def batch_plan(t):
    return D.batches(t.customer, "c_mktsegment", "c_custkey", 25).select("c_custkey", "c_mktsegment", "batch")


@query("SELECT c_custkey, ('0x' || left(sha256('s1:' || c_mktsegment || ':' || c_custkey), 8))::BIGINT / 4294967295.0 < 0.3 AS keep FROM customer")
def graveyard_gate(t):
    return D.kept_by_gate(t.customer.withColumn("rate", F.lit(0.3)), "s1", "c_mktsegment", "c_custkey", "rate").select("c_custkey", "keep")


@query("WITH a AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0), b AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 5 = 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'unused' WHEN b.id IS NULL THEN 'open' ELSE 'honoured' END AS status FROM a FULL JOIN b USING (id)")
def waiver_status(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"))
    return D.waivers(s.where("id % 3 = 0"), s.where("id % 5 = 0"), ["id"])


@query("WITH a AS (SELECT c_custkey AS id, c_mktsegment AS c, c_nationkey AS p FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Z' ELSE c_mktsegment END AS c, CASE WHEN c_custkey % 4 = 0 THEN 99 ELSE c_nationkey END AS p FROM customer WHERE c_custkey % 13 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN b.id IS NULL THEN 'orphan' WHEN a.c <> b.c THEN 'stale_contract' WHEN a.p <> b.p THEN 'stale_provenance' ELSE 'current' END AS state FROM a FULL JOIN b USING (id)")
def artifact_versions(t):
    k = F.col("c_custkey")
    a = t.customer.where(k % 11 != 0).select(k.alias("id"), F.col("c_mktsegment").alias("c"), F.col("c_nationkey").alias("p"))
    b = t.customer.where(k % 13 != 0).select(k.alias("id"), F.when(k % 5 == 0, "Z").otherwise(F.col("c_mktsegment")).alias("c"), F.when(k % 4 == 0, 99).otherwise(F.col("c_nationkey")).alias("p"))
    return D.versions(a, b, "id", ["c"], ["p"])


# --- logs -----------------------------------------------------------------------------------------

LOG = "WITH l AS (SELECT user_id AS behaviour, (json_extract(props, '$.k')::INT) % 5 AS locator, event_type AS judge, event_id % 3 AS verdict, event_id AS ts FROM events), v AS (SELECT behaviour, locator, judge, arg_max(verdict, ts) AS verdict FROM l GROUP BY ALL)"


def _log(t: Tables):
    return t.events.select(F.col("user_id").alias("behaviour"), (F.from_json("props", "k int")["k"] % 5).alias("locator"), F.col("event_type").alias("judge"), (F.col("event_id") % 3).alias("verdict"), F.col("event_id").alias("at"))


@query(LOG + " SELECT behaviour, locator, count(*) FILTER (verdict >= 1) AS votes, sum(verdict)::BIGINT AS score FROM v GROUP BY ALL HAVING sum(verdict) >= 1 AND count(*) FILTER (verdict >= 1) >= 2")
def published_citations(t):
    return L.published(_log(t)).select("behaviour", "locator", "votes", "score")


@query(LOG + ", b AS (SELECT DISTINCT behaviour FROM l), j AS (SELECT DISTINCT judge FROM l), o AS (SELECT DISTINCT locator FROM l), d AS (SELECT DISTINCT behaviour, locator, judge FROM l) SELECT behaviour, locator, judge FROM b, o, j WHERE (behaviour, locator, judge) NOT IN (SELECT (behaviour, locator, judge) FROM d)")
def rollout_plan(t):
    l = _log(t)  # noqa: E741
    keys = ["behaviour", "locator", "judge"]
    return L.plan([l.select(k).distinct() for k in keys], L.done_keys(l, keys), keys)


@query("WITH c AS (SELECT event_type AS model, event_id % 100 AS p, event_id % 10 AS c, event_id % 50 AS o FROM events), x AS (SELECT model, p + o AS t, ((p - c) * 2.0 + c * 0.5 + o * 8.0) / 1e6 AS cost FROM c) SELECT model, count(*) AS calls, sum(t)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM x GROUP BY ROLLUP (model)")
def spend_rollup(t):
    e = F.col("event_id")
    calls = t.events.select(F.col("event_type").alias("model"), (e % 100).alias("prompt"), (e % 10).alias("cached"), F.lit(0).alias("written"), (e % 50).alias("completion"))
    rates = t.events.select(F.col("event_type").alias("model")).distinct().select("model", F.lit(2.0).alias("input"), F.lit(0.5).alias("cached"), F.lit(None).cast("double").alias("write"), F.lit(8.0).alias("output"))
    return L.spend(calls, rates).select("model", "calls", "tokens", F.round("cost", 6).alias("cost"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'unlogged' WHEN a.k IS NULL THEN 'no_artifact' ELSE 'logged' END AS status FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0) b USING (k)")
def usage_audit(t):
    s = t.supplier.select(F.col("s_suppkey").alias("k"))
    return L.audit(s.where("k % 2 = 0"), s.where("k % 3 = 0"), "k")


@query()
def rename_replay(t):
    return L.final_names(t.orders.select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 30).alias("old"), ((F.col("o_custkey") * 7 + 1) % 30).alias("new")))


@query("WITH RECURSIVE p AS (SELECT DISTINCT c_nationkey + 1000 AS parent, c_custkey + 100000 AS child FROM customer UNION SELECT n_regionkey, n_nationkey + 1000 FROM nation), d AS (SELECT child AS id, 0 AS wave FROM p WHERE child NOT IN (SELECT parent FROM p)), w1 AS (SELECT parent AS id, 1 AS wave FROM p GROUP BY parent HAVING bool_and(child IN (SELECT id FROM d))), w2 AS (SELECT parent AS id, 2 AS wave FROM p GROUP BY parent HAVING bool_and(child IN (SELECT id FROM d UNION ALL SELECT id FROM w1)) AND NOT bool_and(child IN (SELECT id FROM d))) SELECT DISTINCT id, wave FROM (SELECT * FROM d UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)")
def scheduler_waves(t):
    p = t.customer.select((F.col("c_nationkey") + 1000).alias("parent"), (F.col("c_custkey") + 100000).alias("child")).union(t.nation.select(F.col("n_regionkey").cast("bigint"), (F.col("n_nationkey") + 1000).cast("bigint")))
    return L.frontier_order(p)
