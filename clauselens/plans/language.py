"""Queries of the text functions: grammar, notation, names, sentences, locators, loaders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import grammar as N
from ..functions import text as X
from ..lineage import cut, discard, shared_dir
from ..operators import relations as R
from ..operators import segment as G
from ..sources import loaders as O
from .base import DOC_TOK, Tables, query

#: Sentences that stand for clauses: part number p has sentence p % 24, with its own name in it.
SENTENCES = [
    "The model must always tell the user about {}.", "The {} must not be shared.", "Operators mustn't ever hide a {}.", "It should generally avoid {}, unless the user asks.",
    "You shouldn't use {} however.", "The assistant may offer {} but never to third parties.", "It may not offer {}.", "It can't show {}.",
    "Users could see {}; this is fine.", "Sharing {} is prohibited except by the developer.", "They are required to log {} even when tired.", "Anyone is allowed to see {}.",
    "Refrain from {} otherwise.", "The Model Spec defines {}.", "A platform has to list {} provided that systems agree.", "It shall by default not name {}.",
    "Must simply never mention {} apart from tests.", "Free to choose {}, in which case stop.", "{} cannot be moved notwithstanding Root.", "It is the model's duty to keep {}.",
    "Nothing here about {}.", "Should it not rain, {} stays.", "must respect the user, not the operator, about {}", "Muster the {}; maybe it mayor may. Nonetheless.",
]
SAID = "list_extract([" + ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES) + f"], (p_partkey % {len(SENTENCES)})::INT + 1)"
CLAUSES = f"WITH c AS (SELECT p_partkey AS id, replace({SAID}, '{{}}', p_name) AS text, p_type AS section, p_brand FROM part)"


def _clauses(t: Tables):
    said = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("p_partkey") % len(SENTENCES)).cast("int") + 1)
    return t.part.select(F.col("p_partkey").alias("id"), F.replace(said, F.lit("{}"), F.col("p_name")).alias("text"), F.col("p_type").alias("section"), "p_brand")


# --- grammar --------------------------------------------------------------------------------------


def _when(cases: list[tuple[str, str]]) -> str:
    """A list of the names whose condition holds, in order, joined by commas."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases) + "], lambda x: x IS NOT NULL), ',')"


PLAIN = CLAUSES + ", n AS (SELECT id, section, regexp_replace(translate(lower(text), '‘’', ''''''), 'n''t\\b', ' not', 'g') AS t FROM c), w AS (SELECT *, ' ' || regexp_replace(t, '[^a-z]+', '  ', 'g') || ' ' AS w FROM n)"


def _force_sql(force: str) -> str:
    """Words stand between spaces of their own in w, so modals and their negated runs can be counted."""
    reach = f"(?: (?:{'|'.join(N.SCOPE_WORDS)}) ){{0,2}} (?:{'|'.join(N.NEGATORS)}) "
    parts = [f"regexp_matches(t, '{p}')" for p, f in ((p.replace("'", "''"), f) for p, f in N.FORCE_PHRASES) if f == force]
    for modal, (as_is, negated) in N.MODALS.items():
        all_, no = f"len(regexp_extract_all(w, ' {modal} '))", f"len(regexp_extract_all(w, ' {modal} {reach}'))"
        if as_is == force:
            parts.append(f"{all_} > {no}")
        if negated == force:
            parts.append(f"{no} > 0")
    return " OR ".join(parts)


FORCES_SQL = _when([(f, _force_sql(f)) for f in N.FORCES])
CUES_SQL = _when([(c, f"regexp_matches(t, '{p}')") for c, p in N.DEFEATERS.items()])
PARTIES_SQL = _when([(c, f"regexp_matches(regexp_replace(t, '{N.NOT_A_PARTY}', ' ', 'g'), '{p}')") for c, p in N.PARTIES.items()])


@query(PLAIN + f" SELECT id, {FORCES_SQL} AS forces FROM w")
def deontic_forces(t):
    return _clauses(t).select("id", F.array_join(N.forces(F.col("text")), ",").alias("forces"))


@query(PLAIN + f" SELECT id, {CUES_SQL} AS cues FROM w")
def defeater_cues(t):
    return _clauses(t).select("id", F.array_join(N.defeaters(F.col("text")), ",").alias("cues"))


@query(PLAIN + f" SELECT id, {PARTIES_SQL} AS parties FROM w")
def principal_mentions(t):
    return _clauses(t).select("id", F.array_join(N.principals(F.col("text")), ",").alias("parties"))


CLASSED = PLAIN + f", f AS (SELECT id, section, {FORCES_SQL} <> '' AS f, {CUES_SQL} <> '' AS d, contains({PARTIES_SQL}, ',') AS p FROM w), k AS (SELECT id, section, CASE WHEN f OR d OR p THEN {_when([('DEONTIC', 'f'), ('DEFEATED', 'd'), ('PARTIED', 'p')])} ELSE 'CONTROL' END AS categories, CASE WHEN d THEN 'DEFEATED' WHEN f THEN 'DEONTIC' WHEN p THEN 'PARTIED' ELSE 'CONTROL' END AS stratum FROM f)"


@query(CLASSED + " SELECT id, categories, stratum FROM k")
def clause_classes(t):
    c = _clauses(t).select("id", N.classify(F.col("text"))["categories"].alias("c"))
    return c.select("id", F.array_join("c", ",").alias("categories"), N.stratum(F.col("c")).alias("stratum"))


@query(CLASSED + ", x AS (SELECT section, unnest(string_split(categories, ',')) AS category FROM k) SELECT section, category, count(*) AS n FROM x GROUP BY ALL")
def category_crosstab(t):
    c = _clauses(t).select("section", F.explode(N.classify(F.col("text"))["categories"]).alias("category"))
    return c.groupBy("section", "category").agg(F.count(F.lit(1)).alias("n"))


# --- notation -------------------------------------------------------------------------------------

PREFIX, CHAIN = ["", "must_", "mustnot_", "should_", "shouldnot_", "may_", "not_"], ["", "__user", "__model_user", "__third_party_operator", "__platform", "__", "__user__model", "__developer_root_"]
_at = lambda items, by: "list_extract([" + ", ".join(f"'{x}'" for x in items) + f"], ({by} % {len(items)})::INT + 1)"
NAMES = f"WITH n AS (SELECT p_partkey, {_at(PREFIX, 'p_partkey')} AS pre, {_at(CHAIN, 'p_size')} AS post, CASE WHEN p_partkey % 50 = 0 AND p_partkey % 7 <> 6 THEN '' ELSE replace(p_name, ' ', '_') END AS stem FROM part), m AS (SELECT *, pre || stem || post AS name FROM n)"
#: What the parts of a name should come to, from how it was built.
PARSED = (
    NAMES
    + ", q AS (SELECT *, pre || stem || post = '' OR (stem = '' AND pre <> 'not_') OR post IN ('__platform', '__', '__user__model') AS bad FROM m) SELECT p_partkey, CASE WHEN bad OR pre IN ('', 'not_') THEN NULL ELSE left(pre, length(pre) - 1) END AS polarity, "
    "CASE WHEN bad THEN name WHEN pre = 'not_' THEN 'not_' || stem ELSE stem END AS stem, CASE WHEN bad THEN '' WHEN post = '__third_party_operator' THEN 'third_party,operator' ELSE replace(trim(post, '_'), '_', ',') END AS principals, bad AS failed, CASE WHEN bad THEN name ELSE rtrim(name, '_') END AS back, split_part(name, '__', 1) AS bare FROM q"
)


def _names(t: Tables):
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (F.col(by) % len(items)).cast("int") + 1)
    stem = F.when((F.col("p_partkey") % 50 == 0) & (F.col("p_partkey") % 7 != 6), "").otherwise(F.translate("p_name", " ", "_"))
    return t.part.select("p_partkey", F.concat(pick(PREFIX, "p_partkey"), stem, pick(CHAIN, "p_size")).alias("name"))


@query(PARSED.replace("rtrim(name, '_')", "CASE WHEN post = '__developer_root_' THEN rtrim(name, '_') ELSE name END"))
def notation_round_trip(t):
    n = _names(t).withColumn("p", N.parse_name(F.col("name")))
    back = F.when(F.col("p.error").isNotNull(), F.col("name")).otherwise(N.format_name(F.col("p")))
    return n.select("p_partkey", "p.polarity", "p.stem", F.array_join("p.principals", ",").alias("principals"), F.col("p.error").isNotNull().alias("failed"), back.alias("back"), N.dechained(F.col("name")).alias("bare"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'third_party' WHEN 2 THEN 'root' END AS principal FROM customer")
def principal_of_name(t):
    k = F.col("c_custkey") % 4
    return t.customer.select("c_custkey", N.principal_named(F.when(k == 0, "user").when(k == 1, "warn_third_party").when(k == 2, "obey_root").otherwise("superuser_x")).alias("principal"))


@query("SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) IN ('building') THEN 'condition' END AS role FROM customer")
def declared_roles(t):
    return t.customer.select("c_custkey", N.role(F.when(F.col("c_mktsegment") == "BUILDING", " Condition ").otherwise(F.col("c_mktsegment"))).alias("role"))


# --- names ----------------------------------------------------------------------------------------

TITLES = "WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 6 WHEN 0 THEN '_queries' WHEN 1 THEN '_of_users' WHEN 2 THEN '_user_over_operator' WHEN 3 THEN '_the_boss' WHEN 4 THEN '_refused' ELSE '' END AS name FROM part)"


def _titles(t: Tables):
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, "_queries").when(k == 1, "_of_users").when(k == 2, "_user_over_operator").when(k == 3, "_the_boss").when(k == 4, "_refused").otherwise("")
    return t.part.select("p_partkey", F.concat(F.translate("p_name", " ", "_"), tail).alias("name"))


SYN = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in X.SYNONYMS.items()) + "}"
KEYED = (
    TITLES
    + f", w AS (SELECT p_partkey, name, unnest(string_split(name, '_')) AS w, unnest(range(len(string_split(name, '_')))) AS i FROM n), s AS (SELECT *, CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS one FROM w), "
    f"f AS (SELECT p_partkey, name, i, coalesce({SYN}[w], {SYN}[one], one) AS w FROM s), g AS (SELECT * FROM f WHERE w NOT IN ({', '.join(repr(w) for w in X.KEY_STOPWORDS)})), "
    f"k AS (SELECT p_partkey, string_agg(DISTINCT w, ' ' ORDER BY w) AS key, string_agg(w, '>' ORDER BY i) FILTER (w IN ({', '.join(repr(w) for w in X.ORDERED_PARTIES)})) AS parties FROM g GROUP BY ALL)"
)


@query(KEYED + " SELECT p_partkey, key || CASE WHEN contains(coalesce(parties, ''), '>') THEN ' | ' || parties ELSE '' END AS key FROM k")
def vocabulary_keys(t):
    return _titles(t).select("p_partkey", X.vocab_key(F.col("name")).alias("key"))


VOCAB = """WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS base FROM part), v AS (SELECT base AS name, 'act' AS kind, 'to use a ' || replace(base, '_', ' ') AS gloss, length(base) AS n FROM n UNION ALL SELECT 'avoid_' || base, 'act', 'keeping away from it', 3 FROM n
UNION ALL SELECT 'safe_' || base, 'act', 'a ' || replace(base, '_', ' ') || ' that is safe to keep', 5 FROM n UNION ALL SELECT 'harm_' || base, 'act', NULL, 2 FROM n UNION ALL SELECT base || 's', 'situation', 'more than one', 4 FROM n)"""
WORDED = (
    VOCAB
    + f", w AS (SELECT name, kind, n, list_sort(list_distinct(list_filter(list_transform(string_split(name, '_'), lambda x: coalesce({SYN}[x], {SYN}[CASE WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END], CASE WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END)), lambda x: x NOT IN ({', '.join(repr(w) for w in X.KEY_STOPWORDS)})))) AS ws FROM v)"
)
NEG = "[" + ", ".join(f"'{w}'" for w in R.NEGATION_WORDS) + "]"
OPP = "[" + ", ".join(f"'{a}|{b}', '{b}|{a}'" for a, b in R.ANTONYMS) + "]"


def _vocabulary(t: Tables):
    n = t.part.select(F.translate("p_name", " ", "_").alias("base")).distinct()
    say = F.translate("base", "_", " ")
    row = lambda name, kind, gloss, k: F.struct(name.alias("name"), F.lit(kind).alias("kind"), gloss.alias("gloss"), k.cast("int").alias("n"))
    rows = [
        row(F.col("base"), "act", F.concat(F.lit("to use a "), say), F.length("base")), row(F.concat(F.lit("avoid_"), "base"), "act", F.lit("keeping away from it"), F.lit(3)),
        row(F.concat(F.lit("safe_"), "base"), "act", F.concat(F.lit("a "), say, F.lit(" that is safe to keep")), F.lit(5)), row(F.concat(F.lit("harm_"), "base"), "act", F.lit(None).cast("string"), F.lit(2)),
        row(F.concat("base", F.lit("s")), "situation", F.lit("more than one"), F.lit(4)),
    ]
    return n.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    WORDED + f""", p AS (SELECT a.name AS a, b.name AS b, a.kind AS ka, b.kind AS kb, list_filter(a.ws, lambda x: NOT list_contains(b.ws, x)) AS da, list_filter(b.ws, lambda x: NOT list_contains(a.ws, x)) AS db FROM w a JOIN w b ON a.name <> b.name)
SELECT 'contrary' AS rel, a, b, 'contrary_negation' AS via FROM p WHERE a < b AND ka = kb AND len(da) + len(db) > 0 AND (len(da) = 0 OR len(db) = 0) AND len(list_filter(list_concat(da, db), lambda x: NOT list_contains({NEG}, x))) = 0
UNION ALL SELECT 'contrary', a, b, 'contrary_antonym' FROM p WHERE a < b AND ka = kb AND len(da) = 1 AND len(db) = 1 AND (list_contains({OPP}, da[1] || '|' || db[1]) OR len(list_filter({list(R.OPPOSITE_PREFIXES)!r}, lambda x: x || da[1] = db[1] OR x || db[1] = da[1])) > 0)
UNION ALL SELECT 'same_as', a, b, 'same_as_key' FROM p WHERE a < b AND ka = kb AND len(da) + len(db) = 0
UNION ALL SELECT 'entails', a, b, 'entails_nominalisation' FROM p WHERE ka = 'act' AND kb = 'situation' AND len(da) + len(db) = 0
UNION ALL SELECT 'subsumes', a, b, 'subsumes_name_tokens' FROM p WHERE ka = kb AND len(da) = 0 AND len(db) > 0 AND NOT list_has_any(db, {NEG})"""
)
def mechanical_relations(t):
    """The rules over names; those over glosses have their own test."""
    return R.mechanical(_vocabulary(t)).where(~F.col("via").startswith("subsumes_gloss")).select("rel", "a", "b", "via")


RELS = "WITH r AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'contrary' WHEN 1 THEN 'same_as' WHEN 2 THEN 'likes' ELSE 'subsumes' END AS rel, 'n' || p_partkey AS a, 'n' || CASE WHEN p_partkey % 11 = 0 THEN p_partkey WHEN p_partkey % 13 = 0 THEN 999999 ELSE p_partkey // 2 END AS b, p_partkey AS k FROM part), v AS (SELECT 'n' || p_partkey AS name, CASE WHEN p_size % 5 = 0 THEN 'situation' ELSE 'act' END AS kind FROM part)"


def _relations(t: Tables):
    k = F.col("p_partkey")
    rel = F.when(k % 5 == 0, "contrary").when(k % 5 == 1, "same_as").when(k % 5 == 2, "likes").otherwise("subsumes")
    b = F.when(k % 11 == 0, k).when(k % 13 == 0, 999_999).otherwise(F.floor(k / 2))
    rows = t.part.select(rel.alias("rel"), F.concat(F.lit("n"), k).alias("a"), F.concat(F.lit("n"), b).alias("b"), k.alias("rank"))
    return rows, t.part.select(F.concat(F.lit("n"), k).alias("name"), F.when(F.col("p_size") % 5 == 0, "situation").otherwise("act").alias("kind"))


@query(RELS + " SELECT rel, a, b, CASE WHEN rel = 'likes' THEN 'bad_relation' WHEN va.kind IS NULL OR vb.kind IS NULL THEN 'unknown_atom' WHEN a = b THEN 'self_loop' WHEN va.kind <> vb.kind THEN 'cross_kind' END AS reason FROM r LEFT JOIN v va ON va.name = a LEFT JOIN v vb ON vb.name = b")
def relation_guardrails(t):
    return R.refused(*_relations(t)).select("rel", "a", "b", "reason")


@query(
    RELS + """, x AS (SELECT rel, a, b, 'rule' AS via, 'mechanical' AS source, 0 AS i FROM r UNION ALL SELECT rel, a, b, 'said', CASE WHEN k % 2 = 0 THEN 'model' ELSE 'mechanical' END, 1 FROM r WHERE k % 3 = 0),
y AS (SELECT rel, CASE WHEN rel IN ('contrary', 'same_as') THEN least(a, b) ELSE a END AS a, CASE WHEN rel IN ('contrary', 'same_as') THEN greatest(a, b) ELSE b END AS b, via, source, i FROM x)
SELECT rel, a, b, CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source, CASE WHEN count(DISTINCT source) > 1 THEN 'rule+said' ELSE arg_min(via, i) END AS via FROM y GROUP BY ALL"""
)
def merged_relations(t):
    rows, _ = _relations(t)
    one = rows.select("rel", "a", "b", F.lit("rule").alias("via"), F.lit("mechanical").alias("source"))
    two = rows.where("rank % 3 = 0").select("rel", "a", "b", F.lit("said").alias("via"), F.when(F.col("rank") % 2 == 0, "model").otherwise("mechanical").alias("source"))
    return R.merged(one, two)


# --- texts ----------------------------------------------------------------------------------------

TALKS = "WITH d AS (SELECT conv_id AS doc_id, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, role) AS text FROM conversations GROUP BY conv_id)"


def _talks(t: Tables):
    """A conversation as a document, with a heading for each turn."""
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    g = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("x")))).alias("p"))
    return g.select("doc_id", F.array_join(F.transform("p", lambda p: p["x"]), "\n").alias("text"))


HEADED = TALKS + ", l AS (SELECT doc_id AS id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM d), h AS (SELECT *, regexp_matches(line, '^#{1,6}\\s+') AS head, (sum(regexp_matches(line, '^#{1,6}\\s+')::INT) OVER (PARTITION BY id ORDER BY line_no))::BIGINT AS section FROM l)"


@query(HEADED + " SELECT id, section, max(CASE WHEN head THEN 2 END)::INT AS level, max(CASE WHEN head THEN trim(substr(line, 4)) END) AS title, max(CASE WHEN head THEN replace(trim(substr(line, 4)), ' ', '-') END) AS anchor, max(CASE WHEN head THEN trim(substr(line, 4)) END) AS path, min(line_no)::INT AS start, max(line_no)::INT AS \"end\" FROM h GROUP BY id, section")
def document_sections(t):
    return G.sections(G.marked_lines(G.lines(_talks(t)))).withColumn("path", F.array_join("path", " > "))


BLOCKED = HEADED + """, b0 AS (SELECT *, trim(line) = '' AS blank, regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+') AS item FROM h), b1 AS (SELECT *, head OR item OR coalesce(lag(blank OR head) OVER (PARTITION BY id ORDER BY line_no), true) AS s FROM b0),
b2 AS (SELECT *, sum((s AND NOT blank)::INT) OVER (PARTITION BY id ORDER BY line_no) AS block FROM b1), bl AS (SELECT id, section, block, bool_or(head) AS head, string_agg(line, chr(10) ORDER BY line_no) AS raw, min(line_no) AS l0 FROM b2 WHERE NOT blank GROUP BY ALL),
cl AS (SELECT *, row_number() OVER (PARTITION BY id, section ORDER BY l0) AS pos FROM bl WHERE NOT head AND section > 0), ti AS (SELECT DISTINCT id, trim(substr(line, 4)) AS title FROM h WHERE head), na AS (SELECT id, section, max(trim(substr(line, 4))) AS title FROM h WHERE head GROUP BY ALL),
nt AS (SELECT cl.id, cl.section, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\[\\^[^\\]]+\\]', '', 'g'), '\\[\\?\\]\\((#[A-Za-z0-9_-]+)\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '^(?:[-*+]|\\d+[.)])\\s+', ''), '\\s+', ' ', 'g')) AS text FROM cl)"""


@query(BLOCKED + " SELECT nt.id, 'v1 > #' || replace(title, ' ', '-') || ' > ¶' || pos AS locator, title AS section, pos::INT AS pos, text FROM nt JOIN na USING (id, section) WHERE text <> '' AND (nt.id, text) NOT IN (SELECT (id, title) FROM ti)")
def panel_passages(t):
    return G.passages(G.marked_lines(G.lines(_talks(t))), "v1")


SHORT = "|".join(a.replace(".", "\\.") for a in X.ABBREVIATIONS)
CLOSE = "[\"''’”)\\]]*"
SPLIT = f"""string_split(regexp_replace(regexp_replace(x, '((?:^|[\\s(])(?i:{SHORT})[.!?]*)\\.', '\\1' || chr(1), 'g'), '([.!?]{CLOSE}) ([\\p{{Lu}}\\p{{Nd}}"''‘“(\\[*#])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"""
FLAT = "WITH t AS (SELECT doc_id AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || CASE WHEN doc_id % 3 = 0 THEN ' See e.g. No. 5, i.e. \"Mr. X.\" Next (etc.) One! \"Quoted?\" Yes... No.' ELSE '' END AS x FROM documents)"


@query(FLAT + f", s AS (SELECT id, {SPLIT} AS p FROM t), f AS (SELECT id, list_filter(list_transform(p, lambda y: trim(replace(y, chr(1), '.'))), lambda y: y <> '') AS p FROM s) SELECT id, unnest(range(len(p)))::INT AS pos, unnest(p) AS sentence FROM f")
def sentence_split(t):
    flat = F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), F.when(F.col("doc_id") % 3 == 0, ' See e.g. No. 5, i.e. "Mr. X." Next (etc.) One! "Quoted?" Yes... No.').otherwise(""))
    return G.sentence_rows(t.documents.select("doc_id", flat.alias("text")))


@query(
    """WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g') AS h FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<(h[1-6]|p|li|title)\\b[^>]*>', chr(1) || '\\1' || chr(2), 'g'), '(?i)</(?:p|li|h[1-6]|title|article|div|body)\\b', chr(3), 'g') AS h FROM c),
s AS (SELECT page_id AS id, string_split(h, chr(1))[2:] AS p FROM m), r AS (SELECT id, unnest(range(len(p)))::INT AS pos, unnest(p) AS p FROM s),
x AS (SELECT id, pos, lower(split_part(p, chr(2), 1)) AS tag, regexp_replace(split_part(split_part(p, chr(2), 2), chr(3), 1), '(?s)<[^>]*>', ' ', 'g') AS t FROM r)
SELECT id, pos, tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM x"""
)
def html_segments(t):
    return O.html_blocks(t.pages)


PLACE = ["v > #a > ¶{b}", "house-rules@2025-12-18 > #x_y > ¶{b} s{s}", "charter > A > B > ¶{b} s{s}-{e}", "v > p{b}s{s}-¶{c}s{e}", "Bad Spec > #a > ¶1", "v > #a > ¶{b} q", "v › S", "v"]
PLACED = "WITH p AS (SELECT p_partkey AS k, p_size % 4 + 1 AS b, p_size % 3 + 1 AS s, p_size % 3 + 2 AS e, p_size % 4 + 2 AS c FROM part)"


def _places(t: Tables):
    n = lambda c: F.col(c).cast("string")
    p = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_size") % 4 + 1).alias("b"), (F.col("p_size") % 3 + 1).alias("s"), (F.col("p_size") % 3 + 2).alias("e"), (F.col("p_size") % 4 + 2).alias("c"))
    text = F.element_at(F.array(*map(F.lit, PLACE)), (F.col("k") % len(PLACE)).cast("int") + 1)
    for c in "bsec":
        text = F.replace(text, F.lit("{" + c + "}"), n(c))
    return p.select("k", text.alias("locator"))


@query(
    PLACED + """ SELECT k, CASE k % 8 WHEN 1 THEN 'house-rules' WHEN 2 THEN 'charter' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'v' END AS spec, CASE k % 8 WHEN 1 THEN '2025-12-18' END AS version, CASE k % 8 WHEN 0 THEN '#a' WHEN 1 THEN '#x_y' WHEN 2 THEN 'A > B' WHEN 6 THEN 'S' END AS section,
CASE WHEN k % 8 <= 3 THEN b END AS b1, CASE WHEN k % 8 BETWEEN 1 AND 3 THEN s END AS s1, CASE WHEN k % 8 <= 2 THEN b WHEN k % 8 = 3 THEN c END AS b2, CASE WHEN k % 8 = 1 THEN s WHEN k % 8 IN (2, 3) THEN e END AS s2, CASE k % 8 WHEN 4 THEN 'bad spec identifier' WHEN 5 THEN 'bad position' END AS error FROM p"""
)
def parsed_locators(t):
    return _places(t).select("k", X.parse_locator(F.col("locator")).alias("p")).select("k", "p.*")


@query("SELECT c_custkey, 'v1 > ' || c_mktsegment || ' > L' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ' [m' || c_custkey || ']' ELSE '' END AS locator, CASE WHEN c_custkey % 3 = 0 THEN 'sec-' || c_nationkey END AS anchor FROM customer")
def made_locators(t):
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("m"), k.cast("string")))
    panel = F.concat(F.lit("v1 > "), F.when(k % 3 == 0, F.concat(F.lit("#sec-"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_mktsegment")), F.lit(" > ¶2"))
    return t.customer.select("c_custkey", X.locator(F.lit("v1"), F.col("c_mktsegment"), F.col("c_nationkey"), name).alias("locator"), X.locator_anchor(panel).alias("anchor"))


@query("WITH x AS (SELECT p_partkey AS k, p_size % 4 AS m, p_name FROM part) SELECT k, CASE m WHEN 0 THEN 'A ' || p_name || '. B.' || chr(10) || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' WHEN 1 THEN 'Two here. Three there.' WHEN 2 THEN 'B.' || chr(10) || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || chr(10) || 'Two here.' END AS text FROM x")
def span_texts(t):
    """Spans over three blocks: a paragraph of two sentences, a fence, a paragraph of two."""
    blocks = F.array(F.concat(F.lit("- A "), "p_name", F.lit(". B.")), F.lit("```\ncode\n```"), F.lit("Two here.\nThree there."))
    m = F.col("p_size") % 4
    place = F.when(m == 0, "v > #a > ¶1 s1-¶2 s1").when(m == 1, "v > #a > ¶3").when(m == 2, "v > #a > ¶1 s2 - ¶3 s1").otherwise("v > #a > ¶3 s2-3")
    return t.part.select(F.col("p_partkey").alias("k"), X.span_text(blocks, X.parse_locator(place)).alias("text"))


@query("SELECT conv_id, turn, contains(' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', ' ', 'g') || ' ', ' est ') AS found FROM conversations")
def name_mentions(t):
    return t.conversations.select("conv_id", "turn", X.mentions(F.coalesce("text", F.lit("")), F.lit("EST")).alias("found"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k,role' ELSE 'k' END AS keys FROM events")
def banned_keys(t):
    extra = F.when(F.col("event_id") % 3 == 0, ', "x": [{"role" : "say \\"gloss\\": no"}]}').otherwise(', "x": "\\"role\\": no"}')
    return t.events.select("event_id", F.array_join(X.banned_keys(F.concat(F.rtrim(F.col("props"), F.lit("}")), extra), ["k", "role", "gloss"]), ",").alias("keys"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1=2,2=0' WHEN 1 THEN '1=1,2=2' END AS verdicts FROM events")
def verdict_replies(t):
    k = F.col("event_id") % 3
    reply = F.when(k == 0, "Sure.\n1: 2\n 2 : 0 because\n").when(k == 1, "first\n0\n1\n2").otherwise("none at all")
    v = F.array_sort(F.map_entries(X.verdict_lines(reply, 2)))
    return t.events.select("event_id", F.array_join(F.transform(v, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",").alias("verdicts"))


@query("SELECT p_partkey, p_name AS quote, 'The text is about ' || p_name || ', ' || p_type || ' of user.' AS said FROM part")
def readback_sentences(t):
    quote = F.concat("p_name", F.lit(" ~~~ "), "p_brand")
    return t.part.select("p_partkey", X.published_quote(quote).alias("quote"), X.render_atoms(F.array(F.translate("p_name", " ", "_"), F.concat("p_type", F.lit("__user")))).alias("said"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE round(1 / 2.0, 6) END AS cover, p_size % 2 = 0 AS empty, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE round(1 / 3.0, 6) END AS zero, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE round(1 / 3.0, 6) END AS one FROM part")
def phrase_measures(t):
    """Phrase coverage, empty glosses and the two Jaccard conventions."""
    even, none = F.col("p_size") % 2 == 0, F.array().cast("array<string>")
    some = lambda *w: F.when(F.col("p_partkey") % 2 == 0, none).otherwise(F.array(*map(F.lit, w)))
    gloss = F.when(even, F.lit("the share and data")).otherwise(F.lit("share gardens"))
    return t.part.select(
        "p_partkey", X.phrase_coverage(gloss, F.lit("a share of data")).alias("cover"), X.gloss_is_empty(F.lit("share_data"), gloss).alias("empty"),
        F.round(X.jaccard_empty_zero(some("a", "b"), some("b", "c")), 6).alias("zero"), F.round(X.jaccard_empty_one(some("a", "b"), some("b", "c")), 6).alias("one"),
    )


def _phrase_sql(kind: str) -> str:
    p = X.PHRASE_WORDS[kind].replace("'", "''")
    has = f"regexp_matches(lower(text), '\\b(?:{p})\\b')"
    return f"({has} AND NOT regexp_matches(lower(text), 'human-like|humanity')) OR (regexp_matches(lower(text), '\\bmodels\\b') AND NOT contains(lower(text), 'model spec'))" if kind == "party" else has


@query(CLAUSES + f" SELECT id, {_when([(k, _phrase_sql(k)) for k in X.PHRASE_WORDS])} AS kinds FROM c")
def phrase_kinds(t):
    return _clauses(t).select("id", F.array_join(X.phrase_categories(F.col("text")), ",").alias("kinds"))


@query(
    CLAUSES
    + f""", w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_]+')) AS w FROM c), k AS (SELECT id, w, count(*)::DOUBLE AS n FROM w WHERE w NOT IN ({', '.join(repr(x) for x in X.COUNT_STOPWORDS)}) GROUP BY ALL),
n AS (SELECT id, sqrt(sum(n * n)) AS n FROM k GROUP BY id), d AS (SELECT a.id, sum(a.n * b.n) AS d FROM k a JOIN k b ON b.id = a.id + 1 AND a.w = b.w GROUP BY a.id)
SELECT c.id, round(coalesce(d, 0) / (coalesce(n.n, 0) * coalesce(m.n, 0) + 1e-9), 6) AS cosine FROM c JOIN c e ON e.id = c.id + 1 LEFT JOIN d ON d.id = c.id LEFT JOIN n ON n.id = c.id LEFT JOIN n m ON m.id = e.id"""
)
def count_cosines(t):
    """Each clause against the next one."""
    c = _clauses(t)
    return c.join(c.select((F.col("id") - 1).alias("id"), F.col("text").alias("next")), "id").select("id", F.round(X.count_cosine(F.col("text"), F.col("next")), 6).alias("cosine"))


# --- loaders --------------------------------------------------------------------------------------


@query("SELECT conv_id || ':' || turn AS id, text AS quote FROM conversations WHERE text IS NOT NULL")
def clause_records(t):
    """Clause files as one record a conversation, {clauses: [{id, text}]}."""
    row = F.struct(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("text"))
    return O.clause_rows(t.conversations.groupBy("conv_id").agg(F.collect_list(row).alias("clauses"))).select("id", "quote")


@query("SELECT p_partkey, p_name, 'part' AS source FROM part")
def clause_fallback(t):
    rows = O.first_existing(t.spark, [f"{t.folder}/nothing-here.parquet", f"{t.folder}/part.parquet"], format="parquet")
    return rows.select("p_partkey", "p_name", F.regexp_extract("source", r"([a-z]+)\.parquet$", 1).alias("source"))


@query("SELECT DISTINCT p_brand AS id, replace(p_name, ' ', '_') AS name, p_type AS kind FROM part")
def annotation_shapes(t):
    """One table written in the three shapes of annotation files, a third of the brands each."""
    p = t.part.select(F.col("p_brand").alias("clause_id"), F.translate("p_name", " ", "_").alias("name"), F.col("p_type").alias("kind"), (F.crc32("p_brand") % 3).alias("m")).distinct()
    one = p.where("m = 0").groupBy("clause_id").agg(F.collect_list(F.struct("name", "kind")).alias("atoms")).select(F.to_json(F.struct(F.array(F.struct("clause_id", "atoms")).alias("clauses"))).alias("json"))
    span = F.array(F.struct("clause_id")).alias("quote_spans")
    two = p.where("m = 1").groupBy("clause_id").agg(F.collect_list(F.struct("name", "kind", span)).alias("atoms")).select(F.to_json(F.struct("atoms")).alias("json"))
    three = p.where("m = 2").groupBy("clause_id").agg(F.to_json(F.collect_list(F.struct("name", "kind", "clause_id"))).alias("json")).select("json")
    return O.annotations(one.union(two).union(three))


@query("SELECT DISTINCT p_brand AS q, replace(p_name, ' ', '_') AS name, p_type AS kind, CASE WHEN p_type = 'PROMO' THEN 5 ELSE 2 END::INT AS weight FROM part WHERE p_brand <> 'Brand#7'")
def query_files(t):
    weight = F.when(F.col("p_type") == "PROMO", 5)
    atom = F.struct(F.translate("p_name", " ", "_").alias("name"), F.col("p_type").alias("kind"), weight.alias("weight"))
    slug = F.when(F.col("p_brand") == "Brand#7", "_note").otherwise(F.col("p_brand"))
    return O.query_atoms(t.part.groupBy(slug.alias("q")).agg(F.collect_set(atom).alias("atoms")).select(F.to_json(F.create_map("q", "atoms")).alias("json")))


@query("SELECT p_brand AS behaviour, 'spec' AS spec, p_partkey::VARCHAR AS id, 'v > #' || p_type || ' > ¶' || p_size AS locator, p_name AS quote, p_size % 5 = 0 AS example, p_size % 3 AS score, 'a=' || p_size % 2 || ',b=' || p_size % 3 AS verdicts FROM part")
def panel_files(t):
    """Judged passages from {behaviours: [{slug, coverage: {spec: {passages: [...]}}}]}."""
    size = F.col("p_size")
    verdicts = F.create_map(F.lit("a"), size % 2, F.lit("b"), size % 3).alias("verdicts")
    p = F.struct(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("v > #"), "p_type", F.lit(" > ¶"), size.cast("string")).alias("locator"), F.col("p_name").alias("quote"), (size % 5 == 0).alias("exampleBlock"), verdicts, (size % 3).alias("score"))
    b = t.part.groupBy("p_brand").agg(F.collect_list(p).alias("passages")).select(F.struct(F.col("p_brand").alias("slug"), F.create_map(F.lit("spec"), F.struct("passages")).alias("coverage")).alias("b"))
    rows = O.panel_rows(b.select(F.to_json(F.struct(F.array("b").alias("behaviours"))).alias("json")))
    return rows.withColumn("verdicts", F.array_join(F.transform(F.array_sort(F.map_entries("verdicts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("SELECT 'http://e/n' || n_nationkey AS s, 'http://e/r' || n_regionkey || ',http://e/t' || n_nationkey % 3 AS parents, CASE WHEN n_nationkey % 2 = 0 THEN 'a; land.' END AS gloss FROM nation")
def turtle_ontology(t):
    k = F.col("n_nationkey").cast("string")
    note = F.when(F.col("n_nationkey") % 2 == 0, ' ;\n ex:comment "a; land."').otherwise("")
    text = F.concat(F.lit("@prefix ex: <http://e/> .\n@prefix owl: <http://o#> .\n# note\nex:n"), k, F.lit(" a owl:Class ; ex:subClassOf ex:r"), F.col("n_regionkey").cast("string"), F.lit(", ex:t"), (F.col("n_nationkey") % 3).cast("string"), note, F.lit(" ;\n ex:shape [ a owl:Restriction ; ex:on ex:p ] ."))
    return O.ontology(O.turtle_triples(t.nation.select(k.alias("path"), text.alias("text")))).select("s", F.array_join("parents", ",").alias("parents"), "gloss")


@query("SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS parent, n_name AS label FROM nation")
def xml_ontology(t):
    k = F.col("n_nationkey").cast("string")
    row = F.concat(F.lit('<owl:Class rdf:about="n'), k, F.lit('"><rdfs:subClassOf rdf:resource="r'), F.col("n_regionkey").cast("string"), F.lit('"/><rdfs:label>'), "n_name", F.lit("</rdfs:label></owl:Class>"))
    body = t.nation.agg(F.concat(F.lit('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s">'), F.array_join(F.collect_list(row), ""), F.lit("</rdf:RDF>")).alias("value"))
    at = f"{shared_dir(t.spark)}/xml-{uuid.uuid4().hex}"
    body.write.text(at)
    out = cut(O.xml_classes(t.spark, at))
    discard(t.spark, at)
    return out


@query("SELECT event_id, event_type FROM events")
def usage_log(t):
    """Appended in two runs and read back."""
    at = f"{shared_dir(t.spark)}/log-{uuid.uuid4().hex}"
    for half in (0, 1):
        O.append_json(t.events.where(F.col("event_id") % 2 == half).select("event_id", "event_type"), at)
    out = cut(O.json_log(t.spark, at, "event_id bigint, event_type string"))
    discard(t.spark, at)
    return out


@query("SELECT s_suppkey, s_name FROM supplier")
def snapshot_files(t):
    """A snapshot that is written, refused once, and replaced by force."""
    from pyspark.errors import AnalysisException

    at, rows = f"{shared_dir(t.spark)}/snapshot-{uuid.uuid4().hex}", t.supplier.select("s_suppkey", "s_name")
    O.write_once(rows.withColumn("s_name", F.lit("old")), at)
    try:
        O.write_once(rows, at)
        raise AssertionError("a snapshot was replaced without force")
    except AnalysisException:
        O.write_once(rows, at, force=True)
    out = cut(t.spark.read.parquet(at))
    discard(t.spark, at)
    return out


@query(f"WITH {DOC_TOK} SELECT id, count(*) AS n FROM tok GROUP BY id")
def token_rows(t):
    from ..operators.scoring import term_rows

    return term_rows(t.documents, "doc_id", "text").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
