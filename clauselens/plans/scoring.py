"""Queries of the scoring operators over documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import dense_cosine
from ..lineage import cut
from ..operators import cuts as C
from ..operators import joins as J
from ..operators import scoring as S
from .base import BENCH_TOK, DOC_TOK, Tables, otsu_sql, query


def _counts(t: Tables):
    return S.term_counts(t.documents, "doc_id", "text")


def _kept_counts(t: Tables):
    """Term counts for plans that read them more than once: written once, so that texts are tokenised once."""
    return cut(_counts(t))


def _total(t: Tables):
    return t.documents.agg(F.count_distinct("doc_id").alias("n"))


def _queries(t: Tables):
    return S.term_counts(t.benchmark, "item_id", "text")


def _overlap(t: Tables):
    """(q, id, score): summed idf of the terms that a benchmark item and a document share."""
    counts = _kept_counts(t)
    q = _queries(t).select(F.col("id").alias("q"), "term")
    return q.join(S.idf(counts, _total(t)), "term").join(counts.select("id", "term"), "term").groupBy("q", "id").agg(F.sum("idf").alias("score"))


CNT = f"WITH {DOC_TOK}, cnt AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), nn AS (SELECT count(DISTINCT doc_id) AS n FROM documents)"
IDF = CNT + ", idf AS (SELECT term, count(DISTINCT id) AS df, ln(1 + any_value(n) / (1.0 + count(DISTINCT id))) AS idf FROM cnt, nn GROUP BY term)"
OVER = IDF + f", {BENCH_TOK}, q AS (SELECT DISTINCT id AS q, term FROM btok), ov AS (SELECT q, cnt.id, sum(idf) AS score FROM q JOIN idf USING (term) JOIN cnt USING (term) GROUP BY ALL)"
VEC = IDF + f""", {BENCH_TOK}, vr AS (SELECT id, term, (1 + ln(tf)) * idf AS x FROM cnt JOIN idf USING (term)), vn AS (SELECT id, sqrt(sum(x * x)) AS nm FROM vr GROUP BY id),
vec AS (SELECT id, term, x / nm AS w FROM vr JOIN vn USING (id) WHERE nm > 0),
qc AS (SELECT id AS q, term, count(*) AS tf FROM btok GROUP BY ALL), qr AS (SELECT q, term, (1 + ln(tf)) * idf AS x FROM qc JOIN idf USING (term)), qn AS (SELECT q, sqrt(sum(x * x)) AS nm FROM qr GROUP BY q),
qv AS (SELECT q, term, x / nm AS w FROM qr JOIN qn USING (q) WHERE nm > 0)"""
COS = VEC + ", co AS (SELECT q, vec.id, sum(qv.w * vec.w) AS score FROM qv JOIN vec USING (term) GROUP BY ALL)"


@query(CNT + " SELECT id, term, tf FROM cnt")
def doc_term_counts(t):
    return _counts(t)


@query(IDF + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_token_df(t):
    return S.idf(_counts(t), _total(t)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(CNT + " SELECT term, count(DISTINCT id) AS df, round(ln(any_value(n) / count(DISTINCT id)), 6) AS ic FROM cnt, nn GROUP BY term")
def doc_information_content(t):
    return S.information_content(_counts(t), _total(t)).select("term", "df", F.round("ic", 6).alias("ic"))


@query(OVER + ", tp AS (SELECT q, max(score) AS top FROM ov GROUP BY q) SELECT q, id, round(score / top, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score / top, 6) DESC, id) AS rank FROM ov JOIN tp USING (q)")
def doc_idf_rank(t):
    ov = _overlap(t)
    top = ov.groupBy("q").agg(F.max("score").alias("top"))
    s = ov.join(top, "q").select("q", "id", F.round(F.col("score") / F.col("top"), 6).alias("score"))
    return S.ranked(s, "score").withColumn("score", F.round("score", 6))


@query(OVER + ", sc AS (SELECT q AS key, id, round(score, 6) AS score FROM ov)," + otsu_sql("sc") + " SELECT s.key, s.id, s.score, round(o.cut, 6) AS cut FROM sc s JOIN otsu_cut o ON s.key = o.key WHERE s.score > 0 AND s.score >= o.cut")
def doc_otsu_predictions(t):
    s = _overlap(t).select(F.col("q").alias("key"), "id", F.round("score", 6).alias("score"))
    return C.predicted(s, C.otsu(s)).select("key", "id", "score", F.round("cut", 6).alias("cut"))


@query(VEC + " SELECT id, term, round(w, 6) AS w FROM vec")
def doc_tfidf_vectors(t):
    counts = _kept_counts(t)
    return S.unit_vectors(counts, S.idf(counts, _total(t))).select("id", "term", F.round("w", 6).alias("w"))


def _vectors(t: Tables):
    counts = _kept_counts(t)
    idf = S.idf(counts, _total(t))
    return S.unit_vectors(counts, idf), S.unit_vectors(_queries(t).withColumnRenamed("id", "q"), idf, "q")


@query(COS + " SELECT q, id, round(score, 6) AS score FROM co QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id) <= 10")
def doc_cosine_top10(t):
    v, q = _vectors(t)
    return S.top_ids(S.cosines(q, v).withColumn("score", F.round("score", 6)), 10)


@query(
    COS
    + """, best AS (SELECT q, id FROM co WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 12),
m AS (SELECT q, count(*) AS m FROM best GROUP BY q), ce AS (SELECT q, term, sum(w) / any_value(m) AS s FROM best JOIN vec USING (id) JOIN m USING (q) GROUP BY ALL),
nw AS (SELECT q, term, 0.5 * s AS w FROM ce WHERE (q, term) NOT IN (SELECT (q, term) FROM qv) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, term) <= 25),
mg AS (SELECT q, term, w FROM qv UNION ALL SELECT q, term, w FROM nw), mn AS (SELECT q, sqrt(sum(w * w)) AS nm FROM mg GROUP BY q)
SELECT q, term, round(w / nm, 6) AS w FROM mg JOIN mn USING (q)"""
)
def query_expansion_rocchio(t):
    v, q = _vectors(t)
    return S.expanded(q, v).select("q", "term", F.round("w", 6).alias("w"))


ATOMS = f"WITH {DOC_TOK}, {BENCH_TOK}, atm AS (SELECT DISTINCT id, term AS name, lang AS kind FROM tok JOIN documents d ON d.doc_id = tok.id), nn AS (SELECT count(DISTINCT doc_id) AS n FROM documents), ai AS (SELECT name, count(DISTINCT id) AS df, CASE WHEN count(DISTINCT id) > 0.25 * any_value(n) THEN 0 ELSE ln(1 + any_value(n) / (1.0 + count(DISTINCT id))) END AS idf FROM atm, nn GROUP BY name)"


def _atoms(t: Tables):
    return _counts(t).join(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind")), "id").select("id", F.col("term").alias("name"), "kind")


@query(ATOMS + " SELECT name, df, round(idf, 6) AS idf FROM ai")
def atom_idf_with_floor(t):
    return S.atom_idf(_atoms(t), _total(t)).select("name", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {DOC_TOK} SELECT term AS name, count(DISTINCT id) AS df, count(*) AS occurrences FROM tok GROUP BY term")
def atom_vocabulary(t):
    return S.vocabulary(_counts(t).withColumnRenamed("term", "name"), "tf")


def _query_atoms(t: Tables):
    return _queries(t).select(F.col("id").alias("q"), F.col("term").alias("name"), F.lit("en").alias("kind"))


@query(ATOMS + ", qa AS (SELECT DISTINCT id AS q, term AS name FROM btok), tp AS (SELECT max(idf) AS top FROM ai) SELECT q, atm.id, round(sum(idf * CASE WHEN kind = 'en' THEN 1 ELSE 0.4 END) / any_value(top), 6) AS score FROM qa JOIN atm USING (name) JOIN ai USING (name), tp GROUP BY q, atm.id")
def atom_equi_join_scores(t):
    a = cut(_atoms(t))
    return S.atom_scores(_query_atoms(t), a, S.atom_idf(a, _total(t))).select("q", "id", F.round("score", 6).alias("score"))


@query(OVER + ", sec AS (SELECT q, id, source AS section, round(score, 6) AS score FROM ov JOIN documents d ON d.doc_id = ov.id), b AS (SELECT * FROM sec QUALIFY row_number() OVER (PARTITION BY q, section ORDER BY score DESC, id) <= 3) SELECT q, section, round(avg(score) + 3e-8, 6) AS score FROM b GROUP BY ALL")
def section_top3_mean(t):
    s = _overlap(t).withColumn("score", F.round("score", 6)).join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("section")), "id")
    return S.section_top_mean(s).select("q", "section", F.round(F.col("score") + F.lit(3e-8), 6).alias("score"))


BAG = (
    OVER
    + """, u AS (SELECT DISTINCT q, source AS section FROM ov JOIN documents d ON d.doc_id = ov.id WHERE round(score, 6) > 0),
lex AS (SELECT u.q, d.doc_id AS id, u.section, coalesce(round(ov.score, 6), 0) AS lex FROM u JOIN documents d ON d.source = u.section LEFT JOIN ov ON u.q = ov.q AND d.doc_id = ov.id),
top3 AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY q, section ORDER BY lex DESC, id) <= 3), sm AS (SELECT q, section, 0.45 * avg(lex) AS sec FROM top3 GROUP BY ALL)"""
)


def _bag(t: Tables):
    u = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("section"))
    return S.combined_scores(u, {"lex": (_overlap(t).withColumn("score", F.round("score", 6)), 1.0)})


@query(BAG + " SELECT q, id, section, round(lex + 3e-8, 5) AS lex, round(sec + 3e-8, 5) AS section_score, round(lex + sec + 3e-8, 5) AS raw FROM lex JOIN sm USING (q, section)")
def bag_scorer_channels(t):
    return _bag(t).select("q", "id", "section", F.round(F.col("lex") + F.lit(3e-8), 5).alias("lex"), F.round(F.col("section_score") + F.lit(3e-8), 5).alias("section_score"), F.round(F.col("raw") + F.lit(3e-8), 5).alias("raw"))


@query(BAG + ", r AS (SELECT q, id, lex + sec AS raw FROM lex JOIN sm USING (q, section)), s AS (SELECT q, id, round(raw / max(raw) OVER (PARTITION BY q), 6) AS score FROM r) SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s")
def bag_scorer_rank(t):
    b = _bag(t)
    top = b.groupBy("q").agg(F.max("raw").alias("top"))
    return S.ranked(b.join(top, "q").select("q", "id", F.round(F.col("raw") / F.col("top"), 6).alias("score")), "score").withColumn("score", F.round("score", 6))


@query(
    COS + ", pt AS (SELECT q, vec.id, term, qv.w * vec.w AS p FROM qv JOIN vec USING (term)), b AS (SELECT q, id, term, round(p, 6) AS part, row_number() OVER (PARTITION BY q, id ORDER BY round(p, 12) DESC, term) AS rn FROM pt) SELECT q, id, rn::INT AS rn, term, part FROM b WHERE rn <= 3"
)
def explain_top_terms(t):
    v, q = _vectors(t)
    e = S.explain_terms(q, v, 3)
    return e.select("q", "id", F.explode("terms").alias("x")).select("q", "id", "x.rn", "x.term", F.round("x.part", 6).alias("part"))


@query(ATOMS + """, qs AS (SELECT DISTINCT id AS q, CASE WHEN length(term) > 6 THEN 'act' ELSE 'situation' END AS slot, term AS name FROM btok),
g AS (SELECT q, atm.id, bool_or(slot = 'act') AS a, bool_or(slot = 'situation') AS s, count(DISTINCT name) AS n FROM qs JOIN atm USING (name) GROUP BY ALL)
SELECT q, id, (CASE WHEN a AND s THEN 0 WHEN n >= 2 THEN 1 WHEN a THEN 2 WHEN s THEN 3 ELSE 4 END)::INT AS rung FROM g""")
def typed_rungs(t):
    return S.rungs(_slots(t).join(_atoms(t).select("id", "name"), "name"))


def _slots(t: Tables):
    return _query_atoms(t).select("q", F.when(F.length("name") > 6, "act").otherwise("situation").alias("slot"), "name")


@query(
    CNT + f""", {BENCH_TOK}, ic AS (SELECT term AS name, ln(any_value(n) / count(DISTINCT id)) AS ic FROM cnt, nn GROUP BY term), qs AS (SELECT DISTINCT id AS q, CASE WHEN length(term) > 6 THEN 'act' ELSE 'situation' END AS slot, term AS name FROM btok),
f AS (SELECT q, cnt.id, slot, max(ic * 2 / 3.0) AS b FROM qs JOIN ic USING (name) JOIN cnt ON cnt.term = qs.name GROUP BY ALL) SELECT q, id, round(sum(b), 6) AS mass FROM f GROUP BY ALL"""
)
def typed_evidence_mass(t):
    counts = _kept_counts(t)
    ic = S.information_content(counts, _total(t)).select(F.col("term").alias("name"), "ic")
    found = _slots(t).join(counts.select("id", F.col("term").alias("name")), "name").withColumns({"hops": F.lit(0), "weight": F.lit(2)})
    return S.evidence_mass(found, ic).select("q", "id", F.round("mass", 6).alias("mass"))


FIRED = OVER + ", f AS (SELECT q, source AS section, round(score, 6) AS score, d.lang = 'en' AS bears, round(score, 6) >= 12 AS fires FROM ov JOIN documents d ON d.doc_id = ov.id)"


@query(FIRED + ", g AS (SELECT q, section, avg(fires::INT) AS share, avg(score) AS m, bool_or(bears) AS bears, count(*) AS n FROM f GROUP BY ALL) SELECT q, section, round(share, 4) AS share, round(m, 4) AS mean_score, n, CASE WHEN share <= 0.5 THEN 'no majority' WHEN NOT bears THEN 'bears no conduct' END AS why_not, NOT (share <= 0.5 OR NOT bears) AS elected FROM g")
def section_elections(t):
    f = _overlap(t).withColumn("score", F.round("score", 6)).join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("section"), (F.col("lang") == "en").alias("bears")), "id")
    e = S.elections(f.withColumns({"fires": F.col("score") >= 12, "top": F.lit(True)}))
    return e.select("q", "section", F.round("share", 4).alias("share"), F.round("mean_score", 4).alias("mean_score"), "n", "why_not", "elected")


SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, round({SIM}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.label = b.label AND a.vec_id <> b.vec_id) SELECT q, id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) <= 5")
def cosine_topk_embeddings(t):
    e = t.embeddings
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"), F.col("label").alias("block"))
    i = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("y"), F.col("label").alias("block"))
    return J.top_similar(q, i, F.when(F.col("q") != F.col("id"), F.round(dense_cosine(F.col("x"), F.col("y")), 6)), 6).where("sim is not null and rank <= 5").select("q", "id", "sim", "rank")


@query(f"WITH p AS (SELECT a.vec_id // 200 AS q, a.vec_id AS qa, b.vec_id AS id, greatest(0, {SIM}) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.label = b.label), m AS (SELECT q, id, qa, max(s) AS s FROM p GROUP BY ALL) SELECT q, id, round(sum(s), 5) AS score FROM m GROUP BY ALL")
def soft_match_embeddings(t):
    """Queries are the vectors whose id is divisible by 100, against all."""
    e = t.embeddings
    q = e.where("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 200).alias("q"), F.col("vec_id").alias("qa"), F.col("embedding").alias("x"), F.col("label").alias("block"))
    i = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("y"), F.col("label").alias("block"))
    return S.soft_scores(q, i, dense_cosine(F.col("x"), F.col("y"))).select("q", "id", F.round("score", 5).alias("score"))
