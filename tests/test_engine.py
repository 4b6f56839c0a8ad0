"""Operators of the engine on small tables with known answers."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clauselens.functions import grammar as N
from clauselens.functions import text as X
from clauselens.operators import components as K
from clauselens.operators import cuts as C
from clauselens.operators import graphs as H
from clauselens.operators import joins as J
from clauselens.operators import log as L
from clauselens.operators import metrics as M
from clauselens.operators import ordered as Z
from clauselens.operators import relations as E
from clauselens.operators import resample as R
from clauselens.operators import rules as U
from clauselens.operators import scoring as S
from clauselens.operators import segment as G
from clauselens.operators import sets as D
from clauselens.sources import loaders as O


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} string" for k in values) or "x string")
    return df.select(expr.alias("r")).first().r


#: Worked by hand from the suffix list.
STEMS = {
    "helpful": "help", "helpfulness": "help", "harming": "harm", "policies": "polic", "carriers": "carry", "relations": "relat", "sings": "sing", "users": "user",
    "user": "user", "politely": "polite", "generalizations": "generaliz", "statements": "stat", "don't": "don't", "dogs'": "dogs", "reply": "reply", "wishes": "wish",
}


def test_stems(spark):
    assert {w: X.stem(w) for w in STEMS} == STEMS


def test_tokens_and_stems_agree(spark):
    rng = random.Random(1)
    parts = ["help", "harm", "polic", "ful", "ness", "ing", "ies", "ation", "s", "ers", "ly", "i", "ed", "a", "don't", "the"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 5))) + " " + rng.choice(parts) for _ in range(400)] + ["Helpful_harm's", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {i: [w for w in re.findall(X.WORD, (t or "").lower().replace("_", " ")) if w not in X.STOPWORDS] for i, t in enumerate(texts)}
    for r in df.select("i", X.tokens(F.col("t")).alias("k")).collect():
        assert r.k == [X.stem(w) for w in found[r.i]]
    rows = S.term_rows(df, "i", "t").groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("k")).collect()
    assert {r.id: r.k for r in rows} == {i: sorted(X.stem(w) for w in ws) for i, ws in found.items() if ws}


def test_text_functions(spark):
    assert one(spark, X.citation_text(F.col("t")), t="- See [the rule](#r) now[^ab12]") == "See the rule now"
    assert one(spark, X.citation_text(F.col("t")), t="see [?](#chain) and [a](b)") == "see #chain and a"
    assert one(spark, X.match_text(F.col("t")), t="“a” — b… -- c") == '"a" - b... - c'
    assert one(spark, X.link_variants(F.col("t")), t="[A](b) *c*") == ["A c", "b c"]
    assert sorted(one(spark, X.mixed_link_variants(F.col("t")), t="[A](b) [C](d)")) == ["A C", "A d", "b C", "b d"]
    four = " ".join(f"[{c}]({c}{c})" for c in "ABCD")
    assert sorted(one(spark, X.mixed_link_variants(F.col("t")), t=four)) == ["A B C D", "AA BB CC DD"]
    assert one(spark, X.locator(F.lit("v1"), F.lit("S"), F.lit(3), F.lit("m0001"))) == "v1 > S > L3 [m0001]"
    p = one(spark, X.parse_locator(F.col("t")), t="v1-x@2025-12-18 > #intro > ¶2 s1 - ¶3 s4")
    assert p.error == "bad spec identifier"
    p = one(spark, X.parse_locator(F.col("t")), t="house-rules@2025-12-18 > #intro > ¶2 s1 - ¶3 s4")
    assert (p.spec, p.version, p.section, p.b1, p.s1, p.b2, p.s2, p.error) == ("house-rules", "2025-12-18", "#intro", 2, 1, 3, 4, None)
    assert one(spark, X.locator_anchor(F.col("t")), t="v1 > #intro > B2") == "intro"
    assert one(spark, X.sentences(F.col("t")), t='See e.g. Dr. Who. Next one! (Third?) End (no. 4) here. "Said." #5') == ["See e.g. Dr. Who.", "Next one!", "(Third?)", "End (no. 4) here.", '"Said."', "#5"]
    assert one(spark, X.modal_flags(F.col("a"), F.col("b")), a="It must.", b="It may.") == ["strengthened"]
    assert [one(spark, X.formatting_reason(F.col("t")), t=t) for t in ("", "# h", "```", "---", "text")] == ["blank", "heading", "fence", "rule", None]
    assert one(spark, X.mentions(F.col("t"), F.col("n")), t="uses foo_bar.", n="foo_bar") and not one(spark, X.mentions(F.col("t"), F.col("n")), t="foo_barx", n="foo_bar")
    assert one(spark, X.vocab_key(F.col("t")), t="harmful_queries_of_user_not_operator") == "harm not of operator querie user | user>operator"
    assert one(spark, X.verdict_lines(F.col("t"), 2), t="1: 2\n2: 0") == {1: 2, 2: 0} == one(spark, X.verdict_lines(F.col("t"), 2), t="so\n2\n0")
    assert one(spark, X.verdict_lines(F.col("t"), 3), t="none") is None
    assert one(spark, X.message_cause(F.col("t")), t="File a/b.py line 12: 'x'") == "file <path> line <n>: <q>"
    assert one(spark, X.jaccard_empty_zero(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, X.jaccard_empty_one(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, X.span_text(F.array(F.lit("A b. C d."), F.lit("E.")), X.parse_locator(F.col("t"))), t="v > s > ¶1 s2 - ¶2 s1") == "C d.\n\nE."
    assert one(spark, X.published_quote(F.col("t")), t="Caption ~~~ code") == "Caption"
    assert one(spark, X.gloss_is_empty(F.col("a"), F.col("b")), a="share_data", b="the data, share")


FORCES = {
    "You must not lie": ["mustnot"], "must always never lie": ["mustnot"], "must respect the user, not the operator": ["must"], "You may not": ["mustnot"], "It may help": ["may"],
    "It can help": [], "It can't help": ["mustnot"], "It cannot": ["mustnot"], "shouldn’t": ["shouldnot"], "should generally not": ["shouldnot"], "It should help": ["should"], "never": ["mustnot"],
    "must never": ["mustnot"], "is prohibited": ["mustnot"], "refrain from it": ["mustnot"], "are required to": ["must"], "has to": ["must"], "free to": ["may"], "may it must": ["must", "may"],
    "mustard mayor": [], "must by default in general not": ["must"], "must by default not": ["mustnot"], "could not": [], None: [],
}
NAMES = {
    "mustnot_disclose__model_user": ("mustnot", "disclose", ["model", "user"]), "must_x": ("must", "x", []), "shouldnot_x__third_party": ("shouldnot", "x", ["third_party"]), "plain_name": (None, "plain_name", []),
    "no_moral": (None, "no_moral", []), "a__operator_model": (None, "a", ["operator", "model"]), "may_a_b__root": ("may", "a_b", ["root"]), "not_share": (None, "not_share", []), "mustard": (None, "mustard", []),
}


def test_grammar(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(FORCES)], "i int, t string")
    assert {r.t: r.f for r in df.select("t", N.forces(F.col("t")).alias("f")).collect()} == FORCES
    assert one(spark, N.defeaters(F.col("t")), t="Unless told, apart from exceptions; even when, otherwise") == ["unless", "exception", "aside from", "even if", "otherwise"]
    assert one(spark, N.principals(F.col("t")), t="Third parties and ChatGPT; the Model Spec; users") == ["model", "third_party", "user"]
    c = one(spark, N.classify(F.col("t")), t="The user must tell the operator, but")
    assert (c.categories, c.forces, c.defeaters, c.principals) == (["DEONTIC", "DEFEATED", "PARTIED"], ["must"], ["but"], ["operator", "user"])
    assert one(spark, N.classify(F.col("t")), t="Hello user").categories == ["CONTROL"]
    names = spark.createDataFrame([(n,) for n in NAMES], "n string").withColumn("p", N.parse_name(F.col("n")))
    rows = names.select("n", "p.*", N.format_name(F.col("p")).alias("back"), N.stem_of(F.col("n")).alias("s")).collect()
    assert {r.n: (r.polarity, r.stem, r.principals) for r in rows} == NAMES and all(r.error is None and r.back == r.n and r.s == r.stem for r in rows)
    for bad in ("", "must_", "a__b__c", "a__", "__user", "a__platform", "a___user", "must___user", "a__user_x"):
        p = one(spark, N.parse_name(F.col("t")), t=bad)
        assert p.error and p.polarity is None and p.principals == [] and p.stem == bad, bad
        assert one(spark, N.stem_of(F.col("t")), t=bad) == bad
    assert one(spark, N.principal_named(F.col("t")), t="warn_third_party") == "third_party" and one(spark, N.principal_named(F.col("t")), t="superuser") is None
    assert one(spark, N.role(F.col("t")), t=" Topic ") == "topic" and one(spark, N.role(F.col("t")), t="other") is None


def test_mechanical_relations(spark):
    vocabulary = [
        ("share_data", "act", "", 9), ("avoid_share_data", "act", "", 2), ("share_private_data", "act", "", 4), ("share_public_data", "act", "", 3), ("data_shares", "act", "", 1), ("share_datas", "situation", "", 1),
        ("dog", "act", "", 1), ("walk_dog", "act", None, 1), ("pet_care", "act", "to walk a dog and feed it daily", 1), ("long_care", "act", "to walk a dog and feed it daily in parks", 1), ("known_fact", "situation", "", 1), ("unknown_fact", "situation", "", 1),
    ]
    v = spark.createDataFrame(vocabulary, "name string, kind string, gloss string, n int")
    found = E.mechanical(v)
    got = {(r.rel, r.a, r.b, r.via) for r in found.collect()}
    assert {
        ("contrary", "avoid_share_data", "share_data", "contrary_negation"), ("contrary", "share_private_data", "share_public_data", "contrary_antonym"), ("contrary", "known_fact", "unknown_fact", "contrary_antonym"),
        ("same_as", "data_shares", "share_data", "same_as_key"), ("entails", "share_data", "share_datas", "entails_nominalisation"), ("subsumes", "share_data", "share_private_data", "subsumes_name_tokens"),
        ("subsumes", "dog", "walk_dog", "subsumes_name_tokens"), ("subsumes", "walk_dog", "pet_care", "subsumes_gloss_names"), ("subsumes", "pet_care", "long_care", "subsumes_gloss_tokens"),
    } <= got
    assert not any(rel == "subsumes" and b == "avoid_share_data" for rel, _, b, _ in got) and not any({a, b} == {"share_data", "share_datas"} for rel, a, b, _ in got if rel != "entails")
    rows = [("subsumes", "a", "b", 1), ("subsumes", "b", "c", 2), ("subsumes", "c", "a", 3), ("subsumes", "b", "a", 4), ("subsumes", "a", "b", 9), ("contrary", "d", "a", 5), ("subsumes", "a", "d", 0), ("entails", "a", "z", 1), ("odd", "a", "b", 1), ("same_as", "a", "a", 1), ("same_as", "a", "k", 1)]
    out = E.refused(spark.createDataFrame(rows, "rel string, a string, b string, rank int"), spark.createDataFrame([(x, "act") for x in "abcd"] + [("k", "situation")], "name string, kind string"))
    assert {(r.rel, r.a, r.b, r.rank): r.reason for r in out.collect()} == {
        ("subsumes", "a", "b", 1): None, ("subsumes", "b", "c", 2): None, ("subsumes", "c", "a", 3): "cycle", ("subsumes", "b", "a", 4): "cycle", ("subsumes", "a", "b", 9): "duplicate", ("contrary", "d", "a", 5): None,
        ("subsumes", "a", "d", 0): "contradictory_pair", ("entails", "a", "z", 1): "unknown_atom", ("odd", "a", "b", 1): "bad_relation", ("same_as", "a", "a", 1): "self_loop", ("same_as", "a", "k", 1): "cross_kind",
    }
    assert sorted((r.name, r.against) for r in E.contraries(found.where("a = 'known_fact'")).collect()) == [("known_fact", "unknown_fact"), ("unknown_fact", "known_fact")]


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [(None if k == 3 else k, i, rng.randint(0, 9)) for i in range(300) for k in [0 if i % 3 else rng.randint(1, 3)]]
    df = spark.createDataFrame(rows, "k int, i int, x int").repartition(7)
    got = {(r.k, r.i): r.s for r in Z.running(df, ["k"], [F.desc("i")], s="x").collect()}
    assert got == {(k, i): sum(y for c, j, y in rows if c == k and j > i) for k, i, _ in rows}
    assert {r.i: r.rank for r in Z.placed(df, [], ["i"]).collect()} == {i: i + 1 for i in range(300)}
    assert Z.placed(df.limit(0), ["k"], ["i"]).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(7, 7), (300, 300)]
    root = {}
    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    got = {r.node: r.root for r in K.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: top(x) for x in list(root)}
    assert K.components(spark.createDataFrame([], "u int, v int")).count() == 0
    assert {r.id: r.root for r in K.clusters(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("c", "b")], "u string, v string")).collect()} == {"a": "a", "b": "b", "c": "b"}


def test_segments(spark):
    t = "Intro\n\n# One\npara a\npara b\n- item\n```\ncode\n\n# no\n```\n## Two\nlast"
    docs = spark.createDataFrame([(1, t), (2, None)], "doc_id int, text string")
    rows = G.marked_lines(G.lines(docs))
    b = [(r.kind, r.start, r.text) for r in G.blocks(rows).orderBy("block").collect()]
    assert b == [("paragraph", 0, "Intro"), ("heading", 2, "# One"), ("paragraph", 3, "para a\npara b"), ("list_item", 5, "- item"), ("fence", 6, "```\ncode\n\n# no\n```"), ("heading", 11, "## Two"), ("paragraph", 12, "last")]
    s = [(r.section, r.title, r.path, r.start, r.end) for r in G.sections(rows).orderBy("section").collect()]
    assert s == [(0, None, [], 0, 1), (1, "One", ["One"], 2, 10), (2, "Two", ["One", "Two"], 11, 12)]
    assert sum(r.chars for r in G.accounting(docs, G.blocks(rows), rows).collect()) == len(t)
    assert [r.clause for r in G.clauses(G.blocks(rows)).orderBy("start").collect()] == [f"c{i:04d}" for i in range(1, 6)]
    n = spark.createDataFrame([(1, p, "x" if p < 3 else "y") for p in range(6)], "id int, pos int, section string")
    assert {r.pos: r.near for r in G.neighbours(n, 2).collect()}[2] == [0, 1]


def test_cuts(spark):
    rng = random.Random(4)
    data = {"bimodal": [rng.gauss(0.2, 0.03) for _ in range(24)] + [rng.gauss(0.8, 0.03) for _ in range(8)], "flat": [0.5] * 5, "none": [0.0, 0.0]}
    df = spark.createDataFrame([(k, i, round(v, 6)) for k, vs in data.items() for i, v in enumerate(vs)], "key string, id int, score double")
    for name, rule in C.RULES.items():
        cut = {r.key: r.cut for r in rule(df, "key").collect()}
        assert cut["flat"] == cut["none"] == C.NO_CUT, name
        if name in ("otsu", "isodata", "largest_gap"):
            assert sum(v >= cut["bimodal"] for v in data["bimodal"]) == 8, name
    vals = sorted((round(v, 6) for v in data["bimodal"]), reverse=True)
    n = len(vals)
    far = max(range(n), key=lambda i: (round(abs((vals[-1] - vals[0]) * i - (n - 1) * (vals[i] - vals[0])), 9), -i))
    assert math.isclose({r.key: r.cut for r in C.kneedle(df).collect()}["bimodal"], vals[max(far - 1, 0)])
    assert C.predicted(df, C.otsu(df)).count() == 8


def test_metrics(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.choice([0.1, 0.2, 0.5, 0.9]), rng.random() < 0.4) for i in range(60)] + [("b", 0, 0.5, True)]
    df = spark.createDataFrame(rows, "k string, id int, score double, gold boolean")
    got = {r.k: r.auc for r in M.auc(df, "k").collect()}
    p, q = [s for k, _, s, g in rows if k == "a" and g], [s for k, _, s, g in rows if k == "a" and not g]
    assert math.isclose(got["a"], sum((x > y) + (x == y) / 2 for x in p for y in q) / len(p) / len(q)) and got["b"] is None
    cells = M.scored(M.confusion(df.withColumn("pred", F.col("score") > 0.3), "k"))
    r = {r.k: r for r in cells.collect()}
    assert r["b"].mcc == 0.0 and r["b"].precision == 1.0
    a = r["a"]
    assert math.isclose(a.mcc, (a.tp * a.tn - a.fp * a.fn) / math.sqrt((a.tp + a.fp) * (a.tp + a.fn) * (a.tn + a.fp) * (a.tn + a.fn)))
    votes = spark.createDataFrame([("x", 1, 2), ("y", 1, 1), ("z", 1, 0), ("x", 2, 0), ("y", 2, 1), ("z", 2, 1)], "judge string, id int, verdict int")
    g = {(r.judge, r.id): r.gold for r in M.pair_gold(votes).collect()}
    assert g[("z", 1)] and not g[("x", 1)] and g[("x", 2)]
    assert [r.judge for r in M.binary_judges(votes).collect()] == ["x"]
    lab = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert M.labelling_agreement(lab, "a", "b").first().ari == 1.0


def _matchings(edges):
    """Bit masks of the edge sets that share no end."""
    out = [(0, frozenset(), frozenset())]
    for i, (a, b) in enumerate(edges):
        out += [(m | 1 << i, x | {a}, y | {b}) for m, x, y in out if a not in x and b not in y]
        out = list({(x, y): (m, x, y) for m, x, y in out}.values())
    return [m for m, _, _ in out]


def test_joins(spark):
    p = spark.createDataFrame([(1, "x The *quick* brown fox jumps over it", "a"), (2, "nothing", "b"), (3, "", "a")], "p int, text string, anchor string")
    c = spark.createDataFrame([(10, "The  quick brown `fox` jumps over", "a"), (11, "noth", "z"), (12, "", "a")], "c int, text string, anchor string")
    assert sorted((r.p, r.c) for r in J.contained(p, c).collect()) == [(1, 10), (2, 11)]
    assert [(r.p, r.c, r.restricted) for r in J.guarded_containment(p, c).collect()] == [(1, 10, True)]
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["aa", "ab", "b", "[ab](b)", "*aa*", "ba"]) for _ in range(n))
    ps, cs = [(i, say(rng.randint(0, 12))) for i in range(60)], [(i, say(rng.randint(1, 8))[rng.randint(0, 1) :]) for i in range(60)]
    form = lambda t, k: " ".join(re.sub(r"\*\*|\*|`", "", re.sub(r"\[([^\]]*)\]\(([^)]*)\)", rf"\{k}", t)).split())
    sides = lambda t: {form(t, 1), form(t, 2)} - {""}
    got = {(r.p, r.c) for r in J.contained(spark.createDataFrame(ps, "p int, text string"), spark.createDataFrame(cs, "c int, text string")).collect()}
    assert got == {(i, j) for i, t in ps for j, u in cs if any(y in x for x in sides(t) for y in sides(u))}
    head = spark.createDataFrame([(20, "**Title here now**", "a", "meta"), (21, "The quick brown fox", "a", "rule")], "c int, text string, anchor string, kind string")
    part = spark.createDataFrame([(1, "quick brown fox jumps", "a"), (2, "**Title here now**", "a"), (3, "short", "a")], "p int, text string, anchor string")
    both = head.union(spark.createDataFrame([(22, "a quick brown fox jumps up", "a", "rule"), (23, "b quick brown fox jumps up", "a", "rule")], head.schema))
    assert J.guarded_containment(part, both).count() == 0 and {r.c for r in J.guarded_containment(part, both.where("c < 23")).collect()} == {22}
    assert {r.p: r.score for r in J.lifted_scores(p, J.contained(p, c), spark.createDataFrame([(10, 0.7)], "c int, score double")).collect()} == {1: 0.7, 2: 0.0, 3: 0.0}
    rng = random.Random(3)
    iv = [(i, rng.randint(0, 2), x := rng.randint(0, 90), x + rng.randint(0, 30)) for i in range(60)]
    df = spark.createDataFrame(iv, "id int, key int, lo int, hi int")
    got = Counter((r.ida, r.idb) for r in J.interval_overlaps(df, df, 7).collect())
    assert got == Counter((a[0], b[0]) for a in iv for b in iv if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    m = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (0, 2, 5), (0, 3, 6), (0, 3, 7)], "g int, a int, b int")
    assert J.maximum_matching(m, "g").count() == 3
    for seed in range(6):
        rng = random.Random(seed)
        es = {(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(1, 40))}
        best = max(bin(mask).count("1") for mask in _matchings(sorted(es)))
        got = J.maximum_matching(spark.createDataFrame([(0, a, b) for a, b in es], "g int, a int, b int"), "g").collect()
        assert len(got) == best == len({r.a for r in got}) == len({r.b for r in got}) and {(r.a, r.b) for r in got} <= es
    chain = [(0, i, i) for i in range(4000)] + [(0, i, i + 1) for i in range(4000)]
    assert J.maximum_matching(spark.createDataFrame(chain, "g int, a int, b int"), "g").count() == 4000
    boxes = [(i, a := rng.randint(0, 60), a + rng.randint(0, 9), b := rng.randint(0, 60), b + rng.randint(0, 40)) for i in range(80)]
    e = spark.createDataFrame(boxes, "id int, nlo int, nhi int, plo int, phi int")
    meet = lambda x, y: x[1] <= y[2] and y[1] <= x[2] and x[3] <= y[4] and y[3] <= x[4]
    assert {r.id for r in J.edge_overlap(e.where("id < 40"), e.where("id >= 40"), 7).collect()} == {x[0] for x in boxes[:40] if any(meet(x, y) for y in boxes[40:])}
    assert {r.id for r in H.shadowed(e, 7).collect()} == {x[0] for x in boxes if any(meet(x, y) for y in boxes if x is not y)}
    with pytest.raises(ValueError):
        J.rejoined(p.select("p"), p.where("p > 1").select("p"), "p")


def test_scoring(spark):
    pairs = spark.createDataFrame([("q", 1, "a", "x", 0.9), ("q", 1, "a", "y", 0.5), ("q", 1, "b", "x", 0.8)], "q string, id int, name string, own string, credit double")
    assert sorted((r.name, r.own) for r in S.greedy_credits(pairs).collect()) == [("a", "x")]
    rng = random.Random(2)
    many = [("q", i, n, o, rng.randint(1, 3) / 2) for i in range(12) for n in "abc" for o in rng.sample("uvwx", rng.randint(0, 4))]
    want = set()
    for i in range(12):
        taken = set()
        for n in "abc":
            free = sorted((-c, o) for _, j, m, o, c in many if j == i and m == n and o not in taken)
            if free:
                taken.add(free[0][1])
                want.add((i, n, free[0][1], -free[0][0]))
    assert {(r.id, r.name, r.own, r.credit) for r in S.greedy_credits(spark.createDataFrame(many, pairs.schema)).collect()} == want
    q = spark.createDataFrame([("q", "act", "share_data"), ("q", "situation", "risk")], "q string, slot string, name string")
    a = spark.createDataFrame([(1, "must_share_data__operator"), (1, "risk"), (2, "risk"), (2, "may_risk")], "id int, name string")
    e = sorted((r.id, r.slot, r.name, r.how) for r in S.evidence(q, a).collect())
    assert e == [(1, "act", "must_share_data__operator", "stem"), (1, "situation", "risk", "name"), (2, "situation", "may_risk", "stem"), (2, "situation", "risk", "name")]
    blocked = S.evidence(q, a, spark.createDataFrame([("risk", "may_risk")], "name string, against string"))
    assert {(r.id, r.name) for r in blocked.collect() if r.slot == "situation"} == {(1, "risk"), (2, "risk")}
    ops = {r.id: r for r in S.typed_operators(S.evidence(q, a)).collect()}
    assert ops[1].act_and_situation and not ops[2].act_match and ops[2].multi_atom and ops[2].directive_atom
    w = S.bag_scores(
        spark.createDataFrame([(1, "dog", 2), (2, "cat", 1), (3, "eel", 1)], "id int, term string, tf int"), spark.createDataFrame([(1, "dog", "act"), (2, "cat", "act")], "id int, name string, kind string"),
        spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "id int, section string"), spark.createDataFrame([("q", "dog", 1)], "q string, term string, tf int"), spark.createDataFrame([("q", "dog", "act")], "q string, name string, kind string"),
    )
    got = {r.id: r for r in w.collect()}
    assert set(got) == {1, 2} and got[1].lex > 0.9 and got[1].raw > got[2].raw > 0 == got[2].lex and math.isclose(got[1].section_score, 0.45 * got[1].lex / 2 + 0.45 * got[1].atom / 2)
    assert {r.id: r.rung for r in S.rungs(S.evidence(q, a)).collect()} == {1: 0, 2: 1}
    parents = spark.createDataFrame([("dog", "animal"), ("cat", "animal")], "child string, parent string")
    w = spark.createDataFrame([("animal", 1.5), ("cat", 2.0), ("dog", 3.0)], "name string, idf double")
    s = S.best_subsumption(spark.createDataFrame([("q", "dog")], "q string, name string"), spark.createDataFrame([(1, "cat")], "id int, name string"), parents, w).first()
    assert (s.own, s.credit) == ("cat", 1.5)
    cr = spark.createDataFrame([("q", 1, "a", 1.0, ["user"]), ("q", 1, "b", 0.4, ["dev"])], "q string, id int, name string, credit double, patients array<string>")
    pr = S.patient_priced(cr, spark.createDataFrame([("q", ["dev"])], "q string, wanted array<string>"))
    assert {r.name: r.credit for r in pr.collect()} == {"a": 0.5, "b": 0.4}
    cov = spark.createDataFrame([(1, 0, 0.6), (2, 0, 0.2), (2, 1, 0.7), (3, 0, 0.1)], "p int, distance int, cover double")
    assert {r.p: r.verdict for r in S.attribute_phrase(cov).collect()} == {1: "own", 2: "segmentation", 3: "unlocated"}


def brute_conflicts(norms, cond, defeat, excl):
    atoms = sorted({a for c in cond.values() for a in c} | {a for d in defeat.values() for s in d for a in s})
    out = set()
    for mask in range(1 << len(atoms)):
        ctx = {a for i, a in enumerate(atoms) if mask >> i & 1}
        if any(a in ctx and b in ctx for a, b in excl):
            continue
        live = [n for n in norms if cond.get(n, set()) <= ctx and not any(s <= ctx for s in defeat.get(n, []))]
        out |= {(a, b) for a in live for b in live if norms[a][0] == norms[b][0] and norms[a][1] == "oblige" and norms[b][1] == "forbid"}
    return out


def test_conflicts_equal_enumeration(spark):
    for seed in range(4):
        rng = random.Random(seed)
        norms = {f"n{i}": (rng.choice("AB"), rng.choice(["oblige", "forbid"])) for i in range(7)}
        cond = {n: set(rng.sample("pqrst", rng.randint(0, 2))) for n in norms}
        defeat = {n: [set(rng.sample("pqrst", rng.randint(1, 2))) for _ in range(rng.randint(0, 2))] for n in norms}
        excl = [tuple(rng.sample("pqrst", 2)) for _ in range(2)]
        got = U.conflicts(
            spark.createDataFrame([(n, a, m, 1) for n, (a, m) in norms.items()], "norm string, act string, modality string, tier int"),
            spark.createDataFrame([(n, a) for n, c in cond.items() for a in c], "norm string, atom string"),
            spark.createDataFrame([(n, f"d{i}", a) for n, ds in defeat.items() for i, d in enumerate(ds) for a in d], "norm string, defeater string, atom string"),
            spark.createDataFrame(excl, "a string, b string"), spark.createDataFrame([], "a string, b string"),
        )
        assert {(r.n1, r.n2) for r in got.collect()} == brute_conflicts(norms, cond, defeat, excl)


def brute_standing(asserts, beats):
    opposite = {("forbid", "permit"), ("permit", "forbid"), ("forbid", "oblige"), ("oblige", "forbid")}

    def defeated(r, d, a):
        return any(a2 == a and (d2, d) in opposite and (r2, r) in beats and not defeated(r2, d2, a2) for r2, d2, a2 in asserts)

    return {(r, d, a): not defeated(r, d, a) for r, d, a in asserts}


def test_standing_equals_the_recursive_definition(spark):
    rng = random.Random(7)
    asserts = {(p, rng.choice(["forbid", "oblige", "permit"]), rng.choice("AB")) for p in range(9)}
    beats = {(x, y) for x in range(9) for y in range(x + 1, 9) if rng.random() < 0.5}
    a, b = spark.createDataFrame(sorted(asserts), "p int, d string, act string"), spark.createDataFrame(sorted(beats), "x int, y int")
    assert {(r.p, r.d, r.act): r.stands for r in U.standing(a, b).collect()} == brute_standing(asserts, beats)
    with pytest.raises(ValueError):
        U.standing(a, spark.createDataFrame([(1, 2), (2, 1)], "x int, y int"))
    text = lambda df, *cs: df.select(*(F.col(c).cast("string").alias(c) if c in cs else c for c in df.columns))
    acts = spark.createDataFrame([("A",), ("B",)], "act string")
    got = {(r.dropped, r.d, r.act, r.change) for r in U.difference_makers(text(a, "p"), text(b, "x", "y"), acts, [str(p) for p in range(9)]).collect()}
    status = lambda drop: {(d, x) for (p, d, x), ok in brute_standing({k for k in asserts if k[0] != drop}, {k for k in beats if drop not in k}).items() if ok}
    base = status(None)
    assert got == {(str(p), d, x, c) for p in range(9) for c, diff in (("lost", base - status(p)), ("gained", status(p) - base)) for d, x in diff}


def test_rules(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    assert {(r.a, r.b): r.hops for r in U.reachable(e).collect()}[(1, 1)] == 3
    assert {r.node for r in U.cycles(e).collect()} == {1, 2, 3}
    hits = U.engaged(spark.createDataFrame([("n1", "tell_lie"), ("n2", "help")], "node string, act string"), spark.createDataFrame([("q", "deceive")], "q string, act string"), spark.createDataFrame([("tell_lie", "deceive")], "a string, b string"))
    assert [(r.q, r.node) for r in hits.collect()] == [("q", "n1")]
    wall = (spark.createDataFrame([("n1", "user")], "node string, value string"), spark.createDataFrame([("q", "public")], "q string, value string"))
    assert [(r.q, r.node, r.party) for r in U.wall(hits, *wall, "party").collect()] == [("q", "n1", False)]
    r = U.relevant(hits, {"party": wall}).first()
    assert not r.relevant and r.blocked_by == ["party"]
    assert {(r.a, r.b) for r in U.feedback_edges(e.withColumn("rank", F.col("a"))).collect()} == {(3, 1)}
    assert {r.node for r in U.reached(e, spark.createDataFrame([(4,), (9,)], "node int")).collect()} == {4, 5, 9} and U.cyclic_core(e.where("a > 1")).count() == 0
    with pytest.raises(ValueError):
        U.covering_set(spark.createDataFrame([(1024, 1)], "mask bigint, derived int"), 10)
    cover = U.covering_set(spark.createDataFrame([(m, m >> 11 & 1) for m in (0, 2048, 1, 3)], "mask bigint, derived int"), 12).collect()
    assert [(r.atom, r.m1, r.m2) for r in cover] == [(11, 0, 2048)]
    ren = U.rename_candidates(spark.createDataFrame([("n", ["a", "b"])], "name string, words array<string>"), spark.createDataFrame([("p", ["a"]), ("o", ["a", "b", "c"]), ("z", ["q"])], "name string, words array<string>"))
    assert [(r.provide, r.rank) for r in ren.orderBy("rank").collect()] == [("o", 1), ("p", 2)]
    f = U.state_machine_faults(spark.createDataFrame([("open", "done"), ("open", "stuck"), ("stuck", "stuck"), ("lost", "done")], "a string, b string"), "open", ["done"])
    assert sorted((r.state, r.fault) for r in f.collect()) == [("lost", "unreachable"), ("stuck", "reaches no end")]
    kept, out = U.valid_extraction(spark.createDataFrame([("n", "A", "oblige"), ("m", "A", "wish"), ("k", "A", "forbid")], "norm string, act string, modality string"), spark.createDataFrame([("k", "ghost")], "norm string, atom string"), spark.createDataFrame([("x",)], "atom string"))
    assert [r.norm for r in kept.collect()] == ["n"] and {r.norm: r.reason for r in out.collect()} == {"m": "modality", "k": "unknown condition"}
    o = U.outcomes(spark.createDataFrame([(1, "forbid", "A", True), (2, "oblige", "B", True), (3, "oblige", "C", False)], "p int, d string, act string, stands boolean"), spark.createDataFrame([("A",), ("B",)], "act string"), spark.createDataFrame([("C",)], "act string"))
    assert {(r.p, r.outcome) for r in o.collect()} == {(1, "violation"), (2, "fulfils")}


def test_sets_and_logs(spark):
    s = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "stratum string, n int")
    assert {r.stratum: r.k for r in D.allocate(s, 4).collect()} == {"a": 2, "b": 1, "c": 1}
    names = L.final_names(spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "x", "a"), (0, "c", "z")], "seq int, old string, new string"))
    assert {r.old: r.new for r in names.collect()} == {"a": "c", "b": "c", "x": "a", "c": "z"}
    assert {r.id: r.wave for r in L.frontier_order(spark.createDataFrame([("p", "a"), ("p", "q"), ("q", "b"), ("u", "v"), ("v", "u")], "parent string, child string")).collect()} == {"a": 0, "b": 0, "q": 1, "p": 2}
    u = spark.createDataFrame([(1,), (2,)], "id int")
    j = spark.createDataFrame([("x",), ("y",)], "judge string")
    v = spark.createDataFrame([(1, "x", 2)], "id int, judge string, verdict int")
    assert sorted((r.id, r.judge, r.verdict) for r in L.restored_universe(u, j, v).collect()) == [(1, "x", 2), (1, "y", 0), (2, "x", 0), (2, "y", 0)]
    with pytest.raises(ValueError):
        L.restored_universe(u, j, spark.createDataFrame([(9, "x", 2)], "id int, judge string, verdict int"))
    neg = D.negatives(spark.createDataFrame([(i, i / 10) for i in range(50)], "id int, score double"), 5, 10).collect()
    assert Counter(r.pool for r in neg) == {"near": 5, "field": 10} and {r.p for r in neg if r.pool == "field"} == {10 / 45}
    assert sum(r.n for r in D.to_budget(spark.createDataFrame([(c, 3) for c in "abcdef"], "name string, n int"), 7).collect()) == 9


def test_resampling(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(200)], "id int, x double")
    r = R.bootstrap_mean(df, 200).first()
    assert r.mean == 4.5 and 3.8 < r.low < 4.5 < r.high < 5.2
    cells = spark.createDataFrame([("c", i, i % 2 == 0, i % 2 == 0 or i % 10 == 1, i % 3 == 0) for i in range(120)], "cell string, id int, gold boolean, a boolean, b boolean")
    r = R.paired_bootstrap(cells, 100).first()
    assert r.low < r.delta < r.high and r.low > 0
    assert 0 < R.noise_floor(cells.drop("b"), 100).first().floor < 0.3
    p = R.set_null(df, df.where("x >= 8").select("id"), 99).first()
    assert p.observed == 8.5 and p.p == 0.01


def test_more_resampling(spark):
    rng = random.Random(5)
    v = spark.createDataFrame([(i % 20, float(i % 20 + rng.random())) for i in range(400)], "cluster int, x double")
    r = R.cluster_bootstrap(v, 200).first()
    assert r.low < r.mean < r.high and r.high - r.low > 2
    rows = [(i, i % 3 == 0, (i % 3 == 0) + rng.random(), rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, gold boolean, a double, b double")
    r = R.paired_auc(df, 60).first()
    brute = lambda k: sum(x[k] > y[k] for x in rows if x[1] for y in rows if not y[1]) / (50 * 100)
    assert math.isclose(r.delta, brute(2) - brute(3)) and r.low < r.delta < r.high
    d = [x.delta for x in R.auc_null(df.withColumn("cell", F.lit("c")), 40).collect()]
    assert len(d) == 40 and abs(sum(d) / 40) < 0.05
    assert one(spark, X.banned_keys(F.col("t"), ["key", "role"]), t='{"a": {"key": 1}, "b": "say \\\\"role\\\\": x"}'.replace("\\\\", chr(92))) == ["key"]


def test_loaders(spark, tmp_path):
    shapes = ['{"clauses": [{"clause_id": "c1", "atoms": [{"name": "a", "kind": "k"}, {"kind": "k"}]}]}', '{"atoms": [{"name": "a", "kind": "k", "quote_spans": [{"clause_id": "c1"}]}]}', '[{"name": "a", "kind": "k", "clause_id": "c1"}]']
    for s in shapes:
        assert [tuple(r) for r in O.annotations(spark.createDataFrame([(s,)], "json string")).collect()] == [("c1", "a", "k")]
    q = O.query_atoms(spark.createDataFrame([('{"_note": [{"name": "x"}], "help": [{"name": "a", "kind": "k"}, {"name": "b", "weight": 5}]}',)], "json string"))
    assert sorted((r.q, r.name, r.weight) for r in q.collect()) == [("help", "a", 2), ("help", "b", 5)]
    ttl = '@prefix ex: <http://e/> . @prefix owl: <http://o#> .\nex:Dog a owl:Class ; ex:subClassOf ex:Animal, ex:Pet ; ex:comment "a; dog." .\n# note\nex:Animal a owl:Class .'
    got = O.ontology(O.turtle_triples(spark.createDataFrame([("f", ttl)], "path string, text string"))).orderBy("s").collect()
    assert [(r.s, r.parents, r.gloss) for r in got] == [("http://e/Animal", [], None), ("http://e/Dog", ["http://e/Animal", "http://e/Pet"], "a; dog.")]
    xml = '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="A"><rdfs:subClassOf rdf:resource="B"/><rdfs:label>aa</rdfs:label></owl:Class></rdf:RDF>'
    (tmp_path / "o.xml").write_text(xml)
    assert [tuple(r) for r in O.xml_classes(spark, str(tmp_path / "o.xml")).collect()] == [("A", "B", "aa")]
    log = str(tmp_path / "log")
    O.append_json(spark.createDataFrame([(1, "x")], "id int, m string"), log)
    O.append_json(spark.createDataFrame([(2, "y")], "id int, m string"), log)
    (tmp_path / "log" / "bad.json").write_text("{oops\n")
    assert O.json_log(spark, log, "id int, m string").count() == 2
    html = "<title>T &amp; t</title><script>x</script><h1>H</h1><p>One <b>two</b><p>Three<li>item</li>"
    got = O.html_blocks(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r.tag, r.text) for r in got] == [("title", "T & t"), ("h1", "H"), ("p", "One two"), ("p", "Three"), ("li", "item")]


#: Of the queries with a twin this share is compared here, by a hash of the name, to keep the run short.
SHARE = 5


def test_queries_against_their_twins(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from clauselens.plans import registry

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in folder.iterdir():
        con.sql(f"create view {f.stem} as select * from '{f}'")

    def rows(pdf, columns):
        say = lambda v: "-" if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)
        return sorted((tuple(map(say, r)) for r in pdf[columns].itertuples(index=False)), key=str)

    for name, sql in registry.ORACLE.items():
        if zlib.crc32(name.encode()) % SHARE:
            continue
        want = con.sql(sql).df()
        columns = sorted(want.columns)
        got = registry.QUERIES[name](spark, str(folder)).toPandas()
        assert sorted(got.columns) == columns, name
        assert rows(got, columns) == rows(want, columns), name
