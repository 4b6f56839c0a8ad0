"""Graph, module and deontic operators on small tables."""

import json
import random

from pyspark.sql import functions as F

from clauselens.operators import deontic as T
from clauselens.operators import graphs as G
from clauselens.operators import modules as Q
from clauselens.operators import segment as S


def test_graphs(spark):
    nodes = spark.createDataFrame([("a", "Rule A", ["x"], [], 0, 1), ("b", "B takes precedence", [], ["x"], 1, 1)], "id string, claim string, provides array<string>, needs array<string>, lo int, hi int")
    lines = spark.createDataFrame([(0, "first"), (1, "second")], "line_no int, line string")
    got = {r.id: (r.kind, r.quote) for r in G.node_rows(nodes, lines).collect()}
    assert got == {"a": ("definitional", "Rule A\nprovides: x\nfirst\nsecond"), "b": ("ordering", "B takes precedence\nneeds: x\nsecond")}
    e = spark.createDataFrame([("n", 1, 2), ("n", 1, 3)], "name string, needer int, provider int")
    f = spark.createDataFrame([("m", 10, 20)], "name string, needer int, provider int")
    aligned = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "na int, nb int")
    assert [(r.needer, r.provider) for r in G.strict_edges(e, f, aligned).collect()] == [(1, 2)]
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "na int, nb int")
    groups = G.alignment_groups(pairs, spark.createDataFrame([(1, 10), (2, 12)], "a int, b int")).collect()
    assert [(r.kind, r.node, r.others) for r in groups] == [("split", 1, [10, 11])]
    c = spark.createDataFrame([("mustnot_share__user", "k", "r", 1, 3, "user")], "c_name string, c_kind string, c_role string, c_lo int, c_hi int, c_principal string")
    r = spark.createDataFrame([("share__user", "k", "r", 2, 9, "user")], "r_name string, r_kind string, r_role string, r_lo int, r_hi int, r_principal string")
    assert {level: c.join(r, G.span_match(level)).count() for level in ("span", "stem", "deontic", "exact")} == {"span": 1, "stem": 1, "deontic": 0, "exact": 0}
    doc = spark.createDataFrame([(1, "# A {authority=user}\n## B\n# C")], "doc_id int, text string")
    assert [r.authority for r in G.authority(S.sections(S.marked_lines(S.lines(doc)))).where("section > 0").orderBy("section").collect()] == ["user", "user", None]


def test_modules(spark):
    v = spark.createDataFrame([("share_data", ["share", "data"]), ("x", ["x"]), ("data", ["data"])], "name string, parts array<string>")
    got = Q.prefiltered(v, F.array(F.lit("data")), 2).orderBy(F.desc("score")).collect()
    assert [r.name for r in got] == ["data", "share_data"] and round(got[0].hidden, 3) == 0.333
    b = Q.best_atom(spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "p int, words array<string>"), spark.createDataFrame([("n", 1, ["a"]), ("m", 0, ["b"])], "name string, pos int, words array<string>"))
    assert [(r.p, r.name, r.cover) for r in b.collect()] == [(1, "m", 0.5)]
    rows = [(s, st, i) for s in (0, 1) for st, k in (("agree", 20), ("split", 3)) for i in range(k)]
    d = Q.stratified_draw(spark.createDataFrame([(s, st, f"{s}{st}{i}") for s, st, i in rows], "side int, stratum string, id string"), 10)
    assert {(r.side, r.stratum): r.n for r in d.groupBy("side", "stratum").agg(F.count("*").alias("n")).collect()} == {(s, st): n for s in (0, 1) for st, n in (("agree", 7), ("split", 3))}
    c = spark.createDataFrame([(i, 0, i // 6, "k" if i % 2 else "j", i % 3) for i in range(30)], "id int, doc int, section int, kind string, signature int")
    t = Q.readback_trials(c, 4).collect()
    assert len(t) == 120 and sum(r.answer for r in t) == 30 and all(r.option == r.id for r in t if r.answer)


def test_deontic(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    e = T.act_engagement(df([(1, "forbid", "lie"), (2, "permit", "joke")], "p int, d string, act string"), df([("q", "deceive")], "q string, act string"), df([("deceive", "lie")], "act string, variant string"))
    assert [r.p for r in e.collect()] == [1]
    assert [r.p for r in T.applicability(df([(1, "a")], "p int, atom string"), df([(2, "b")], "p int, atom string"), df([("q", "b")], "q string, atom string")).collect()] == [2]
    v = T.violation_reach(df([(1, "forbid", "A", True)], "p int, d string, act string, stands boolean"), df([("A",)], "act string"), df([], "act string"), df([(9, "A")], "p int, act string"))
    assert {(r.p, r.how) for r in v.collect()} == {(1, "violation"), (9, "contrary to duty")}
    f = T.rule_faults(df([("n", "a"), ("m", "c"), ("k", "d")], "norm string, atom string"), df([("m", "x", "c")], "norm string, defeater string, atom string"), df([("a", "b")], "a string, b string"), df([("a", "b")], "a string, b string"))
    assert {(r.norm, r.fault) for r in f.collect()} == {("n", "dead"), ("m", "always defeated")}
    m = T.mutated(df([("rain",), ("cold",)], "atom string"), df([("dry", "rain", "sun")], "scenario string, atom string, by string"), lambda s: s.select("scenario", F.concat(F.lit("m_"), "atom").alias("id")))
    assert {(r.scenario, r.id, r.change) for r in m.collect()} == {("dry", "m_rain", "lost"), ("dry", "m_sun", "gained")}
    mm = T.minimal_moves(df([("", 1, False), ("", 2, True), ("m", 1, True), ("m", 2, True), ("k", 1, False), ("k", 2, False)], "move string, id int, verdict boolean"), df([(1, True), (2, True)], "id int, verdict boolean"))
    assert [(r.move, r.fixed, r.broken) for r in mm.collect()] == [("m", 1, 0)]
    r = T.routed(df([(1, 0, "bad"), (1, 1, "fix"), (2, 0, "odd")], "id int, seq int, kind string"), df([("open", "bad", "repair"), ("repair", "fix", "done")], "state string, kind string, next string"))
    assert {x.id: x.state for x in r.collect()} == {1: "done", 2: "open"}
    p = T.phase_faults(df([("c", 0, "OPEN", False), ("c", 1, "MEASURE", False), ("c", 2, "CLOSE", True)], "cycle string, seq int, phase string, override boolean"))
    assert [(x.seq, x.fault) for x in p.collect()] == [(1, "OPEN to MEASURE")]
    d = T.check_definitions(df([(1, json.dumps({"all": ["a", {"not": "b"}]})), (2, json.dumps({"all": ["a", "b"]})), (3, json.dumps("z"))], "id int, expression string"), {"a", "b"}, [("a", "b")])
    assert {x.id: x.fault for x in d.collect()} == {1: None, 2: "unsatisfiable", 3: "unknown: z"}


def test_check_definition_equals_truth_tables():
    rng = random.Random(1)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice("abcd")
        op = rng.choice(["all", "any", "not"])
        return {op: make(depth - 1)} if op == "not" else {op: [make(depth - 1) for _ in range(rng.randint(1, 3))]}

    def true(e, w):
        if isinstance(e, str):
            return e in w
        (op, x), = e.items()
        return not true(x, w) if op == "not" else (all if op == "all" else any)(true(k, w) for k in x)

    for _ in range(60):
        e, excl = make(3), [tuple(rng.sample("abcd", 2))]
        worlds = [{a for i, a in enumerate("abcd") if m >> i & 1} for m in range(16)]
        ok = any(true(e, w) for w in worlds if not any(a in w and b in w for a, b in excl))
        assert (T.check_definition(e, set("abcd"), excl) is None) == ok
