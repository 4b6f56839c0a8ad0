"""What norms mean for a behaviour: engagement, applicability, reach, coherence, mutation, routing."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, in_order, near, tiled
from ..workers import python_ready
from .components import components
from .rules import difference_makers, outcomes, reachable


def act_engagement(asserts: DataFrame, acts: DataFrame, variants: DataFrame) -> DataFrame:
    """(q, p): passages that assert a status on an act of the behaviour or a variant of it in scope. asserts (p, d, act), acts (q, act), variants (act, variant)."""
    wanted = acts.union(acts.join(variants, "act").select("q", "variant")).distinct()
    return asserts.join(wanted, "act").select("q", "p").distinct()


def applicability(heads: DataFrame, bodies: DataFrame, situation: DataFrame) -> DataFrame:
    """(q, p): passages whose head or body touches a fact of the situation. heads and bodies (p, atom), situation (q, atom).

    Queries with the same facts are one class. Only (class, p) is shuffled; the pairs come out of the last join and need no distinct.
    They come out by class, and each task has at most about TILE passages, so that files of them stay small (tiled()).
    """
    facts = cut(situation.where("atom is not null").groupBy("q").agg(F.array_sort(F.collect_set("atom")).alias("facts")))
    classes = cut(facts.select("facts").distinct().withColumn("k", F.monotonically_increasing_id()))
    asked = near(cut(facts.join(classes, "facts").select("k", "q")))
    said = heads.union(bodies)
    touched = said.join(near(cut(classes.select("k", F.explode("facts").alias("atom")))), "atom").select("k", "p")
    passages = said.agg(F.approx_count_distinct("p")).first()[0]
    return in_order(tiled(touched, passages, "p").distinct(), "k").join(asked, "k").select("q", "p")


def defeat_reach(governing: DataFrame, beats: DataFrame) -> DataFrame:
    """(q, p): passages connected with a governing one through beats, in either direction and at any depth. governing (q, p), beats (x, y).

    That is the connected component, so its label is joined, once for each query and component.
    """
    at = components(beats.select(F.col("x").alias("u"), F.col("y").alias("v"))).withColumnRenamed("node", "p")
    roots = governing.select("q", "p").join(at, "p").select("q", "root").distinct()
    return governing.select("q", "p").union(roots.join(at, "root").select("q", "p")).distinct()


def violation_reach(stood: DataFrame, done: DataFrame, omitted: DataFrame, duties: DataFrame) -> DataFrame:
    """(p, how): passages that an action violates or fulfils, and duties that a violation triggers. duties (p, act): what holds when the act is violated."""
    o = outcomes(stood, done, omitted)
    more = duties.join(o.where("outcome = 'violation'").select("act").distinct(), "act").select("p", F.lit("contrary to duty").alias("how"))
    return o.select("p", F.col("outcome").alias("how")).union(more).distinct()


def behaviour_conflicts(behaviour: DataFrame, document: DataFrame) -> DataFrame:
    """(q, act, kind): where what a behaviour does meets what the document says. behaviour (q, act, form), document (act, d); form is does, avoids or permits.

    kind: act (does what is forbidden), duality (avoids what is obliged), permission (permits what is forbidden), silence (no status at all).
    """
    j = behaviour.join(document.select("act", "d").distinct(), "act", "left")
    kind = F.when(F.col("d").isNull(), "silence").when((F.col("form") == "does") & (F.col("d") == "forbid"), "act").when((F.col("form") == "avoids") & (F.col("d") == "oblige"), "duality").when((F.col("form") == "permits") & (F.col("d") == "forbid"), "permission")
    return j.select("q", "act", kind.alias("kind")).where("kind is not null").distinct()


def behaviour_acts(declared: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(q, act): the acts that a behaviour's statements name, as far as the vocabulary knows them. declared (q, does: text such as act(x, y) or -act), vocabulary (act)."""
    head = F.regexp_extract("does", r"^\s*(?:-|not\s+)?([a-z][a-z0-9_]*)", 1)
    return declared.select("q", head.alias("act")).where("act <> ''").distinct().join(vocabulary.select("act").distinct(), "act", "left_semi").select("q", "act")


#: The encodings of relevance by name. Each takes tables and gives (q, p) or, where no query is named, rows with p.
ENCODINGS: dict[str, Callable[..., DataFrame]] = {
    "engagement": act_engagement, "applicability": applicability, "difference": difference_makers, "defeat": defeat_reach, "violation": violation_reach,
}


def encoded(name: str, *tables: DataFrame) -> DataFrame:
    """(encoding, p): the passages that an encoding of ENCODINGS finds in its tables; an unknown name raises KeyError."""
    out = ENCODINGS[name](*tables)
    return out.select(F.lit(name).alias("encoding"), out["p" if "p" in out.columns else "dropped"].cast("string").alias("p")).distinct()


# --- definitions as small Boolean expressions -----------------------------------------------------


def _names(e) -> set[str]:
    return {e} if isinstance(e, str) else set().union(*map(_names, next(iter(e.values())) if isinstance(next(iter(e.values())), list) else [next(iter(e.values()))]))


def _value(e, world: dict[str, bool]) -> bool | None:
    """Truth of an expression where only some atoms are settled; None while it is open."""
    if isinstance(e, str):
        return world.get(e)
    (op, x), = e.items()
    if op == "not":
        v = _value(x, world)
        return None if v is None else not v
    stop = op == "any"
    seen = [_value(k, world) for k in x]
    return stop if stop in seen else None if None in seen else not stop


def _settled(world: dict[str, bool], atom: str, value: bool, against: dict[str, set], needs: dict[str, set], needed: dict[str, set]) -> dict[str, bool] | None:
    """world with an atom settled and all that follows from the axioms, or None on a contradiction."""
    world, todo = dict(world), [(atom, value)]
    while todo:
        a, v = todo.pop()
        if world.setdefault(a, v) != v:
            return None
        for b, w in ([(x, False) for x in against.get(a, ())] + [(x, True) for x in needs.get(a, ())]) if v else [(x, False) for x in needed.get(a, ())]:
            if b not in world:
                todo.append((b, w))
            elif world[b] != w:
                return None
    return world


def check_definition(expression, known: set[str], exclusions: list[tuple[str, str]], requires: list[tuple[str, str]] = ()) -> str | None:
    """The first fault of an expression of all, any and not over atoms, or None: unknown atoms, unsatisfiable under the axioms.

    Atoms are settled one by one; what the axioms force follows at once, and a branch ends as soon as
    the expression is false. When it is true, all open atoms may be false, which breaks no axiom.
    """
    names = _names(expression)
    if names - known:
        return "unknown: " + ", ".join(sorted(names - known))
    against, needs, needed = defaultdict(set), defaultdict(set), defaultdict(set)
    for a, b in exclusions:
        against[a].add(b)
        against[b].add(a)
    for a, b in requires:
        needs[a].add(b)
        needed[b].add(a)
    order, stack = sorted(names), [{}]
    while stack:
        world = stack.pop()
        now = _value(expression, world)
        if now:
            return None
        if now is None:
            atom = next(a for a in order if a not in world)
            stack += [w for v in (False, True) if (w := _settled(world, atom, v, against, needs, needed)) is not None]
    return "unsatisfiable"


def check_definitions(rows: DataFrame, known: set[str], exclusions: list[tuple[str, str]], requires: list[tuple[str, str]] = ()) -> DataFrame:
    """(id, fault) of definitions (id, expression as JSON); a sound one has a null fault. A search over a few atoms for each row, in Arrow batches."""
    python_ready(rows.sparkSession)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda t: check_definition(json.loads(t), known, exclusions, requires))

    fault = F.pandas_udf(each, "string")

    return rows.select("id", fault("expression").alias("fault"))


def rule_faults(conditions: DataFrame, defeaters: DataFrame, exclusions: DataFrame, requires: DataFrame) -> DataFrame:
    """(norm, fault): dead rules, whose conditions with all they require hold an excluded pair, and rules that a defeater always beats.

    conditions (norm, atom), defeaters (norm, defeater, atom), exclusions (a, b), requires (a, b).
    """
    need = reachable(requires).select(F.col("a").alias("atom"), F.col("b").alias("more"))
    closed = conditions.select("norm", "atom").union(conditions.join(need, "atom").select("norm", "more")).distinct()
    dead = closed.withColumnRenamed("atom", "a").join(exclusions, "a").join(closed.withColumnRenamed("atom", "b"), ["norm", "b"]).select("norm", F.lit("dead").alias("fault"))
    have = closed.groupBy("norm").agg(F.collect_set("atom").alias("have"))
    beaten = defeaters.groupBy("norm", "defeater").agg(F.collect_set("atom").alias("need")).join(have, "norm").where(F.size(F.array_except("need", "have")) == 0).select("norm", F.lit("always defeated").alias("fault"))
    return dead.union(beaten).distinct()


def mutated(facts: DataFrame, replacements: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(scenario, id, change): what a relevance gains and loses when one fact of a situation is replaced by another.

    facts (atom), replacements (scenario, atom, by). evaluate takes (scenario, atom) and returns (scenario, id); all scenarios run in one plan.
    """
    scenarios = replacements.select("scenario").distinct()
    every = facts.crossJoin(scenarios).join(replacements, ["scenario", "atom"], "left").select("scenario", F.coalesce("by", "atom").alias("atom"))
    base = evaluate(facts.select(F.lit("").alias("scenario"), "atom")).select("id").distinct()
    now = evaluate(every).select("scenario", "id").distinct()
    was = base.crossJoin(scenarios).select("scenario", "id")
    return was.join(now, ["scenario", "id"], "left_anti").select("scenario", "id", F.lit("lost").alias("change")).union(now.join(was, ["scenario", "id"], "left_anti").select("scenario", "id", F.lit("gained")))


def minimal_moves(scenarios: DataFrame, wanted: DataFrame) -> DataFrame:
    """(move, fixed, broken): single moves that turn some wrong verdict right, with what they break. scenarios (move, id, verdict), '' being no move; wanted (id, verdict)."""
    w = wanted.select("id", F.col("verdict").alias("want"))
    base = scenarios.where("move = ''").select("id", F.col("verdict").alias("was"))
    j = scenarios.where("move <> ''").join(base, "id").join(w, "id")
    right, before = F.col("verdict") == F.col("want"), F.col("was") == F.col("want")
    return j.groupBy("move").agg(F.count(F.when(right & ~before, 1)).alias("fixed"), F.count(F.when(~right & before, 1)).alias("broken")).where("fixed > 0")


def routed(failures: DataFrame, steps: DataFrame, start: str = "open", most: int = 8) -> DataFrame:
    """(id, state): where failures end that walk a transition table by their event kinds in order. failures (id, seq, kind), steps (state, kind, next); an unknown kind keeps the state. Up to ``most`` events are read at a time, round by round."""
    state = cut(failures.select("id").distinct().withColumn("state", F.lit(start)))
    table = steps.select("state", "kind", "next")
    longest = failures.agg(F.max("seq")).first()[0]
    for k in range(0, (longest if longest is not None else -1) + 1):
        now = failures.where(F.col("seq") == k).select("id", "kind")
        state = state.join(now, "id", "left").join(table, ["state", "kind"], "left").select("id", F.coalesce("next", "state").alias("state"))
        if k % most == most - 1:
            state = cut(state)
    return state


def competency(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(question, fault): missing and unexpected answers, and questions whose run gave nothing. expected and observed (question, answer)."""
    ran = observed.select("question").distinct()
    silent = expected.select("question").distinct().join(ran, "question", "left_anti").select("question", F.lit("no run").alias("fault"))
    key = ["question", "answer"]
    gone = expected.join(ran, "question", "left_semi").join(observed, key, "left_anti").select("question", F.concat(F.lit("missing "), "answer"))
    extra = observed.join(expected, key, "left_anti").select("question", F.concat(F.lit("unexpected "), "answer"))
    return silent.union(gone).union(extra)


#: A cycle's phases and where each leads.
PHASES = (("OPEN", "PREDICT"), ("PREDICT", "IMPLEMENT"), ("IMPLEMENT", "MEASURE"), ("MEASURE", "ADJUDICATE"), ("ADJUDICATE", "CENSUS"), ("ADJUDICATE", "DECIDE"), ("CENSUS", "DECIDE"), ("DECIDE", "CLOSE"))


def phase_faults(log: DataFrame) -> DataFrame:
    """(cycle, seq, fault) of moves that the phases don't allow, unless overridden. log (cycle, seq, phase, override boolean)."""
    from pyspark.sql import Window

    steps = log.sparkSession.createDataFrame(PHASES, "was string, phase string").withColumn("ok", F.lit(True))
    w = Window.partitionBy("cycle").orderBy("seq")
    j = log.withColumn("was", F.lag("phase").over(w)).join(steps, ["was", "phase"], "left")
    bad = F.when(F.col("was").isNull(), F.col("phase") != "OPEN").otherwise(F.col("ok").isNull()) & ~F.coalesce("override", F.lit(False))
    return j.where(bad).select("cycle", "seq", F.concat(F.coalesce("was", F.lit("start")), F.lit(" to "), "phase").alias("fault"))


# --- why a rule didn't fire -----------------------------------------------------------------------


def silence(nodes: DataFrame, bodies: DataFrame, true: DataFrame) -> DataFrame:
    """(node, missing): for silent nodes the sorted conditions of their rules that don't hold; empty if all do. nodes (node), bodies (node, rule, name), true (node, name)."""
    rows = nodes.select("node", F.lit(None).alias("name"), F.lit("n").alias("of"))
    for of, side in (("b", bodies), ("t", true)):  # no join: these tables are large however small an estimate calls them, and none may be broadcast
        rows = rows.union(side.where("node is not null and name is not null").select("node", "name", F.lit(of)))
    is_ = lambda of: F.bool_or(F.col("of") == of)
    each = rows.repartition("node").groupBy("node", "name").agg(is_("n").alias("asked"), (is_("b") & ~is_("t")).alias("lacks"))
    missing = F.array_sort(F.collect_set(F.when(F.col("lacks"), F.col("name"))))
    return each.groupBy("node").agg(F.bool_or("asked").alias("asked"), missing.alias("missing")).where("asked").select("node", "missing")


#: What each wall asks, for readers.
WALL_QUESTIONS = {"actor": "whose conduct is this rule about?", "protects": "whom does this rule protect?", "governs": "what does this rule govern?"}


def explained(decisions: DataFrame, nodes: DataFrame, acts: DataFrame) -> DataFrame:
    """(q, node, text): each decision in plain words. The first reason that applies is given: matching acts, the first wall that stopped it, or no shared act.

    decisions (q, node, relevant, blocked_by array) as relevant() gives them, for any pairs, hits or not; nodes (node, claim, acts array),
    acts (q, acts array). Names are read with spaces for underscores.
    """
    say = lambda names: F.array_join(F.transform(F.array_sort(names), lambda a: F.translate(a, "_", " ")), ", ")
    j = decisions.join(nodes.select("node", "claim", F.col("acts").alias("own")), "node").join(acts.select("q", F.col("acts").alias("wanted")), "q")
    shared = F.array_intersect("own", "wanted")
    asked = F.create_map(*(F.lit(x) for pair in WALL_QUESTIONS.items() for x in pair))
    wall = F.try_element_at(F.col("blocked_by"), F.lit(1))
    head = F.concat(F.when(F.col("relevant"), "FLAGGED for ").otherwise("NOT FLAGGED for "), F.translate(F.col("q").cast("string"), "_", " "), F.lit(".\n"))
    why = (
        F.when(F.col("relevant") & (F.size(shared) > 0), F.concat(F.lit("It is about "), say(shared), F.lit(".")))
        .when(F.col("relevant"), F.lit("It shares no act by name; a broader act or another channel leads to it."))
        .when(F.size("blocked_by") > 0, F.concat(F.lit("Stopped at: "), F.coalesce(F.try_element_at(asked, wall), wall)))
        .when(F.size("own") == 0, F.lit("It states no rule about any act."))
        .otherwise(F.concat(F.lit("Its rules are about "), say(F.col("own")), F.lit("; the behaviour involves "), say(F.col("wanted")), F.lit(".")))
    )
    return j.select("q", "node", F.concat(head, F.lit("Claim: "), F.coalesce("claim", F.lit("")), F.lit("\n"), why).alias("text"))


# --- declarations learned from labels -------------------------------------------------------------


def log_loss(p: Column, label: Column) -> Column:
    """Mean negative log-likelihood of probabilities, kept 1e-6 off 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.avg(-F.when(label == 1, F.log(q)).otherwise(F.log(1 - q)))


def folds(rows: DataFrame, id: str, n: int = 5, seed: int = 17) -> DataFrame:
    """rows with fold: dealt out in hash order inside each label, so every fold has its share of both."""
    from .ordered import placed
    from .sets import hashed

    return placed(rows, ["label"], [hashed(seed, id), id], "_i").withColumn("fold", ((F.col("_i") - 1) % n).cast("int")).drop("_i")


def calibrated_baselines(rows: DataFrame) -> DataFrame:
    """One row: prior and instrument, mean held-out log losses of two yardsticks. rows (fold, label 0 or 1, engaged boolean).

    prior predicts the label's share in the other folds; instrument the smoothed share among rows with the same engagement there.
    """
    per = rows.groupBy("fold", "engaged").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    total = per.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    mine = per.groupBy("fold").agg(F.sum("n").alias("nf"), F.sum("k").alias("kf"))
    prior = mine.crossJoin(total).select("fold", ((F.col("k") - F.col("kf")) / (F.col("n") - F.col("nf"))).alias("prior"))
    arm = per.groupBy("engaged").agg(F.sum("n").alias("na"), F.sum("k").alias("ka"))
    other = per.select("fold").distinct().crossJoin(arm).join(per, ["fold", "engaged"], "left").fillna(0, ["n", "k"])
    tuned = other.select("fold", "engaged", ((F.col("ka") - F.col("k") + 1) / (F.col("na") - F.col("n") + 2)).alias("tuned"))
    each = rows.join(prior, "fold").join(tuned, ["fold", "engaged"]).groupBy("fold").agg(log_loss(F.col("prior"), F.col("label")).alias("p"), log_loss(F.col("tuned"), F.col("label")).alias("t"))
    return each.agg(F.avg("p").alias("prior"), F.avg("t").alias("instrument"))


def declaration_fit(rows: DataFrame, features: list[str], grid: list[float]) -> DataFrame:
    """(c, cv_log_loss, kept): for each strength c the mean held-out log loss of a class-balanced L1 logistic fit, and the features that a fit on all rows keeps.

    rows (fold, label 0 or 1, features). The fits are distributed; a row of the result is a point of the grid, the lowest loss is the choice.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double"))).select("fold", "label", "features")
    size = {r.label: r.n for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    total = sum(size.values())
    weight = F.when(F.col("label") == 1, total / (2 * max(1, size.get(1.0, 0)))).otherwise(total / (2 * max(1, size.get(0.0, 0))))
    data = data.withColumn("weight", weight).cache()
    numbers = sorted(r.fold for r in data.select("fold").distinct().collect())
    out = []
    for c in grid:
        fit = LogisticRegression(elasticNetParam=1.0, regParam=1 / (c * max(1, total)), weightCol="weight", maxIter=200).fit
        losses = []
        for k in numbers:
            scored = fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k))
            losses.append(scored.agg(log_loss(vector_to_array("probability")[1], F.col("label"))).first()[0])
        kept = [f for f, w in zip(features, fit(data).coefficients.toArray(), strict=True) if abs(w) > 1e-6]
        out.append((c, float(sum(losses) / max(1, len(losses))), kept))
    data.unpersist()
    return rows.sparkSession.createDataFrame(out, "c double, cv_log_loss double, kept array<string>")
