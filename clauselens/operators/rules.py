"""Norms, defeat, closure, walls, lint findings and small enumerations over tables.

Rule programs are rows, not text: norms (norm, act, modality, tier), conditions (norm, atom),
defeaters (norm, defeater, atom), exclusions (a, b), incompatible acts (a, b). Recursion runs as
rounds of joins with each round cut, and stops when nothing is new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grammar import FORCES
from ..lineage import cut

# --- conflicts ------------------------------------------------------------------------------------


def _atoms_of(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("atom")).alias(name))


def conflicts(norms: DataFrame, conditions: DataFrame, defeaters: DataFrame, exclusions: DataFrame, incompatible: DataFrame) -> DataFrame:
    """(n1, n2, kind, witness, tier, resolved) of every pair of norms that can bind at once.

    kind: obliged_and_forbidden on one act, or incompatible_obligations. Adding context can only
    defeat more, so the union of both norms' conditions is the smallest scenario and decides the
    pair: no excluded pair in it, no defeater of either with all its conditions in it. That union is
    the witness. resolved: the tiers differ, so the lower number wins.
    """
    c = norms.join(_atoms_of(conditions, "norm", "cond"), "norm", "left").withColumn("cond", F.coalesce("cond", F.array().cast("array<string>")))
    l, r = (c.select(*(F.col(x).alias(f"{x}_{s}") for x in ("norm", "act", "modality", "tier", "cond"))) for s in "12")
    same = l.where("modality_1 = 'oblige'").join(r.where("modality_2 = 'forbid'"), F.col("act_1") == F.col("act_2")).withColumn("kind", F.lit("obliged_and_forbidden"))
    both = incompatible.union(incompatible.select("b", "a")).toDF("act_1", "act_2").distinct()
    rivals = l.where("modality_1 = 'oblige'").join(both, "act_1").join(r.where("modality_2 = 'oblige'"), "act_2").where("norm_1 < norm_2").withColumn("kind", F.lit("incompatible_obligations"))
    pairs = same.unionByName(rivals).withColumn("witness", F.array_sort(F.array_union("cond_1", "cond_2")))
    pairs = pairs.select(F.col("norm_1").alias("n1"), F.col("norm_2").alias("n2"), "kind", "witness", "tier_1", "tier_2")
    long = pairs.select("n1", "n2", "kind", F.explode("witness").alias("atom"))
    x = long.withColumnRenamed("atom", "a").join(exclusions.union(exclusions.select("b", "a")).distinct(), "a").join(long.withColumnRenamed("atom", "b"), ["n1", "n2", "kind", "b"]).select("n1", "n2", "kind").distinct()
    need = defeaters.groupBy("norm", "defeater").agg(F.array_sort(F.collect_set("atom")).alias("need"))
    beaten = [pairs.join(need.withColumnRenamed("norm", n), n).where(F.size(F.array_except("need", "witness")) == 0).select("n1", "n2", "kind") for n in ("n1", "n2")]
    bad = x.union(beaten[0]).union(beaten[1]).distinct()
    out = pairs.join(bad, ["n1", "n2", "kind"], "left_anti")
    return out.select("n1", "n2", "kind", "witness", F.least("tier_1", "tier_2").alias("tier"), (F.col("tier_1") != F.col("tier_2")).alias("resolved"))


def witness_prose(n1: Column, n2: Column, witness: Column) -> Column:
    """One sentence for a conflict."""
    when = F.when(F.size(witness) > 0, F.concat(F.lit("When "), F.array_join(witness, " and "), F.lit(", "))).otherwise(F.lit("Always, "))
    return F.concat(when, n1, F.lit(" and "), n2, F.lit(" cannot both be met."))


def valid_extraction(norms: DataFrame, conditions: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept norms, rejected (norm, reason)): a norm with an unknown modality, no act or an undeclared condition goes."""
    unknown = conditions.join(atoms, "atom", "left_anti").select("norm").distinct().withColumn("u", F.lit(True))
    j = norms.join(unknown, "norm", "left")
    reason = F.when(~F.col("modality").isin("oblige", "forbid", "permit"), "modality").when(F.col("act").isNull(), "no act").when(F.col("u"), "unknown condition")
    j = j.withColumn("reason", reason).drop("u")
    return j.where("reason is null").drop("reason"), j.where("reason is not null").select("norm", "reason")


# --- closure --------------------------------------------------------------------------------------


def reachable(edges: DataFrame, most: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(a, b, hops): the shortest number of steps from a to b, up to ``most``; cycles give (a, a). edges (a, b).

    starts (a), if given, are the only nodes that are followed. Each round writes its new pairs only.
    """
    e = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    first = e if starts is None else e.join(starts.select("a").distinct(), "a", "left_semi")
    fronts = [cut(first.withColumn("hops", F.lit(1)))]
    while (most is None or len(fronts) < most) and not fronts[-1].isEmpty():
        step = fronts[-1].select("a", F.col("b").alias("m")).join(e.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        seen = reduce(DataFrame.union, (f.select("a", "b") for f in fronts))
        fronts.append(cut(step.join(seen, ["a", "b"], "left_anti").withColumn("hops", F.lit(len(fronts) + 1))))
    return reduce(DataFrame.union, fronts)


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node) of the starts (node) and all they lead to: a search from all of them at once, a row a node. edges (a, b)."""
    e = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    fronts = [cut(starts.select("node").where("node is not null").distinct())]
    while not fronts[-1].isEmpty():
        step = fronts[-1].join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        fronts.append(cut(step.join(reduce(DataFrame.union, fronts), "node", "left_anti")))
    return reduce(DataFrame.union, fronts)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges (a, b) that are left when those that no edge leads to, or whose end leads nowhere, are taken off again and again: empty if there is no cycle."""
    e, n = cut(edges.select("a", "b").where("a is not null and b is not null").distinct()), -1
    while (now := e.count()) not in (0, n):
        n = now
        e = cut(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    return e


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops): nodes that reach themselves, with the shortest way; only the cyclic core is searched."""
    return reachable(cyclic_core(edges), most).where("a = b").select(F.col("a").alias("node"), "hops")


def feedback_edges(edges: DataFrame) -> DataFrame:
    """(a, b): edges that close a cycle when edges are added in rank order. edges (a, b, rank).

    Edges outside the cyclic core can't; the core's are added one by one within each of its weakly
    connected parts, which the rules that use this keep small.
    """
    from .components import components

    core = cyclic_core(edges)
    at = components(core.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("a"), "root")
    rows = core.join(at, "a").join(edges.groupBy("a", "b").agg(F.min("rank").alias("rank")), ["a", "b"])
    spot = F.row_number().over(Window.partitionBy("root").orderBy("rank"))

    def close(pdf):
        after: dict = {}
        out = []
        for a, b in pdf.sort_values("spot")[["a", "b"]].itertuples(index=False):
            seen, todo = {b}, [b]
            while todo and a not in seen:
                new = after.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            if a in seen:
                out.append((a, b))
            else:
                after.setdefault(a, set()).add(b)
        return type(pdf)(out, columns=["a", "b"])

    return rows.withColumn("spot", spot).select("root", "a", "b", "spot").groupBy("root").applyInPandas(close, edges.select("a", "b").schema)


def self_loops(needs: DataFrame, provides: DataFrame) -> DataFrame:
    """(node, name): a node that needs a name it provides."""
    return needs.join(provides, ["node", "name"], "left_semi").distinct()


def open_predicates(heads: DataFrame, bodies: DataFrame, given: DataFrame) -> DataFrame:
    """(name, used_by): names that rules' bodies use, that no rule concludes and nobody gives. heads and bodies (rule, name), given (name)."""
    closed = heads.select("name").union(given.select("name")).distinct()
    return bodies.join(closed, "name", "left_anti").groupBy("name").agg(F.count_distinct("rule").alias("used_by"))


# --- deontic kernel -------------------------------------------------------------------------------


def standing(asserts: DataFrame, beats: DataFrame) -> DataFrame:
    """asserts (p, d, act) with stands: whether the assertion survives defeat.

    An assertion is defeated by an opposite one (forbid against permit or oblige) on the same act
    whose passage beats its own and that stands itself. beats must have no cycle; it is evaluated
    from the unbeaten ones down, a round for each depth. Raises on a cycle.
    """
    if not cyclic_core(beats.select(F.col("x").alias("a"), F.col("y").alias("b"))).isEmpty():
        raise ValueError("beats has a cycle")
    a = cut(asserts.select("p", "d", "act").distinct())
    opposite = ((F.col("d") == "forbid") & F.col("d2").isin("permit", "oblige")) | ((F.col("d2") == "forbid") & F.col("d").isin("permit", "oblige"))
    rivals = a.join(a.select(F.col("p").alias("p2"), F.col("d").alias("d2"), "act"), "act").where(opposite)
    attack = cut(rivals.join(beats.select(F.col("x").alias("p2"), F.col("y").alias("p")).distinct(), ["p2", "p"]))
    key, rival = ["p", "d", "act"], [F.col("p2").alias("p"), F.col("d2").alias("d"), "act"]
    known = cut(a.join(attack.select(*key).distinct(), key, "left_anti").withColumn("stands", F.lit(True)))
    left = cut(a.join(known, key, "left_anti"))
    while not left.isEmpty():
        state = attack.join(left, key, "left_semi").join(known.select(*(F.col(c).alias(n) for c, n in (("p", "p2"), ("d", "d2"), ("act", "act"), ("stands", "s")))), ["p2", "d2", "act"], "left")
        g = state.groupBy(*key).agg(F.coalesce(F.bool_or("s"), F.lit(False)).alias("beaten"), F.count(F.when(F.col("s").isNull(), 1)).alias("open"))
        new = cut(g.where("beaten or open = 0").select(*key, (~F.col("beaten")).alias("stands")))
        known = cut(known.union(new))
        left = cut(left.join(new, key, "left_anti"))
    return known


def statuses(stood: DataFrame) -> DataFrame:
    """(d, act) that some standing assertion gives."""
    return stood.where("stands").select("d", "act").distinct()


def outcomes(stood: DataFrame, done: DataFrame, omitted: DataFrame) -> DataFrame:
    """(p, act, outcome): violation or fulfils, by the acts done and omitted (act)."""
    s = stood.where("stands")
    bad = s.where("d = 'forbid'").join(done, "act", "left_semi").union(s.where("d = 'oblige'").join(omitted, "act", "left_semi")).select("p", "act", F.lit("violation").alias("outcome"))
    return bad.union(s.where("d = 'oblige'").join(done, "act", "left_semi").select("p", "act", F.lit("fulfils"))).distinct()


def difference_makers(asserts: DataFrame, beats: DataFrame, acts: DataFrame, passages: list[str]) -> DataFrame:
    """(dropped, d, act, change): how the statuses of some acts change when a passage is left out.

    All scenarios run in one evaluation: acts and passages carry the scenario in their names.
    """
    spark = asserts.sparkSession
    drops = spark.createDataFrame([("",), *((p,) for p in passages)], "dropped string")
    tag = lambda c: F.concat_ws("\u0001", "dropped", c)
    a = asserts.crossJoin(drops).where("p <> dropped").select(tag("p").alias("p"), "d", tag("act").alias("act"))
    b = beats.crossJoin(drops).where("x <> dropped and y <> dropped").select(tag("x").alias("x"), tag("y").alias("y"))
    found = statuses(standing(a, b)).select(F.substring_index("act", "\u0001", 1).alias("dropped"), "d", F.substring_index("act", "\u0001", -1).alias("act")).join(acts, "act", "left_semi")
    base = found.where("dropped = ''").drop("dropped")
    full = base.crossJoin(drops.where("dropped <> ''"))
    now = found.where("dropped <> ''")
    key = ["dropped", "d", "act"]
    return full.join(now, key, "left_anti").select(*key, F.lit("lost").alias("change")).union(now.join(full, key, "left_anti").select(*key, F.lit("gained")))


# --- relevance by act -----------------------------------------------------------------------------


def engaged(node_acts: DataFrame, wanted: DataFrame, parents: DataFrame) -> DataFrame:
    """(q, node, act): a node's act is a wanted act, or above or below it in the hierarchy. node_acts (node, act), wanted (q, act), parents (a, b) child to parent."""
    up = reachable(parents).select("a", "b")
    near = up.union(up.select("b", "a")).union(node_acts.select(F.col("act").alias("a"), F.col("act").alias("b"))).distinct()
    return wanted.withColumnRenamed("act", "w").join(near.select(F.col("a").alias("w"), F.col("b").alias("act")), "w").join(node_acts, "act").select("q", "node", "act").distinct()


def wall(hits: DataFrame, annotated: DataFrame, declared: DataFrame, column: str) -> DataFrame:
    """(q, node, passes) of the hits (q, node) that a wall applies to: the query declares something and the node is annotated.

    A wall passes if some annotation agrees or is unspecified. annotated (node, value), declared (q, value).
    """
    q = declared.groupBy("q").agg(F.collect_set("value").alias("want"))
    n = annotated.groupBy("node").agg(F.collect_set("value").alias("have"))
    pairs = hits.select("q", "node").distinct().join(q, "q").join(n, "node")
    return pairs.select("q", "node", (F.array_contains("have", "unspecified") | F.arrays_overlap("want", "have")).alias(column))


def relevant(hits: DataFrame, walls: dict[str, tuple[DataFrame, DataFrame]], channel: DataFrame | None = None) -> DataFrame:
    """(q, node, relevant, blocked_by): hits behind walls (name: annotated, declared); a channel (q, node) alone suffices. Where a wall doesn't apply it passes."""
    out = hits.select("q", "node").distinct()
    for name, (annotated, declared) in walls.items():
        out = out.join(wall(hits, annotated, declared, name), ["q", "node"], "left").withColumn(name, F.coalesce(name, F.lit(True)))
    none = F.array().cast("array<string>")
    stopped = F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in walls))) if walls else none
    out = out.select("q", "node", stopped.alias("blocked_by")).withColumn("relevant", F.size("blocked_by") == 0)
    if channel is not None:
        more = channel.select("q", "node").distinct().withColumn("c", F.lit(True))
        out = out.join(more, ["q", "node"], "full_outer").select("q", "node", F.coalesce("blocked_by", none).alias("blocked_by"), (F.coalesce("relevant", F.lit(False)) | F.coalesce("c", F.lit(False))).alias("relevant"))
    return out


# --- names ----------------------------------------------------------------------------------------


def containment_edges(names: DataFrame, reserved: list[str], least: int = 2) -> DataFrame:
    """(child, parent): child is one plain modifier and the parent's name, and the parent has enough children. names (name)."""
    n = names.select("name").where(~F.col("name").contains("__") & ~F.split("name", "_")[0].isin(*FORCES, "not")).distinct()
    t = n.where(F.instr("name", "_") > 0).select(F.col("name").alias("child"), F.regexp_extract("name", "^([^_]+)_", 1).alias("m"), F.regexp_replace("name", "^[^_]+_", "").alias("parent"))
    e = t.where(~F.col("m").isin(reserved)).join(n.withColumnRenamed("name", "parent"), "parent").select("child", "parent")
    many = e.groupBy("parent").agg(F.count_distinct("child").alias("k")).where(F.col("k") >= least).select("parent")
    return e.join(many, "parent", "left_semi").select("child", "parent")


def rename_candidates(needs: DataFrame, provides: DataFrame, k: int = 3) -> DataFrame:
    """(need, provide, jaccard, rank): for each dangling need the provided names whose words are most alike; ties by name. Both: (name, words array)."""
    a = needs.select(F.col("name").alias("need"), F.explode(F.array_distinct("words")).alias("w"), F.size(F.array_distinct("words")).alias("sa"))
    b = provides.select(F.col("name").alias("provide"), F.explode(F.array_distinct("words")).alias("w"), F.size(F.array_distinct("words")).alias("sb"))
    g = a.join(b, "w").groupBy("need", "provide", "sa", "sb").agg(F.count(F.lit(1)).alias("n"))
    s = g.select("need", "provide", (F.col("n") / (F.col("sa") + F.col("sb") - F.col("n"))).alias("jaccard"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("need").orderBy(F.desc("jaccard"), "provide"))).where(F.col("rank") <= k)


# --- findings -------------------------------------------------------------------------------------


def findings(*checks: tuple[str, str, DataFrame]) -> DataFrame:
    """(check, severity, where): a row for each row that a check's query returns; its first column says where."""
    parts = [df.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(df.columns[0]).cast("string").alias("where")) for name, severity, df in checks]
    return reduce(DataFrame.unionByName, parts)


def state_machine_faults(steps: DataFrame, start: str, final: list[str]) -> DataFrame:
    """(state, fault): unreachable states, dead ends, and states that reach no final one. steps (a, b)."""
    all_ = steps.select("a").union(steps.select("b")).distinct().toDF("state")
    given = lambda states: steps.sparkSession.createDataFrame([(x,) for x in states], "node string")
    at = reached(steps, given([start])).withColumnRenamed("node", "state")
    ends = reached(steps.select(F.col("b").alias("a"), F.col("a").alias("b")), given(final)).withColumnRenamed("node", "state")
    off = all_.join(at, "state", "left_anti").select("state", F.lit("unreachable").alias("fault"))
    no_end = all_.where(~F.col("state").isin(final)).join(ends, "state", "left_anti").select("state", F.lit("reaches no end").alias("fault"))
    return off.union(no_end)


def situations(spark, atoms: list[str], exclusive: list[tuple[str, str]]) -> tuple[DataFrame, int]:
    """((mask, atoms) of every choice of atoms without an excluded pair, the number suppressed); at most 10 atoms."""
    if len(atoms) > 10:
        raise ValueError("at most 10 choice atoms")
    at = {a: i for i, a in enumerate(atoms)}
    every = spark.range(1 << len(atoms)).withColumnRenamed("id", "mask")
    for a, b in exclusive:
        both = (1 << at[a]) | (1 << at[b])
        every = every.where(F.col("mask").bitwiseAND(F.lit(both)) != both)
    out = every.withColumn("atoms", F.array_compact(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(a)) for a, i in at.items()))) if atoms else F.array().cast("array<string>"))
    return out, (1 << len(atoms)) - out.count()


def covering_set(rows: DataFrame, atoms: int) -> DataFrame:
    """(atom, m1, m2): for each of so many atoms the first two situations that differ in it alone and in what follows. rows (mask, derived).

    An atom without such a pair has no row. Raises if a mask holds an atom beyond them.
    """
    if not rows.where(F.shiftright(F.col("mask").cast("bigint"), atoms) != 0).isEmpty():
        raise ValueError(f"a mask holds more than {atoms} atoms")
    x, y = rows.select(F.col("mask").alias("m1"), F.col("derived").alias("d1")), rows.select(F.col("mask").alias("m2"), F.col("derived").alias("d2"))
    bits = F.array(*(F.struct(F.lit(k).alias("atom"), F.lit(1 << k).alias("bit")) for k in range(atoms)))
    flip = x.select("*", F.explode(bits).alias("x")).select("m1", "d1", "x.atom", F.col("m1").bitwiseXOR(F.col("x.bit")).alias("m2")).where("m1 < m2")
    pairs = flip.join(y, "m2").where(~F.col("d1").eqNullSafe(F.col("d2")))
    return pairs.groupBy("atom").agg(F.min(F.struct("m1", "m2")).alias("p")).select("atom", "p.m1", "p.m2")


# --- what an extraction says about its conflicts --------------------------------------------------


def rule_coverage(rules: DataFrame, rejected: DataFrame, provisions: int) -> DataFrame:
    """One row: rules_claimed, rules_rejected, rules_emitted, coverage, coverage_claimed (null if there are no provisions). rules (id), rejected (id); a rejected rule that wasn't claimed doesn't count."""
    j = rules.select("id").where("id is not null").distinct().join(rejected.select("id").distinct().withColumn("no", F.lit(1)), "id", "left")
    g = j.agg(F.count(F.lit(1)).alias("rules_claimed"), F.count("no").alias("rules_rejected"))
    n = F.nullif(F.lit(float(provisions)), F.lit(0.0))
    emitted = F.col("rules_claimed") - F.col("rules_rejected")
    return g.select("*", emitted.alias("rules_emitted"), (emitted / n).alias("coverage"), (F.col("rules_claimed") / n).alias("coverage_claimed"))


def unencoded_reasons(rows: DataFrame) -> DataFrame:
    """(reason, n) of what wasn't encoded; null is an empty reason."""
    return rows.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def conflict_channels(norms: DataFrame, incompatible: DataFrame) -> DataFrame:
    """One row: n_incompat, n_live (between two obliged acts), n_both (acts both obliged and forbidden), any_open: whether any conflict can be derived at all.

    norms (act, modality), incompatible (a, b).
    """
    acts = norms.where("act is not null").groupBy("act").agg(F.bool_or(F.col("modality") == "oblige").alias("o"), F.bool_or(F.col("modality") == "forbid").alias("f"))
    obliged = acts.where("o").select("act")
    live = incompatible.where("a <> b").join(obliged.withColumnRenamed("act", "a"), "a", "left_semi").join(obliged.withColumnRenamed("act", "b"), "b", "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(incompatible, "n_incompat").crossJoin(n(live, "n_live")).crossJoin(n(acts.where("o and f"), "n_both"))
    return one.withColumn("any_open", (F.col("n_live") > 0) | (F.col("n_both") > 0))


def needs_reading(found: DataFrame, interpretive: DataFrame) -> DataFrame:
    """conflicts() with literal: whether the witness holds without any interpretive atom (atom), so that the conflict stands on facts alone.

    The witness is the smallest scenario, so an interpretive atom in it is in every scenario.
    """
    open_ = found.select("n1", "n2", "kind", F.explode("witness").alias("atom")).join(interpretive.select("atom").distinct(), "atom", "left_semi").select("n1", "n2", "kind").distinct().withColumn("_r", F.lit(True))
    return found.join(open_, ["n1", "n2", "kind"], "left").withColumn("literal", F.col("_r").isNull()).drop("_r")


def conflict_report(found: DataFrame, locators: DataFrame) -> DataFrame:
    """One row a conflict of conflicts(): id (c0001 and on, by tier, then norms), both locators, the witness and its sentence. locators (norm, locator)."""
    at = lambda x: locators.select(F.col("norm").alias(x), F.col("locator").alias("at_" + x))
    j = found.join(at("n1"), "n1", "left").join(at("n2"), "n2", "left")
    from .ordered import placed

    out = placed(j, [], ["tier", "n1", "n2", "kind"], "_i")
    prose = witness_prose(F.col("n1").cast("string"), F.col("n2").cast("string"), F.col("witness"))
    return out.select(F.format_string("c%04d", "_i").alias("id"), "n1", "n2", "kind", "tier", "resolved", "at_n1", "at_n2", "witness", prose.alias("prose"))
