"""Query modules side by side: sweeps, orders, closures, comparisons, and batch choices around them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import auc, confusion, scored
from .sets import hashed


@dataclass(frozen=True)
class QueryModule:
    """A named scorer: rank gives (q, id, score), predict (q, id), explain any rows with q and id."""

    name: str
    rank: Callable[..., DataFrame]
    predict: Callable[..., DataFrame]
    explain: Callable[..., DataFrame] | None = field(default=None)


def compare_modules(modules: list[QueryModule], universe: DataFrame, gold: DataFrame) -> DataFrame:
    """(module, q, tp, fp, fn, tn, precision, recall, f1, mcc, auc) of every module on one universe (q, id) with gold (q, id)."""
    out = None
    g = gold.select("q", "id").distinct().withColumn("g", F.lit(True))
    for m in modules:
        p = m.predict().select("q", "id").distinct().withColumn("p", F.lit(True))
        rows = universe.join(m.rank().select("q", "id", "score"), ["q", "id"], "left").join(p, ["q", "id"], "left").join(g, ["q", "id"], "left")
        rows = rows.select("q", "id", "score", F.coalesce("p", F.lit(False)).alias("pred"), F.coalesce("g", F.lit(False)).alias("gold"), F.lit(m.name).alias("module"))
        out = rows if out is None else out.unionByName(rows)
    return scored(confusion(out, "module", "q")).drop("floor_f1").join(auc(out, "module", "q"), ["module", "q"])


def rung_sweep(rungs: DataFrame, depth: int = 5) -> DataFrame:
    """(q, depth, n): ids within the first rungs, cumulatively. rungs (q, id, rung)."""
    per = rungs.groupBy("q", "rung").agg(F.count(F.lit(1)).alias("c"))
    return per.select("q", "c", F.explode(F.sequence("rung", F.lit(depth - 1))).alias("depth")).groupBy("q", "depth").agg(F.sum("c").alias("n"))


def section_sweep(sections: DataFrame, most: int = 10) -> DataFrame:
    """(q, k, section): sections of the k strongest, nested. sections (q, section, score)."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "section")
    return sections.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("q", F.explode(F.sequence("rn", F.lit(most))).alias("k"), "section")


def section_ranked(scores: DataFrame, k: int = 3) -> DataFrame:
    """scores (q, section, id, score) with the section's score, the mean of its k best, and its place: rows of one section aren't told apart."""
    from .scoring import section_top_mean

    means = section_top_mean(scores, "section", k).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "section")
    placed = means.withColumn("place", F.row_number().over(order).cast("bigint"))
    return scores.drop("score").join(placed, ["q", "section"])


def salience(ranked: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """ranked (q, id, score, kind, pos) with rank by falling score, kind tier, document order; every row once."""
    tier = F.coalesce(F.create_map(*(x for k, v in tiers.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")], F.lit(99))
    return ranked.withColumn("tier", tier).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "tier", "pos", "id")))


def lexicographic(rows: DataFrame) -> DataFrame:
    """rows (q, section, section_score, id, score in 0 to 1) with combined = (section's place from the weakest + score) / (sections + 1)."""
    s = rows.select("q", "section", "section_score").distinct()
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("section_score", F.desc("section"))) - 1)
    n = s.groupBy("q").agg(F.count(F.lit(1)).alias("m"))
    return rows.join(s.select("q", "section", "place"), ["q", "section"]).join(n, "q").withColumn("combined", (F.col("place") + F.col("score")) / (F.col("m") + 1)).drop("place", "m")


def union_closure(core: DataFrame, elected: DataFrame, members: DataFrame) -> DataFrame:
    """(q, id): a typed core and all members of elected sections. core (q, id), elected (q, section), members (section, id)."""
    return core.select("q", "id").union(elected.join(members, "section").select("q", "id")).distinct()


def position_scores(order: DataFrame, pairs: DataFrame, universe: DataFrame) -> DataFrame:
    """(p, score): an order (c, rank) as n - rank + 1, lifted to passages by the largest; 0 without a clause."""
    n = order.agg(F.count(F.lit(1)).alias("n"))
    s = order.crossJoin(n).select("c", (F.col("n") - F.col("rank") + 1).cast("double").alias("score"))
    best = pairs.join(s, "c").groupBy("p").agg(F.max("score").alias("score"))
    return universe.select("p").join(best, "p", "left").fillna(0.0, ["score"])


def top_precision(ranked: DataFrame, k: int) -> DataFrame:
    """(q, precision): share of gold among the first k (or all, if fewer). ranked (q, rank, gold boolean)."""
    return ranked.where(F.col("rank") <= k).groupBy("q").agg(F.avg(F.col("gold").cast("double")).alias("precision"))


def band(cuts: DataFrame, sentinel: float = 2.0) -> DataFrame:
    """One row: n, low, high, mean, sd, q05, q50, q95 of cuts other than the sentinel; quantiles by nearest rank."""
    return cuts.where(F.col("cut") < sentinel).agg(F.count(F.lit(1)).alias("n"), F.min("cut").alias("low"), F.max("cut").alias("high"), F.avg("cut").alias("mean"), F.stddev_pop("cut").alias("sd"), *(F.expr(f"percentile_disc({q}) within group (order by cut)").alias(a) for q, a in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))))


def prefiltered(vocabulary: DataFrame, words: Column, most: int) -> DataFrame:
    """(name, score, hidden): the names closest to some words, overlap / sqrt(parts), at most that many; hidden is the share not shown. vocabulary (name, parts array)."""
    s = F.size(F.array_intersect("parts", words)) / F.sqrt(F.size("parts").cast("double"))
    n = vocabulary.agg(F.count(F.lit(1)).alias("n"))
    top = vocabulary.select("name", s.alias("score")).orderBy(F.desc("score"), "name").limit(most)
    return top.crossJoin(n).select("name", "score", F.greatest(F.lit(0.0), 1 - F.lit(float(most)) / F.col("n")).alias("hidden"))


def stratified_draw(rows: DataFrame, per_side: int, seed: int = 17) -> DataFrame:
    """Half of a draw from agreeing, half from split rows of each side, topped up from the other stratum where one is short. rows (side, stratum in agree or split, id)."""
    w = Window.partitionBy("side", "stratum").orderBy(hashed(seed, "id"), "id")
    placed = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_side)
    first = F.col("rn") <= per_side // 2
    order = Window.partitionBy("side").orderBy(F.when(first, 0).otherwise(1), "rn", "stratum")
    return placed.withColumn("take", F.row_number().over(order)).where(F.col("take") <= per_side).drop("rn", "take")


def best_atom(phrases: DataFrame, atoms: DataFrame, least: float = 0.5) -> DataFrame:
    """(p, name, cover): the atom with the largest share of a phrase's words, the first by pos of equals; none below least. phrases (p, words array), atoms (name, pos, words array)."""
    x = phrases.select("p", F.size("words").alias("n"), F.explode("words").alias("w")).join(atoms.select("name", "pos", F.explode("words").alias("w")), "w")
    g = x.groupBy("p", "n", "name", "pos").agg((F.count_distinct("w") / F.first("n")).alias("cover")).where(F.col("cover") >= least)
    return g.groupBy("p").agg(F.min(F.struct((-F.col("cover")).alias("c"), "pos", "name")).alias("b")).select("p", F.col("b.name").alias("name"), (-F.col("b.c")).alias("cover"))


def readback_trials(clauses: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """(id, option, place, answer, collides, by_kind): each clause among n - 1 distractors of its section, topped up from the document, in hash order.

    clauses (id, doc, section, kind, signature). collides: another option has the same signature. by_kind: the kind alone
    gives the answer away. Candidates are the next ones in hash order around the clause, so no section is paired with itself.
    """
    ring = lambda *keys: Window.partitionBy(*keys).orderBy(hashed(seed, "id"), "id")
    near = clauses.select("id", "doc", "section", *(F.lead("id", k).over(ring("doc", "section")).alias(f"s{k}") for k in range(1, n)), *(F.lead("id", k).over(ring("doc")).alias(f"d{k}") for k in range(1, 2 * n)), *(F.lag("id", k).over(ring("doc")).alias(f"b{k}") for k in range(1, 2 * n)))
    pool = F.array_compact(F.array(*(F.col(f"s{k}") for k in range(1, n)), *(F.col(f"d{k}") for k in range(1, 2 * n)), *(F.col(f"b{k}") for k in range(1, 2 * n))))
    chosen = near.select("id", F.slice(F.array_except(F.array_distinct(pool), F.array("id")), 1, n - 1).alias("others"))
    rows = chosen.select("id", F.explode(F.concat(F.array("id"), F.col("others"))).alias("option"))
    facts = clauses.select(F.col("id").alias("option"), "kind", "signature")
    own = clauses.select("id", F.col("kind").alias("k0"), F.col("signature").alias("s0"))
    j = rows.join(facts, "option").join(own, "id").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(hashed(seed + 1, "id", "option"))))
    all_ = Window.partitionBy("id")
    other = F.col("option") != F.col("id")
    return j.select("id", "option", "place", (~other).alias("answer"), F.max((other & (F.col("signature") == F.col("s0"))).cast("int")).over(all_).cast("boolean").alias("collides"), (F.sum((other & (F.col("kind") == F.col("k0"))).cast("int")).over(all_) == 0).alias("by_kind"))
