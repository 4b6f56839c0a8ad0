"""Append-only logs: resume, plans, publication, spend, and replay of renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def done_keys(log: DataFrame, keys: list[str], rubric: str | None = None) -> DataFrame:
    """Distinct keys that the log holds for a rubric; unparsed rows don't count."""
    rows = log.where("parsed") if "parsed" in log.columns else log
    rows = rows.where(F.col("rubric") == rubric) if rubric is not None else rows
    return rows.select(*keys).distinct()


def plan(axes: list[DataFrame], done: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of the axes that isn't done yet. Axes are short lists (queries, judges, versions)."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    return out.join(done, keys, "left_anti")


def published(log: DataFrame, least_votes: int = 2) -> DataFrame:
    """(behaviour, locator, votes, score, verdicts): latest verdict of each judge, summed; kept with a score and enough votes.

    log (behaviour, locator, judge, verdict, at). The maximum of a struct picks the latest without a window.
    """
    last = log.groupBy("behaviour", "locator", "judge").agg(F.max(F.struct("at", "verdict"))["verdict"].alias("verdict"))
    panel = last.agg(F.count_distinct("judge").alias("panel"))
    g = last.groupBy("behaviour", "locator").agg(F.count(F.when(F.col("verdict") >= 1, 1)).alias("votes"), F.sum("verdict").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("judge", "verdict")))).alias("verdicts"))
    return g.crossJoin(panel).where((F.col("score") >= 1) & (F.col("votes") >= F.least(F.lit(least_votes), F.col("panel")))).drop("panel")


def restored_universe(universe: DataFrame, judges: DataFrame, votes: DataFrame) -> DataFrame:
    """(id, judge, verdict) of every id and judge, absent ones with 0; raises if a vote names an unknown id or the universe repeats one."""
    if not votes.join(universe, "id", "left_anti").isEmpty():
        raise ValueError("votes for ids outside the universe")
    if not universe.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("the universe repeats an id")
    return universe.select("id").crossJoin(judges.select("judge").distinct()).join(votes, ["id", "judge"], "left").fillna(0, ["verdict"])


def token_cost(prompt: Column, cached: Column, written: Column, completion: Column, rates: Column) -> Column:
    """Price of a call in millionths: rates is a struct of input, cached (null: as input), write (null: as input), output per million tokens."""
    c, w = F.coalesce(rates["cached"], rates["input"]), F.coalesce(rates["write"], rates["input"])
    return ((prompt - cached - written) * rates["input"] + cached * c + written * w + completion * rates["output"]) / F.lit(1e6)


def spend(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, calls, tokens, cost, unpriced), with a row of null model for the total. calls (model, prompt, cached, written, completion), rates (model, input, cached, write, output)."""
    r = rates.select("model", F.struct("input", "cached", "write", "output").alias("rate"))
    j = calls.join(r, "model", "left").withColumn("cost", token_cost(F.col("prompt"), F.col("cached"), F.col("written"), F.col("completion"), F.col("rate")))
    return j.rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count(F.when(F.col("rate").isNull(), 1)).alias("unpriced"))


def audit(artifacts: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """(key, status): logged, unlogged or no_artifact."""
    j = artifacts.select(key).distinct().withColumn("a", F.lit(1)).join(log.select(key).distinct().withColumn("l", F.lit(1)), key, "full_outer")
    return j.select(key, F.when(F.col("l").isNull(), "unlogged").when(F.col("a").isNull(), "no_artifact").otherwise("logged").alias("status"))


def final_names(renames: DataFrame) -> DataFrame:
    """(old, new): where each name ends after a log of renames (seq, old, new), each applying to names as they are then.

    Each row's next is the first later row that renames its new name; chains are followed by pointer
    doubling, so the rounds grow with the logarithm of the longest one. seq must not repeat. The rows
    of one name are ordered by one task.
    """
    w = Window.partitionBy("name").orderBy(F.desc("seq"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    log = cut(renames.select("seq", "old", "new"))
    asked = log.select(F.col("new").alias("name"), "seq", F.lit(True).alias("asks"), "new")
    said = log.select(F.col("old").alias("name"), "seq", F.lit(False).alias("asks"), "new")
    later = F.last(F.when(~F.col("asks"), F.col("seq")), ignorenulls=True).over(w)
    # at its own seq a row that renames a name to itself must not follow itself, so questions come first
    at = cut(asked.union(said).withColumn("next", later).where("asks").select("seq", "new", "next"))
    while not at.where("next is not null").isEmpty():
        to = at.select(F.col("seq").alias("next"), F.col("new").alias("new2"), F.col("next").alias("next2"))
        far = at.join(to, "next", "left")
        at = cut(far.select("seq", F.coalesce("new2", "new").alias("new"), F.col("next2").alias("next")))
    first = log.groupBy("old").agg(F.min("seq").alias("seq"))
    return first.join(at, "seq").select("old", "new")


def ready(parents: DataFrame, done: DataFrame) -> DataFrame:
    """Parents not done whose children are all done. parents (parent, child), done (id)."""
    d = done.select(F.col("id").alias("child"), F.lit(1).alias("ok"))
    g = parents.join(d, "child", "left").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("k")).where("n = k")
    return g.join(done.select(F.col("id").alias("parent")), "parent", "left_anti").select("parent")


def frontier_order(parents: DataFrame) -> DataFrame:
    """(id, wave): the round in which each node becomes ready, leaves in 0; nodes on a cycle never do and are left out."""
    p = cut(parents.select("parent", "child").distinct())
    leaves = p.select(F.col("child").alias("id")).join(p.select(F.col("parent").alias("id")), "id", "left_anti").distinct()
    out = cut(leaves.withColumn("wave", F.lit(0)))
    wave = 0
    while True:
        wave += 1
        new = cut(ready(p, out).select(F.col("parent").alias("id")).withColumn("wave", F.lit(wave)))
        if new.isEmpty():
            return out
        out = cut(out.union(new))
