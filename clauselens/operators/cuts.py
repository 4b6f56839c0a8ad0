"""Label-free cuts of score tables (key, id, score), and what to do with them.

Scores are counted by level before any window, so a window holds a key's distinct levels or its 256
bins, never its rows. A key with fewer than two distinct positive scores gets the cut 2.0, above
every score, and so an empty prediction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

NO_CUT, BINS = 2.0, 256


def positive_levels(scores: DataFrame, key: str = "key") -> DataFrame:
    """(key, score, c): counts of positive scores."""
    return scores.where("score > 0").groupBy(key, "score").agg(F.count(F.lit(1)).alias("c"))


def extent(scores: DataFrame, key: str = "key") -> DataFrame:
    """(key, lo, hi, n, s, ss, levels) of positive scores, for every key of scores."""
    p = F.when(F.col("score") > 0, F.col("score"))
    return scores.groupBy(key).agg(F.min(p).alias("lo"), F.max(p).alias("hi"), F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("sd"))


def is_degenerate() -> Column:
    """Over a row of extent(): fewer than two distinct scores."""
    return F.col("lo").isNull() | (F.col("lo") == F.col("hi"))


def guarded(cuts: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """(key, cut) for every key of extent(); NO_CUT where it is degenerate."""
    return every.join(cuts, key, "left").select(key, F.when(is_degenerate(), NO_CUT).otherwise(F.coalesce("cut", F.lit(NO_CUT))).alias("cut"))


def histogram(scores: DataFrame, every: DataFrame, key: str = "key", bins: int = BINS) -> DataFrame:
    """(key, bin, c, lo, width): counts of positive scores in equal bins from 0; the largest falls in the last."""
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / F.col("width"))).cast("int")
    rows = scores.where("score > 0").join(every.where(~is_degenerate()).select(key, "lo", width.alias("width")), key)
    return rows.groupBy(key, number.alias("bin"), "lo", "width").agg(F.count(F.lit(1)).alias("c"))


def _edge() -> Column:
    return F.col("lo") + F.col("width") * (F.col("bin") + 1)


def otsu(scores: DataFrame, key: str = "key") -> DataFrame:
    """The upper edge of the bin with the largest variance between the two sides; the first of equals."""
    every = extent(scores, key)
    mid = F.col("lo") + F.col("width") * (F.col("bin") + 0.5)
    h = histogram(scores, every, key).withColumns({"edge": _edge(), "x": F.col("c") * mid})
    up = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(key)
    h = h.withColumns({"w0": F.sum("c").over(up), "s0": F.sum("x").over(up), "n": F.sum("c").over(all_), "s": F.sum("x").over(all_)}).where("w0 < n")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("w0"))
    var = F.round(F.col("w0") / F.col("n") * ((F.col("n") - F.col("w0")) / F.col("n")) * gap * gap, 9)
    best = h.groupBy(key).agg(F.max(F.struct(var.alias("v"), (-F.col("bin")).alias("b"), F.col("edge").alias("cut"))).alias("m"))
    return guarded(best.select(key, F.col("m.cut").alias("cut")), every, key)


def triangle(scores: DataFrame, key: str = "key") -> DataFrame:
    """The edge of the bin furthest from the chord between the fullest bin and the last; the first of equals."""
    every = extent(scores, key)
    h = histogram(scores, every, key)
    peak = h.groupBy(key).agg(F.max(F.struct("c", (-F.col("bin")).alias("b"))).alias("p"), F.max(F.struct("bin", "c")).alias("e"))
    peak = peak.select(key, (-F.col("p.b")).alias("x0"), F.col("p.c").alias("y0"), F.col("e.bin").alias("x1"), F.col("e.c").alias("y1"))
    bins = peak.where("x1 > x0").select("*", F.explode(F.sequence("x0", "x1")).alias("bin")).join(h.select(key, "bin", "c"), [key, "bin"], "left").fillna(0, ["c"])
    d = F.round(F.abs((F.col("y1") - F.col("y0")) * (F.col("bin") - F.col("x0")) - (F.col("x1") - F.col("x0")) * (F.col("c") - F.col("y0"))).cast("double"), 9)
    best = bins.groupBy(key).agg(F.max(F.struct(d.alias("d"), (-F.col("bin")).alias("b"))).alias("m")).select(key, (-F.col("m.b")).alias("bin"))
    cuts = best.join(every.select(key, "lo", ((F.col("hi") - F.col("lo")) / BINS).alias("width")), key).select(key, _edge().alias("cut"))
    return guarded(cuts, every, key)


def _placed_levels(scores: DataFrame, key: str) -> DataFrame:
    """Levels in falling order with first and last rank (from 0) of their rows, and the level above."""
    w = Window.partitionBy(key).orderBy(F.desc("score"))
    rows = positive_levels(scores, key).withColumn("upto", F.sum("c").over(w))
    return rows.select(key, "score", "c", (F.col("upto") - F.col("c")).alias("first"), (F.col("upto") - 1).alias("last"), F.lag("score").over(w).alias("above"))


def kneedle(scores: DataFrame, key: str = "key") -> DataFrame:
    """The score one rank above the rank that lies furthest from the chord of the sorted scores; the first of equals."""
    every = extent(scores, key)
    rows = _placed_levels(scores, key).join(every, key)
    ends = F.array_distinct(F.array("first", "last"))  # between its first and last rank a level's distance is largest at an end
    rows = rows.select("*", F.explode(ends).alias("i"))
    d = F.round(F.abs((F.col("lo") - F.col("hi")) * F.col("i") - (F.col("n") - 1) * (F.col("score") - F.col("hi"))), 9)
    before = F.when(F.col("i") > F.col("first"), F.col("score")).otherwise(F.coalesce("above", "score"))
    best = rows.groupBy(key).agg(F.max(F.struct(d.alias("d"), (-F.col("i")).alias("b"), before.alias("cut"))).alias("m"))
    return guarded(best.select(key, F.col("m.cut").alias("cut")), every, key)


def largest_gap(scores: DataFrame, key: str = "key", lo: float = 0.01, hi: float = 0.5) -> DataFrame:
    """The score above the widest gap between neighbours within a window of ranks; the first of equals."""
    every = extent(scores, key)
    rows = _placed_levels(scores, key).join(every, key)
    inside = (F.col("first") >= F.greatest(F.lit(1), F.floor(F.lit(lo) * F.col("n")))) & (F.col("first") < F.least(F.col("n"), F.greatest(F.lit(2), F.floor(F.lit(hi) * F.col("n")))))
    best = rows.where(inside).groupBy(key).agg(F.max(F.struct(F.round(F.col("above") - F.col("score"), 9).alias("g"), (-F.col("first")).alias("b"), F.col("above").alias("cut"))).alias("m"))
    return guarded(best.select(key, F.col("m.cut").alias("cut")), every, key)


def mean_plus_sd(scores: DataFrame, key: str = "key", c: float = 1.0) -> DataFrame:
    every = extent(scores, key)
    return guarded(every.select(key, (F.col("mean") + c * F.col("sd")).alias("cut")), every, key)


def top_q(scores: DataFrame, key: str = "key", q: float = 0.1, k: int | None = None) -> DataFrame:
    """The score at rank k, or at rank max(1, round(q n))."""
    every = extent(scores, key)
    rank = F.greatest(F.lit(1), F.least(F.lit(k), F.col("n"))) if k else F.greatest(F.lit(1), F.bround(F.lit(q) * F.col("n")))
    rows = _placed_levels(scores, key).join(every.select(key, rank.alias("at")), key).where("first < at and at <= last + 1")
    return guarded(rows.select(key, F.col("score").alias("cut")), every, key)


def isodata(scores: DataFrame, key: str = "key", rounds: int = 100) -> DataFrame:
    """The fixed point of the mean of the means below and above. Each round is one aggregation over the levels; keys stay on the cluster."""
    every = extent(scores, key)
    levels = cut(positive_levels(scores, key))
    now = every.select(key, F.col("mean").alias("cut"))
    part = lambda cond: F.sum(F.when(cond, F.col("score") * F.col("c"))) / F.sum(F.when(cond, F.col("c")))
    for _ in range(rounds):
        new = levels.join(now, key).groupBy(key).agg(F.first("cut").alias("old"), ((part(F.col("score") < F.col("cut")) + part(F.col("score") >= F.col("cut"))) / 2).alias("new"))
        new = new.select(key, F.coalesce("new", "old").alias("cut"), F.abs(F.coalesce("new", "old") - F.col("old")).alias("step"))
        new = cut(new)
        moved = new.agg(F.max("step")).first()[0]
        now = new.select(key, "cut")
        if not moved or moved < 1e-12:
            break
    return guarded(now, every, key)


#: The rules by name.
RULES: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "otsu": otsu, "isodata": isodata, "triangle": triangle, "kneedle": kneedle, "largest_gap": largest_gap,
    "mean+0.0sd": lambda s, k="key": mean_plus_sd(s, k, 0.0), "mean+0.5sd": lambda s, k="key": mean_plus_sd(s, k, 0.5), "mean+1.0sd": lambda s, k="key": mean_plus_sd(s, k, 1.0),
    "top_q=0.05": lambda s, k="key": top_q(s, k, 0.05), "top_q=0.10": lambda s, k="key": top_q(s, k, 0.10), "top_q=0.25": lambda s, k="key": top_q(s, k, 0.25),
}


def label_free_cuts(scores: DataFrame, names: list[str], key: str = "key") -> DataFrame:
    """(rule, key, cut) of several rules."""
    out = None
    for name in names:
        one = RULES[name](scores, key).select(F.lit(name).alias("rule"), key, "cut")
        out = one if out is None else out.unionByName(one)
    return out


def predicted(scores: DataFrame, cuts: DataFrame, key: str = "key") -> DataFrame:
    """Rows with a positive score at or above their key's cut."""
    return scores.join(cuts, key).where((F.col("score") > 0) & (F.col("score") >= F.col("cut")))


def sweep(scores: DataFrame, grid: list[float], key: str = "key") -> DataFrame:
    """(key, cut, n): size of the predicted set at each cut of a grid. Levels are counted first."""
    levels = positive_levels(scores, key).select("*", F.explode(F.array(*map(F.lit, grid))).alias("cut"))
    return levels.groupBy(key, "cut").agg(F.coalesce(F.sum(F.when(F.col("score") >= F.col("cut"), F.col("c"))), F.lit(0)).alias("n"))


def bystanders(scores: DataFrame, cuts: DataFrame, widths: list[float], key: str = "key") -> DataFrame:
    """(key, eps, n): how many scores lie within eps of the cut."""
    near = scores.join(cuts, key).withColumn("d", F.abs(F.col("score") - F.col("cut")))
    return near.groupBy(key).agg(*(F.count(F.when(F.col("d") <= e, 1)).alias(f"n{i}") for i, e in enumerate(widths))).select(key, F.explode(F.array(*(F.struct(F.lit(e).alias("eps"), F.col(f"n{i}").alias("n")) for i, e in enumerate(widths)))).alias("x")).select(key, "x.eps", "x.n")


def stability(scores: DataFrame, grid: list[float], draw: str = "draw") -> DataFrame:
    """(cut, agreement) of the grid cut whose predicted sets agree best between draws; the lowest of equals.

    scores (draw, id, score). Cuts at which every draw predicts all its positive scores don't count; no draw, or only such cuts, gives NO_CUT.
    """
    rows = scores.where("score > 0").select(draw, "id", "score", F.explode(F.array(*map(F.lit, grid))).alias("cut")).where("score >= cut")
    by_id = rows.groupBy("cut", "id").agg(F.array_sort(F.collect_set(draw)).alias("draws"))  # draws are few
    pair = by_id.select("cut", F.explode("draws").alias("a"), "draws").select("cut", "a", F.explode("draws").alias("b")).where("a < b").groupBy("cut", "a", "b").agg(F.count(F.lit(1)).alias("both"))
    size = rows.groupBy("cut", draw).agg(F.count(F.lit(1)).alias("n"))
    full = scores.where("score > 0").groupBy(draw).agg(F.count(F.lit(1)).alias("all"))
    draws = full.select(draw)
    every = draws.select(F.col(draw).alias("a")).crossJoin(draws.select(F.col(draw).alias("b"))).where("a < b").select("a", "b", F.explode(F.array(*map(F.lit, grid))).alias("cut"))
    sized = lambda x: size.select("cut", F.col(draw).alias(x), F.col("n").alias("n" + x))
    j = every.join(pair, ["cut", "a", "b"], "left").join(sized("a"), ["cut", "a"], "left").join(sized("b"), ["cut", "b"], "left").fillna(0, ["both", "na", "nb"])
    union = F.col("na") + F.col("nb") - F.col("both")
    mean = j.groupBy("cut").agg(F.avg(F.when(union > 0, F.col("both") / union).otherwise(0.0)).alias("agreement"))
    vacuous = full.select(draw, "all", F.explode(F.array(*map(F.lit, grid))).alias("cut")).join(size, ["cut", draw], "left").groupBy("cut").agg(F.bool_and(F.coalesce("n", F.lit(0)) == F.col("all")).alias("v"))
    best = mean.join(vacuous, "cut").where("not v").agg(F.max(F.struct(F.round("agreement", 12).alias("a"), (-F.col("cut")).alias("c"))).alias("m"))
    return best.select(F.coalesce(-F.col("m.c"), F.lit(NO_CUT)).alias("cut"), F.col("m.a").alias("agreement"))
