"""Agreement and error measures over long tables, one aggregation each.

Predictions are rows (keys, id, pred boolean, gold boolean) over an explicit universe; scores are
rows (keys, id, score, gold). Ratios with an empty denominator are 0, except AUC, which is null when
a class is empty. Rank measures count scores by level first, so a window holds distinct levels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    d = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(d > 0, (tp * tn - fp * fn) / F.sqrt(d)).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, tp, fp, fn, tn)"""
    n = lambda p, g: F.count(F.when((F.col("pred") == p) & (F.col("gold") == g), 1))
    return rows.groupBy(*keys).agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))


def scored(cells: DataFrame, unreachable: str | None = None) -> DataFrame:
    """Confusion cells with precision, recall, f1, mcc and the all-relevant floor; unreachable: a column of gold outside the universe."""
    fn = F.col("fn") + (F.col(unreachable) if unreachable else F.lit(0))
    base = (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return cells.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + fn),
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn), "mcc": mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")), "floor_f1": 2 * base / (1 + base),
    })


def reachable_floor(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, floor_b): the MCC of predicting every row that some clause reaches. rows (keys, joined boolean, gold boolean) over the universe."""
    cells = confusion(rows.withColumn("pred", F.coalesce("joined", F.lit(False))), *keys)
    return cells.select(*keys, mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("floor_b"))


def levels_of(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, score, p, n): gold and other rows (or their weights) of each distinct score; a null score is 0."""
    w = F.col(weight) if weight else F.lit(1)
    s = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    return rows.groupBy(*keys, F.coalesce("score", F.lit(0.0)).alias("score")).agg(s(F.col("gold")).alias("p"), s(~F.col("gold")).alias("n"))


def auc(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, auc): Mann-Whitney with ties as half, from counts by level; null score is 0; null when a class is empty.

    Running sums over the levels are split over tasks, so a key may have any number of levels.
    """
    levels = running(levels_of(rows, *keys, weight=weight), list(keys), ["score"], under="n")
    wins = F.sum(F.col("p") * (F.col("under") + F.col("n") / 2.0))
    return levels.groupBy(*keys).agg((wins / F.nullif(F.sum("p") * F.sum("n").cast("double"), F.lit(0.0))).alias("auc"))


def roc(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, score, fpr, tpr) at each distinct score, falling."""
    levels = levels_of(rows, *keys)
    total = levels.groupBy(*keys).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    upto = running(levels, list(keys), [F.desc("score")], _sn="n", _sp="p")
    j = upto.join(total, list(keys)) if keys else upto.crossJoin(total)
    return j.select(*keys, "score", ratio(F.col("_sn") + F.col("n"), F.col("_n")).alias("fpr"), ratio(F.col("_sp") + F.col("p"), F.col("_p")).alias("tpr"))


def tpr_at(points: DataFrame, fpr: float, *keys: str) -> DataFrame:
    """(keys, tpr): the best true positive rate at no more than this false positive rate."""
    return points.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("fpr") <= fpr, F.col("tpr"))), F.lit(0.0)).alias("tpr"))


def operating_point(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, fpr, tpr) of a binary predictor."""
    rate = lambda g: F.coalesce(F.avg(F.when(F.col("gold") == g, F.col("pred").cast("double"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(rate(False).alias("fpr"), rate(True).alias("tpr"))


def mcc_curve(rows: DataFrame, grid: list[float], *keys: str) -> DataFrame:
    """(keys, cut, mcc) of score >= cut and score > 0 at each cut of a grid; rows (keys, score, gold), counted by level first."""
    levels = rows.groupBy(*keys, "score").agg(F.count(F.when(F.col("gold"), 1)).alias("p"), F.count(F.when(~F.col("gold"), 1)).alias("n"))
    at = levels.select("*", F.explode(F.array(*map(F.lit, grid))).alias("cut")).withColumn("pred", (F.col("score") > 0) & (F.col("score") >= F.col("cut")))
    s = lambda c, p: F.sum(F.when(F.col("pred") == p, F.col(c)).otherwise(0))
    g = at.groupBy(*keys, "cut").agg(s("p", True).alias("tp"), s("n", True).alias("fp"), s("p", False).alias("fn"), s("n", False).alias("tn"))
    return g.select(*keys, "cut", mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("mcc"))


def oracle_cut(curve: DataFrame, *keys: str) -> DataFrame:
    """(keys, cut, mcc) with the largest mcc, the lowest cut of equals. It reads labels: a ceiling, not a rule."""
    best = curve.groupBy(*keys).agg(F.max(F.struct(F.round("mcc", 9).alias("m"), (-F.col("cut")).alias("c"))).alias("b"))
    return best.select(*keys, (-F.col("b.c")).alias("cut"), F.col("b.m").alias("mcc"))


def leave_one_out_cut(curve: DataFrame, key: str) -> DataFrame:
    """(key, cut): the cut with the largest summed curve of the other keys, the lowest of equals."""
    total = curve.groupBy("cut").agg(F.sum("mcc").alias("all"))
    rest = curve.join(total, "cut").withColumn("others", F.round(F.col("all") - F.col("mcc"), 9))
    best = rest.groupBy(key).agg(F.max(F.struct("others", (-F.col("cut")).alias("c"))).alias("b"))
    return best.select(key, (-F.col("b.c")).alias("cut"))


# --- judges ---------------------------------------------------------------------------------------


def judge_pairs(votes: DataFrame, level: int = 1) -> DataFrame:
    """(a, b, both, either, jaccard) of each pair of judges; votes (judge, id, verdict); a missing verdict is 0."""
    yes = votes.where(F.col("verdict") >= level).select("judge", "id").distinct()
    n = yes.groupBy("judge").agg(F.count(F.lit(1)).alias("n"))
    sets = yes.groupBy("id").agg(F.array_sort(F.collect_set("judge")).alias("js"))  # judges are few
    both = sets.select(F.explode("js").alias("a"), "js").select("a", F.explode("js").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    judges = votes.select("judge").distinct()
    every = judges.select(F.col("judge").alias("a")).join(judges.select(F.col("judge").alias("b")), F.expr("a < b"))
    size = lambda x: n.select(F.col("judge").alias(x), F.col("n").alias("n" + x))
    j = every.join(both, ["a", "b"], "left").join(size("a"), "a", "left").join(size("b"), "b", "left").fillna(0)
    return j.select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either"), ratio(F.col("both"), F.col("na") + F.col("nb") - F.col("both")).alias("jaccard"))


def pair_gold(votes: DataFrame, level: int = 1) -> DataFrame:
    """(judge, id, pred, gold): each held-out judge against the intersection of the others. Every id has every judge."""
    per = votes.groupBy("id").agg(F.count(F.when(F.col("verdict") >= level, 1)).alias("yes"), F.count(F.lit(1)).alias("m"))
    rows = votes.select("id", "judge", (F.col("verdict") >= level).alias("pred")).join(per, "id")
    return rows.select("judge", "id", "pred", ((F.col("yes") - F.col("pred").cast("int")) == F.col("m") - 1).alias("gold"))


def reference(votes: DataFrame, least: int) -> DataFrame:
    """(id, score) of ids whose verdicts sum to at least that; a missing verdict counts 0."""
    return votes.groupBy("id").agg(F.coalesce(F.sum("verdict"), F.lit(0)).alias("score")).where(F.col("score") >= least)


def strict_reference(votes: DataFrame, level: int = 1) -> DataFrame:
    """(id) that every judge of the panel gives at least this level; a judge without a vote there doesn't."""
    yes = votes.where(F.col("verdict") >= level).groupBy("id").agg(F.count_distinct("judge").alias("k"))
    return yes.crossJoin(votes.agg(F.count_distinct("judge").alias("m"))).where("k = m").select("id")


def verdict_faults(rows: DataFrame) -> DataFrame:
    """Rows whose score isn't the sum of their verdicts map; must be empty."""
    return rows.where(F.col("score") != F.aggregate(F.map_values("verdicts"), F.lit(0), lambda a, b: a + b))


def binary_judges(votes: DataFrame) -> DataFrame:
    """Judges that never give the middle verdict 1."""
    return votes.groupBy("judge").agg(F.bool_or(F.col("verdict") == 1).alias("mid")).where("not mid").select("judge")


# --- two labelings --------------------------------------------------------------------------------


def labelling_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, adjusted Rand index and normalised mutual information of two labelings."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    part = lambda df, x: df.agg(pairs(F.col("c")).alias("p" + x), F.sum(F.col("c") * F.log("c")).alias("h" + x), F.sum("c").alias("n" + x))
    rows_, cols = (cells.groupBy(k).agg(F.sum("c").alias("c")) for k in ("a", "b"))
    one = part(cells, "ab").crossJoin(part(rows_, "a")).crossJoin(part(cols, "b"))
    n = F.col("nab")
    expect = F.col("pa") * F.col("pb") / (n * (n - 1) / 2)
    entropy = lambda x: F.log(n) - F.col("h" + x) / n
    top = (F.col("pa") + F.col("pb")) / 2 - expect
    mutual = entropy("a") + entropy("b") - entropy("ab")
    product = F.sqrt(entropy("a") * entropy("b"))
    return one.select(n.cast("bigint").alias("n"), F.when(top != 0, (F.col("pab") - expect) / top).otherwise(1.0).alias("ari"), F.when(product > 0, mutual / product).otherwise(1.0).alias("nmi"))


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows with the average rank of a value, from counts by level."""
    levels = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running(levels, [], [value], _u="_c").select(value, (F.col("_u") + (F.col("_c") + 1) / 2.0).alias(out))
    return rows.join(ranks, value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pearson, spearman (tied ranks averaged)."""
    r = average_ranks(average_ranks(rows, a, "_ra"), b, "_rb")
    return r.agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


# --- sets over runs -------------------------------------------------------------------------------


def run_agreement(rows: DataFrame) -> DataFrame:
    """(item, runs, mean_jaccard, all_jaccard) of the sets that several runs give an item; rows (run, item, name).

    mean over pairs of runs, null with fewer than two; all: intersection over union of all runs. Runs
    are few, so pairs are formed from an array of runs by name.
    """
    x = rows.select("run", "item", "name").distinct()
    runs = x.groupBy("item").agg(F.array_sort(F.collect_set("run")).alias("rs"))
    size = x.groupBy("item", "run").agg(F.count(F.lit(1)).alias("n"))
    names = x.groupBy("item", "name").agg(F.array_sort(F.collect_set("run")).alias("have"))
    both = names.select("item", F.explode("have").alias("a"), "have").select("item", "a", F.explode("have").alias("b")).where("a < b").groupBy("item", "a", "b").agg(F.count(F.lit(1)).alias("both"))
    every = runs.select("item", F.explode("rs").alias("a"), "rs").select("item", "a", F.explode("rs").alias("b")).where("a < b")
    j = every.join(both, ["item", "a", "b"], "left").fillna(0, ["both"])
    for k in ("a", "b"):
        j = j.join(size.select("item", F.col("run").alias(k), F.col("n").alias("n" + k)), ["item", k])
    mean = j.groupBy("item").agg(F.avg(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("mean_jaccard"))
    whole = names.join(runs, "item").groupBy("item").agg(F.avg((F.size("have") == F.size("rs")).cast("double")).alias("all_jaccard"), F.max(F.size("rs")).alias("runs"))
    return whole.join(mean, "item", "left").select("item", "runs", "mean_jaccard", "all_jaccard")


def weighted_recall(rows: DataFrame) -> DataFrame:
    """One row: precision on candidates, and recall with misses weighted by 1 / inclusion probability; rows (candidate, gold, p)."""
    hit, miss = F.count(F.when(F.col("candidate") & F.col("gold"), 1)), F.sum(F.when(~F.col("candidate") & F.col("gold"), 1 / F.col("p")).otherwise(0.0))
    return rows.agg(ratio(hit, F.count(F.when(F.col("candidate"), 1))).alias("precision"), ratio(hit, hit + miss).alias("recall"))


def flag_effect(rows: DataFrame, *strata: str) -> DataFrame:
    """(n, effect): mean rate with a flag less without, pooled over strata by their size; rows (flag, rate). A stratum without both arms doesn't count."""
    arm = lambda f: F.avg(F.when(F.col("flag") == f, F.col("rate")))
    g = rows.groupBy(*strata).agg((arm(True) - arm(False)).alias("e"), F.count(F.lit(1)).alias("n")).where("e is not null")
    return g.agg(F.sum("n").alias("n"), (F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("effect"))


def growth(first_seen: DataFrame) -> DataFrame:
    """(pos, names): distinct names within the first positions; first_seen has one row a name with its first pos."""
    per = first_seen.groupBy("pos").agg(F.count(F.lit(1)).alias("c"))
    return running(per, [], ["pos"], _u="c").select("pos", (F.col("_u") + F.col("c")).alias("names"))


def heaps_slope(curve: DataFrame) -> DataFrame:
    """One row: slope of ln names on ln (pos + 1)."""
    return curve.agg(F.regr_slope(F.log("names"), F.log(F.col("pos") + 1.0)).alias("slope"))


# --- registry -------------------------------------------------------------------------------------

#: Metrics by name: functions of (rows, *keys) that give one row a key with named values.
METRICS: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str):
    """Register a metric under a name."""

    def add(f: Callable[..., DataFrame]):
        METRICS[name] = f
        return f

    return add


@metric("confusion")
def _confusion(rows: DataFrame, *keys: str) -> DataFrame:
    return confusion(rows, *keys)


@metric("agreement")
def _agreement(rows: DataFrame, *keys: str) -> DataFrame:
    return scored(confusion(rows, *keys)).select(*keys, "precision", "recall", "f1", "mcc")


@metric("auc")
def _auc(rows: DataFrame, *keys: str) -> DataFrame:
    return auc(rows, *keys)


@metric("operating_point")
def _operating_point(rows: DataFrame, *keys: str) -> DataFrame:
    return operating_point(rows, *keys)


def measured(names: list[str], rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, measure, value) of registered metrics over rows (keys, id, pred, gold, score); an unknown name raises KeyError."""
    parts = []
    for name in names:
        m = METRICS[name](rows, *keys)
        values = [c for c in m.columns if c not in keys]
        parts.append(m.select(*keys, F.lit(name).alias("metric"), F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in values))).alias("x")).select(*keys, "metric", "x.measure", "x.value"))
    return reduce(DataFrame.union, parts)
