"""Resampling, noise floors, null distributions and small learned read-outs.

A bootstrap gives each row a Poisson(1) weight in each replicate, read from the first 32 bits of
md5(seed:replicate:id), so draws are the same on any cluster and in SQL. Replicates are group keys of
one plan: rows are multiplied in place, summed on the map side, and never joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import auc, mcc

# Cumulative probabilities of Poisson(1), from 0 on.
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.9999898046)


def uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) from a seed and values."""
    said = F.concat_ws(":", F.lit(str(seed)), *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def poisson(u: Column) -> Column:
    """The Poisson(1) count at a quantile, at most 8."""
    out = F.when(u < POISSON[0], 0)
    for k, p in enumerate(POISSON[1:], 1):
        out = out.when(u < p, k)
    return out.otherwise(len(POISSON))


def replicated(rows: DataFrame, replicates: int, first: int = 1) -> DataFrame:
    """rows once for each r from first to replicates."""
    return rows.select("*", F.explode(F.sequence(F.lit(first), F.lit(replicates))).alias("r"))


def interval(draws: DataFrame, value: str, at: tuple[float, ...] = (0.025, 0.975)) -> list[Column]:
    """Percentiles as columns low, high."""
    return [F.percentile(value, at[0]).alias("low"), F.percentile(value, at[1]).alias("high")]


def bootstrap_mean(values: DataFrame, replicates: int = 2000, seed: int = 17) -> DataFrame:
    """One row: mean, low, high (2.5 and 97.5 percentiles of resampled means). values (id, x)."""
    w = poisson(uniform(seed, "r", "id"))
    means = replicated(values.select("id", "x"), replicates).withColumn("w", w).groupBy("r").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return values.agg(F.avg("x").alias("mean")).crossJoin(means.agg(*interval(means, "m")))


def _weighted_mcc(pred: str, *, w: str = "w") -> Column:
    k = lambda p, g: F.coalesce(F.sum(F.when((F.col(pred) == p) & (F.col("gold") == g), F.col(w))), F.lit(0))
    return mcc(k(True, True), k(True, False), k(False, True), k(False, False))


def paired_bootstrap(cells: DataFrame, replicates: int = 2000, seed: int = 17) -> DataFrame:
    """One row: delta of the mean MCC of two predictors over cells, low, high. One draw serves both sides; cells weigh the same.

    cells (cell, id, gold, a, b booleans).
    """
    w = F.when(F.col("r") == 0, 1).otherwise(poisson(uniform(seed, "r", "cell", "id")))
    x = replicated(cells.select("cell", "id", "gold", "a", "b"), replicates, 0).withColumn("w", w)
    g = x.groupBy("cell", "r").agg(_weighted_mcc("a").alias("ma"), _weighted_mcc("b").alias("mb"))
    d = g.groupBy("r").agg(F.avg(F.col("ma") - F.col("mb")).alias("d")).withColumn("drawn", F.when(F.col("r") > 0, F.col("d")))
    return d.agg(F.max(F.when(F.col("r") == 0, F.col("d"))).alias("delta"), *interval(d, "drawn"))


def noise_floor(cells: DataFrame, replicates: int = 2000, seed: int = 17) -> DataFrame:
    """One row: floor, half the 95 % width of the difference between two independent draws of one predictor. cells (cell, id, gold, a)."""
    x = replicated(cells.select("cell", "id", "gold", "a"), replicates).withColumns({f"w{s}": poisson(uniform(seed + s, "r", "cell", "id")) for s in (0, 1)})
    g = x.groupBy("cell", "r").agg((_weighted_mcc("a", w="w0") - _weighted_mcc("a", w="w1")).alias("d")).groupBy("r").agg(F.avg("d").alias("d"))
    return g.agg(*interval(g, "d")).select(((F.col("high") - F.col("low")) / 2).alias("floor"))


def set_null(values: DataFrame, chosen: DataFrame, replicates: int = 999, seed: int = 17) -> DataFrame:
    """One row: observed mean of the chosen ids, p = (1 + as large) / (replicates + 1) among hash-drawn sets of about that size. values (id, x), chosen (id)."""
    flagged = values.join(chosen.select("id").distinct().withColumn("c", F.lit(True)), "id", "left")
    size = flagged.agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("k"), F.avg(F.when(F.col("c"), F.col("x"))).alias("seen"))
    each = replicated(flagged.crossJoin(size), replicates)
    m = each.where(uniform(seed, "r", "id") < F.col("k") / F.col("n")).groupBy("r", "seen").agg(F.avg("x").alias("m"))
    return m.agg(F.max("seen").alias("observed"), ((1 + F.count(F.when(F.col("m") >= F.col("seen"), 1))) / F.lit(replicates + 1.0)).alias("p"))


def random_names(vocabulary: DataFrame, matched: DataFrame, seeds: int, seed: int = 17) -> DataFrame:
    """(s, name, n): for each seed, names in hash order until their occurrences reach those of a matched set, so that controls delete as much.

    vocabulary (name, n occurrences), matched (name): the set whose occurrences are the budget. Names of the set aren't drawn.
    """
    from .ordered import running

    budget = vocabulary.join(matched.select("name").distinct(), "name", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("budget"))
    rest = vocabulary.join(matched.select("name").distinct(), "name", "left_anti").select("name", "n", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("s"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("s").cast("string"), "name"))
    return running(rest, ["s"], [order, "name"], _b="n").crossJoin(budget).where(F.col("_b") < F.col("budget")).select("s", "name", "n")


def cut_bootstrap(scores: DataFrame, rule, replicates: int = 20, seed: int = 17) -> DataFrame:
    """(key, low, mid, high) of a cut rule over resampled scores; the replicate is part of the rule's key. scores (key, id, score)."""
    drawn = replicated(scores.where("score > 0").select("key", "id", "score"), replicates).withColumn("t", poisson(uniform(seed, "r", "id"))).where("t > 0")
    keyed = drawn.select(F.concat_ws("\u0001", "key", "r").alias("key"), "id", "score", F.explode(F.sequence(F.lit(1), F.col("t"))))
    cuts = rule(keyed.select("key", "id", "score")).select(F.substring_index("key", "\u0001", 1).alias("key"), "cut")
    return cuts.groupBy("key").agg(*(F.percentile("cut", q).alias(a) for q, a in ((0.05, "low"), (0.5, "mid"), (0.95, "high"))))


def ablation(channels: DataFrame, names: list[str], weights: dict[str, float]) -> DataFrame:
    """(variant, q, id, score): the weighted sum with all channels, with each one left out, and with the first alone. One scan: variants are an array."""
    full = {n: weights[n] for n in names}
    variants = {"full": full, **{f"minus {n}": full | {n: 0.0} for n in names}, f"{names[0]} only": {n: full[n] if n == names[0] else 0.0 for n in names}}
    each = [F.struct(F.lit(v).alias("variant"), sum((F.lit(w[n]) * F.col(n) for n in names), F.lit(0.0)).alias("score")) for v, w in variants.items()]
    return channels.select("q", "id", F.explode(F.array(*each)).alias("x")).select("x.variant", "q", "id", "x.score")


def out_of_fold(rows: DataFrame, features: list[str], label: str, id: str, folds: int = 5, seed: int = 17) -> DataFrame:
    """(id, fold, score): logistic scores of each row from the other folds; a diagnostic. Folds are by hash of the id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), id), F.lit(folds))).withColumn("label", F.col(label).cast("double")))
    out = None
    for k in range(folds):
        model = LogisticRegression(regParam=0.1, elasticNetParam=0.0).fit(data.where(F.col("fold") != k))
        one = model.transform(data.where(F.col("fold") == k)).select(id, "fold", vector_to_array("probability")[1].alias("score"))
        out = one if out is None else out.union(one)
    return out


def principal_vectors(rows: DataFrame, id: str, vector: str, k: int = 8) -> DataFrame:
    """(id, vec): dense vectors projected on their first k principal components (distributed covariance)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(data).transform(data).select(id, vector_to_array("p").alias("vec"))


def cluster_bootstrap(values: DataFrame, replicates: int = 2000, seed: int = 17) -> DataFrame:
    """One row: mean, low, high of x when whole clusters are drawn. values (cluster, x); clusters are summed before they are multiplied."""
    sums = values.groupBy("cluster").agg(F.sum("x").alias("s"), F.count("x").alias("c"))
    w = poisson(uniform(seed, "r", "cluster"))
    means = replicated(sums, replicates).withColumn("w", w).groupBy("r").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("c")), F.lit(0))).alias("m"))
    return sums.agg((F.sum("s") / F.sum("c")).alias("mean")).crossJoin(means.agg(*interval(means, "m")))


def paired_auc(rows: DataFrame, replicates: int = 1000, seed: int = 17) -> DataFrame:
    """One row: delta of the AUCs of two scores, low, high; each draw serves both. rows (id, gold, a, b)."""
    w = F.when(F.col("r") == 0, 1).otherwise(poisson(uniform(seed, "r", "id")))
    x = replicated(rows.select("id", "gold", "a", "b"), replicates, 0).withColumn("w", w).where("w > 0")
    both = x.select("r", "gold", "w", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("score")), F.struct(F.lit("b").alias("side"), F.col("b").alias("score")))).alias("s")).select("r", "gold", "w", "s.side", "s.score")
    d = auc(both, "r", "side", weight="w").groupBy("r").agg(F.sum(F.when(F.col("side") == "a", F.col("auc")).otherwise(-F.col("auc"))).alias("d"), F.count("auc").alias("k"))
    d = d.where("k = 2").withColumn("drawn", F.when(F.col("r") > 0, F.col("d")))
    return d.agg(F.max(F.when(F.col("r") == 0, F.col("d"))).alias("delta"), *interval(d, "drawn"))


def auc_null(rows: DataFrame, replicates: int = 200, seed: int = 17) -> DataFrame:
    """(r, delta): differences of mean AUC between two random rankings over cells; what no information looks like. rows (cell, id, gold)."""
    x = replicated(rows.select("cell", "id", "gold"), replicates).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    a = auc(x.select("cell", "r", "side", "gold", uniform(seed, "r", "side", "cell", "id").alias("score")), "cell", "r", "side")
    return a.groupBy("r").agg((F.avg(F.when(F.col("side") == 0, F.col("auc"))) - F.avg(F.when(F.col("side") == 1, F.col("auc")))).alias("delta"))
