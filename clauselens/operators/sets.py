"""Set operations, snapshots, diffs, samples and allocations.

Hash order replaces random order: the same seed gives the same rows on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash


def hashed(seed: int, *columns: str) -> Column:
    """Text that orders rows at random, fixed by seed and columns: md5(seed:values), the same in SQL."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def freeze(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows as (keys, content): a canonical JSON of the other columns in name order, and its hash as ``sha``."""
    rest = sorted(c for c in rows.columns if c not in keys)
    body = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return rows.select(*keys, body.alias("content"), F.sha2(body, 256).alias("sha"))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed between two frozen tables; equal rows are left out."""
    a, b = old.select(*keys, F.col("sha").alias("_a")), new.select(*keys, F.col("sha").alias("_b"))
    j = a.join(b, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return j.select(*keys, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def flips(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, direction, cause) of predictions that changed; both sides: keys, score, cut.

    cause: match_change if the score moved, threshold_drift if the cut did, both if both.
    """
    a, b = (df.select(*keys, F.col("score").alias("s" + x), F.col("cut").alias("c" + x)) for df, x in ((old, "a"), (new, "b")))
    j = a.join(b, keys, "full_outer").withColumns({f"p{x}": F.coalesce((F.col("s" + x) > 0) & (F.col("s" + x) >= F.col("c" + x)), F.lit(False)) for x in "ab"}).where("pa <> pb")
    moved, drift = ~F.col("sa").eqNullSafe(F.col("sb")), F.col("ca").isNotNull() & F.col("cb").isNotNull() & (F.col("ca") != F.col("cb"))
    return j.select(*keys, F.when(F.col("pb"), "gained").otherwise("lost").alias("direction"), F.when(moved & drift, "both").when(moved, "match_change").otherwise("threshold_drift").alias("cause"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, gained, lost, novel) of ids whose set of names changed; novel: gained names unknown to the old vocabulary. Both: (id, name)."""
    plus = new.select("id", "name").distinct().join(old, ["id", "name"], "left_anti")
    minus = old.select("id", "name").distinct().join(new, ["id", "name"], "left_anti")
    known = old.select("name").distinct().withColumn("known", F.lit(True))
    p = plus.join(known, "name", "left").select("id", F.lit(1).alias("g"), F.lit(0).alias("l"), F.col("known").isNull().cast("int").alias("v"))
    m = minus.select("id", F.lit(0).alias("g"), F.lit(1).alias("l"), F.lit(0).alias("v"))
    return p.union(m).groupBy("id").agg(F.sum("g").alias("gained"), F.sum("l").alias("lost"), F.sum("v").alias("novel"))


def newest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the largest ``by`` of each key, whole. A struct maximum, so partial results merge before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != by]
    g = rows.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("_r"))
    return g.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in (by, *rest)))


def least_severe(rows: DataFrame, key: str, severity: str, order: str) -> DataFrame:
    """The row of least severity of each key, the first by order of equals."""
    rest = [c for c in rows.columns if c not in (key, severity, order)]
    g = rows.groupBy(key).agg(F.min(F.struct(severity, order, *rest)).alias("_r"))
    return g.select(key, *(F.col(f"_r.{c}").alias(c) for c in (severity, order, *rest)))


def equivalence(rows: DataFrame) -> DataFrame:
    """(signature, first, n): ids with the same set of names, the smallest of them, and how many; rows (id, name).

    The signature is the SHA-256 of the sorted names, their lengths before them, so that no two sets share one by their spelling.
    """
    named = F.transform(F.array_sort(F.collect_set(F.col("name").cast("string"))), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))
    s = rows.groupBy("id").agg(F.sha2(F.array_join(named, ","), 256).alias("signature"))
    return s.groupBy("signature").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))


def separability(classes: DataFrame) -> DataFrame:
    """One row from equivalence(): items, classes, ceiling (classes / items), collided items."""
    n = F.sum("n")
    return classes.agg(n.alias("items"), F.count(F.lit(1)).alias("classes"), (F.count(F.lit(1)) / n).alias("ceiling"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("collided"))


def stratified(rows: DataFrame, stratum: str, id: str, n: int, seed: int = 17) -> DataFrame:
    """Up to n rows of each stratum in hash order. Each task keeps its own n first, so a large stratum isn't gathered."""
    w = Window.partitionBy(stratum).orderBy(hashed(seed, id), id)
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n)


def allocate(sizes: DataFrame, total: int) -> DataFrame:
    """(stratum, n, k): total draws in proportion to n, by largest remainder, ties by stratum; sizes are few rows."""
    everything = Window.partitionBy(F.lit(0))
    share = F.lit(float(total)) * F.col("n") / F.sum("n").over(everything)
    x = sizes.withColumn("share", share).withColumn("base", F.floor("share")).withColumn("left", F.lit(total) - F.sum(F.floor("share")).over(everything))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), "stratum")
    return x.withColumn("rn", F.row_number().over(order)).select("stratum", "n", (F.col("base") + (F.col("rn") <= F.col("left")).cast("int")).alias("k"))


def round_robin(rows: DataFrame, stratum: str, id: str, limit: int) -> DataFrame:
    """limit rows taken in turn over the strata, each in id order; a stratum gives at most limit."""
    w = Window.partitionBy(stratum).orderBy(id)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).orderBy("turn", stratum).limit(limit)


def negatives(scores: DataFrame, near: int, field: int, seed: int = 17) -> DataFrame:
    """(id, pool, p): the best-scored negatives with p = 1, and a hash-ordered sample of the rest with its inclusion probability."""
    top = scores.orderBy(F.desc("score"), "id").limit(near).select("id", F.lit("near").alias("pool"), F.lit(1.0).alias("p"))
    rest = scores.join(top.select("id"), "id", "left_anti")
    frame = rest.agg(F.count(F.lit(1)).alias("m"))
    drawn = rest.orderBy(hashed(seed, "id"), "id").limit(field).crossJoin(frame)
    return top.union(drawn.select("id", F.lit("field").alias("pool"), F.least(F.lit(1.0), F.lit(float(field)) / F.col("m")).alias("p")))


def to_budget(occurrences: DataFrame, budget: int, seed: int = 17) -> DataFrame:
    """Names in hash order until their occurrences before reach a budget; occurrences (name, n): a vocabulary."""
    w = Window.partitionBy(F.lit(0)).orderBy(hashed(seed, "name"), "name").rowsBetween(Window.unboundedPreceding, -1)
    return occurrences.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < budget).drop("before")


def batches(rows: DataFrame, section: str, order: str, size: int) -> DataFrame:
    """rows with batch: numbers from 0 inside each section, nothing dropped."""
    w = Window.partitionBy(section).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def split_pairs(rows: DataFrame, key: str, seed: int = 17) -> DataFrame:
    """rows with side: dev or held, by a coin for each key."""
    return rows.withColumn("side", F.when(F.substring(hashed(seed, key), 1, 1) < "8", "dev").otherwise("held"))


def kept_by_gate(rows: DataFrame, seed: str, bucket: str, id: str, rate: str) -> DataFrame:
    """rows with keep: the first 32 bits of sha256(seed:bucket:id) as a share of 2^32 - 1 lie below the bucket's rate."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(bucket).cast("string"), F.col(id).cast("string")), 256)
    return rows.withColumn("keep", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0) < F.col(rate))


def versions(stored: DataFrame, current: DataFrame, id: str, contract: list[str], provenance: list[str]) -> DataFrame:
    """(id, state): current, stale_contract, stale_provenance, missing or orphan, by hashes of two groups of columns."""
    h = lambda df, x: df.select(id, content_hash(*map(F.col, contract)).alias("c" + x), content_hash(*map(F.col, provenance)).alias("p" + x))
    j = h(stored, "s").join(h(current, "n"), id, "full_outer")
    state = F.when(F.col("cs").isNull(), "missing").when(F.col("cn").isNull(), "orphan").when(F.col("cs") != F.col("cn"), "stale_contract").when(F.col("ps") != F.col("pn"), "stale_provenance").otherwise("current")
    return j.select(id, state.alias("state"))


def waivers(findings: DataFrame, waived: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): open findings, honoured waivers and unused ones."""
    j = findings.select(*keys).distinct().withColumn("f", F.lit(1)).join(waived.select(*keys).distinct().withColumn("w", F.lit(1)), keys, "full_outer")
    return j.select(*keys, F.when(F.col("f").isNull(), "unused").when(F.col("w").isNull(), "open").otherwise("honoured").alias("status"))


def without_names(annotations: DataFrame, queries: DataFrame, drop: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Both tables without the names of drop (name): a set operation on the shared vocabulary. Neither is changed otherwise."""
    gone = drop.select(name).distinct()
    return annotations.join(gone, name, "left_anti").select(*annotations.columns), queries.join(gone, name, "left_anti").select(*queries.columns)


def emptied(annotations: DataFrame, drop: DataFrame, id: str = "id", name: str = "name") -> DataFrame:
    """Ids all of whose names are dropped."""
    gone = drop.select(name).distinct()
    return annotations.select(id).distinct().join(annotations.join(gone, name, "left_anti").select(id).distinct(), id, "left_anti")


def conflict_buckets(tool: DataFrame, baseline: DataFrame) -> DataFrame:
    """(a, b, bucket) of unordered pairs: tool_only, baseline_only or both. Both: (a, b)."""
    pairs = lambda df, x: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(x, F.lit(True))
    j = pairs(tool, "_t").join(pairs(baseline, "_s"), ["a", "b"], "full_outer")
    return j.select("a", "b", F.when(F.col("_t") & F.col("_s"), "both").when(F.col("_t"), "tool_only").otherwise("baseline_only").alias("bucket"))
