"""Exact dedup by deterministic block naming (operator 5), with DataFrame functions only.

A text is cut into blocks of a fixed number of code points. The distinct blocks are dealt out by
content and sorted; a block's integer name is its place in that order. Adjacent names are then
paired and the pairs named the same way, level by level, until each document has one name. Equal
(level, name) means equal text, and only that: names come from comparing contents, never from a
hash alone. A hash merely carries the names back to the blocks; where two distinct blocks share a
hash, these blocks are joined by their content instead.

Block text is shuffled once. Every later shuffle carries integers. Hot blocks (copies) are merged
before the shuffle, and the joins that bring names back can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, fresh

#: A run of blanks that isn't one plain space already.
BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BLOCK_CHARS = 2048
NO_RIGHT = -(2**63)


def normalised(text: Column) -> Column:
    """The text with every run of ASCII blanks replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def blocks_of(text: Column, size: int) -> Column:
    """Blocks of so many code points, the last one shorter; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)))


def _place(*keys: str) -> Column:
    """Place in the sorted order of the partition's distinct keys. The partition is set by the keys'
    hash and the order by the keys, so a task that runs again gives the same names."""
    return F.monotonically_increasing_id()


def block_names(rows: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    """(h, name) of each distinct block; rows has a column block."""
    distinct = rows.groupBy("block").agg(F.count(F.lit(1)).alias("uses"))
    return distinct.sortWithinPartitions("block").select(hash_of(F.col("block")).alias("h"), _place("block").alias("name"))


def pair_names(pairs: DataFrame) -> DataFrame:
    """(k, a, b, name) of each distinct pair. k makes the join deal both sides out anew, so that hot pairs can be split."""
    distinct = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses"))
    named = distinct.sortWithinPartitions("a", "b").select("a", "b", _place("a", "b").alias("name"))
    return named.select(F.xxhash64("a", "b").alias("k"), "a", "b", "name")


def identities(
    docs: DataFrame,
    text: Column | None = None,
    block_chars: int = BLOCK_CHARS,
    hash_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, rid (an own number for each row), level, name.

    Rows have equal texts exactly if level and name are equal. docs needs doc_id and text; other
    columns don't matter. Null text is empty, null and repeated doc_id are allowed, an empty table
    gives an empty table.
    """
    norm = normalised(F.col("text")) if text is None else text
    base = docs.select("doc_id", norm.alias("_norm"))
    names = cut(block_names(base.select(F.explode(blocks_of(F.col("_norm"), block_chars)).alias("block")), hash_of))
    clash = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    rows = (
        base.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.sha2("_norm", 256).alias("sha"), blocks_of(F.col("_norm"), block_chars).alias("bs"))
        .select("doc_id", "rid", "sha", F.size("bs").alias("n"), F.posexplode("bs").alias("pos", "block"))
        .select("doc_id", "rid", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "n", "pos", "block", hash_of(F.col("block")).alias("h"))
    )
    plain = ["doc_id", "rid", "sha", "n", "pos", "name"]
    if clash.isEmpty():
        level0 = rows.drop("block").join(names, "h").select(plain)
    else:  # distinct blocks that share a hash: few, and joined by what they hold
        clash = cut(clash)
        shared = base.select(F.explode(blocks_of(F.col("_norm"), block_chars)).alias("block")).withColumn("h", hash_of(F.col("block"))).join(clash, "h", "left_semi")
        own = shared.groupBy("block").agg(F.count(F.lit(1)).alias("uses")).sortWithinPartitions("block").select("block", (-1 - _place("block")).alias("name"))
        rows = cut(rows.join(clash.withColumn("clash", F.lit(True)), "h", "left").withColumn("block", F.when(F.col("clash"), F.col("block"))))
        level0 = rows.where("clash is null").drop("block").join(names, "h").select(plain).union(rows.where("clash").join(cut(own), "block").select(plain))
    level0 = cut(level0)
    heads = level0.where("pos = 0").select("rid", "doc_id", F.col("sha").alias("text_sha256"))
    now, level = level0.select("rid", "n", "pos", "name"), 0
    longest = now.agg(F.max("n")).first()[0] or 0
    done = now.where("n = 1").select("rid", F.lit(0).alias("level"), "name")
    while longest > 1:
        level += 1
        pairs = now.where("n > 1").groupBy("rid", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_RIGHT)).alias("b"),
        )
        pairs = pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        now = cut(pairs.withColumn("k", F.xxhash64("a", "b")).join(pair_names(pairs), ["k", "a", "b"]).select("rid", "n", "pos", "name"))
        done = done.union(now.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        longest = (longest + 1) // 2
    return heads.join(done, "rid")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, copies_of_row.

    keep_id is the smallest doc_id among equal texts (a null id counts as the largest); exactly one
    row of each group is kept, so of repeated rows with one doc_id a single one is. Null text is
    empty, and empty texts are equal. copies_of_row: rows with this doc_id and this text.
    """
    rows = cut(identities(docs, None, block_chars, hash_of))
    keys = ["level", "name"]
    groups = rows.groupBy(keys).agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    groups = groups.select(F.xxhash64(*keys).alias("k"), *keys, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    out = rows.withColumn("k", F.xxhash64(*keys)).join(groups, ["k", *keys])
    return out.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without later copies of a text, all columns as they were.

    The row with the smallest doc_id stays. Rows that repeat both doc_id and text count once.
    """
    i, h = fresh(docs, "own_id"), fresh(docs, "own_sha")
    found = cut(exact_groups(docs).select(F.col("doc_id").alias(i), F.col("text_sha256").alias(h), "kept"))
    kept = found.where("kept").drop("kept")
    keyed = docs.withColumns({h: F.sha2(normalised(F.col("text")), 256), i: F.col("doc_id")})
    same = lambda x, y: x[i].eqNullSafe(y[i]) & (x[h] == y[h])
    left = keyed.join(kept, same(keyed, kept), "left_semi")
    twins = found.groupBy(i, h).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not twins.isEmpty():  # rows that repeat both doc_id and text
        twins = cut(twins)
        left = left.join(twins, same(left, twins), "left_anti").union(left.join(twins, same(left, twins), "left_semi").dropDuplicates([i, h]))
    return left.drop(i, h)


def op5_query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
