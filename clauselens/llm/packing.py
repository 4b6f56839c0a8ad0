"""Packing by optimal length buckets (operator 4).

The distinct lengths of all documents make one histogram. Dynamic programming over it finds the
bucket boundaries with the least padding. Inside a bucket every document is padded to the bucket's
longest, so a batch of the token budget holds a fixed number of them.

The histogram is exact: an entry for each distinct length. d distinct lengths add up to at least
d (d + 1) / 2, so a corpus of T tokens has at most sqrt(2 T) of them, 16 bytes each on the driver:
0.6 MB for a billion tokens, 100 MB for 20 trillion.

Numbering the rows of a bucket takes no single task: rows are dealt out by ranges of (bucket,
doc_id, length, row number), numbered within their task, and shifted by the counts of the tasks before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents

BUCKETS, TOKENS = 12, 1 << 16


def word_tokens(text: Column) -> Column:
    """Words of a text and one end token; null is empty."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("bigint")


def cheapest(base: np.ndarray, c: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """For each j the first i from 0 to j with the least base[i] - c[i] * tops[j].

    That i never falls as j grows (tops ascend), so the middle j of a range halves the i of both its
    sides. A level of all ranges is one pass over at most twice as many places as there are j.
    """
    n = len(base)
    out = np.zeros(n, np.int64)
    lo, hi, least, most = (np.array([x], np.int64) for x in (0, n - 1, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(mid, most) - least + 1
        first = np.r_[0, np.cumsum(size)[:-1]]
        i = np.arange(size.sum()) + np.repeat(least - first, size)
        value = base[i] - c[i] * np.repeat(tops[mid], size)
        at = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, first), size))
        who = np.searchsorted(first, at, "right")
        best = i[at[np.r_[True, who[1:] != who[:-1]]]]
        out[mid] = best
        left, right = lo < mid, mid < hi
        lo, hi, least, most = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (least[left], best[right]), (best[left], most[right])))
    return out


def best_boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """The longest length of each bucket, ascending, and the padding in all, for at most so many buckets.

    length: distinct, ascending; count: documents of each. Of equally good boundaries the lower ones, from the last down.
    """
    n = len(length)
    if not n:
        return [], 0
    c, s = np.r_[0, np.cumsum(count)].astype(np.int64), np.r_[0, np.cumsum(count * length)].astype(np.int64)
    tops = np.r_[0, length].astype(np.int64)
    cost = np.r_[0, np.full(n, np.iinfo(np.int64).max // 4)].astype(np.int64)
    choices = []
    for _ in range(min(buckets, n)):  # a bucket of lengths i to j - 1 pads (c[j] - c[i]) * tops[j] - (s[j] - s[i]); an empty one nothing
        i = cheapest(cost + s, c, tops)
        cost = cost[i] + (c - c[i]) * tops - (s - s[i])
        choices.append(i)
    bounds, j = [], n
    for i in reversed(choices):
        if i[j] < j:
            bounds.append(int(tops[j]))
        j = int(i[j])
    return bounds[::-1], int(cost[n])


def boundaries(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """best_boundaries() of a column length. The driver gets the histogram of distinct lengths."""
    rows = lengths.groupBy(F.col("length").cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("length")
    return best_boundaries(rows["length"].to_numpy(), rows["n"].to_numpy(), buckets)[0]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, tokens: int = TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, length, bucket, bucket_len, batch, place, padding.

    bucket_len: what every document of the bucket is padded to. batch and place number the batches
    of a bucket and the documents of a batch from 0, in ascending (doc_id, length) order (null ids first). A
    batch holds as many documents as fit the token budget at bucket_len, at least one, so a longer
    document is a batch of its own and is neither cut nor dropped. Null text is empty. Repeated ids
    are kept. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    lengths = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (word_tokens(F.col("text")) if length is None else length).cast("bigint").alias("length"), F.monotonically_increasing_id().alias("row")))
    bounds = boundaries(lengths, buckets)
    number = F.lit(0)
    for k, b in reversed(list(enumerate(bounds))):
        number = F.when(F.col("length") <= b, k).otherwise(number)
    upper = F.array(*map(F.lit, bounds or [0])).cast("array<bigint>")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lengths.withColumn("bucket", number).repartitionByRange(n, "bucket", "doc_id", "length", "row").sortWithinPartitions("bucket", "doc_id", "length", "row")
    dealt = cut(dealt.withColumn("number", F.monotonically_increasing_id()).withColumn("task", F.shiftright("number", 33)))
    counts = dealt.groupBy("task", "bucket").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # tasks plus buckets at most
    shifts, before = [], {}
    for task, bucket, first, rows in sorted(tuple(r) for r in counts):
        shifts.append((task, bucket, before.get(bucket, 0) - first))
        before[bucket] = before.get(bucket, 0) + rows
    shift = spark.createDataFrame(shifts, "task bigint, bucket int, shift bigint")
    placed = dealt.join(F.broadcast(shift), ["task", "bucket"]).withColumn("index", F.col("number") + F.col("shift"))
    placed = placed.withColumn("bucket_len", F.element_at(upper, F.col("bucket") + 1))
    room = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(tokens) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return placed.select("doc_id", "length", "bucket", "bucket_len", F.floor(F.col("index") / room).alias("batch"), (F.col("index") % room).alias("place"), (F.col("bucket_len") - F.col("length")).alias("padding"))


def batches(packed: DataFrame) -> DataFrame:
    """One row per batch of pack(): bucket, batch, bucket_len, docs, tokens, padding and doc_ids in their places.

    A batch is bounded by the token budget, so its list is too. Null ids stand as null.
    """
    g = packed.groupBy("bucket", "batch").agg(
        F.first("bucket_len").alias("bucket_len"), F.count(F.lit(1)).alias("docs"), F.sum("length").alias("tokens"), F.sum("padding").alias("padding"),
        F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("in_place"),
    )
    return g.select("bucket", "batch", "bucket_len", "docs", "tokens", "padding", F.transform("in_place", lambda x: x["doc_id"]).alias("doc_ids"))


def _layers(buckets: int) -> str:
    """Common table expressions of the dynamic programming, a pair for each bucket, and of the way back."""
    out = ["k0 AS (SELECT j, CASE WHEN j = 0 THEN 0 ELSE 1000000000000000000 END AS cost FROM b)"]
    for k in range(1, buckets + 1):
        out.append(f"k{k} AS (SELECT j, x.cost AS cost, x.i AS i FROM (SELECT t.j, min({{'cost': k.cost + (t.c - f.c) * t.l - (t.s - f.s), 'i': f.j}}) AS x FROM b t JOIN b f ON f.j <= t.j JOIN k{k - 1} k ON k.j = f.j GROUP BY t.j))")
    out.append(f"w{buckets + 1} AS (SELECT max(j) AS j FROM b)")
    out += [f"w{k} AS (SELECT i AS j FROM k{k} WHERE j = (SELECT j FROM w{k + 1}))" for k in range(buckets, 0, -1)]
    return ",\n".join(out)


OP4_SQL = rf"""WITH d AS (SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1)::BIGINT AS length FROM documents),
h AS (SELECT length AS l, count(*)::BIGINT AS n FROM d GROUP BY ALL),
b AS (SELECT row_number() OVER (ORDER BY l) AS j, l, (sum(n) OVER (ORDER BY l))::BIGINT AS c, (sum(n * l) OVER (ORDER BY l))::BIGINT AS s FROM h UNION ALL SELECT 0, 0, 0, 0),
{_layers(BUCKETS)},
u AS (SELECT DISTINCT l FROM b WHERE l > 0 AND j IN ({" UNION ALL ".join(f"SELECT j FROM w{k}" for k in range(2, BUCKETS + 2))})),
o AS (SELECT d.*, (SELECT count(*) FROM u WHERE u.l < d.length)::INT AS bucket, (SELECT min(l) FROM u WHERE u.l >= d.length) AS bucket_len FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, length) - 1 AS index, greatest(1, {TOKENS} // bucket_len) AS room FROM o)
SELECT doc_id, length, bucket, bucket_len, (index // room)::BIGINT AS batch, (index % room)::BIGINT AS place, bucket_len - length AS padding FROM p"""


def op4_query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))
