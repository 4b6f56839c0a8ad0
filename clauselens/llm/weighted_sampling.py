"""Document fingerprints by consistent weighted sampling (operator 3), with DataFrame functions only.

A text is the multiset of its words (ASCII lower case), weighted by count. For sample k every word x has fixed
random numbers r and c from Gamma(2, 1) and b from (0, 1), all read from one hash of (x, k): b from 24 bits, r and c
as the quantiles of Gamma(2, 1) that 16 bits each choose, looked up in a table instead of taking logarithms. With
weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the word with the least a gives
the sample (x, t). Two texts agree in a sample with a probability that equals their generalised
Jaccard similarity, sum of least weights over sum of largest.

A sample travels as one bigint, ln a in the upper half and 32 hash bits of (x, t) in the lower, so
that a plain min() finds it. The document order (descending doc_id) is dealt out in ranges: each
range also gets a copy of the row that follows its last one, so no task sees more than its range,
and text is shuffled once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

SAMPLES = 64
#: Samples that one aggregate takes; code for more of them at once grows too long to be compiled well.
AT_ONCE = 16
#: Bits that index the quantile tables of Gamma(2, 1).
LEVELS = 16
_LOW, _ODD = (1 << 32) - 1, 0x9E3779B1


def gamma_quantiles(levels: int = LEVELS) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2 ** levels equal shares, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << levels) + 0.5) / (1 << levels)
    x = np.where(p < 0.5, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x


def tables(spark: SparkSession) -> DataFrame:
    """One row: the quantiles r and their logarithms. Its size is fixed, a megabyte."""
    x = gamma_quantiles()
    return spark.createDataFrame([(x.tolist(), np.log(x).tolist())], "r array<double>, log_c array<double>")


def sample_key(word: Column, log_weight: Column, k: Column, r: Column, log_c: Column) -> Column:
    """ln a and 32 bits of (word, t) of sample k as one bigint; the least one of a text is its sample. r and log_c: the tables."""
    bits = F.xxhash64(word, k)
    own_r = F.get(r, bits.bitwiseAND(F.lit((1 << LEVELS) - 1)).cast("int"))
    own_c = F.get(log_c, F.shiftrightunsigned(bits, 40).bitwiseAND(F.lit((1 << LEVELS) - 1)).cast("int"))
    b = (F.shiftrightunsigned(bits, LEVELS).bitwiseAND(F.lit((1 << 24) - 1)) + F.lit(0.5)) / F.lit(float(1 << 24))
    t = F.floor(log_weight / own_r + b)
    upper = F.floor((own_c - own_r * (t - b + F.lit(1.0)) + F.lit(60.0)) * F.lit(float(1 << 24)))  # ln a lies between -60 and 4
    return F.shiftleft(upper, 32).bitwiseOR(word.bitwiseXOR(t * F.lit(_ODD)).bitwiseAND(F.lit(_LOW)))


def words_of(text: Column) -> Column:
    """Lower-cased words (A-Z only); a text without words has the empty word alone."""
    return F.split(F.trim(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")), " +")


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and fingerprint (8 hexadecimal digits a sample) for each row of texts (keys, text).

    keys must name a row. If texts are already dealt out by one of the keys, nothing is shuffled.
    """
    words = texts.select(*keys, F.explode(words_of(F.col("text"))).alias("word")).select(*keys, F.xxhash64("word").alias("word"))
    counts = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n")).select(*keys, "word", F.log("n").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(AT_ONCE))).alias("first"))
    one = counts.crossJoin(F.broadcast(tables(texts.sparkSession)))  # a single row of fixed size
    keyed = [sample_key(F.col("word"), F.col("w"), F.col("first") + F.lit(k), F.col("r"), F.col("log_c")) for k in range(AT_ONCE)]
    least = one.groupBy(*keys, "first").agg(*(F.min(x).alias(f"s{k}") for k, x in enumerate(keyed)))
    digits = F.concat(*(F.lpad(F.hex(F.col(f"s{k}").bitwiseAND(F.lit(_LOW))), 8, "0") for k in range(AT_ONCE)))
    parts = least.select(*keys, "first", digits.alias("digits")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "digits"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["digits"]), "")
    return parts.select(*keys, F.lower(F.substring(whole, 1, 8 * samples)).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = sum(((F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples)), F.lit(0))
    return same / F.lit(float(samples))


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, range, follows: rows dealt out by ranges of doc_id, null ids in the lowest.

    A row with follows = 1 is the copy that closes a range: the first row of the next lower range
    that has rows, for the lowest range the first of all.
    """
    steps = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", steps, 10_000)).first()[0] or [])) if steps else []
    number = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id")))) if bounds else F.lit(0)
    rows = docs.select("doc_id", "text", number.cast("int").alias("range"), F.lit(0).alias("follows"))
    heads = cut(rows.groupBy("range").agg(F.max(F.struct("doc_id", "text")).alias("head")))  # a row for each range
    order = Window.orderBy(F.desc("range"))
    everything = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closing = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(everything)).alias("head"))
    return rows.union(closing.select("head.doc_id", "head.text", "range", F.lit(1)))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half (rounded down) replaced by as many first code points, or all, of the next document
    in descending doc_id order; after the last comes the first. Null text is empty; null ids come
    last; rows with one doc_id are ordered by text, descending. A single row is followed by itself.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ranges = ranges or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # many to a task, so that long texts even out
    rows = in_ranges(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), ranges)
    order = Window.partitionBy("range").orderBy("follows", F.desc_nulls_last("doc_id"), F.desc("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    placed = rows.withColumns({"place": F.row_number().over(order), "next": F.coalesce(F.lead("text").over(order), F.lit(""))})
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next").substr(F.lit(1), half))
    both = placed.select("range", "place", "doc_id", "follows", F.length("text").cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    facts = both.where("follows = 0").select("range", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    texts = both.select("range", "place", F.posexplode(F.array("text", "edited")).alias("which", "text"))
    marks = fingerprints(texts, ["range", "place", "which"], samples)
    pick = lambda i: F.max(F.when(F.col("which") == i, F.col("fingerprint")))
    pairs = marks.groupBy("range", "place").agg(pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint"))
    pairs = pairs.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("place")))
    return facts.join(pairs, ["range", "place"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )


def op3_query(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
