"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash, by operator 7: 64-bit fingerprints of the distinct shingles, those
within its radius found by balls of half the radius; a connected group of fingerprints is a group of
candidates. Pairs near 0.8 differ in 5 to 14 bits, which no ball reaches. For these, texts that share
a band of ROWS MinHashes of their shingle sets, in one of BANDS, are groups as well; a pair at
similarity s does so with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9999 at 0.8. Every link is then
verified with the shingle sets themselves.

The pairs of a group are never all written out. First each text of a group is held against one of
them; what these links connect needs no more pairs. Then, in groups that still hold several
components, all texts outside the largest component are held against all others, in blocks of at
most about BLOCK texts on each side that are dealt out to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fresh, python_ready, slices, texts_of
from .simhash import ball_links, bit_counts, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, BLOCK = 32, 6, 128
#: Words of 64 bits of a wide SimHash.
WIDE = 4
_SHIFT, _TIMES = (np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def most_bits(similarity: float) -> int:
    """Bits of a wide SimHash that may differ at this similarity: the likely number and one standard deviation.

    An estimate that no link rests on any more. Sets of one size with Jaccard similarity J have
    cosine 2 J / (1 + J); a bit differs with probability angle / pi.
    """
    p, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WIDE
    return round(n * p + math.sqrt(n * p * (1 - p)))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash."""
    x = (h ^ _MIX[k % 4]) * _MIX[(k + 1) % 4]
    x ^= x >> np.uint64(31)
    x *= _MIX[(k + 2) % 4]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    found = list(shingle_hashes(text, SHINGLE))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def fingerprint(s: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set: a bit is 1 if it is set in over half of the hashes; 0 for an empty set."""
    return np.packbits(2 * bit_counts(s) > len(s), bitorder="little").view(np.int64)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of MinHashes of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 128):
        np.minimum(least, ((s[i : i + 128, None] ^ _SHIFT) * _TIMES).min(0), out=least)
    least, key = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key ^ least[:, k], k)
    return key


def mapped(docs: DataFrame, names: list[str], schema: str, columns) -> DataFrame:
    """For each row of docs (doc_id, text) what columns says of the shingle sets of some texts. Null text is empty."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column(1))
            for i, j in slices(at, 8 << 20):
                raw = data[at[i] : at[j]].tobytes()
                sets = [shingle_set(raw[at[k] - at[i] : at[k + 1] - at[i]]) for k in range(i, j)]
                ids = pa.array(np.array([set_id(s) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(columns(batch.column(0)[i:j], ids, sets), names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, id, fp, keys) for each row of docs; id names the shingle set, fp is its SimHash."""

    def columns(doc_ids, ids, sets):
        keys = np.concatenate([band_keys(s) for s in sets]).view(np.int64)
        return [doc_ids, ids, pa.array(np.concatenate([fingerprint(s) for s in sets])), pa.FixedSizeListArray.from_arrays(pa.array(keys), BANDS).cast(pa.list_(pa.int64()))]

    return mapped(docs, ["doc_id", "id", "fp", "keys"], "doc_id bigint, id bigint, fp bigint, keys array<bigint>", columns)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles) for each row of docs."""
    return mapped(docs, ["id", "shingles"], "id bigint, shingles binary", lambda _, ids, sets: [ids, pa.array([s.tobytes() for s in sets], pa.binary())])


def of_groups(rows: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """rows joined to groups (key, n, ...) by key. hot: the keys of all groups of more than BLOCK rows; these rows stay where they are."""
    few = rows.join(F.broadcast(hot), "key", "left_anti").join(groups.where(F.col("n") <= BLOCK), "key")
    many = rows.join(F.broadcast(groups.where(F.col("n") > BLOCK)), "key")
    return few.unionByName(many)


def parts(n) -> F.Column:
    """Blocks of so many rows."""
    return F.ceil(n / BLOCK).cast("int")


def numbers(n) -> F.Column:
    """A row for each of 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v of this Jaccard similarity or more. A v of many pairs is sent to several tasks."""
    many = F.broadcast(cut(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)))
    share = F.coalesce(parts(F.col("n")), F.lit(1))
    left = pairs.join(many, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), share).cast("int").alias("part"))
    right = sets.withColumnRenamed("id", "v").join(many, "v", "left").select("v", F.col("shingles").alias("b"), numbers(share).alias("part"))
    both = left.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(right, ["v", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(shared / max(1, len(a) + len(b) - shared) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def links_between(ids: np.ndarray, roots: np.ndarray, seeking: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links of rows that seek to the others, one for each other component that has a similar text."""
    size = np.array([len(s) for s in sets])
    other = np.flatnonzero(~seeking & (size > 0))
    u, v = [], []
    if not len(other):
        return u, v
    known, code = np.unique(np.concatenate([sets[k] for k in other]), return_inverse=True)
    starts = np.r_[0, np.cumsum(size[other])[:-1]]
    for k in np.flatnonzero(seeking):
        mark = np.zeros(len(known), np.int64)
        mark[np.searchsorted(known, np.intersect1d(known, sets[k], assume_unique=True))] = 1
        shared = np.add.reduceat(mark[code], starts)
        near = other[(shared / (size[k] + size[other] - shared) >= similarity) & (roots[other] != roots[k])]
        for m in near[np.unique(roots[near], return_index=True)[1]]:
            u.append(int(ids[k]))
            v.append(int(ids[m]))
    return u, v


def remaining_links(members: DataFrame, roots: DataFrame, hot: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links u, v between components (node, root) that share a group of members (key, n, id)."""
    at = roots.withColumnRenamed("node", "id")
    rows = cut(members.where("n > 2").select("key", "id").join(at, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max_by("root", "c").alias("largest"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
    rows = of_groups(rows, cut(open_), hot)
    i, j, place = parts(F.col("outside")), parts(F.col("n")), F.xxhash64("id")
    others = rows.select("key", "id", "root", numbers(i).alias("i"), F.pmod(place, j).cast("int").alias("j"), F.lit(False).alias("seeking"))
    seeking = rows.where("root <> largest").select("key", "id", "root", F.pmod(place, i).cast("int").alias("i"), numbers(j).alias("j"), F.lit(True).alias("seeking"))

    def meet(table: pa.Table) -> pa.Table:
        ids, of, seek = (table.column(c).to_numpy() for c in ("id", "root", "seeking"))
        s = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        u, v = links_between(ids, of, seek.astype(bool), s, similarity)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return cut(others.union(seeking)).join(sets, "id").groupBy("key", "i", "j").applyInArrow(meet, "u bigint, v bigint")


def ball_groups(known: DataFrame) -> DataFrame:
    """(key, id) of ids (id, fp) whose fingerprints are linked through differences of at most the radius; equal ones are."""
    prints = cut(known.select("fp").distinct())
    roots = components(ball_links(prints, prints.count())).withColumnRenamed("node", "fp")
    return known.select("id", "fp").join(roots, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit(64)).alias("key"), "id")


def candidate_groups(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, rep, id) of the ids that share a ball group or a band, once for equal groups, and the keys of more than BLOCK ids."""
    rows = known.select(F.explode("keys").alias("key"), "id").union(cut(ball_groups(known)))
    prints = F.sum(F.shiftright(F.xxhash64("id"), 24)).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b")
    groups = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"), *prints).where("n > 1"))
    once = cut(groups.groupBy("n", "rep", "a", "b").agg(F.min("key").alias("key")).select("key", "n", "rep"))
    hot = groups.where(F.col("n") > BLOCK).select("key")
    return cut(of_groups(rows, once, hot)), hot


def near_copy_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of docs: the smallest doc_id that links of this similarity reach.

    Null text is empty; texts without words are linked. component_id is null where no member has an
    id. Repeated rows are linked. An empty table gives an empty table.
    """
    found = cut(featured(docs))
    known = cut(found.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    members, hot = candidate_groups(known)
    sets = cut(shingle_sets(docs).join(members.select("id").distinct(), "id").groupBy("id").agg(F.first("shingles").alias("shingles")))
    pairs = cut(members.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct())
    links = cut(verified(pairs, sets, similarity))
    links = links.union(cut(remaining_links(members, components(links), hot, sets, similarity)))
    at = components(links).withColumnRenamed("node", "id")
    rooted = cut(known.select("id", "first").join(at, "id", "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("k", F.xxhash64("root"))
    named = cut(rooted.withColumn("k", F.xxhash64("root")).join(least, ["k", "root"]).select("id", "component_id"))
    return found.select("doc_id", "id").join(named, "id").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near copies of another: of each group the row with the smallest doc_id stays.

    Rows without a doc_id can't be named and all stay. All columns stay as they were.
    """
    i = fresh(docs, "out_id")
    out = near_copy_groups(docs, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias(i)).distinct()
    return docs.join(out, docs["doc_id"] == out[i], "left_anti")
