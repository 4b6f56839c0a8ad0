"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 7).

Two fingerprints at most ``radius`` bits apart (radius even) have a variant in common that is at most
radius / 2 bits from each. Every distinct fingerprint emits all its variants within radius / 2 (2081
for 64 bits and radius 4); equal variants meet in one bucket, and what meets there is verified.

How the variants travel: the bucket of a variant is a linear hash over GF(2), so the bucket of
``fingerprint ^ mask`` is ``bucket(fingerprint) ^ bucket(mask)``. A fingerprint is therefore sent to
each bucket that one of its variants falls in, and the bucket writes out just those variants. The
number of buckets follows the number of fingerprints, so that a bucket's variants fit in memory at
every size; with few buckets a fingerprint travels once for many variants. Buckets are worked off in
passes that each send at most about ``PASS_BYTES`` a fingerprint; a pass ends in the shared folder
and its shuffle files go, so the disk that is needed at once stays in proportion to the input, also
where a fingerprint's variants fall into thousands of buckets.

Memory: all variants of a bucket (about ``BUCKET_VARIANTS``). Equal fingerprints are merged first, so
copies cost nothing here. Links inside a bucket leave it as a spanning forest, never as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, documents, local_roots, python_ready, slices, texts_of

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
BUCKET_VARIANTS, LEAST_BUCKET_BITS = 4_000_000, 7
#: Bytes that a fingerprint may send in one pass.
PASS_BYTES = 4096
#: Set bits of a byte, lowest first.
_BIT_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = np.arange(8) * 256
SHINGLES_AT_ONCE = 100_000


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit set."""
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048)
    return (counts.reshape(8, 256) @ _BIT_OF).ravel()


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, some at a time. Fewer words than size: one shingle; none: nothing."""
    words = text.lower().split()
    if not words:
        return
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for i in range(0, len(starts), SHINGLES_AT_ONCE):
        pairs = zip(starts[i : i + SHINGLES_AT_ONCE].tolist(), ends[i : i + SHINGLES_AT_ONCE].tolist(), strict=True)
        yield np.array([digest(whole[a:b], seed) for a, b in pairs], dtype="<u8")


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, size):
        n += len(h)
        counts += bit_counts(h)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp holds the 64 bits as a signed bigint. Null text is empty."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column(1))
            for i, j in slices(at, 8 << 20):
                part = data[at[i] : at[j]].tobytes()
                fps = np.array([simhash(part[at[k] - at[i] : at[k + 1] - at[i]], size) for k in range(i, j)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


@cache
def ball(bits: int, half: int, bucket_bits: int) -> tuple[np.ndarray, ...]:
    """Column hashes of the bits, then the masks within half sorted by bucket, their distinct buckets, starts and counts."""
    columns = np.random.default_rng(7).integers(0, 1 << bucket_bits, bits, dtype=np.uint64)
    masks = np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(bits), k)], dtype=np.uint64)
    of = bucket_of(masks, columns)
    order = np.argsort(of, kind="stable")
    classes, starts, counts = np.unique(of[order], return_index=True, return_counts=True)
    return columns, masks[order], classes, starts, counts


def bucket_of(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The linear hash: the exclusive or of the columns of the set bits."""
    out = np.zeros(len(x), np.uint64)
    for i, c in enumerate(columns):
        out ^= ((x >> np.uint64(i)) & np.uint64(1)) * c
    return out


def bucket_bits_for(n: int, bits: int, half: int, least: int = LEAST_BUCKET_BITS) -> int:
    """Bits of a bucket number, for at most about BUCKET_VARIANTS variants in each and enough buckets to share out."""
    each = sum(math.comb(bits, k) for k in range(half + 1))
    return min(40, max(least, math.ceil(math.log2(max(1, n * each / BUCKET_VARIANTS)))))


def passes_for(bits: int, half: int, bucket_bits: int, item_bytes: int) -> int:
    """How many passes keep what an item sends below PASS_BYTES in each."""
    return max(1, math.ceil(len(ball(bits, half, bucket_bits)[2]) * item_bytes / PASS_BYTES))


def packed_by_bucket(buckets: np.ndarray, load: np.ndarray, item_bytes: int) -> tuple[pa.Array, pa.Array]:
    """Distinct buckets, and the bytes of each one's items; buckets are sorted, load has the items in that order."""
    distinct, starts = np.unique(buckets, return_index=True)
    offsets = pa.py_buffer((np.r_[starts, len(buckets)] * item_bytes).astype(np.int64))
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(distinct), [None, offsets, pa.py_buffer(np.ascontiguousarray(load))])
    return pa.array(distinct.view(np.int64)), packed.cast(pa.binary())


def variants_in(fps: np.ndarray, bucket: int, bits: int, half: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants that fall in this bucket, and whose each is (a place in fps)."""
    columns, masks, classes, starts, counts = ball(bits, half, bucket_bits)
    wanted = bucket_of(fps, columns) ^ np.uint64(bucket)
    k = np.minimum(np.searchsorted(classes, wanted), len(classes) - 1)
    n = np.where(classes[k] == wanted, counts[k], 0)
    owner = np.repeat(np.arange(len(fps)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return fps[owner] ^ masks[starts[k][owner] + inner], owner


def links_in(fps: np.ndarray, bucket: int, bits: int, radius: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (places in fps) of the links that this bucket shows."""
    variants, owner = variants_in(fps, bucket, bits, radius // 2, bucket_bits)
    order = np.argsort(variants)
    variants, owner = variants[order], owner[order]
    new = np.r_[True, variants[1:] != variants[:-1]]
    shared = ~(new & np.r_[new[1:], True])
    group, owner, new = np.cumsum(new)[shared], owner[shared], new[shared]
    if not len(group):
        return owner, owner
    first = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    near = np.bitwise_count(fps[owner] ^ fps[first]) <= radius
    group, owner = group[near], owner[near]
    who, owner = np.unique(owner, return_inverse=True)
    root = local_roots(group, owner, len(who))
    out = root != np.arange(len(who))
    return who[out], who[root[out]]


def ball_links(distinct: DataFrame, n: int, bits: int = BITS, radius: int = RADIUS) -> DataFrame:
    """Links u, v (fp values) that connect all fingerprints within radius of each other.

    distinct: a column fp without repeats, n rows. The links are a subset of those within radius that
    has the same components. radius must be even.
    """
    if radius % 2 or not 0 <= radius < bits <= 64:
        raise ValueError("radius must be even and less than bits")
    half = radius // 2
    bucket_bits = bucket_bits_for(n, bits, half)
    passes = passes_for(bits, half, bucket_bits, 8)

    def send(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns, _, classes, _, _ = ball(bits, half, bucket_bits)
            step = max(1, (1 << 21) // len(classes))
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for i in range(0, len(fps), step):
                    some = fps[i : i + step]
                    to = (bucket_of(some, columns)[:, None] ^ classes[None, :]).ravel()
                    mine = np.flatnonzero(to % np.uint64(passes) == number)
                    mine = mine[np.argsort(to[mine], kind="stable")]
                    yield pa.RecordBatch.from_arrays([*packed_by_bucket(to[mine], some[mine // len(classes)], 8)], ["bucket", "load"])

        return run

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(x.as_py() for x in table.column("load")), np.uint64)
        a, b = links_in(fps, key[0].as_py(), bits, radius, bucket_bits)
        return pa.table({"u": fps[a].view(np.int64), "v": fps[b].view(np.int64)})

    found = [distinct.select("fp").mapInArrow(send(k), "bucket bigint, load binary").groupBy("bucket").applyInArrow(meet, "u bigint, v bigint") for k in range(passes)]
    return reduce(DataFrame.union, map(cut, found)) if passes > 1 else found[0]


def near_groups(fps: DataFrame, bits: int = BITS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of fps (doc_id, fp).

    Fingerprints within radius bits are linked; component_id is the smallest doc_id that links reach,
    the own one included (null where no member has an id). Equal fingerprints, zero among them, are
    linked. An empty table gives an empty table; repeated and null ids are kept as they are.
    """
    fps = cut(fps)
    known = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = components(ball_links(known, known.count(), bits, radius))
    rooted = cut(known.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("k", F.xxhash64("root"))
    named = cut(rooted.withColumn("k", F.xxhash64("root")).join(least, ["k", "root"]).select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = near_groups(fingerprints(docs))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
