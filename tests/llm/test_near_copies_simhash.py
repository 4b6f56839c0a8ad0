"""The SimHash step of the near-copy stage against brute force over all pairs of fingerprints."""

import random

import pytest

pytest.importorskip("public_tokenizers")
from clauselens.llm import near_copies  # noqa: E402


def test_ball_groups(spark):
    """Fingerprints linked through at most 4 differing bits are one group; the operator's balls find it, not the bands."""
    rng, fps = random.Random(3), []
    for _ in range(60):
        fps.append(rng.getrandbits(64))
        for k in (0, 3, 4, 4, 5):
            x = fps[-1]
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            fps.append(x)
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add(i)
    known = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "id bigint, fp bigint")
    got = {}
    for r in near_copies.ball_groups(known).collect():
        got.setdefault(r.key, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_fingerprints_follow_the_texts(spark):
    """An edit of one word in 400 moves few bits: such a pair is a ball group."""
    rng = random.Random(4)
    w = ["".join(rng.choices("etaoinsh", k=5)) for _ in range(400)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:-1]))], "doc_id bigint, text string")
    a, b = (r.fp for r in near_copies.featured(docs).collect())
    assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
