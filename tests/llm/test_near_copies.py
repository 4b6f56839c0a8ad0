"""Near copies against brute-force Jaccard of five-word shingle sets."""

import random
from itertools import combinations

import pytest

pytest.importorskip("public_tokenizers")
from clauselens.llm import near_copies  # noqa: E402

LETTERS = "etaoinshrdlucm"


def words(rng, n):
    return ["".join(rng.choices(LETTERS, k=rng.randint(2, 9))) for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts):
    """The smallest place that links of exactly 0.8 or more reach, for each text."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(texts))]


def groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(df).collect()}
    return [got[i] for i in range(len(texts))]


def edited(rng, w, places):
    w = list(w)
    for k in places:
        w[k] = "new" + str(rng.randint(0, 10**9))
    return w


@pytest.mark.parametrize("block", [128, 8])
def test_crowds_and_stars(spark, monkeypatch, block):
    """Links that only one pair of a large group carries: copies of one original, and a near pair in a crowd with the same words."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(5)
    star = words(rng, 304)
    texts = [" ".join(star)] + [" ".join(edited(rng, star, rng.sample(range(5, 299), 5))) for _ in range(150)]
    crowd = words(rng, 200)
    for _ in range(60):
        rng.shuffle(crowd)
        texts.append(" ".join(crowd))
    texts += [" ".join(edited(rng, t.split(), [50, 150])) for t in texts[-4:]]
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    want = brute(texts)
    assert len(set(want)) < 80
    assert groups(spark, texts) == want


@pytest.fixture(scope="module")
def passages():
    """300 pairs of texts whose similarity a replaced, cut or appended passage brings to between 0.8 and 0.83."""
    rng, pairs = random.Random(6), []
    while len(pairs) < 300:
        w = words(rng, rng.randint(150, 600))
        k, kind = int(len(w) * rng.uniform(0.08, 0.26)), len(pairs) % 3
        at = rng.randrange(len(w) - k)
        other = w + words(rng, k) if kind == 0 else w[:at] + w[at + k :] if kind == 1 else w[:at] + words(rng, k) + w[at + k :]
        if 0.8 <= jaccard(shingles(" ".join(w)), shingles(" ".join(other))) < 0.83:
            pairs.append((" ".join(w), " ".join(other)))
    return pairs


def test_recall_with_passage_edits(spark, passages):
    got = groups(spark, [t for pair in passages for t in pair])
    caught = sum(got[2 * k] == got[2 * k + 1] for k in range(len(passages)))
    print(f"recall {caught} of {len(passages)}")
    assert caught >= 0.99 * len(passages)


def test_links_are_exact(spark):
    """Repeated lines and pairs below 0.8 link nothing."""
    rng = random.Random(7)
    line, texts = " ".join(words(rng, 14)), []
    texts += [" ".join([*words(rng, rng.randint(150, 300)), *[line] * 20]) for _ in range(10)]
    for _ in range(40):
        w = words(rng, 300)
        texts += [" ".join(w), " ".join(edited(rng, w, rng.sample(range(5, 295), 8)))]
    assert groups(spark, texts) == brute(texts) == list(range(len(texts)))
