"""The pipeline against a plain-Python version of its five stages.

The language stage has a rule that holds for this corpus: all texts with letters are in their own
language, so only texts without any are rejected. Random strings are scored by the trained models.
"""

import random
import re
from itertools import combinations

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from clauselens.llm import packing, secrets  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {"en": "er on an re he in ed nd ha at".split(), "de": "sch ung eit ver zu ein ich lich".split()}
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(8)
    words = lambda lang, n: ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 5))) for _ in range(n)]
    texts = [(lang, words(lang, rng.randint(60, 250))) for lang in ("en", "de") for _ in range(100)]
    for k in range(0, 60, 3):  # passages appended, cut and replaced, and exact copies
        lang, w = texts[k]
        n = int(len(w) * (0.1, 0.17, 0.35)[k % 9 // 3])
        texts += [(lang, w + words(lang, n)), (lang, w[n:]), (lang, w[:20] + words(lang, n // 2) + w[20 + n // 2 :]), (lang, list(w))]
    line = words("en", 12)
    texts += [("en", words("en", 160) + line * 15) for _ in range(8)]
    star = words("en", 304)
    for _ in range(40):
        v = list(star)
        for i in rng.sample(range(5, 299), 5):
            v[i] = words("en", 1)[0] + "ha"
        texts.append(("en", v))
    texts.append(("en", star))
    rows = [(lang, " ".join(w)) for lang, w in texts]
    rows += [("en", " ".join(words("en", 80)) + tail) for tail in (" AKIA" + "ABCDEFGH12345678", ' secretoken = "abcdefghijkl"', " deadbeef01234567 ha", " xK9vQ2mZr7Lp4TbW8s")]
    rows += [("en", "12345 !!!"), (None, None)]
    rng.shuffle(rows)
    return [(i * 7, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(rows)]


def near_groups(docs):
    sets = {}
    for i, t in docs.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(docs), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: top(i) for i in docs}


def redacted(t):
    models, spans = secrets.trained(), []
    spans += [(*m.span(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    spans += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    spans += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]{16,}", t)]
    spans += [(*m.span(), "random") for m in re.finditer("[A-Za-z0-9+/_-]{16,}", t) if models.score(m[0].encode()) > models.threshold]
    out, i, kinds = "", 0, ["assign", "access", "hex", "random"]
    spans.sort(key=lambda s: (s[0], kinds.index(s[2])))
    while spans:
        a, b, kind = spans.pop(0)
        while spans and spans[0][0] < b:
            b = max(b, spans.pop(0)[1])
        out, i = out + t[i:a] + f"<{kind}>", b
    return out + t[i:]


def least_padding(lengths, buckets):
    """Padding of the best cut of sorted lengths into at most so many buckets."""
    x = sorted(lengths)
    total = [0]
    for v in x:
        total.append(total[-1] + v)
    best = [0] + [float("inf")] * len(x)
    for _ in range(buckets):
        best = [0] + [min(best[j], *(best[i] + (j - i) * x[j - 1] - total[j] + total[i] for i in range(j))) for j in range(1, len(x) + 1)]
    return best[-1]


def test_run_equals_the_reference(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        stages[name] = {r.doc_id: r.text for r in docs.collect()}
    want = {i: t for i, t, *_ in rows if t and re.search("[a-z]", t)}
    assert stages["language_id"] == want
    first = {}
    for i in sorted(want):
        first.setdefault(SPACE.sub(" ", want[i]), i)
    want = {i: want[i] for i in first.values()}
    assert stages["exact_dedup"] == want
    want = {i: want[i] for i, root in near_groups(want).items() if i == root}
    assert stages["simhash_near_dedup"] == want
    want = {i: redacted(t) for i, t in want.items()}
    assert stages["secret_scan"] == want
    assert sum("<" in t for t in want.values()) >= 4
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    length = {i: len(SPACE.sub(" ", t).split()) + 1 for i, t in want.items()}
    assert sorted((r.doc_id, r.length) for r in got) == sorted(length.items())
    assert sum(r.padding for r in got) == least_padding(length.values(), packing.BUCKETS)
    for bucket in {r.bucket for r in got}:
        mine = sorted((r for r in got if r.bucket == bucket), key=lambda r: r.doc_id)
        longest = max(r.length for r in mine)
        room = max(1, packing.TOKENS // longest)
        assert [(r.bucket_len, r.padding, r.batch, r.place) for r in mine] == [(longest, longest - r.length, k // room, k % room) for k, r in enumerate(mine)]
