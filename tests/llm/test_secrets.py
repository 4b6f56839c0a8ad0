"""Secrets in awkward places."""

import random
import re
import string

import pytest

pytest.importorskip("public_tokenizers")
from clauselens.llm import secrets  # noqa: E402


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in secrets.scan(df).collect()}


def test_overlapping_keywords(spark):
    texts = ['secretoken = "abcdefghijkl"', "apikeypasswdtoken: abcdefghijklm", "secretokensecret=abcdefghijklmn", "secret token"]
    got = spans(spark, texts)
    pattern = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(texts):
        want = [m.span() for m in pattern.finditer(t) if len(m[2]) >= 12]
        assert got[i].n_assign == len(want)
        assert [x for x in got[i].spans.split(",") if x.startswith("assign")] == [f"assign:{a}:{b}" for a, b in want]


def test_short_keys_and_keys_in_paths(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    short = [f"use {key(n)} here" for n in (16, 17, 18, 19) for _ in range(10)]
    path = [f"see /srv/house/children/letter/night/story/picture/sentence/example/{key(24)} now" for _ in range(20)]
    got = spans(spark, short + path)
    found = [[x for x in got[i].spans.split(",") if x.startswith("random")] for i in range(60)]
    assert sum(map(bool, found[:40])) >= 38
    assert sum(x == [f"random:{len(t) - 28}:{len(t) - 4}"] for x, t in zip(found[40:], path, strict=True)) >= 19


def test_ordinary_names_of_all_forms_stay(spark):
    names = secrets.labelled_samples(3000, seed=123)[1]
    got = spans(spark, names)
    assert sum("random" in got[i].spans for i in range(3000)) <= 6
    held = []
    real = secrets.RandomStrings.score
    model = type("Recording", (secrets.RandomStrings,), {"score": lambda self, raw: held.append(raw.decode()) or real(self, raw)})
    strings, names = secrets.labelled_samples(600)
    model(strings, names)
    assert {i % 6 for i, s in enumerate(names) if s in set(held)} == set(range(6))
