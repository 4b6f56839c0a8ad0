"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from clauselens.llm import registry  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, own_id string, out_id string"
SYLLABLES = {"en": "er on an re he in ed nd ha at".split(), "de": "sch ung eit ver zu ein ich lich".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    text = lambda lang, n: " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 5))) for _ in range(n))
    clean = [(lang, text(lang, rng.randint(20, 200))) for lang in ("en", "de") for _ in range(120)]
    rows = [(i, t, lang, "s", len(t), "o", "p") for i, (lang, t) in enumerate(clean)]
    words = clean[5][1].split()
    words[3:4] = ["another"]
    rows += [(1000, clean[5][1].replace(" ", " \t", 2), "en", "s", None, None, None), (1001, " ".join([*words, *text("en", 300).split()][: len(words)]), "en", None, None, None, None)]
    rows += [(1002, "12345 !!!", "en", "s", 9, None, None), (1003, None, None, None, None, None, None), (1004, text("en", 60) + " AKIA" + "ABCDEFGH12345678", "en", "s", 1, None, None), (None, text("en", 50), "en", "s", 1, None, None)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    clean = set(range(240)) | {None}
    assert set(counts["language_id"]) == clean | {1000, 1001, 1004}
    assert set(counts["exact_dedup"]) == clean | {1001, 1004}
    assert clean <= set(counts["simhash_near_dedup"]) and 1001 not in counts["simhash_near_dedup"]
    assert counts["secret_scan"][1004].text.endswith(" <access>")
    assert set(counts["packing"]) == set(counts["secret_scan"]) == set(counts["simhash_near_dedup"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(counts["packing"])


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
