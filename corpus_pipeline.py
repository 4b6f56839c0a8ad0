"""The corpus pipeline: documents in, packed batches out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.
"""

from __future__ import annotations

import os
import uuid

from clauselens.llm.common import discard, documents, shared_dir
from clauselens.llm.exact_dedup import drop_exact_copies
from clauselens.llm.language_id import fit, keep_identified, labelled_sample
from clauselens.llm.near_copies import drop_near_copies
from clauselens.llm.packing import pack
from clauselens.llm.secrets import redact


def language_id(spark, docs, sf_dir):
    """Documents that some language accepts; the models learn from the stage's own labelled rows."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    return keep_identified(docs, fit(labelled_sample(docs)))


def exact_dedup(spark, docs, sf_dir):
    """One document of each text."""
    return drop_exact_copies(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return drop_near_copies(docs)


def secret_scan(spark, docs, sf_dir):
    """All documents, with secrets replaced by their kind."""
    return redact(docs)


def packing(spark, docs, sf_dir):
    """Bucket, batch and place of each document."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: SQL can't express the language models and fingerprints; tests/llm/test_pipeline_reference.py holds run() against a plain-Python version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in turn over documents, each written to the shared folder and read again.

    What a stage has read is removed once its own result is written; the last input stays, as the
    result is computed when it is asked for.
    """
    docs, before = documents(spark, sf_dir), None
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(at := f"{folder}/{name}")
        docs = spark.read.parquet(at)
        if before is not None:
            discard(spark, before)
        before = at
