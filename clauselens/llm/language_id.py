"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays (operator 1).

One model per language over letters and word ends. For each order the n-grams of all languages stand
in one sorted array of 64-bit hashes, with a column of full interpolated log-probabilities per
language; a second sorted array holds the back-off weights of the contexts. A text goes to the
language with the lowest cross-entropy per character. It is rejected if that entropy lies beyond
what held-out texts of the language show at this length.

The models are fitted on the driver from a bounded sample of labelled rows, about ``per_language``
texts of each language, drawn by a hash of the id; texts over ``FIT_CHARS`` are not drawn. Scoring
covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chars_before, documents, python_ready, slices, texts_of

ORDER, PER_LANGUAGE, FIT_CHARS = 5, 500, 50_000
#: Characters that an unseen one is one of.
ALPHABET = 2000
#: Share of the sample that calibrates rejection, and the entropy (nats) always allowed above the mean.
HELD, SLACK = 4, 1.0
#: Bytes of texts, and characters of them, that are scored at a time.
RUN_BYTES, PLACES = 1 << 20, 1 << 20
SPACE = 32
_MULTIPLIER = np.random.default_rng(5).integers(1 << 62, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def letter_table() -> np.ndarray:
    """The lower-case letter of each code point, a space for all that isn't a letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters with one space after each word, ORDER - 1 spaces before each text; which are scored; where texts begin."""
    n, ends = len(at) - 1, chars_before(data)[at]
    code = letter_table()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    pads, size = ORDER - 1, np.diff(ends)
    first = ends[:-1] + np.arange(n) * (pads + 1)
    out = np.full(len(code) + n * (pads + 1), SPACE, np.uint32)
    out[np.arange(len(code)) + np.repeat(first + pads - ends[:-1], size)] = code
    pad = np.zeros(len(out), bool)
    pad[(first[:, None] + np.arange(pads)).ravel()] = True
    letter = out != SPACE
    keep = pad | letter | np.r_[False, letter[:-1]]
    starts = np.r_[0, np.cumsum(keep)][first] if n else first
    return out[keep].astype(np.uint64), ~pad[keep], starts


def gram_keys(code: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, for n from 1 to ORDER; places before the start count as zero."""
    keys = [code * _MULTIPLIER[0]]
    for m in range(1, ORDER):
        k = keys[-1].copy()
        k[m:] += code[:-m] * _MULTIPLIER[m]
        keys.append(k)
    return keys


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted array, and which are really there."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


@dataclass
class Models:
    """Sorted n-gram hashes, log-probabilities, context hashes and log back-off weights by order; calibration by language."""

    languages: list[str]
    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_back: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def log_probabilities(self, code: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """One row a scored place, one column a language."""
        keys, at = gram_keys(code), np.flatnonzero(scored)
        out = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for m in range(ORDER, 0, -1):
            place = at[left]
            k, there = find(self.grams[m - 1], keys[m - 1][place])
            out[left[there]] += self.log_p[m - 1][k[there]]
            left = left[~there]
            if not len(left):
                return out
            if m > 1:
                k, there = find(self.contexts[m - 1], keys[m - 2][at[left] - 1])
                out[left[there]] += self.log_back[m - 1][k[there]]
            else:
                out[left] += self.log_back[0][0] - np.float32(np.log(ALPHABET))
        return out

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities by language, and scored characters (0 without a letter), of each text.

        Characters are scored some at a time, each with the ORDER - 1 before it, wherever a text ends.
        """
        code, scored, starts = stream(data, at)
        n = np.add.reduceat(scored.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        total = np.zeros((len(starts), len(self.languages)))
        for i in range(0, len(code), PLACES):
            before = max(0, i - ORDER + 1)
            mine = scored[before : i + PLACES].copy()
            mine[: i - before] = False
            rows = self.log_probabilities(code[before : i + PLACES], mine)
            if len(rows):
                who = np.searchsorted(starts, np.flatnonzero(mine) + before, "right") - 1
                new = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                total[who[new]] += np.add.reduceat(rows, new, axis=0, dtype=np.float64)
        return total, n

    def judge(self, logs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, its share (0 to 1) among all, and whether it is rejected."""
        each = -logs / np.maximum(n, 1)[:, None]
        best = np.argmin(each, 1)
        lowest = each[np.arange(len(each)), best]
        weight = np.exp(-(each - lowest[:, None]) * np.minimum(n, 100)[:, None])
        limit = self.mean[best] + np.maximum(SLACK, self.spread[best] / np.sqrt(np.maximum(n, 1)))
        return best, np.where(n > 0, 1 / weight.sum(1), 0.0), (n == 0) | (lowest > limit)


def fit(samples: dict[str, list[str]]) -> Models:
    """Models from texts by language. Every HELD-th text calibrates rejection and is not counted."""
    languages = sorted(samples)
    if not languages:
        return Models([], [], [], [], [], np.zeros(0), np.zeros(0))
    counted = {x: [t for i, t in enumerate(samples[x]) if i % HELD or len(samples[x]) < 2 * HELD] for x in languages}
    seen = []  # by language and order: keys, suffix keys, context keys of distinct n-grams, and raw counts
    for x in languages:
        code, scored, _ = stream(*texts_of(pa.array(counted[x], pa.string())))
        keys, place = gram_keys(code), np.flatnonzero(scored)
        by_order = []
        for m in range(ORDER):
            k, first, n = np.unique(keys[m][place], return_index=True, return_counts=True)
            p = place[first]
            by_order.append((k, keys[m - 1][p] if m else np.zeros(len(p), np.uint64), keys[m - 1][p - 1] if m else np.zeros(len(p), np.uint64), n))
        seen.append(by_order)
    grams, log_p, contexts, log_back = [], [], [], []
    for m in range(ORDER):
        union, first = np.unique(np.concatenate([s[m][0] for s in seen]), return_index=True)
        suffix, context = (np.concatenate([s[m][i] for s in seen])[first] for i in (1, 2))
        heads = np.unique(context)
        lower = np.exp(log_p[m - 1][np.searchsorted(grams[m - 1], suffix)].astype(np.float64)) if m else np.full((len(union), len(languages)), 1 / ALPHABET)
        p, back = np.zeros((len(union), len(languages))), np.ones((len(heads), len(languages)))
        for j, s in enumerate(seen):
            key, _, own, n = s[m]
            if m < ORDER - 1:  # lower orders count distinct characters before the n-gram
                n = np.bincount(np.searchsorted(key, s[m + 1][1]), minlength=len(key))
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            h = np.searchsorted(heads, own)
            total, types = np.bincount(h, n, len(heads)), np.bincount(h, n > 0, len(heads))
            back[:, j] = np.where(total > 0, discount * types / np.maximum(total, 1), 1)
            p[np.searchsorted(union, key), j] = np.maximum(n - discount, 0) / np.maximum(total[h], 1)
        p += back[np.searchsorted(heads, context)] * lower
        grams.append(union)
        log_p.append(np.log(p).astype(np.float32))
        contexts.append(heads)
        log_back.append(np.log(np.maximum(back, 1e-12)).astype(np.float32))
    models = Models(languages, grams, log_p, contexts, log_back, np.zeros(len(languages)), np.zeros(len(languages)))
    for j, x in enumerate(languages):
        logs, n = models.score(*texts_of(pa.array(samples[x][::HELD], pa.string())))
        some = n > 0
        entropy = -logs[some, j] / n[some]
        if len(entropy):
            long = n[some] >= np.median(n[some])
            models.mean[j] = entropy[long].mean()
            models.spread[j] = 3 * max(1.0, np.max((entropy - models.mean[j]) * np.sqrt(n[some])))
        else:
            models.mean[j] = np.inf
    return models


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, list[str]]:
    """About so many texts of each non-null lang, drawn by a hash of doc_id; collected to the driver.

    The share drawn follows each language's count, so the sample's size doesn't grow with the table.
    """
    share = docs.where("lang is not null").groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))  # no text is read
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= FIT_CHARS)).select("doc_id", "lang", "text")
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(1)), 11) / F.lit(float(1 << 53))
    rows = usable.where(F.col("lang") != "und").join(F.broadcast(share), "lang").where(drawn < F.col("share")).select("lang", "doc_id", "text").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
        out.setdefault(r[0], []).append(r[2])
    return out


def _judged(models: Models, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language, share, rejection and scored characters of each text."""
    logs, count = np.zeros((len(at) - 1, len(models.languages))), np.zeros(len(at) - 1, np.int64)
    for i, j in slices(at, RUN_BYTES):
        logs[i:j], count[i:j] = models.score(data[at[i] : at[j]], at[i : j + 1] - at[i])
    return *models.judge(logs, count), count


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, entropy_chars) for each row of docs, from the text alone.

    Null text and text without a letter: ``und``, score 0, rejected. Without any model all texts are
    ``und``. Repeated and null doc_id are kept.
    """
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            data, at = texts_of(batch.column(1))
            best, share, rejected, n = _judged(own, data, at) if own.languages else (np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1), np.ones(len(at) - 1, bool), np.zeros(len(at) - 1, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[np.where(n > 0, best, -1)], pa.string()), pa.array(np.clip(share, 0, 1)), pa.array(rejected), pa.array(n)], ["doc_id", "lang_pred", "score", "rejected", "scored_chars"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean, scored_chars bigint")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs whose text a language accepts, all columns as they were. Without any model all rows stay."""
    if not models.languages:
        return docs
    python_ready(docs.sparkSession)
    shared, where = docs.sparkSession.sparkContext.broadcast(models), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected, _ = _judged(shared.value, *texts_of(batch.column(where)))
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fold that models never learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    models = fit(labelled_sample(docs.where(~held_out(F.col("doc_id")))))
    found = identify(docs, models)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "scored_chars")
