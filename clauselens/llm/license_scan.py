"""License scans (operator 9): fuzzy search for short notices.

A text is reduced to its words, lower-cased and joined by single spaces. A notice of length m may
differ in up to k edits: cut into k + 1 pieces, at least one piece stands unchanged in any match
(pigeonhole), so exact finds of the pieces give all candidates: the few runs of whole words that
begin and end near such a place. The regex library's bounded-error matching verifies each of them
and counts its edits. Words that carry the meaning of a notice (names, version numbers) must stand
unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chars_before, documents, python_ready, slices, texts_of

#: Notice, label, most edits, words that must stand unchanged, and whether exact places count as base.
NOTICES = (
    ("under the mit license", "mit", 1, ("mit",), True),
    ("apache license version 2", "apache-2", 1, ("2",), True),
    ("cc by nc", "cc-by-nc", 0, (), True),
    ("cc by sa", "cc-by-sa", 0, (), False),
    ("gnu general public license", "gpl", 2, ("gnu", "general"), False),
    ("gnu lesser general public license", "lgpl", 2, ("gnu", "lesser"), False),
    ("gnu affero general public license", "agpl", 2, ("gnu", "affero"), False),
    ("mozilla public license version 2", "mpl-2", 2, ("2",), False),
    ("bsd 3 clause license", "bsd-3", 1, ("bsd", "3"), False),
    ("bsd 2 clause license", "bsd-2", 1, ("bsd", "2"), False),
    ("creative commons attribution noncommercial", "cc-by-nc", 3, (), False),
    ("creative commons attribution sharealike", "cc-by-sa", 3, (), False),
    ("permission is hereby granted free of charge", "mit", 3, (), False),
    ("redistribution and use in source and binary forms", "bsd", 3, (), False),
    ("all rights reserved", "all-rights-reserved", 1, ("all",), False),
)
RUN_BYTES = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (np.arange(256) >= 128)
_LOWER[~_WORD] = 32
_LOWER[0] = 0


def seeds(notice: str, k: int) -> list[tuple[int, bytes]]:
    """k + 1 pieces that make up the notice, each with its place."""
    raw = notice.encode()
    ends = [len(raw) * (i + 1) // (k + 1) for i in range(k + 1)]
    return [(a, raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@cache
def compiled(notices: tuple = NOTICES) -> list[tuple]:
    """Notice bytes, label, edits, needed words, base, pieces and the verifier of each notice."""
    out = []
    for text, label, k, needed, base in notices:
        pattern = regex.compile("(?:" + regex.escape(text, special_only=True) + "){e<=%d}" % k, regex.BESTMATCH)
        out.append((text.encode(), label, k, {w.encode() for w in needed}, base, seeds(text, k), verifier(pattern, {w.encode() for w in needed})))
    return out


#: Candidates whose edits a worker remembers, by notice.
KNOWN = 50_000


def verifier(pattern, needed: set[bytes]):
    """A function from a candidate's bytes to its edits (in characters), or None where it isn't the notice."""

    @lru_cache(KNOWN)
    def edits(candidate: bytes) -> int | None:
        if not needed <= set(candidate.split()):
            return None
        found = pattern.fullmatch(candidate.decode(errors="replace"))
        return sum(found.fuzzy_counts) if found else None

    return edits


def finds(raw: bytes, piece: bytes) -> Iterator[int]:
    at = raw.find(piece)
    while at >= 0:
        yield at
        at = raw.find(piece, at + 1)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch of texts: lower-cased bytes with one space between words and a zero byte
    after each text; the place of each byte in data; where each text begins (and the end)."""
    n = len(at) - 1
    spread = np.zeros(len(data) + n, np.uint8)
    who = np.repeat(np.arange(n), np.diff(at))
    source = data.copy()
    source[source == 0] = 32
    spread[np.arange(len(data)) + who] = source
    low = _LOWER[spread]
    keep = np.ones(len(low), bool)
    if len(low):
        keep[:-1] = (low[:-1] != 32) | (low[1:] != 32)
    place = np.flatnonzero(keep)
    low = low[place]
    first = np.r_[0, np.flatnonzero(low == 0) + 1]
    origin = place - np.searchsorted(first[1:], np.arange(len(low)), "left")
    return low, origin, first


def best_span(raw: bytes, a: int, size: int, k: int, edits) -> tuple[int, int, int] | None:
    """(edits, start, end) of the whole words around place a that come closest to a notice of this size.

    An edit adds at most four bytes and takes away at most one, so that few words' ends have to be
    looked at, however long the text is.
    """
    best = None
    starts = [s for s in range(max(0, a - 4 * k), min(a + k, len(raw) - 1) + 1) if raw[s] not in FREE and (s == 0 or raw[s - 1] in FREE)]
    ends = [e for e in range(max(1, a + size - k), min(a + size + 4 * k, len(raw)) + 1) if raw[e - 1] not in FREE and (e == len(raw) or raw[e] in FREE)]
    for s in starts:
        for e in ends:
            if e > s and raw.find(0, s, e) < 0 and (n := edits(raw[s:e])) is not None and (best is None or (n, s, -e) < (best[0], best[1], -best[2])):
                best = n, s, e
    return best


FREE = b" \x00"


def search(low: np.ndarray, first: np.ndarray, notices: tuple = NOTICES) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
    """Base places and all verified spans of a batch: (start, end, label) and (start, end, label, edits) in bytes of low.

    Each candidate is verified by itself, so the time grows with their number. Of spans of a notice
    that overlap the one with fewer edits stays, of equals the first.
    """
    raw = low.tobytes()
    base: list[tuple[int, int, str]] = []
    spans: list[tuple[int, int, str, int]] = []
    for text, label, k, _, is_base, pieces, edits in compiled(notices):
        kept: list[tuple[int, int, int]] = []
        for a in sorted({p - place for place, piece in pieces for p in finds(raw, piece)}):
            if raw.startswith(text, max(a, 0)) and a >= 0 and (a == 0 or raw[a - 1] in FREE) and (a + len(text) == len(raw) or raw[a + len(text)] in FREE):
                found = 0, a, a + len(text)
                if is_base:
                    base.append((a, a + len(text), label))
            else:
                found = best_span(raw, a, len(text), k, edits) if k else None
            if found is None:
                continue
            if kept and found[1] < kept[-1][2]:
                if found[0] < kept[-1][0]:
                    kept[-1] = found
            else:
                kept.append(found)
        spans += ((s, e, label, n) for n, s, e in kept)
    return base, spans


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"


def license_scan(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """One row per row of docs: words, base places and labels, labels of all verified notices, score, spans.

    score: the best 1 - edits / length, 0 without a notice. spans: label:start:end:edits in code
    points of the text. Null and empty texts have no words. Repeated and null doc_id are kept.
    """
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column(1))
            for i, j in slices(at, RUN_BYTES):
                part, own, n = data[at[i] : at[j]], at[i : j + 1] - at[i], j - i
                low, origin, first = words_of(part, own)
                inside = low > 32
                starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
                of = np.searchsorted(starts, first)
                base, spans = search(low, first, notices)
                places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                for a, _, label in base:
                    k = int(np.searchsorted(first, a, "right")) - 1
                    places[k].append((int(np.searchsorted(starts, a) - of[k]), label))
                more: list[list[tuple[int, int, str, int]]] = [[] for _ in range(n)]
                for a, b, label, e in spans:
                    k = int(np.searchsorted(first, a, "right")) - 1
                    more[k].append((int(origin[a] - own[k]), int(origin[b - 1] - own[k]) + 1, label, e))
                said, score = [], np.zeros(n)
                for k in range(n):
                    if more[k]:
                        before = chars_before(part[own[k] : own[k + 1]])
                        said.append(",".join(f"{label}:{before[a]}:{before[b]}:{e}" for a, b, label, e in sorted(more[k])))
                        score[k] = max(1 - e / max(1, b - a) for a, b, _, e in more[k])
                    else:
                        said.append("")
                    if places[k]:
                        score[k] = 1.0
                join = lambda labels: ",".join(sorted(set(labels)))
                words = [[w for w, _ in p] for p in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        pa.array(np.diff(of)),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([min(w, default=None) for w in words], pa.int64()),
                        pa.array([max(w, default=None) for w in words], pa.int64()),
                        pa.array([join(label for _, label in p) for p in places], pa.string()),
                        pa.array([join([label for _, label in p] + [x[2] for x in m]) for p, m in zip(places, more, strict=True)], pa.string()),
                        pa.array(np.clip(score, 0, 1)),
                        pa.array(said, pa.string()),
                    ],
                    SCHEMA_NAMES,
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def op9_query(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir).select("doc_id", "text"))
