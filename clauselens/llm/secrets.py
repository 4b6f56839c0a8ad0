"""Secret scans (operator 10): fixed kinds by pattern, and random-looking strings by two character Markov models.

One model is trained on labelled random strings, the other on labelled ordinary identifiers. A
candidate (a long run of key characters) is reported as ``random`` if its log-likelihood ratio by
character, random against ordinary, is above a threshold. The threshold is calibrated on labelled
identifiers that the models did not see.

Offsets are code points, ends exclusive, of the whole match.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chars_before, documents, python_ready, slices, texts_of

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_KEYWORD = re.compile(rb"(?=password|passwd|secret|token|api_?key)")  # overlapping ones too
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_RANDOM = 12, 18, 16, 16
_SEGMENT = re.compile(rb"[^/_-]+")
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_KEY = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
RUN_BYTES = 8 << 20
#: Part of the calibration identifiers that may score above the threshold.
FALSE_RATE = 0.0005

#: Everyday parts of identifiers and prose, for labelled ordinary samples.
PARTS = (
    "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some "
    "file path user index value count config server client request response handler manager factory builder service module package import export buffer stream parser token length offset default option setting context session cache query table column field record schema version update remove filter group order limit error status message event thread process worker node tree graph list array string number object class method function return public private static "
    "house world school children letter night story picture second sentence example answer point city during however whole several "
).split()


def labelled_samples(n: int = 6000, seed: int = 10) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), as many of each, always the same for one seed.

    Random: base64, alphanumeric, lower-case alphanumeric and hexadecimal strings of 16 to 64
    characters. Ordinary: words joined in snake, kebab, path, camel and plain form, with numbers at
    some ends, and long invented words of common syllables in several languages.
    """
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits + "+/", upper + lower + digits, lower + digits, digits + "abcdef", upper + digits]
    strings = ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 64))) for i in range(n)]
    syllables = "er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ment tion able ing ly ness sch ung keit lich ver ein ich ent que eau eux oi ai ch pa elle ci do ga la os ra mente ado cion ue ez".split()
    names = []
    for i in range(n):
        words = rng.choices(PARTS, k=rng.randint(2, 8))
        form = i % 6
        joined = ("_", "-", "/")[form].join(words) if form < 3 else words[0] + "".join(w.capitalize() for w in words[1:]) if form == 3 else "".join(words) if form == 4 else "".join(rng.choices(syllables, k=rng.randint(5, 20)))
        names.append(joined + (str(rng.randint(0, 2030)) if rng.random() < 0.15 else ""))
    return strings, names


class Markov:
    """First-order model of characters 0 to 127, with an edge mark at both ends; counts plus a little."""

    def __init__(self, samples: list[str], add: float = 0.1):
        counts = np.full((129, 129), add)
        for s in samples:
            c = np.array([128, *s.encode("ascii", "replace"), 128])
            np.add.at(counts, (c[:-1], c[1:]), 1)
        self.log = np.log(counts / counts.sum(1, keepdims=True))


class RandomStrings:
    """Log-likelihood ratio by character of random strings against ordinary identifiers."""

    def __init__(self, strings: list[str], names: list[str], false_rate: float = FALSE_RATE):
        # names come in six forms by turns, so every fourth six are held out
        fit = [s for i, s in enumerate(strings) if i % 4], [s for i, s in enumerate(names) if i // 6 % 4]
        self.ratio = Markov(fit[0]).log - Markov(fit[1]).log
        held = np.array([self.best(s.encode()) for i, s in enumerate(names) if not i // 6 % 4] or [0.0])
        self.threshold = max(0.5, float(np.quantile(held, 1 - false_rate)) + 0.1)

    def score(self, raw: bytes) -> float:
        c = np.minimum(np.array([128, *raw, 128]), 128)
        return float(self.ratio[c[:-1], c[1:]].sum() / (len(raw) + 1))

    def best(self, raw: bytes) -> float:
        """The highest score of a run and of its segments that are long enough."""
        return max([self.score(raw), *(self.score(m[0]) for m in _SEGMENT.finditer(raw) if len(m[0]) >= LEAST_RANDOM)])

    def spans(self, raw: bytes) -> list[tuple[int, int]]:
        """The parts of a run that look random: the whole, or else neighbouring segments that do."""
        if self.score(raw) > self.threshold:
            return [(0, len(raw))]
        joined: list[list[int]] = []
        near = False
        for m in _SEGMENT.finditer(raw):
            fits = self.score(m[0]) > self.threshold
            if fits and near:
                joined[-1][1] = m.end()
            elif fits:
                joined.append([*m.span()])
            near = fits
        return [(a, b) for a, b in joined if b - a >= LEAST_RANDOM and self.score(raw[a:b]) > self.threshold]


@cache
def trained() -> RandomStrings:
    """The models over labelled_samples()."""
    return RandomStrings(*labelled_samples())


def runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least so many members.

    A run of least places holds a multiple of least, so only those places are looked at first.
    """
    probes = np.flatnonzero(member[::least]) * least
    if not len(probes):
        return probes, probes
    near = np.zeros(len(member) // least + 3, bool)
    k = probes // least
    near[k] = near[k + 1] = True  # blocks k - 1 and k hold the run's start or middle
    blocks = np.flatnonzero(near)
    at = (((blocks - 1)[:, None] * least) + np.arange(least)).ravel()
    at = at[(at >= 0) & (at < len(member))]
    at = at[member[at]]
    new = np.r_[True, np.diff(at) > 1]
    starts = at[new]
    ends = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def assigned(raw: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches, none overlapping; those with a short value take their place but aren't reported."""
    free = 0
    for m in _KEYWORD.finditer(raw.lower()):
        if m.start() >= free and (found := _ASSIGN.match(raw, m.start())):
            free = found.end()
            if found.end(2) - found.start(2) >= LEAST_ASSIGN:
                yield found.span()


def spans_of(data: np.ndarray, at: np.ndarray, models: RandomStrings) -> list[list[tuple[int, int, int]]]:
    """For each text of a batch its (start, kind number, end) in bytes, sorted. data: the texts' bytes, at: offsets."""
    # a zero byte between texts keeps runs and matches apart
    n = len(at) - 1
    spread = np.zeros(len(data) + n, np.uint8)
    spread[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    first = at[:-1] + np.arange(n)
    raw = spread.tobytes()
    found = [(a, 0, b) for a, b in assigned(raw)]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    a, b = runs(_HEX[spread], LEAST_HEX)
    found += zip(a.tolist(), [2] * len(a), b.tolist(), strict=True)
    a, b = runs(_KEY[spread], LEAST_RANDOM)
    found += [(x + i, 3, x + j) for x, y in zip(a.tolist(), b.tolist(), strict=True) for i, j in models.spans(raw[x:y])]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    found.sort()
    if found:
        who = np.searchsorted(first, [x[0] for x in found], "right") - 1
        for k, (x, kind, y) in zip(who.tolist(), found, strict=True):
            out[k].append((x - int(first[k]), kind, y - int(first[k])))
    return out


def in_chars(raw: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not spans:
        return spans
    before = chars_before(raw)
    return [(int(before[a]), kind, int(before[b])) for a, kind, b in spans]


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts by kind, a digest of the base spans, all spans as kind:start:end.

    Spans are sorted by start, then kind as in KINDS. Null and empty texts have none (the digest is
    that of an empty string). Repeated and null doc_id are kept.
    """
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = trained()
        for batch in batches:
            data, at = texts_of(batch.column(1))
            for i, j in slices(at, RUN_BYTES):
                part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                found = [in_chars(part[own[k] : own[k + 1]], s) for k, s in enumerate(spans_of(part, own, models))]
                say = lambda spans: ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
                base = [hashlib.sha256(say([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], *(pa.array([sum(x[1] == k for x in s) for s in found], pa.int64()) for k in range(3)), pa.array(base, pa.string()), pa.array([say(s) for s in found], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by <kind>, and n_chars (if there) counted anew where a text changed.

    Overlapping spans are replaced together under the first one's kind. No row is dropped; a null
    text stays null; all columns stay.
    """
    python_ready(docs.sparkSession)
    where, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(raw: bytes, spans: list[tuple[int, int, int]]) -> bytes:
        out, i = [], 0
        merged: list[list[int]] = []
        for a, kind, b in spans:
            if merged and a < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([a, kind, b])
        for a, kind, b in merged:
            out += [raw[i:a], b"<" + KINDS[kind].encode() + b">"]
            i = b
        return b"".join([*out, raw[i:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = trained()
        for batch in batches:
            data, at = texts_of(batch.column(where))
            for i, j in slices(at, RUN_BYTES):
                part, own, rows = data[at[i] : at[j]], at[i : j + 1] - at[i], batch.slice(i, j - i)
                found = spans_of(part, own, models)
                if any(found):
                    columns = list(rows.columns)
                    text, n = columns[where].to_pylist(), columns[count].to_pylist() if count is not None else None
                    for k, s in enumerate(found):
                        if s:
                            text[k] = clean(part[own[k] : own[k + 1]].tobytes(), s).decode()
                            if n:
                                n[k] = len(text[k])
                    columns[where] = pa.array(text, columns[where].type)
                    if n:
                        columns[count] = pa.array(n, columns[count].type)
                    rows = pa.RecordBatch.from_arrays(columns, names=rows.schema.names)
                yield rows

    return docs.mapInArrow(run, docs.schema)


def op10_query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))
