"""BPE encoding and decoding with a pair occurrence index (operator 6).

The distinct pieces of a run of documents are laid out as one array of symbols with links to the
neighbours. An index maps each mergeable pair, by its rank, to all its places in that array. Active
ranks are taken in ascending order; all occurrences of a pair merge at once, and the pairs that
this creates are entered under their own ranks. A piece is merged once, however often it occurs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, python_ready, slices, texts_of
from .pretokens import PieceIds, Pretokenizer

#: Bytes of text whose pieces are merged together.
RUN_BYTES = 16 << 20
DEAD, END = -2, -1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.cut = Pretokenizer(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_alphabet()
        self.size = max([*vocab.values(), *self.cut.special.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = self.left * self.size + self.right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        table = [b""] * self.size
        for token, i in vocab.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.cut.special.items():
            table[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_len = np.array([len(t) for t in table], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.store = PieceIds(self.cut, self.ids_of)

    def merge(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie one after another in data, and how many each piece has."""
        n = len(data)
        symbol = np.append(self.of_byte[data], END)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[ends[:-1]] = -1
        if n:
            before[0] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            key = symbol[at] * self.size + symbol[after[at]]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            real = self.keys[k] == key
            rank, at = self.order[k[real]], at[real]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            rank, at = rank[by], at[by]
            firsts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for r, a, b in zip(rank[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(at)], strict=True):
                if r in places:
                    places[r].append(at[a:b])
                else:
                    places[r] = [at[a:b]]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after < n))
        while active:
            rank = heapq.heappop(active)
            at = np.unique(np.concatenate(places.pop(rank)))
            a, b = self.left[rank], self.right[rank]
            right = after[at]
            still = (symbol[at] == a) & (symbol[right] == b)
            at, right = at[still], right[still]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of one symbol the pairs are taken from the left
                first = np.r_[True, at[1:] != right[:-1]]
                k = np.arange(len(at))
                odd = (k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 1
                at, right = at[~odd], right[~odd]
            beyond = after[right]
            symbol[at], symbol[right] = self.into[rank], DEAD
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            left = before[at]
            enter(np.concatenate([left[left >= 0], at[inside]]))
        alive = np.r_[0, np.cumsum(symbol[:n] != DEAD)]
        return symbol[:n][symbol[:n] != DEAD].astype(np.int32), np.diff(alive[np.r_[0, ends]])

    def ids_of(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Ids of pieces, merged together."""
        raw = [p.encode() for p in pieces]
        return pieces, *self.merge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        return self.store.encode(texts)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        n = self.token_len[ids]
        at = np.repeat(self.token_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.token_bytes[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def encoder(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) would be wide; this keeps digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256.
    One row per row of docs; null text is empty and has no ids. path: the tokenizer file, on every
    executor.
    """
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            data, at = texts_of(batch.column(1))
            for i, j in slices(at, RUN_BYTES):
                raw = data[at[i] : at[j]].tobytes()
                ids, n = bpe.encode([raw[at[k] - at[i] : at[k + 1] - at[i]].decode() for k in range(i, j)])
                ends = np.r_[0, np.cumsum(n)]
                each = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(n), pa.array([sha(x.astype("<u4").tobytes()) for x in each], pa.string()), pa.array([sha(bpe.decode(x).encode()) for x in each], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for each row of docs: the ids themselves."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = encoder(path).encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def op6_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
