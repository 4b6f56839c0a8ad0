"""Token-id files with fixed-width bit packing (operator 2).

A file holds ids in blocks of BLOCK ids, each id in the fewest bits that the vocabulary needs, least
significant bit first. Behind the blocks stand the document table (doc_id, a flag for null ids, first
id, number of ids), the byte offset of every block, and a fixed footer. Blocks unpack with numpy a
whole block at a time, and any range of ids is read by its blocks alone.

One file a range of doc_id; ids ascend from file to file and within each. Files are written under a
name of the attempt and then renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, python_ready, shared_dir, slices, texts_of
from .pretokens import PieceIds, Pretokenizer

MAGIC, BLOCK = b"TIDBITS1", 1 << 14
#: magic, bits, ids a block, documents, ids, place of the document table, place of the block offsets.
FOOTER = struct.Struct("<8sIIQQQQ")
RUN_BYTES = 8 << 20
#: Words sent to the tokenizers library in one text.
LINES = 500


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side in so many bits each (1 to 32), padded with zeros to 8 ids."""
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.ravel()[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint8)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        value = rows[:, j] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, first + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(raw: bytes | np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    packed = np.frombuffer(raw, np.uint8).reshape(-1, bits)
    out = np.zeros((len(packed), 8), np.uint64)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        for k in range(-(-(shift + bits) // 8)):
            out[:, j] |= packed[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] >>= np.uint64(shift)
    return (out & np.uint64((1 << bits) - 1)).ravel()[:n].astype(np.uint32)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TokenFileWriter:
    """Writes one file; append() takes documents in order."""

    def __init__(self, folder: str, name: str, vocabulary: int, attempt: str = "0"):
        self.fs, root = opened(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temporary = f"{root}/{name}", f"{root}/.{name}.{attempt}"
        self.out, self.bits = self.fs.open_output_stream(self.temporary), width(vocabulary)
        self.place, self.offsets, self.rest, self.n = 0, [], np.zeros(0, np.int64), 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def append(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Documents' ids one after another, and how many each has."""
        self.docs.append((doc_ids.astype(np.int64), nulls.astype(np.uint8), lens.astype(np.int64)))
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(ids[i : i + BLOCK])
        self.rest = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.place)
        self.place += self.out.write(pack(ids, self.bits))

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        if len(self.rest):
            self._block(self.rest)
        ids, nulls, lens = (np.concatenate(x) if self.docs else np.zeros(0, np.int64) for x in (zip(*self.docs, strict=True) if self.docs else [()] * 3))
        table = self.place
        for x in (ids.astype("<i8"), (np.cumsum(lens) - lens).astype("<i8"), lens.astype("<i8"), nulls.astype(np.uint8)):
            self.place += self.out.write(x.tobytes())
        at = self.place
        self.out.write(np.array([*self.offsets, table], "<i8").tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.bits, BLOCK, len(ids), self.n, table, at))
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return len(ids), self.n


class TokenFile:
    """Reads one file: the document table, and any range of ids."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block, self.n_docs, self.n_ids, table, at = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.offsets = np.frombuffer(self._read(at, size - FOOTER.size - at), "<i8")
        columns = self._read(table, 25 * self.n_docs)
        self.doc_id, self.start, self.n_tokens = (np.frombuffer(columns, "<i8", self.n_docs, 8 * k * self.n_docs) for k in range(3))
        self.null_id = np.frombuffer(columns, np.uint8, self.n_docs, 24 * self.n_docs).astype(bool)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive) of the file; only the blocks that hold them are read."""
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        raw = np.frombuffer(self._read(int(self.offsets[i]), int(self.offsets[j] - self.offsets[i])), np.uint8)
        n = min(j * self.block, self.n_ids) - i * self.block
        return unpack(raw, n, self.bits)[a - i * self.block : b - i * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.start[k]), int(self.start[k] + self.n_tokens[k]))


class LibraryEncoder:
    """The tokenizers library over distinct pieces, each encoded once and remembered. A piece encodes alone as it does in its text."""

    def __init__(self, path: str):
        self.cut = Pretokenizer(path)
        self.size = self.cut.library.get_vocab_size(with_added_tokens=True)
        self.store = PieceIds(self.cut, self.ids_of)

        self.line = self._each(["\n"])[0]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.cut.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))

    def ids_of(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Ids of pieces. Words with their leading space go to the library some hundred to a text, one
        a line, which cuts them as they are; a call for each would cost more than its merges."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()] if len(self.line) == 1 else []
        other = [p for p in pieces if p[0] != " " or not p[1:].isalpha()] if words else pieces
        ids, lens = self._each(other)
        if not words:
            return other, ids, lens
        lines, _ = self._each(["\n".join(words[i : i + LINES]) + "\n" for i in range(0, len(words), LINES)])
        ends = np.flatnonzero(lines == self.line[0])
        return other + words, np.concatenate([ids, lines[lines != self.line[0]]]), np.concatenate([lens, np.diff(np.r_[-1, ends]) - 1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.store.encode(texts)


@cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int) -> list[tuple[int, int, int]]:
    """Encode every text, append end_id to each, and write the files in ascending doc_id order (nulls first).

    Returns (file number, documents, ids) for each file; their number is the session's shuffle
    partitions. Null text has end_id alone. Rows with one doc_id stand in the order of their texts.
    An empty table writes no files. folder must be visible to driver and executors.
    """
    spark = docs.sparkSession
    python_ready(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, library = TaskContext.get(), None, library_encoder(path)
        for batch in batches:
            if out is None and len(batch):
                out = TokenFileWriter(folder, f"{task.partitionId():06d}.ids", max(library.size, end_id + 1), str(task.taskAttemptId()))
            data, at = texts_of(batch.column(1))
            for i, j in slices(at, RUN_BYTES):
                raw = data[at[i] : at[j]].tobytes()
                ids, lens = library.encode([raw[at[k] - at[i] : at[k + 1] - at[i]].decode() for k in range(i, j)])
                who = batch.column(0)[i:j]
                out.append(who.fill_null(0).to_numpy(zero_copy_only=False), who.is_null().to_numpy(zero_copy_only=False), np.insert(ids, np.cumsum(lens), end_id), lens + 1)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), *out.close())], ["file", "docs", "ids"])

    made = dealt.mapInArrow(run, "file bigint, docs bigint, ids bigint").collect()  # a row for each file
    return sorted((r[0], r[1], r[2]) for r in made)


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    start counts the ids of all documents before it, over all files.
    """
    python_ready(spark)
    bases = dict(zip((f for f, _, _ in files), np.cumsum([0, *(n for _, _, n in files)]).tolist(), strict=False))
    numbers = list(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file = TokenFile(f"{folder}/{numbers[k]:06d}.ids")
                ends = file.start + file.n_tokens
                i = 0
                while i < file.n_docs:
                    j = max(i + 1, int(np.searchsorted(ends, file.start[i] + (1 << 21), "right")))
                    crc = []
                    if j == i + 1:  # a long document, some ids at a time
                        c = 0
                        for a in range(int(file.start[i]), int(ends[i]), 1 << 21):
                            c = zlib.crc32(file.ids(a, min(a + (1 << 21), int(ends[i]))).astype("<u4").tobytes(), c)
                        crc.append(c)
                    else:
                        raw = memoryview(file.ids(int(file.start[i]), int(ends[j - 1])).astype("<u4").tobytes())
                        first = 4 * int(file.start[i])
                        crc = [zlib.crc32(raw[4 * a - first : 4 * b - first]) for a, b in zip(file.start[i:j].tolist(), ends[i:j].tolist(), strict=True)]
                    who = pa.array(file.doc_id[i:j], mask=file.null_id[i:j])
                    yield pa.RecordBatch.from_arrays([who, pa.array(file.start[i:j] + bases[numbers[k]]), pa.array(file.n_tokens[i:j]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    return spark.range(0, len(numbers), 1, max(1, len(numbers))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files inside the shared one."""
    return os.path.join(shared_dir(spark), f"token-ids-{uuid.uuid4().hex}")


def op2_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_folder(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    files = write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_files(spark, folder, files)
