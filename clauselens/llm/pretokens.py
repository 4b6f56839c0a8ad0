"""Pieces that a byte-level BPE merges within: one list of strings per text, exactly as the tokenizers library cuts them.

Texts of common Latin characters go through a compiled pattern with explicit classes; a text with
any other character is cut by the library's own pre-tokenizer, so Unicode versions can't differ.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

_L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_S = r"\t\n\r\x20"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_CUT = re.compile(r"(?<=[^\s]) ")
#: Characters cut at once: lists of pieces stay bounded for a text of any length.
PIECE_CHARS = 1 << 20
#: Encoded pieces that a worker remembers; beyond that it starts anew.
KNOWN_PIECES = 800_000


def parts(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in runs of about so many characters, cut only before a space after a non-space, where a piece always ends."""
    i = 0
    while len(text) - i > most:
        found = _CUT.search(text, i + most)
        if found is None:
            break
        yield text[i : found.start()]
        i = found.start()
    yield text[i:] if i else text


class Pretokenizer:
    """Cuts texts into pieces. Special tokens stand alone as pieces."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def plain(self, text: str) -> list[str]:
        if _OTHER.search(text) is None:
            return _FAST.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces, in order; joined they are the text."""
        for part in parts(text):
            if self._special is None or self._special.search(part) is None:
                yield self.plain(part)
            else:
                for k, run in enumerate(self._special.split(part)):
                    if run:
                        yield [run] if k % 2 else self.plain(run)


class PieceIds:
    """Ids of pieces, each worked out once and remembered; a text's ids are those of its pieces in turn."""

    def __init__(self, cut: Pretokenizer, ids_of: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], most: int = KNOWN_PIECES):
        self.cut, self.ids_of, self.most = cut, ids_of, most
        self.forget()

    def forget(self) -> None:
        """Empty the memory; special tokens stay."""
        special = self.cut.special
        self.known = {t: k for k, t in enumerate(special)}
        self.ids, self.lens = np.array([*special.values()], np.int32), np.ones(len(special), np.int64)
        self.at = np.arange(len(special))

    def learn(self, pieces: list[str]) -> None:
        """Work out the pieces, each named once, that aren't known yet."""
        new = [p for p in pieces if p not in self.known]
        if new:
            new, ids, lens = self.ids_of(new)  # in any order
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.ids, self.lens = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.lens, lens])
            self.at = np.cumsum(self.lens) - self.lens

    def spread(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has."""
        if len(self.known) > self.most:
            self.forget()
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        which = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        n = self.lens[which]
        return self.ids[np.repeat(self.at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if any(len(t) > PIECE_CHARS for t in texts):  # the pieces of a long text are listed a part at a time
            each = [np.concatenate([np.zeros(0, np.int32), *(self.spread(p)[0] for p in self.cut.pieces(t))]) for t in texts]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        runs = [list(chain.from_iterable(self.cut.pieces(t))) for t in texts]
        ids, lens = self.spread(list(chain.from_iterable(runs)))
        ends = np.r_[0, np.cumsum(lens)]
        return ids, np.diff(ends[np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int64)])
