"""Packing by sum of squares: an online rule that keeps few windows partly filled.

Each document's ids (cut at the window) form pieces. A level array counts the open windows of each fill level; a piece goes to
the level, or to a new window, that leaves the sum of the squared counts smallest. A window that is full is closed and
its pieces are emitted. When too many windows are open, and at a task's end, the emptiest ones are cut up to fill the others; what is
left at the end is cut into windows of powers of two, which need no padding. Every task packs its own rows, so there is no shuffle.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import tidy

#: Open windows of a task (their ids take 16 KB each at most), and cached words of a worker.
OPEN, WORDS = 1024, 500_000
#: A fixed value of the tokenizer's file: its pattern, by which words of characters up to U+024F are split here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class CachedTokenizer:
    """The ids that tokenizers gives for a whole text, with each distinct word encoded once.

    Texts are parted at space, tab and newline, which the tokenizer drops, so words are encoded apart. Words of
    characters up to U+024F are split on by the tokenizer's own pattern, in lower case; others go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")
        self.plain = re.compile("[\x21-\x7e\xa1-įı-ɏ]+")
        self.split = regex.compile(PATTERN)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        probe = "It's a Straße, in 1234 ¾ çà!? ... naïve_word's"
        if b"".join(self._part(p) for w in probe.split() for p in self.split.findall(w.lower())) != self._whole(probe):
            self.plain = re.compile(r"(?!)")  # a tokenizer of another kind: words go to it whole

    def _part(self, part: str) -> bytes:
        """A lower-case word of the pattern, straight to the tokenizer's BPE model."""
        if not part.isascii():
            part = "".join(map(self.letters.__getitem__, part.encode()))
        ids = [t.id for t in self.tokenizer.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        if self.plain.fullmatch(word) and not self.special.search(word):
            low = word.lower()
            if low.isalpha():
                parts = [low]
            elif low[-1] in ".,!?;:" and low[:-1].isalpha():
                parts = [low[:-1], low[-1]]
            else:
                parts = self.split.findall(low)
            out = []
            for p in parts:
                if (ids := self.parts.get(p)) is None:
                    ids = self.parts[p] = self._part(p)
                out.append(ids)
            return b"".join(out)
        return self._whole(word)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for i in range(0, len(texts), 256):
            parted = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts[i : i + 256]]
            if len(self.words) > WORDS:
                self.words, self.parts = {}, {}
            for w in set().union(*parted).difference(self.words):
                self.words[w] = self._learn(w)
            get = self.words.__getitem__
            for words in parted:
                yield np.frombuffer(b"".join(map(get, words)), "<u4")


_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Sum-of-squares packing of one stream; emit gets (window's number, its pieces) when a window closes. A piece is (document, start, ids, document's length)."""

    def __init__(self, size: int, emit: Callable[[int, list], None], most_open: int = OPEN):
        self.size, self.emit, self.most = size, emit, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.at: dict[int, list[list]] = {}
        self.open = self.closed = 0

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.size
        for s in range(0, whole, self.size):
            self._close([(doc, s, ids[s : s + self.size], len(ids))])
        if whole < len(ids):
            self._place([(doc, whole, ids[whole:], len(ids))], len(ids) - whole)
        if self.open > self.most:
            self._fill(self.most // 2)

    def _close(self, pieces: list) -> None:
        self.emit(self.closed, pieces)
        self.closed += 1

    def _place(self, pieces: list, n: int) -> None:
        """Into the level h with the smallest change of the sum of squares: 2(N[h+n] - N[h]) + 2, or 2 N[n] + 1 for a new window; full windows don't count."""
        after = self.count[n:].copy()
        after[-1] = 0
        change = 2 * (after - self.count[: len(after)]) + 2
        change[-1] -= 1 if len(after) > 1 else 0
        change[self.count[: len(after)] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * after[0] + 1
        h = len(change) - 1 - int(np.argmin(change[::-1]))  # the fullest on ties
        if h:
            pieces = self._take(h) + pieces
        self._put(pieces, h + n)

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def _put(self, pieces: list, level: int) -> None:
        if level == self.size:
            self._close(pieces)
        else:
            self.count[level] += 1
            self.open += 1
            self.at.setdefault(level, []).append(pieces)

    def _fill(self, keep: int) -> None:
        """Cut the emptiest windows up to fill the fullest ones until `keep` are open or one is left."""
        while self.open > max(keep, 1):
            levels = np.flatnonzero(self.count)
            low, high = int(levels[0]), int(levels[-1])
            spare, full = self._take(low), self._take(high)
            room = self.size - high
            while room and spare:
                doc, start, ids, total = spare.pop()
                if len(ids) > room:
                    spare.append((doc, start, ids[: len(ids) - room], total))
                    start, ids = start + len(ids) - room, ids[len(ids) - room :]
                full.append((doc, start, ids, total))
                room -= len(ids)
            self._put(full, self.size - room)
            if spare:
                self._put(spare, sum(len(p[2]) for p in spare))

    def finish(self) -> None:
        self._fill(1)
        for level in np.flatnonzero(self.count):
            rest = self._take(int(level))
            for bit in range(self.size.bit_length(), -1, -1):
                room, part = level & 1 << bit, []
                while room:
                    doc, start, ids, total = rest.pop(0)
                    if len(ids) > room:
                        rest.insert(0, (doc, start + int(room), ids[room:], total))
                        ids = ids[:room]
                    part.append((doc, start, ids, total))
                    room -= len(ids)
                if part:
                    self._close(part)


def pack(df: DataFrame, path: str, size: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (unless with_ids is False).

    A document's ids are the tokenizer's and `end`. Null text counts as empty: its one id is `end`. Repeated rows are packed each; a
    null id is carried along; other columns of any name are ignored; an empty table gives an empty result. A sequence_id is the
    task's partition in its upper bits and a number from 0 in its lower 40.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        first = TaskContext.get().partitionId() << 40

        def emit(number: int, pieces: list) -> None:
            offset = 0
            for doc, start, ids, total in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + number, offset)
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                offset += len(ids)

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        packer, encoder, last = Packer(size, emit), tokenizer(path), np.array([end], "<u4")
        for b in batches:
            ids_col, texts = b.column(0).to_pylist(), b.column(1)
            for i in range(0, len(ids_col), 256):
                for doc, ids in zip(ids_col[i : i + 256], encoder.encode_batch([t or "" for t in texts.slice(i, 256).to_pylist()]), strict=True):
                    packer.add(doc, np.concatenate([ids, last]))
                if len(rows) > 2000:
                    yield out()
        packer.finish()
        yield out()

    types = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), types)
