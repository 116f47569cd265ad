"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement by A-star search.

A text's lattice holds every way to cut it into the model's pieces (bytes where a character has none). A cut never depends on the next
word, so the lattice is a chain of word lattices; a path's log-probability is the sum of its words'. The search keeps disjoint regions of the
path space: "the same choices before word j, another choice at j, anything after". A region's priority is the largest
perturbed log-probability in it, drawn as a Gumbel with the region's exact total mass as its location, truncated by its parent's. The
best region is popped, its best path is a draw from the region's distribution; the rest is split into a region per word, all at once
in numpy. What is out of a word is kept as a trie over its lattice: the mass that is left is a sum of terms that are never taken away from
each other, and a draw from it walks the trie, so no cut is lost, however small its share. The first k pops are k distinct paths drawn without replacement; with the (k+1)-th as threshold each has an
inclusion score 1 - exp(-exp(log p - threshold)). Draws are seeded by the row's key.

Piece weights come from the model's merge ranks by a Zipf law, as BPE models carry ranks, not probabilities. Nothing is trained.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import tidy

SPACE = "▁"
#: Weight exponent of the Zipf law, a byte's log weight, rows (characters of distinct words) that a worker remembers, and options (pieces) a row that it has room for.
ZIPF, BYTE, REMEMBERED, OPTIONS = 1.3, -16.0, 2_400_000, 4
#: Characters of new words whose options are made at once.
CHUNK = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: The finer cut, for models in which no piece has both letters and other characters than the leading spaces.
_LETTER = r"[^\W\d_²]"
_RUNS = re.compile(rf"{SPACE}*{_LETTER}+|{SPACE}*(?:[^{SPACE}\w]|[\d_²])+|{SPACE}+")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(seed: np.ndarray, *at) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seeds and places only, not on what is drawn with them."""
    x = seed
    for a in at:
        x = _mix(x + _STEP * (np.atleast_1d(a).astype(np.uint64) + np.uint64(1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _gumbel(mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mass - np.log(-np.log(u))


class Out:
    """A node of the trie of a word's cuts that are out: what is behind each column, and the log mass that is left from here on."""

    __slots__ = ("behind", "left")

    def __init__(self) -> None:
        self.behind: dict[int, Out] = {}
        self.left = 0.0


class Lattices:
    """Word lattices as one table: a row per character of each word, and an option for each piece that starts there, with its cumulative share, log share, id and length.

    A row's options lie side by side, shorter pieces first; its last one takes the rest of the shares, whatever rounding left. Options are made for all new words at once: hashes
    of substrings are looked up in the sorted hashes of the pieces, as far as some piece begins like them, then log masses are summed from the right. A character's bytes, where
    they are several, have a negative id: -1 less the code point. Column c means the piece of c+1 characters; a cut of a word is the tuple of its columns.
    """

    BY_ROW, BY_OPTION = (("first", np.int64), ("count", np.int16), ("size", np.int32), ("again", bool)), (("share", np.float64), ("log", np.float64), ("id", np.int32), ("length", np.int16))

    def __init__(self, pieces: dict[str, tuple[int, float]], to_bytes):
        self.to_bytes, self.width = to_bytes, max(map(len, pieces), default=1)
        begins = [self._hashes(p) for p in pieces]
        hashes = np.array([h[-1] for h in begins], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.kind = np.zeros(1 << 20, np.uint8)  # by the upper bits of a hash: 1, it may be a piece's; 2, it may be that of how a longer one begins
        self.kind[self.hashes >> np.uint64(44)] = 1
        self.kind[np.array(list({x for h in begins for x in h[:-1]}), np.uint64) >> np.uint64(44)] |= 2
        self.start = np.searchsorted(self.hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.most = int(np.diff(self.start, append=len(self.hashes)).max())
        self.ids = np.array([i for i, _ in pieces.values()], np.int32)[order]
        self.weights = np.array([w for _, w in pieces.values()], np.float64)[order]
        self.reset()

    def forget(self) -> None:
        """Make room: words that no later batch had again go, or all, if the others take over half of it."""
        words, rows = list(self.at), np.fromiter(self.at.values(), np.int64, len(self.at))
        kept = np.flatnonzero(self.again[rows])
        rows, sizes = rows[kept], self.size[rows[kept]].astype(np.int64)
        stops = np.cumsum(sizes)
        if not len(kept) or stops[-1] > REMEMBERED // 2 or len(self.first) > REMEMBERED + (1 << 16) or len(self.share) > OPTIONS * (REMEMBERED + (1 << 16)):
            return self.reset()
        old = np.repeat(rows - (stops - sizes), sizes) + np.arange(stops[-1])
        first, count = self.first[old], self.count[old]
        below = np.cumsum(count, dtype=np.int64)
        if below[-1] > OPTIONS * REMEMBERED // 2:
            return self.reset()
        options = np.repeat(first - (below - count), count) + np.arange(below[-1])
        for name, _ in self.BY_OPTION:
            x = getattr(self, name)
            x[: len(options)] = x[options]
        self.rows, self.options = int(stops[-1]), len(options)
        self.first[: self.rows], self.count[: self.rows] = below - count, count
        self.size[stops - sizes], self.again[: self.rows] = sizes, False
        self.at = dict(zip((words[i] for i in kept.tolist()), (stops - sizes).tolist(), strict=True))

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = self.options = 0
        for names, most in ((self.BY_ROW, REMEMBERED + (1 << 16)), (self.BY_OPTION, OPTIONS * (REMEMBERED + (1 << 16)))):
            for name, kind in names:
                setattr(self, name, np.empty(most, kind))

    @staticmethod
    def _hashes(text: str) -> list[int]:
        """Hashes of how a text begins, by length; the last is the text's."""
        h, found = 0, []
        for c in text:
            h = (h + ord(c) + 1) * int(_STEP) & (1 << 64) - 1
            found.append(h)
        return found

    def _room(self, rows: int, options: int) -> None:
        """A batch of very long words may need more than the table has."""
        for names, need in ((self.BY_ROW, rows), (self.BY_OPTION, options)):
            for name, kind in names:
                if need > len(old := getattr(self, name)):
                    setattr(self, name, np.concatenate([old, np.empty(max(need - len(old), len(old)), kind)]))

    def place(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First row, and the one after the last, of each of these distinct words; those that are new are added."""
        row, new = self._known(words)
        if new and (self.rows + sum(map(len, new)) > REMEMBERED or self.options > OPTIONS * REMEMBERED):
            self.forget()
            row, new = self._known(words)
        if new:
            self.add(new)
            row[row < 0] = [*map(self.at.__getitem__, new)]
        return row, row + self.size[row]

    def _known(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each word's first row, -1 for those that are new, and these."""
        row = np.fromiter(map(self.at.get, words, itertools.repeat(-1)), np.int64, len(words))
        self.again[row[row >= 0]] = True
        return row, [words[i] for i in np.flatnonzero(row < 0).tolist()]

    def add(self, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        rows = self.rows + np.cumsum(sizes) - sizes
        self.at.update(zip(words, rows.tolist(), strict=True))
        self.rows += int(sizes.sum())
        self._room(self.rows, 0)
        self.size[rows], self.again[rows] = sizes, False
        order = np.argsort(-sizes, kind="stable")
        chunk = np.cumsum(sizes[order]) // CHUNK
        bounds = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(words)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            some = order[a:b]
            self._add([words[i] for i in some.tolist()], rows[some], sizes[some])

    def _find(self, code: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, pieces) of each length; left has how many characters a place's word has from there on."""
        live, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        for c in range(self.width):
            h = (h + code[live + c]) * _STEP
            kind = self.kind[h >> np.uint64(44)]
            at = np.flatnonzero(kind & 1)
            some = h[at]
            spot = self.start[some >> np.uint64(44)]
            for _ in range(self.most - 1):
                spot = np.minimum(spot + (self.hashes[spot] < some), len(self.hashes) - 1)
            known = np.flatnonzero(self.hashes[spot] == some)
            yield live[at[known]], spot[known]
            on = np.flatnonzero((kind > 1) & (left[live] > c + 1))
            if not len(on):
                return
            live, h = live[on], h[on]

    def _add(self, words: list[str], rows: np.ndarray, sizes: np.ndarray) -> None:
        """words come by length, the longest first."""
        stops = np.cumsum(sizes)
        n, word = int(stops[-1]), np.repeat(np.arange(len(words)), sizes)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        left = stops[word] - np.arange(n)
        # places are worked on by the characters left, then by word, so those whose masses are summed at once lie side by side; base[d] is the first with d left
        base = np.concatenate([[0, 0], np.cumsum(np.cumsum(np.bincount(sizes)[:0:-1])[::-1])])
        own = base[left] + word
        found = list(self._find(code, left))
        weight, piece = np.empty(n), np.zeros(n, np.int32)
        missing = np.ones(n, bool)
        at, spot = found[0]
        weight[at], piece[at], missing[at] = self.weights[spot], self.ids[spot], False
        missing = np.flatnonzero(missing)
        chars, which = np.unique(code[missing], return_inverse=True)
        ids = [self.to_bytes(chr(c - 1)) for c in chars.tolist()]
        weight[missing] = np.array([BYTE * len(i) for i in ids])[which] if len(missing) else 0.0
        piece[missing] = np.array([i[0] if len(i) == 1 else -c for i, c in zip(ids, chars.tolist(), strict=True)], np.int32)[which] if len(missing) else 0
        found[0] = np.arange(n), None
        count = np.zeros(n, np.int64)
        for at, _ in found:
            count[own[at]] += 1
        first = np.cumsum(count) - count
        total, free = int(count.sum()), first.copy()
        weights, ids, length, behind = np.empty(total), np.empty(total, np.int32), np.empty(total, np.int16), np.empty(total, np.int64)
        for c, (at, spot) in enumerate(found):
            o = own[at]
            x = free[o]
            free[o] = x + 1
            weights[x], ids[x], length[x] = (self.weights[spot], self.ids[spot], c + 1) if c else (weight, piece, 1)
            rest = left[at] - (c + 1)
            behind[x] = np.where(rest > 0, base[rest] + word[at], n)
        below = np.zeros(n + 1)
        bounds = np.append(first, total)
        for a, b in zip(base[1:].tolist(), base[2:].tolist(), strict=False):
            x = slice(bounds[a], bounds[b])
            logs, starts = weights[x] + below[behind[x]], first[a:b] - bounds[a]
            top = np.maximum.reduceat(logs, starts)
            below[a:b] = top + np.log(np.add.reduceat(np.exp(logs - np.repeat(top, count[a:b])), starts))
        log = weights + below[behind] - np.repeat(below[:n], count)
        share = np.exp(log)
        k, more = 1, np.flatnonzero(count > 1)
        while len(more):
            x = first[more] + k
            share[x] += share[x - 1]
            k += 1
            more = more[count[more] > k]
        share[first + count - 1] = 2.0
        # kept by word and place
        count, first = count[own], first[own]
        to = np.cumsum(count) - count
        order = np.repeat(first - to, count) + np.arange(total)
        self._room(0, self.options + total)
        spots = np.repeat(rows - (stops - sizes), sizes) + np.arange(n)
        self.first[spots], self.count[spots] = to + self.options, count
        x = slice(self.options, self.options + total)
        self.share[x], self.log[x], self.id[x], self.length[x] = share[order], log[order], ids[order], length[order]
        self.options += total

    def option(self, place: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The options of these columns at these rows."""
        found = self.first[place]
        behind = np.flatnonzero(self.length[found] <= column)
        while len(behind):
            found[behind] += 1
            behind = behind[self.length[found[behind]] <= column[behind]]
        return found

    @property
    def piece(self) -> "Ids":
        return Ids(self)

    def walk(self, row: np.ndarray, end: np.ndarray, seed: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A cut of each word [row, end): log shares by word, then (word, row, column) of each piece, by word and place."""
        log, word, place, option = self.draw(row, end, seed, draw)
        return log, word, place, self.length[option] - 1

    def draw(self, row: np.ndarray, end: np.ndarray, seed: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same with options in place of columns."""
        pieces, steps = np.zeros(len(row), np.int64), []
        live, at, seed = np.arange(len(row)), row, self.turn(seed, draw)
        while len(live):
            u, found = uniform(seed, at - row), self.first[at]
            behind = np.flatnonzero(self.share[found] <= u)
            while len(behind):
                found[behind] += 1
                behind = behind[self.share[found[behind]] <= u[behind]]
            steps.append((live, at, found))
            pieces[live] = len(steps)
            at = at + self.length[found]
            on = np.flatnonzero(at < end)
            live, at, row, end, seed = live[on], at[on], row[on], end[on], seed[on]
        first = np.cumsum(pieces) - pieces
        place, option = np.empty(int(pieces.sum()), np.int64), np.empty(int(pieces.sum()), np.int64)
        for n, (live, at, found) in enumerate(steps):
            x = first[live] + n
            place[x], option[x] = at, found
        return np.add.reduceat(self.log[option], first), np.repeat(np.arange(len(pieces)), pieces), place, option

    @staticmethod
    def turn(seed: np.ndarray, draw: int) -> np.ndarray:
        return _mix(seed + np.uint64(int(_STEP) * draw & (1 << 64) - 1))

    def others(self, log: np.ndarray, word: np.ndarray, place: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Log mass of each word's other cuts, from the log shares of its cut."""
        return self.rest(log, word, place, self.option(place, column))

    def rest(self, log: np.ndarray, word: np.ndarray, place: np.ndarray, option: np.ndarray) -> np.ndarray:
        """The same with options in place of columns. Where one minus the share would lose digits, it is summed up step by step."""
        with np.errstate(divide="ignore"):
            rest = np.log(-np.expm1(np.minimum(log, 0.0)))
        if len(fine := np.flatnonzero(log > -1e-9)):
            number = np.full(len(log), -1)
            number[fine] = np.arange(len(fine))
            at = np.flatnonzero(number[word] >= 0)
            own, option, low, count = number[word[at]], option[at], self.first[place[at]], self.count[place[at]].astype(np.int64)
            starts = np.cumsum(count) - count
            logs = self.log[np.repeat(low - starts, count) + np.arange(count.sum())]
            logs[starts + option - low] = -np.inf
            taken = self.log[option]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            before = np.cumsum(taken) - taken
            before -= np.repeat(before[first], np.diff(first, append=len(own)))
            rest[fine] = np.logaddexp.reduceat(before + np.logaddexp.reduceat(logs, starts), first)
        return rest

    def _options(self, node: Out | None, at: int) -> list[tuple[float, int]]:
        """(log mass without what is out, column) of each piece at a place."""
        x = slice(a := int(self.first[at]), a + int(self.count[at]))
        logs = [(w, c - 1) for w, c in zip(self.log[x].tolist(), self.length[x].tolist(), strict=True)]
        return [(w + node.behind[c].left if c in node.behind else w, c) for w, c in logs] if node else logs

    def exclude(self, node: Out, at: int, end: int, cut: tuple[int, ...]) -> None:
        """Take a cut of [at, end) out; it isn't out yet."""
        path = [(node, at)]
        for c in cut:
            node, at = node.behind.setdefault(c, Out()), at + c + 1
            path.append((node, at))
        node.left = -math.inf
        for node, at in reversed(path[:-1]):
            logs = [w for w, _ in self._options(node, at)]
            top = max(logs)
            node.left = top if top == -math.inf else top + math.log(sum(math.exp(w - top) for w in logs))

    def draw_left(self, node: Out | None, row: int, end: int, u: list[float]) -> tuple[int, ...]:
        """One of the cuts that aren't out, by its share among them; u has a number for each character."""
        at, cut = row, []
        while at < end:
            if node:
                options = [o for o in self._options(node, at) if o[0] > -math.inf]
                top = max(o[0] for o in options)
                x = u[at - row] * sum(math.exp(w - top) for w, _ in options)
                for w, c in options:  # noqa: B007  the last one takes what rounding leaves
                    x -= math.exp(w - top)
                    if x <= 0:
                        break
                node = node.behind.get(c)
            else:
                x = slice(a := int(self.first[at]), a + int(self.count[at]))
                c = int(self.length[a + np.argmax(self.share[x] > u[at - row])]) - 1
            cut.append(c)
            at += c + 1
        return tuple(cut)


class Ids:
    """Piece ids of a table by row and column."""

    def __init__(self, table: Lattices) -> None:
        self.table = table

    def __getitem__(self, at) -> np.ndarray:
        place, column = map(np.asarray, at)
        return self.table.id[self.table.option(place, column)]


class Search:
    """A text's regions and the paths found so far. A path is (option of each piece, where each word's end, log share of each word, priority)."""

    def __init__(self, row: np.ndarray, end: np.ndarray, seed: int, top: float):
        self.row, self.end, self.seed, self.number, self.found = row, end, seed, 0, []
        # (-priority, number, word j, the trie of word j's cuts that are out, or the only one, index of the path that is kept before j)
        self.heap = [(-top, 0, 0, None, -1)]

    def pop(self, table: Lattices) -> None:
        top, _, self.j, self.out, self.origin = heapq.heappop(self.heap)
        self.top = -top
        if isinstance(self.out, tuple):
            cut, self.out = self.out, Out()
            table.exclude(self.out, int(self.row[self.j]), int(self.end[self.j]), cut)

    def finish(self, table: Lattices, option: np.ndarray, stops: np.ndarray, logs: np.ndarray, rest: np.ndarray, noise: np.ndarray, more: int) -> None:
        """Take the drawn path of the popped region, whose words from j on are given with the log mass that each has left and a Gumbel draw, and split the rest.

        `more` regions are popped after this one, and the next is looked at.
        """
        j = self.j
        if j:
            old = self.found[self.origin]
            cut = old[1][j - 1]
            option, stops, logs = np.concatenate([old[0][:cut], option]), np.concatenate([old[1][:j], stops + cut]), np.concatenate([old[2][:j], logs])
        self.found.append((option, stops, logs, self.top))
        g = (np.cumsum(logs) - logs)[j:] + rest + noise
        best = np.argpartition(-g, more)[: more + 1] if len(g) > more + 1 else np.arange(len(g))  # regions further down can't be popped
        for low, x in sorted(zip((-g[best]).tolist(), best.tolist(), strict=True)):
            if low == math.inf:  # nothing is left of this word
                break
            i = j + x
            own = tuple((table.length[option[stops[i - 1] if i else 0 : stops[i]]] - 1).tolist())
            self.number += 1
            # conditioned to lie below the parent's: the total of the parts has the parent's as its largest
            heapq.heappush(self.heap, (float(np.logaddexp(low, -self.top)), self.number, i, self.out if i == j and self.out else own, len(self.found) - 1))  # no other region has this trie


class Sampler:
    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes: dict[int, int] = {}
        pieces: dict[str, tuple[int, float]] = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                pieces[piece] = (i, -ZIPF * math.log(len(pieces) + 2.7))
        self.unknown = self.model.unk_id()
        apart = all(len(_RUNS.findall(p)) == 1 for p in pieces)
        self.cut = _RUNS if apart else _WORDS
        self.kinds, self.powers = np.zeros(0x110000, np.uint8), np.ones(1, np.uint64)
        self.lattices = Lattices(pieces, self._bytes)

    def _bytes(self, ch: str) -> tuple[int, ...]:
        return tuple(self.bytes.get(b, self.unknown) for b in ch.encode("utf-8", "replace"))

    def units(self, text: str) -> list[str]:
        """The normalised text's words; no piece reaches over the end of one."""
        return self.cut.findall(self.normal(text))

    def normal(self, text: str) -> str:
        return self.model.normalize(text) if text else ""

    def _kinds(self, code: np.ndarray) -> np.ndarray:
        """1 for the space sign; then what `cut` tells apart."""
        kinds = self.kinds[code]
        if not kinds.all():
            for c in np.unique(code[kinds == 0]).tolist():
                self.kinds[c] = 1 if chr(c) == SPACE else 2 if self.cut is _WORDS or re.match(_LETTER, chr(c)) else 3
            kinds = self.kinds[code]
        return kinds

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """First row, and the one after the last, of every word of normalised texts, the words that units() gives; and where each text's words end.

        The words of a batch are told apart by hashes and then compared with the first of their hash, so only one of each is made a string and looked up.
        """
        none, joined = np.zeros(0, np.int64), "".join(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        if not joined:
            return none, none, [0] * len(bounds)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self._kinds(code)
        begins = np.ones(len(code), bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != 1)  # spaces belong to what follows
        begins[bounds[:-1][bounds[:-1] < len(code)]] = True
        start = np.flatnonzero(begins)
        sizes = np.diff(start, append=len(code))
        place = np.arange(len(code)) - np.repeat(start, sizes)
        if (most := int(sizes.max())) > len(self.powers):
            self.powers = np.cumprod(np.full(most, _STEP))
        h = np.add.reduceat((code + np.uint64(1)) * self.powers[place], start)
        order = np.argsort(h)
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        one, which = order[new], np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        like = one[which]
        if (sizes[like] != sizes).any() or (code[np.repeat(start[like], sizes) + place] != code).any():  # two words with one hash: each is made a string
            number: dict[str, int] = {}
            which = np.array([number.setdefault(w, len(number)) for t in texts for w in self.cut.findall(t)])
            words = list(number)
        else:
            words = [joined[a:b] for a, b in zip(start[one].tolist(), (start[one] + sizes[one]).tolist(), strict=True)]
        row, end = self.lattices.place(words)
        return row[which], end[which], np.searchsorted(start, bounds).tolist()

    def sample_batch(self, texts: list[str], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct (ids, log p, perturbed log p, inclusion score), best first; fewer only if it has fewer paths."""
        return self.sample_normal([self.normal(t) for t in texts], k, seeds)

    def sample_normal(self, texts: list[str], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """The same for normalised texts."""
        row, end, stops = self._words(texts)
        tops = _gumbel(np.zeros(1), uniform(np.array(seeds, np.uint64), 1 << 30)).tolist()
        searches = [Search(row[a:b], end[a:b], s, top) for a, b, s, top in zip(stops, stops[1:], seeds, tops, strict=False)]
        live = [s for s in searches if len(s.row)]
        for draw in range(k):
            if not (live := [s for s in live if s.heap]):
                break
            for s in live:
                s.pop(self.lattices)
            for s, path in zip(live, self._paths(live, draw), strict=True):
                s.finish(self.lattices, *path, k - draw - 1)
        out = []
        for s in searches:
            if not len(s.row):
                out.append([(np.zeros(0, np.int32), 0.0, 0.0, 1.0)])
                continue
            bar = -s.heap[0][0] if s.heap else -math.inf
            out.append([])
            for option, _, logs, g in s.found:
                p = float(logs.sum())
                out[-1].append((self._ids(option), p, g, 1.0 if bar == -math.inf else -math.expm1(-math.exp(min(p - bar, 30.0)))))
        return out

    def _paths(self, live: list[Search], draw: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Options of the pieces, each word's end, log share, what is left of it and a Gumbel draw, of the words from each search's word j on; word j's cut is none that is out."""
        row, end = (np.concatenate([x[s.j :] for x, s in zip(xs, live, strict=True)]) for xs in ([s.row for s in live], [s.end for s in live]))
        sizes = np.array([len(s.row) - s.j for s in live], np.int64)
        first = np.cumsum(sizes) - sizes
        number = np.arange(len(row)) - np.repeat(first - np.array([s.j for s in live], np.int64), sizes)
        of = np.repeat(np.array([s.seed for s in live], np.uint64), sizes)
        seed = _mix(of + _STEP * number.astype(np.uint64))
        table = self.lattices
        log, word, place, option = table.draw(row, end, seed, draw)
        rest = table.rest(log, word, place, option)
        noise = _gumbel(np.zeros(1), uniform(of, draw + 1, number + (1 << 31)))
        ends = np.cumsum(np.bincount(word, minlength=len(row)))
        for f, n, s in zip(first.tolist(), sizes.tolist(), live, strict=True):
            start = int(ends[f - 1]) if f else 0
            what, stops, logs, left = option[start : int(ends[f + n - 1])], ends[f : f + n] - start, log[f : f + n], rest[f : f + n]
            if s.out:
                a, b = int(row[f]), int(end[f])
                u = uniform(np.repeat(Lattices.turn(seed[f : f + 1], draw), b - a), np.arange(b - a)).tolist()
                cut = table.draw_left(s.out, a, b, u)
                table.exclude(s.out, a, b, cut)
                own = table.option(a + np.cumsum([0, *(c + 1 for c in cut[:-1])]), np.array(cut))
                logs[0], left[0] = table.log[own].sum(), s.out.left
                what, stops = np.concatenate([own, what[stops[0] :]]), stops + (len(cut) - stops[0])
            yield what, stops, logs, left, noise[f : f + n]

    def _ids(self, option: np.ndarray) -> np.ndarray:
        """Piece ids, characters without a piece as bytes."""
        piece = self.lattices.id[option]
        if len(spots := np.flatnonzero(piece < 0)):
            ids = [self._bytes(chr(-1 - c)) for c in piece[spots].tolist()]
            times = np.ones(len(piece), np.int64)
            times[spots] = [len(i) for i in ids]
            piece = np.repeat(piece, times)
            piece[piece < 0] = [x for i in ids for x in i]
        return piece

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.model.decode(ids)


_samplers: dict[str, Sampler] = {}


def sampler(path: str) -> Sampler:
    if path not in _samplers:
        _samplers[path] = Sampler(path)
    return _samplers[path]


def sample_segmentations(df: DataFrame, path: str, k: int = 2, key_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per text and draw: doc_id, draw (1 is best), n_pieces, log_p, perturbed, inclusion, ids_crc32, round_trip, and ids (unless with_ids is False).

    round_trip tells that decoding gives the text that encoding by the model itself and decoding gives. The seed is the XXH64 of the key and the
    text, so repeated rows get equal draws, and a null key is seeded by the text. Null text counts as empty: one draw without pieces. Texts with
    fewer than k segmentations have fewer draws; of equal perturbed values the region that was made first is popped. Texts of any length are cut whole. Other columns of any name are ignored; an empty table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("draw", pa.int32()), ("n_pieces", pa.int64()), ("log_p", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                keys, texts = b.column(0).slice(at, 100).to_pylist(), [t or "" for t in b.column(1).slice(at, 100).to_pylist()]
                seeds = [xxhash.xxh64_intdigest(f"{key}\x00{t}".encode("utf-8", "replace")) for key, t in zip(keys, texts, strict=True)]
                rows, cuts = [], []
                normal = [s.normal(t) for t in texts]
                for key, text, found in zip(keys, normal, s.sample_normal(normal, k, seeds), strict=True):
                    plain = text.removeprefix(SPACE)
                    for n, (ids, p, g, share) in enumerate(found, 1):
                        same = s.decode(ids).replace(" ", SPACE) == plain
                        rows.append((key, n, len(ids), p, g, share, zlib.crc32(ids.astype("<u4").tobytes()), same))
                        cuts.append(ids.astype(np.int32))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
                if with_ids:
                    stops = np.cumsum([0, *map(len, cuts)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(stops, np.concatenate(cuts)))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    types = "doc_id long, draw int, n_pieces long, log_p double, perturbed double, inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return df.select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), types)
