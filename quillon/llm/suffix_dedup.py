"""Suffix dedup by a common-prefix-aware distributed merge sort.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Sorting every suffix of a corpus would move
it fifty times over, so, as in prefix-doubling string sorting, a first exchange of hashes finds the suffixes that have no partner:

1. Each 50-byte window is represented by one 28-byte string in it, its anchor, that depends on the window's bytes alone (mod-sampling: the
   least of its 46 hashed 5-byte strings, taken modulo the 23 places that an anchor may have, so that few places are
   anchors). Equal windows have equal anchors, so a window whose anchor no other text holds is unique. The anchors' hashes are dealt by hash and sorted; of
   equal ones in a slice of a batch the first goes, so a hot passage sends one row a slice.
2. The windows with repeated anchors are cut into pieces, one for each 16-byte string that is the least in its windows. The suffix at
   that string, up to the end of its last window, is sorted within a slice and front-coded (length of the prefix
   shared with the suffix before, and the rest), as one run a slice and part. Of equal pieces in a slice only those of the least
   doc_id travel; the others are decided there. The number of parts follows from the number of repeated anchors.
3. A part merges its runs by a loser tree over (shared prefix, rest): of two suffixes the one that shares more with the last one put out is the
   less, without a look at its bytes, and only bytes beyond the known prefix are ever compared. The shared prefixes that come
   out bound the groups of one 16-byte string, in which every window gets the least doc_id that holds it.

Anchors found more than ``Limits.hot`` times, such as those at the edges of a passage that a third of all documents hold, would make
one group of a part as large as the corpus. Their windows take another exact way: each by itself, summed to its least doc_id before the shuffle.

Copies of a whole text take no part: the one with the least doc_id stands for all, and the others lose all their bytes. Texts count
as copies if 128 bits of hash and their lengths agree; all other decisions compare bytes.

Cases: a null text is empty; a text under 50 bytes never loses anything; documents with the same doc_id do not count against each other, as neither is
smaller; a null doc_id counts as smaller than any other; strings that repeat within one document stay; rows given twice
get the same result twice; a text of any length is read whole, in segments of bounded length; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import NO_ID
from quillon.llm.components import whole_groups
from quillon.llm.decontamination import mixed
from quillon.session import discard, materialise, table

#: Bytes of a window, of an anchor, of the strings that choose it, and of those that group suffixes.
LENGTH, ANCHOR, CHOICE, GRAM = 50, 28, 5, 16
PLACES = LENGTH - ANCHOR + 1  # where an anchor may lie in its window
_FACTOR = 0x9E3779B97F4A7C15
ID = ["id", "th"]


@dataclass(frozen=True)
class Limits:
    """What is held at once; no result depends on them. ``segment``: windows of a text; ``chunk``: bytes that are hashed together; ``slice``: bytes of
    texts that share a run; ``hot``: occurrences beyond which an anchor is hot; ``part``: bytes of suffixes that one task merges."""

    segment: int = 1 << 20
    chunk: int = 1 << 17
    slice: int = 6 << 20
    hot: int = 1 << 16
    part: int = 16 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """(id, th, text as bytes): the doc_id with a number for null, and the hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))


# -- anchors -------------------------------------------------------------------------------------------------------------
def _hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the hash of every string of so many bytes, shorter by the strings that the end cuts off."""
    h, factor, width = data.astype(np.uint64) + np.uint64(1), _FACTOR, 1
    powers = [(1, h)]
    while 2 * width <= max(sizes):
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
        powers.append((width, h))
    out = []
    for size in sizes:
        left, total = size, None
        for width, h in reversed(powers):
            if left >= width:
                part = h[size - left :]
                total = part if total is None else total[: len(part)] * np.uint64(pow(_FACTOR, width, 1 << 64)) + part
                left -= width
        out.append(mixed(total))
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each place that of the least hash, leftmost of equals, among the ``width`` places that begin with it."""
    low = np.uint64(0xFFFFFFFF)
    least, have = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[step:], least[:-step])
        have += step
    return (least & low).astype(np.int64)


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each ANCHOR-byte string, place of the anchor of each LENGTH-byte window) of at least LENGTH bytes."""
    choice, anchor = _hashes(data, CHOICE, ANCHOR)
    at = _least(choice, LENGTH - CHOICE + 1)
    start = np.arange(len(at))
    return anchor, start + (at - start) % PLACES


def window_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each GRAM-byte string, place of the least one in each LENGTH-byte window) of at least LENGTH bytes."""
    (gram,) = _hashes(data, GRAM)
    return gram, _least(gram, LENGTH - GRAM + 1)


def _chunks(texts: list[bytes], limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of all texts, in chunks that are hashed at once: (bytes; of each window whether it lies in one text; its text; what its
    place in the chunk exceeds its place in the text by)."""
    held, size = [], 0

    def joined():
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        sizes = np.array([len(p) for _, _, p in held])
        starts = np.cumsum(sizes) - sizes
        windows = len(data) - LENGTH + 1
        own = np.repeat(np.arange(len(held)), sizes)[:windows]
        inside = np.arange(windows) + LENGTH <= (starts + sizes)[own]
        return data, inside, np.array([i for i, _, _ in held])[own], (starts - np.array([a for _, a, _ in held]))[own]

    for i, text in enumerate(texts):
        for a in range(0, len(text) - LENGTH + 1, limits.segment):
            part = text[a : a + limits.segment + LENGTH - 1]
            if held and size + len(part) > limits.chunk:
                yield joined()
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield joined()


def _starts(inside: np.ndarray, *marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) windows of the runs of windows that count and agree in all marks."""
    new = np.ones(len(inside), bool)
    new[1:] = ~inside[:-1]
    for m in marks:
        new[1:] |= m[1:] != m[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.ones(len(inside), bool)
    ends[:-1] = new[1:] | ~inside[1:]
    return first, np.flatnonzero(ends & inside)


def _slices(columns: list[list], texts: int, size_limit: int) -> Iterator[list[list]]:
    """The rows of parallel lists in slices of about ``size_limit`` bytes of text; a longer text is a slice of its own."""
    start = size = 0
    for i, t in enumerate(columns[texts]):
        if i > start and size + len(t) > size_limit:
            yield [c[start:i] for c in columns]
            start, size = i, 0
        size += len(t)
    if columns[texts][start:]:
        yield [c[start:] for c in columns]


#: An anchor's row: place = ((number of occurrences that the row stands for << 31 | place in the text) << 12 | bytes from the first window to the anchor
#: << 6 | bytes from the last one) << 1 | whether another text in the slice holds it. A row with ``near`` is a text's: pairs of h and place, as bytes.
ANCHOR_ROW = "h long, th long, place long, near binary"
FOUND = "h long, th long, place long"
_COUNT, _MOST = 44, (1 << 19) - 1


def _anchor_rows(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """The anchors of each distinct text for the exchange. Of those that texts of the slice share the first goes, with their number; the others are
    decided, and take one row a text through it, dealt by text."""
    for b in batches:
        for hashes, texts in _slices([b.column(0).to_pylist(), b.column(1).to_pylist()], 1, limits.slice):
            firsts = dict(zip(reversed(hashes), reversed(texts)))
            th, found = np.array(list(firsts), np.int64), ([], [], [])
            for data, inside, text, shift in _chunks(list(firsts.values()), limits):
                anchor, at = window_anchors(data)
                first, last = _starts(inside, at, text)
                q = at[first]
                for x, values in zip(found, (anchor[q], text[first], (q - shift[first]) << 12 | (q - first) << 6 | (q - last))):
                    x.append(values)
            if not found[0]:
                continue
            h, text, place = (np.concatenate(x) for x in found)
            order = np.argsort(h, kind="stable")
            h, text, place = h[order].view(np.int64), text[order], place[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[start, len(h)])
            shared = np.minimum.reduceat(text, start) != np.maximum.reduceat(text, start)
            decided = np.repeat(shared, count)
            stands = np.ones(len(h), np.int64)
            stands[start[shared]] = np.minimum(count[shared], _MOST)
            packed = stands << _COUNT | place << 1 | decided
            decided[start] = False
            names = [x.split()[0] for x in ANCHOR_ROW.split(", ")]
            for k in np.array_split(np.flatnonzero(~decided), len(h) // 65536 + 1):
                yield pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array(th[text[k]]), pa.array(packed[k]), pa.nulls(len(k), pa.binary())], names=names)
            rest = np.flatnonzero(decided)
            rest = rest[np.argsort(text[rest], kind="stable")]
            if len(rest):
                begin = np.flatnonzero(np.r_[True, text[rest][1:] != text[rest][:-1]])
                pairs = np.column_stack([h[rest], packed[rest]])
                own = th[text[rest[begin]]]
                near = [pairs[a:z].tobytes() for a, z in zip(begin, [*begin[1:], len(rest)])]
                yield pa.RecordBatch.from_arrays([pa.array(mixed(own.view(np.uint64)).view(np.int64)), pa.array(own), pa.array(np.zeros(len(own), np.int64)), pa.array(near, pa.binary())], names=names)


def _met(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h those whose anchor two texts hold at least; an anchor that is hot adds a row with the place -1. A group has at most a row a
    slice of the corpus, and the rows of one text."""
    for t in whole_groups(batches, 65536):
        near = t.column(3).is_valid().to_numpy().astype(bool)
        h, th, place = (t.column(k).to_numpy()[~near] for k in range(3))
        out = []
        if len(h):
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[start, len(h)])
            many = (np.minimum.reduceat(th, start) != np.maximum.reduceat(th, start)) | (np.maximum.reduceat(place & 1, start) > 0)
            hot = start[many & (np.add.reduceat(place >> _COUNT, start) > most)]
            keep = np.flatnonzero(np.repeat(many, count))
            out = [(h[keep], th[keep], place[keep]), (h[hot], th[hot], np.full(len(hot), -1))]
        some = np.flatnonzero(near)
        if len(some):
            pairs = [np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for x in t.column(3).take(pa.array(some))]
            both = np.concatenate(pairs)
            out.append((both[:, 0], np.repeat(t.column(1).to_numpy()[some], [len(x) for x in pairs]), both[:, 1]))
        for a, b_, c in out:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_), pa.array(c)], names=["h", "th", "place"])


def repeated_anchors(rows: DataFrame, limits: Limits) -> DataFrame:
    """(h, th, place): the anchors of each text that another text has too, and a row with the place -1 for each hot one."""
    apart = rows.select("th", "data").mapInArrow(lambda x: _anchor_rows(x, limits), ANCHOR_ROW).repartition("h").sortWithinPartitions("h")
    return apart.mapInArrow(lambda x: _met(x, limits.hot), FOUND)


# -- runs ----------------------------------------------------------------------------------------------------------------
def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes the lengths shared with the one before, and the rests."""
    shared: list[int] = []
    for k in range(0, len(suffixes), 8192):
        some = suffixes[max(k - 1, 0) : k + 8192]
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        width = int(sizes.max()) + 1
        padded = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in some), np.uint8).reshape(-1, width)
        differ = padded[1:] != padded[:-1]
        differ[:, -1] = True
        shared += ([] if k else [0]) + np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1])).tolist()
    return shared, [x[n:] for n, x in zip(shared, suffixes)]


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` is known."""
    end = min(len(a), len(b))
    while known < end:
        step = min(8, end - known)
        if a[known : known + step] != b[known : known + step]:
            while a[known] == b[known]:
                known += 1
            return known
        known += step
    return end


class LoserTree:
    """Merges sorted front-coded runs; each is an iterator of (shared with the one before in the run, rest, payload)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs, k = runs, len(runs)
        self.heads: list[bytes] = [b""] * k
        self.shared, self.load = [-1] * k, [None] * k  # -1: the run is at its end, and loses always
        for i in range(k):
            self._next(i)
        self.size = 1
        while self.size < k:
            self.size *= 2
        self.losers = [-1] * self.size
        winners = [i if i < k else -1 for i in range(self.size)]
        level = self.size
        while level > 1:
            level //= 2
            won = []
            for j in range(level):
                w, lost = self._play(winners[2 * j], winners[2 * j + 1])
                self.losers[level + j] = lost
                won.append(w)
            winners = won
        self.winner = winners[0]

    def _next(self, i: int) -> None:
        item = next(self.runs[i], None)
        if item is None:
            self.shared[i] = -1
            return
        n, rest, self.load[i] = item
        self.heads[i] = self.heads[i][:n] + rest
        self.shared[i] = n

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser). What both share with the last suffix put out decides; equal lengths need bytes beyond them alone."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        x, y = self.shared[a], self.shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = self.heads[a], self.heads[b]
        n = common(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(shared with the one before, suffix, payload) in sorted order."""
        while self.winner >= 0 and self.shared[self.winner] >= 0:
            w = self.winner
            yield self.shared[w], self.heads[w], self.load[w]
            self._next(w)
            node = (self.size + w) // 2
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


def pack(suffixes: list[bytes], lefts: list[bytes], heads: np.ndarray) -> bytes:
    """A run of sorted suffixes with the bytes before them and (id, th, place of the first window), as bytes."""
    shared, rests = front_coded(suffixes)
    sizes = np.array([shared, list(map(len, rests)), list(map(len, lefts))], np.int32).T
    return struct.pack("<I", len(suffixes)) + np.ascontiguousarray(heads, np.int64).tobytes() + sizes.tobytes() + b"".join(rests) + b"".join(lefts)


def unpack(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    (n,) = struct.unpack_from("<I", run)
    heads = np.frombuffer(run, np.int64, 3 * n, 4).reshape(n, 3).tolist()
    sizes = np.frombuffer(run, np.int32, 3 * n, 4 + 24 * n).reshape(n, 3).tolist()
    at = 4 + 36 * n
    left = at + sum(s[1] for s in sizes)
    for (i, th, place), (shared, rest, before) in zip(heads, sizes):
        yield shared, run[at : at + rest], (run[left : left + before], i, th, place)
        at += rest
        left += before


RUN = "part int, run binary, id long, th long, start int, end int"
#: Values of ``part`` in rows that are no run: a range that goes, and a window of a hot anchor (its bytes in ``run``).
RANGE, OPEN = -1, -2


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _pieces(texts: list[bytes], places: list[np.ndarray], limits: Limits) -> tuple[list[bytes], np.ndarray]:
    """The pieces, each from its first window to the end of its last, and of each a row (text, place of the first window, bytes before the suffix, hash of the
    suffix's first GRAM bytes, whether it is hot); ``places`` are the texts' repeated anchors as (place << 1 | hot)."""
    pieces: list[bytes] = []
    rows = [np.zeros((0, 5), np.int64)]
    for data, inside, text, shift in _chunks(texts, limits):
        begin = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (shift[1:] != shift[:-1])]).tolist()
        marks = [np.zeros(len(text) + 1, np.int32) for _ in range(2)]
        for k, end in zip(begin, [*begin[1:], len(text)]):
            p = places[text[k]]
            q = (p >> 13 & 0x7FFFFFFF) + shift[k]
            first, last = q - (p >> 7 & 63), q - (p >> 1 & 63)
            mine = (first >= k) & (last < end)  # another segment of a long text has the others
            for m, some in zip(marks, (mine, mine & (p & 1 == 1))):
                np.add.at(m, first[some], 1)
                np.add.at(m, last[some] + 1, -1)
        repeated, hot = (np.cumsum(m[:-1]) > 0 for m in marks)
        gram, at = window_grams(data)
        first, last = _starts(inside & repeated, at, text, hot)
        q, whole = at[first], data.tobytes()
        pieces += [whole[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
        rows.append(np.column_stack([text[first], first - shift[first], q - first, (gram[q] >> np.uint64(1)).view(np.int64), hot[first]]))
    return pieces, np.concatenate(rows)


def _open_windows(pieces: list[tuple[bytes, int, int, int]], batch) -> Iterator[pa.RecordBatch]:
    """The windows of hot pieces (bytes, id, th, place): of equal ones those of the least id, and the ranges of the others."""
    least: dict[bytes, int] = {}
    windows = [(piece[k : k + LENGTH], i, th, first + k) for piece, i, th, first in pieces for k in range(len(piece) - LENGTH + 1)]
    for w, i, _, _ in windows:
        if i < least.get(w, i + 1):
            least[w] = i
    for kind in (OPEN, RANGE):
        rows = [x for x in windows if (x[1] > least[x[0]]) == (kind == RANGE)]
        if rows:
            w, i, th, start = zip(*rows)
            yield batch([kind] * len(rows), w if kind == OPEN else None, i, th, start, [x + LENGTH for x in start])


def _make_runs(batches: Iterator[pa.RecordBatch], parts: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Runs of slices of (id, th, data, places), and the rows that are no runs."""
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def batch(*columns) -> pa.RecordBatch:
        n = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds)], names=_names(RUN))

    for b in batches:
        places = [x.values.to_numpy() for x in b.column(3)]
        for ids, ths, texts, marks in _slices([b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), places], 2, limits.slice):
            pieces, rows = _pieces(texts, marks, limits)
            if not pieces:
                continue
            known: dict[bytes, int] = {}  # equal pieces have their suffix at the same place, as it depends on their bytes alone
            same = np.array([known.setdefault(p, k) for k, p in enumerate(pieces)])
            text, first, left, gram, hot = rows.T
            i, th = np.array(ids, np.int64)[text], np.array(ths, np.int64)[text]
            least = i.copy()
            np.minimum.at(least, same, i)
            gone = np.flatnonzero(i > least[same])
            if len(gone):
                size = np.fromiter((len(pieces[k]) for k in gone.tolist()), np.int64, len(gone))
                yield batch(np.full(len(gone), RANGE), None, i[gone], th[gone], first[gone], first[gone] + size)
            stay = i == least[same]
            some = np.flatnonzero(stay & (hot > 0)).tolist()
            if some:
                yield from _open_windows([(pieces[k], int(i[k]), int(th[k]), int(first[k])) for k in some], batch)
            some = np.flatnonzero(stay & (hot == 0))
            part = gram[some] % parts
            some = some[np.argsort(part, kind="stable")]
            numbers, begin = np.unique(np.sort(part), return_index=True)
            runs = []
            heads = np.column_stack([i, th, first])
            for k, z in zip(begin.tolist(), [*begin[1:].tolist(), len(some)]):
                run = sorted((pieces[x][l:], x) for x, l in zip(some[k:z].tolist(), left[some[k:z]].tolist()))
                order = [x for _, x in run]
                runs.append(pack([x for x, _ in run], [pieces[x][:l] for x, l in zip(order, left[order].tolist())], heads[order]))
            if runs:
                yield batch(numbers, runs, None, None, None, None)


def _common_end(a: bytes, b: bytes) -> int:
    n, end = 0, min(len(a), len(b))
    while n < end and a[-1 - n] == b[-1 - n]:
        n += 1
    return n


def _decide(group: list[tuple[bytes, tuple]]) -> Iterator[tuple[int, int, int, int]]:
    """(id, th, start, end) of the bytes in a group of one string that windows of a smaller id cover."""
    held: dict[tuple[bytes, bytes], int] = {}
    for suffix, (left, i, _, _) in group:
        old = held.get((left, suffix))
        if old is None or i < old:
            held[left, suffix] = i
    pieces = []
    for suffix, (left, i, th, first) in group:
        if held[left, suffix] < i:
            yield i, th, first, first + len(left) + len(suffix)
        else:
            pieces.append((suffix, left, i, th, first))
    if len(held) == 1:
        return
    if len(pieces) <= 6:  # the bytes that two pieces share around the string make windows if there are enough of them
        for suffix, left, i, th, first in pieces:
            for other, before, j, _, _ in pieces:
                if j < i:
                    l, r = _common_end(left, before), common(suffix, other, GRAM)
                    if l + r >= LENGTH:
                        yield i, th, first + len(left) - l, first + len(left) + r
        return
    for before in range(max(len(p[1]) for p in pieces) + 1):  # windows with equal bytes have the string at the same place
        least: dict[bytes, int] = {}
        some = [(left[len(left) - before :] + suffix[: LENGTH - before], i, th, first + len(left) - before) for suffix, left, i, th, first in pieces if len(left) >= before and len(suffix) >= LENGTH - before]
        for w, i, _, _ in some:
            if i < least.get(w, i + 1):
                least[w] = i
        for w, i, th, start in some:
            if least[w] < i:
                yield i, th, start, start + LENGTH


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges that go, from all runs of one part."""
    schema = "id long, th long, start int, end int"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    tree = LoserTree([unpack(run.as_py()) for b in batches for run in b.column(0)])
    rows: list[tuple[int, int, int, int]] = []
    group: list[tuple[bytes, tuple]] = []
    for shared, suffix, load in tree:
        if shared < GRAM:
            if len(group) > 1:
                rows.extend(_decide(group))
            group = []
            if len(rows) >= 65536:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_names(schema))
                rows = []
        group.append((suffix, load))
    if len(group) > 1:
        rows.extend(_decide(group))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_names(schema))


def _open_ranges(runs: DataFrame) -> DataFrame:
    """The ranges that go of the windows of hot anchors: each by itself, so that no group is held anywhere; a window has a row a slice at most for each least id."""
    each = runs.where(F.col("part") == OPEN).select(F.col("run").alias("window"), *ID, "start", "end")
    least = each.groupBy("window").agg(F.min("id").alias("least"))
    return each.join(least.hint("merge"), "window").where(F.col("id") > F.col("least")).select(*ID, "start", "end")


def removed_ranges(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(id, th, ranges): the byte ranges (start, end) that go, sorted; rows of ``keyed`` that lose nothing are absent."""
    second = F.xxhash64(F.lit(1), "data").alias("check")
    texts = materialise(rows.select(*ID, second, F.octet_length("data").alias("n")), "texts")
    firsts = texts.groupBy("th", "check", "n").agg(F.min("id").alias("first"))
    copies = texts.join(firsts, ["th", "check", "n"]).where((F.col("id") > F.col("first")) & (F.col("n") >= LENGTH)).select(*ID, F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))
    anchors = materialise(repeated_anchors(rows, limits), "anchors")
    hot = anchors.where("place = -1").select("h", F.lit(1).cast("long").alias("hot"))
    any_hot = not hot.isEmpty()
    places = anchors.where("place >= 0").join(hot, "h", "left") if any_hot else anchors.withColumn("hot", F.lit(0).cast("long"))
    places = places.select("th", F.col("place").bitwiseAND((1 << _COUNT) - 2).bitwiseOR(F.coalesce("hot", F.lit(0).cast("long"))).alias("place"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-anchors.count() * 2 * LENGTH // limits.part))
    by_text = places.groupBy("th").agg(F.collect_list("place").alias("places"))
    wanted = materialise(by_text.join(firsts.select("th", F.col("first").alias("id")), "th"), "places")
    discard(anchors)
    pieces = rows.join(wanted.hint("merge"), ID).select(*ID, "data", "places")
    runs = materialise(pieces.mapInArrow(lambda x: _make_runs(x, parts, limits), RUN), "suffix-runs")
    discard(wanted)
    dealt = runs.where("part >= 0").repartitionById(parts, "part").select("run")
    ranges = dealt.mapInArrow(_merge_runs, "id long, th long, start int, end int")
    ranges = ranges.unionByName(runs.where(F.col("part") == RANGE).select(*ID, "start", "end")).unionByName(copies)
    if any_hot:
        ranges = ranges.unionByName(_open_ranges(runs))
    out = materialise(ranges.groupBy(*ID).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges")), "ranges")
    discard(runs, texts)
    return out


def dedup(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): for each row its size, the maximal removed runs (start, end) and the bytes left."""
    rows = keyed(docs)
    joined = rows.join(removed_ranges(rows, limits).hint("merge"), ID, "left").select("id", "data", F.col("ranges.start").alias("start"), F.col("ranges.end").alias("end"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, kept = [], [], []
            for value, start, end in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                data, merged = value.as_py(), []
                for s, e in zip(start or [], end or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                    else:
                        merged.append((s, e))
                edges = [0, *(x for m in merged for x in m), len(data)]
                n.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if merged else data)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    out = joined.mapInArrow(cut, "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id"))).select("doc_id", "n_bytes", "spans", "kept")


def op7_suffix_dedup(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each document."""
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
