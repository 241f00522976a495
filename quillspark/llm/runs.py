"""Runs of repeated words: a longest-previous-factor array from suffixes and their common prefixes, its blocks, Main's
extensions at their borders, and copies of what earlier blocks hold."""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of some documents whose suffixes are sorted at once; a longer document is sorted alone.
WORDS = 200_000
#: A run has LEAST words and TIMES periods, at least.
LEAST, TIMES = 6, 4
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]


class Names:
    """Equal names for equal substrings of a power of two letters, ordered as the substrings are.

    `levels[k][i]` names the 2^k letters from place i, by the rank of the first suffix that starts with them. Each level
    sorts again only the suffixes that the last one left together. A number that stands once in the text ends every
    substring that reaches it, so separators keep texts apart. After the last level, names are the suffixes' ranks."""

    def __init__(self, letters: np.ndarray):
        n, order = len(letters), np.argsort(letters, kind="stable")
        head = self._heads(np.r_[True, letters[order][1:] != letters[order][:-1]], np.arange(n))
        name = np.empty(n, np.int32)
        name[order] = head
        self.levels, step = [name], 1
        while len(open_ := self._open(order, name)):
            places = order[open_]
            ahead = np.minimum(places + step, n)
            key = np.r_[name, -1][ahead].astype(np.int64) + name[places].astype(np.int64) * (n + 1)
            turn = np.argsort(key, kind="stable")
            places, key = places[turn], key[turn]
            order = order.copy()
            order[open_] = places
            name = name.copy()
            name[places] = self._heads(np.r_[True, key[1:] != key[:-1]], open_)
            self.levels.append(name)
            step *= 2
        self.order = order

    @staticmethod
    def _heads(first: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return ranks[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]

    @staticmethod
    def _open(order: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Ranks of suffixes that share their name with a neighbour."""
        if len(order) < 2:
            return np.zeros(0, np.int64)
        same = name[order][1:] == name[order][:-1]
        return np.flatnonzero(np.r_[same, False] | np.r_[False, same])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that are equal from the places i and j on; i and j differ."""
        n, size = len(self.order), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + size, j + size
            inside = np.maximum(a, b) < n
            same = inside & (self.levels[k][np.where(inside, a, 0)] == self.levels[k][np.where(inside, b, 0)])
            size += same << k
        return size

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that are equal from the places i and j back."""
        size = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - size - (1 << k) + 1, j - size - (1 << k) + 1
            inside = np.minimum(a, b) >= 0
            same = inside & (self.levels[k][np.where(inside, a, 0)] == self.levels[k][np.where(inside, b, 0)])
            size += same << k
        return size


def previous_factors(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest substring that starts there and also at an earlier place, and such a place.

    The nearest suffixes above and below, in sorted order, that start earlier share the longest prefixes; one pass with a
    stack over the common prefixes of neighbours finds both."""
    order = names.order
    factor, source = np.zeros(len(order), np.int64), np.full(len(order), -1, np.int64)
    near = np.flatnonzero(names.levels[0][order[1:]] == names.levels[0][order[:-1]]) + 1
    common = names.ahead(order[near - 1], order[near])
    # neighbours without a common letter part the order into groups; each has a pass of its own
    cuts = np.flatnonzero(np.diff(near) != 1) + 1
    places, shared = order.tolist(), common.tolist()
    length, origin = {}, {}
    for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(near)].tolist()):
        if lo == hi:
            continue
        first = int(near[lo]) - 1
        # the stack holds earlier places under later ones, each with its common prefix with the one below
        held, with_below = [places[first]], [0]
        for k in range(lo, hi + 1):
            place, up = (places[first + 1 + k - lo], shared[k]) if k < hi else (-1, 0)
            while held and held[-1] > place:
                top, below = held.pop(), with_below.pop()
                if below >= up:
                    if below:
                        length[top], origin[top] = below, held[-1]
                else:
                    length[top], origin[top] = up, place
                up = min(up, below)
            held.append(place)
            with_below.append(up)
    if length:
        at = np.fromiter(length, np.int64, len(length))
        factor[at], source[at] = np.fromiter(length.values(), np.int64, len(length)), np.fromiter(origin.values(), np.int64, len(length))
    return factor, source


def blocks(factor: np.ndarray, begins: list[int], ends: list[int]) -> np.ndarray:
    """First places of the blocks of the texts [begin, end): each block is the longest earlier substring, or a new letter."""
    out, size = [], factor.tolist()
    for i, end in zip(begins, ends):
        while i < end:
            out.append(i)
            i += size[i] or 1
    return np.array(out, np.int64)


def _spread(first: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of `first` with every period from 1 to its `most`."""
    most = np.maximum(most, 0)
    return np.repeat(first, most), np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1


def border_runs(names: Names, first: np.ndarray, last: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, end, period) of all runs that hold or touch a border of the blocks [first, last).

    A run of four periods has two of them on one side of a border. On the right they lie in the block that the run ends
    in; on the left they are shorter than the block before, as a block that starts one period after a run does
    reaches at least as far as the run."""
    parts = []
    b, p = _spread(first, (last - first) // 2)
    same = names.levels[0][b] == names.levels[0][b + p]
    b, p = b[same], p[same]
    right = names.ahead(b, b + p)
    b, p, right = (v[right >= p] for v in (b, p, right))
    left = np.zeros(len(b), np.int64)
    left[b > 0] = names.behind(b[b > 0] - 1, (b + p)[b > 0] - 1)
    parts.append((b - left, b + p + right, p))
    b, p = _spread(last, last - first - 1)
    same = names.levels[0][b - 1] == names.levels[0][np.maximum(b - 1 - p, 0)]
    b, p = b[same & (b > p)], p[same & (b > p)]
    left = names.behind(b - 1, b - 1 - p)
    b, p, left = (v[left >= p] for v in (b, p, left))
    right = np.zeros(len(b), np.int64)
    in_text = b < len(names.order)
    right[in_text] = names.ahead(b[in_text], (b - p)[in_text])
    parts.append((b - p - left, b + right, p))
    start, end, period = (np.concatenate(x) for x in zip(*parts))
    long = end - start >= np.maximum(least, times * period)
    found: dict[tuple[int, int], int] = {}
    for s, e, q in zip(start[long].tolist(), end[long].tolist(), period[long].tolist()):
        found[s, e] = min(q, found.get((s, e), q))  # a multiple of a run's period spans the same words
    return [(s, e, q) for (s, e), q in found.items()]


def with_copies(runs: list[Run], first: list[int], last: list[int], source: list[int]) -> list[Run]:
    """Those runs and the ones that lie strictly inside a block: these are copied from where the block stands before.

    Runs are kept in the order of their starts, a bucket a start; blocks are taken from left to right, so a block that
    overlaps its source finds there what it has itself been given."""
    runs = sorted(runs)
    have = set(runs)
    for begin, end, origin in zip(first, last, source):
        if origin < 0 or end - begin < LEAST + 2 or not runs or runs[0][0] >= end:
            continue
        shift, at = begin - origin, bisect.bisect_right(runs, (origin, 1 << 62, 0))
        while at < len(runs) and runs[at][0] + shift < end:
            s, e, q = runs[at]
            if e + shift < end and (new := (s + shift, e + shift, q)) not in have:
                have.add(new)
                bisect.insort(runs, new, lo=at + 1)
            at += 1
    return runs


def all_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs (start, end, period) of each text, an array of letters (integers from 0)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    # letters of different texts differ, and a separator that stands once follows each text
    most = max([int(t.max()) + 1 for t in texts if len(t)], default=1)
    letters = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for k, (t, b) in enumerate(zip(texts, begins.tolist())):
        letters[b : b + len(t)] = t + k * most
        letters[b + len(t)] = len(texts) * most + k
    names = Names(letters)
    factor, source = previous_factors(names)
    first = blocks(factor, begins.tolist(), (begins + sizes).tolist())
    last = first + np.maximum(factor[first], 1)
    out: list[list[Run]] = [[] for _ in texts]
    found = border_runs(names, first, last)
    owner = np.searchsorted(begins, [s for s, _, _ in found], "right") - 1
    for k, run in zip(owner.tolist(), found):
        out[k].append(run)
    for k in sorted(set(owner.tolist())):
        lo, hi = np.searchsorted(first, [begins[k], begins[k] + sizes[k]])
        b = int(begins[k])
        out[k] = [(s - b, e - b, q) for s, e, q in with_copies(out[k], first[lo:hi].tolist(), last[lo:hi].tolist(), source[first[lo:hi]].tolist())]
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, a tenth of all documents with their end made periodic, by a hash of the id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def _row(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    runs = sorted((s, e - s, q) for s, e, q in runs)
    best = None
    for s, size, q in runs:
        if best is None or (size * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
            best = s, size, q
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for s, size, q in runs:
            dropped[s + q] += 1
            dropped[s + size] -= 1
        words = [w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d]
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Runs of each text: how many, the one of greatest exponent, and digests of all runs and of the words without repeats.

    A run is a stretch of words with smallest period q, of at least LEAST words and TIMES periods, that no neighbour
    extends. With `plant`, a tenth of the documents get a periodic end first. Takes doc_id and text. Nothing is shuffled;
    the suffixes of some documents, WORDS words or one document, are sorted together. A null, empty or blank text has
    no words and no runs; a null id plants nothing; rows with equal ids stay apart; of equal exponents the first start
    counts, then the shortest period. An empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        words: list[list[bytes]] = []

        def answers() -> pa.RecordBatch:
            texts = []
            for own in words:
                number: dict[bytes, int] = {}
                texts.append(np.fromiter([number.setdefault(w, len(number)) for w in own], np.int64, len(own)))
            rows = [_row(*x) for x in zip(ids, words, all_runs(texts))]
            ids.clear(), words.clear()
            kinds = {"long": pa.int64(), "string": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows), SCHEMA.split(", "))], names=[x.split()[0] for x in SCHEMA.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = (text.as_py() or b"").split()  # bytes split at space and tab to carriage return
                own = planted(own, doc_id) if plant else own
                if ids and size + len(own) > WORDS:
                    yield answers()
                    size = 0
                ids.append(doc_id)
                words.append(own)
                size += len(own) + 1
        if ids:
            yield answers()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
