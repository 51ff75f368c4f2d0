"""Runs: stretches of words that repeat with a period and cannot be extended.

A stretch with smallest period q and at least ``max(least, 2 q)`` words holds two points of
the grid of step ``max(q, least - q)``, one period apart. So for every period the grid points
i and i + p are compared, about ``n log n`` of them, and how far the words agree on both sides
gives the whole run. Multiples of a run's period find the same stretch; the smallest counts.

The agreement to the right of two points comes from a difference-cover structure. A cover of
31 residues in 6 of them has, for any two points, a shift below 31 that puts both on sampled
positions. The words up to there are compared directly, which ends nearly every comparison;
beyond, sampled suffixes are ranked (31 words first, then doubled), and the least common
prefix between two ranks is a range minimum in a sparse table. The reversed words give the
agreement to the left. Only documents with a comparison that survives a few words are sampled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: A perfect difference set: every difference modulo 31 occurs. Fixed values.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words searched together, grid points looked at together, and the text length up to which grids are tabled.
BLOCK, POINTS, TABLED = 1 << 18, 1 << 21, 2048


def _shifts() -> np.ndarray:
    """For each (i, j) modulo 31 the least shift that puts both into the cover."""
    inside = np.zeros(MODULUS, bool)
    inside[list(COVER)] = True
    i, j, s = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return (inside[(i + s) % MODULUS] & inside[(j + s) % MODULUS]).argmax(axis=2)


SHIFTS = _shifts()


class Extensions:
    """How far the words at two positions agree. Every text must end in a code of its own."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        self.codes = np.concatenate([codes, np.full(2 * MODULUS, -1, codes.dtype)])
        place = np.flatnonzero(np.isin(np.arange(self.size) % MODULUS, COVER))
        self.where = np.full(self.size + 2 * MODULUS, -1)
        self.where[place] = np.arange(len(place))
        ranks = [self._first_ranks(place)]
        reach = MODULUS
        while ranks[-1].max(initial=-1) + 1 < len(place) and reach < self.size:
            after = self.where[np.minimum(place + reach, self.size)]
            second = np.where(after < 0, 0, ranks[-1][after] + 1)
            ranks.append(np.unique(ranks[-1] * (len(place) + 1) + second, return_inverse=True)[1])
            reach *= 2
        order = np.argsort(ranks[-1], kind="stable")
        self.rank = np.empty(len(place), np.int64)
        self.rank[order] = np.arange(len(place))
        self.minima = self._sparse_table(self._neighbours(place[order], ranks))

    def _first_ranks(self, place: np.ndarray) -> np.ndarray:
        """Ranks by the first 31 words, several codes packed into a key."""
        bits = max(1, int(self.codes.max(initial=0) + 1).bit_length())
        keys = []
        for at in range(0, MODULUS, 63 // bits):
            key = np.zeros(len(place), np.int64)
            for step in range(at, min(at + 63 // bits, MODULUS)):
                key = (key << bits) | (self.codes[place + step] + 1)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(place), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        out = np.empty(len(place), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _neighbours(self, place: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sampled suffix with the next in order: by doubled ranks, then word by word."""
        a, b = place[:-1].copy(), place[1:].copy()
        start = a.copy()
        for level in range(len(ranks) - 1, -1, -1):
            x, y = self.where[np.minimum(a, self.size)], self.where[np.minimum(b, self.size)]
            same = (x >= 0) & (y >= 0) & (ranks[level][x] == ranks[level][y])
            a, b = a + same * (MODULUS << level), b + same * (MODULUS << level)
        return a - start + self._direct(a, b, np.full(len(a), MODULUS))

    def _direct(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on, at most ``most``, compared one by one."""
        out = np.zeros(len(a), np.int64)
        going, step = np.flatnonzero(most > 0), 0
        while len(going):
            going = going[self.codes[a[going] + step] == self.codes[b[going] + step]]
            step += 1
            out[going] = step
            going = going[most[going] > step]
        return out

    @staticmethod
    def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of positions a and b (a is not b)."""
        shift = SHIFTS[a % MODULUS, b % MODULUS]
        out = self._direct(a, b, shift)
        far = np.flatnonzero(out == shift)
        x, y = self.where[a[far] + shift[far]], self.where[b[far] + shift[far]]
        both = (x >= 0) & (y >= 0)
        far, x, y = far[both], self.rank[x[both]], self.rank[y[both]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        for depth in np.unique(level):
            at = level == depth
            table = self.minima[depth]
            out[far[at]] += np.minimum(table[low[at]], table[high[at] - (1 << int(depth))])
        return out


def _step(period: np.ndarray, least: int) -> np.ndarray:
    return np.maximum(period, least - period)


def grid(n: int, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p) for every period p of at most half of n words and every grid point i with i + p < n, in parts."""
    at = 1
    while 2 * at <= n:
        period = np.arange(at, min(n // 2, at + max(1, POINTS * at // n)) + 1)
        count = (n - period - 1) // _step(period, least) + 1
        ends = np.cumsum(count)
        take = max(1, int(np.searchsorted(ends, POINTS, side="right")))
        period, count, ends = period[:take], count[:take], ends[:take]
        p = np.repeat(period, count)
        yield (np.arange(ends[-1]) - np.repeat(ends - count, count)) * _step(p, least), p
        at += take


class _Table:
    """The grids of all short texts: those of n words are the points whose later end is below n."""

    def __init__(self, least: int):
        i, p = (np.concatenate(c) for c in zip(*grid(2 * TABLED, least), strict=True))
        keep = i + p < TABLED
        order = np.argsort((i + p)[keep], kind="stable")
        self.i, self.p = i[keep][order], p[keep][order]
        self.count = np.searchsorted((self.i + self.p), np.arange(TABLED + 1))


def _survivors(codes: np.ndarray, i: np.ndarray, p: np.ndarray, least: int) -> np.ndarray:
    """Which pairs (i, i + p) agree in enough neighbouring words for a run; half of ``least`` words are looked at on each side."""
    near = (least + 1) // 2
    at = np.flatnonzero(codes[i] == codes[i + p])
    i, j = i[at], (i + p)[at]
    found = np.ones(len(at), np.int64)
    for side, reach in ((1, near), (-1, near + 1)):
        going = np.arange(len(at))
        for step in range(1, reach):
            going = going[codes[i[going] + side * step] == codes[j[going] + side * step]]
            found[going] += 1
    return at[found >= near]


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with an end of its own before, between and behind them; and where each begins."""
    top = max((int(t.max(initial=-1)) for t in texts), default=-1) + 1
    ends = top + np.arange(len(texts) + 1, dtype=np.int64)
    parts = [ends[:1]]
    for k, text in enumerate(texts):
        parts += [text, ends[k + 1:k + 2]]
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.concatenate(parts).astype(np.int64), np.cumsum(sizes + 1) - sizes


def _measured(codes: np.ndarray, forward: Extensions, backward: Extensions, i: np.ndarray, p: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of the stretches around surviving pairs, each once and with its smallest period."""
    right = forward.agree(i, i + p)
    left = backward.agree(len(codes) - i, len(codes) - i - p)
    keep = left + right >= _step(p, least)
    return _least_period(np.column_stack([i - left, i + p + right, p])[keep])


def _least_period(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


class Finder:
    """Finds the runs of many texts at once; ``least`` is the smallest number of words of a run."""

    def __init__(self, least: int = LEAST):
        self.least, self.table = least, _Table(least)

    def runs(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text of word codes its runs as rows (start, end, period), by start and period."""
        out = [np.zeros((0, 3), np.int64)] * len(texts)
        short = [k for k, t in enumerate(texts) if self.least <= len(t) <= TABLED]
        for k, rows in zip(short, self._short([texts[k] for k in short]), strict=True):
            out[k] = rows
        for k, text in enumerate(texts):
            if len(text) > TABLED:
                out[k] = self._long(text)
        return [rows[np.lexsort((rows[:, 2], rows[:, 0]))] for rows in out]

    def _short(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        codes, begin = _laid_out(texts)
        count = self.table.count[[len(t) for t in texts]] if texts else np.zeros(0, np.int64)
        found = []
        at = 0
        while at < len(texts):
            to = at + max(1, int(np.searchsorted(np.cumsum(count[at:]), POINTS, side="right")))
            own = np.repeat(np.arange(at, min(to, len(texts))), count[at:to])
            which = np.arange(len(own)) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to])
            i, p = begin[own] + self.table.i[which], self.table.p[which]
            keep = _survivors(codes, i, p, self.least)
            found.append(np.column_stack([own[keep], i[keep] - begin[own[keep]], p[keep]]))
            at = to
        out = [np.zeros((0, 3), np.int64)] * len(texts)
        hits = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        if len(hits):
            used, own = np.unique(hits[:, 0], return_inverse=True)
            codes, begin = _laid_out([texts[k] for k in used])
            rows = _measured(codes, Extensions(codes), Extensions(codes[::-1].copy()), hits[:, 1] + begin[own], hits[:, 2], self.least)
            text = np.searchsorted(begin, rows[:, 0], side="right") - 1
            rows[:, :2] -= begin[text][:, None]
            cuts = np.searchsorted(text, np.arange(len(used) + 1))
            for k, a, b in zip(used.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[k] = rows[a:b]
        return out

    def _long(self, text: np.ndarray) -> np.ndarray:
        codes, begin = _laid_out([text])
        both, rows = None, np.zeros((0, 3), np.int64)
        for i, p in grid(len(text), self.least):
            i = i + begin[0]
            keep = _survivors(codes, i, p, self.least)
            if len(keep):
                both = both or (Extensions(codes), Extensions(codes[::-1].copy()))
                rows = _least_period(np.concatenate([rows, _measured(codes, *both, i[keep], p[keep], self.least)]))
        rows[:, :2] -= begin[0]
        return rows


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside every run's repeats, that is behind its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the checksum of its id with its tail turned into a loop; a null id is left alone."""
    if doc_id is None or not words:
        return words
    code = zlib.crc32(str(doc_id).encode())
    if code % 10:
        return words
    g, n = code // 10, len(words)
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    times = -(-(n - at) // period)
    return words[:at] + (words[at:at + period] * times)[:n - at]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start, then period), and the collapsed text.

    Words are cut at ASCII white space and numbered from 0; the collapsed text joins by
    spaces the words that are not repeats. ``rewrite`` may change the words before.
    A null, empty or wordless text has no run and an empty collapsed text; repeated rows give
    repeated results, ties cannot occur (no two runs share start and period), an empty table
    gives an empty result, and other columns are not read. Texts are searched whole; a batch
    is worked on in blocks of about ``BLOCK`` words, one longer text is a block of its own.
    """
    def run(batches):
        finder = Finder(least)
        for batch in batches:
            ids, at = batch.column(0), 0
            worded, block, held = [], {}, 0
            for k, (doc_id, text) in enumerate(zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = (text or "").encode().split()
                worded.append(words if rewrite is None else rewrite(doc_id, words))
                held += len(words)
                if held >= BLOCK or k + 1 == batch.num_rows:
                    yield answer(finder, ids.slice(at, len(worded)), worded)
                    at, worded, held = k + 1, [], 0

    def answer(finder, ids, worded):
        number: dict[bytes, int] = {}
        texts = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in worded]
        runs = finder.runs(texts)
        rows = np.concatenate(runs)
        items = pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()), items)
        kept = [b" ".join(collapse(words, r)).decode() for words, r in zip(worded, runs, strict=True)]
        return pa.RecordBatch.from_arrays([ids, lists, pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")).mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest (ties: smallest start, then period), and digests of runs and collapsed text."""
    top = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
