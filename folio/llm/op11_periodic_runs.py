"""Operator 11, runs of periodic words by Gusfield and Stoye's linear method for tandem repeats.

Documents are independent of one another, so a task takes them some megabytes at a time and works on all of them at once:

1. suffixes are ordered by doubling: a level's ranks name all factors of 2^level words, the last level's are the suffix array, the
   leaves of the suffix tree in order. Two factors' common extension, forwards or back, is a descent through the levels;
2. LZ blocks: each block is the longest prefix that also starts earlier. Only around their borders can squares (a word sequence
   twice in a row) begin for the first time; these are a leftmost-covering set;
3. suffix-link walks complete the vocabulary of squares: from a square its right rotation, which is the next place while the period
   goes on, and else is looked up in the tree. A stretch of rotations is one step;
4. all places of each kind of square are read off its interval of the tree; neighbours of one period merge into runs.

Squares of a root that is itself a power are left out throughout: their runs have the smaller period.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import grams as G
from folio.llm.common import quoted, release, spread, table, text_bytes

PART_BYTES = 2 << 20  # text that is worked on at once
_EXPANDED = 1 << 22  # places of squares held at once


class Factors:
    """Ranks of all factors of 1, 2, 4 and so on words, by start: equal factors of one document have equal ranks, and ranks are in the
    order of the suffixes. A rank is the place of its group in the suffix array."""

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        self.n, self.at = len(codes), at
        self.end = np.repeat(at[1:], np.diff(at))
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key = doc * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        self.levels: list[np.ndarray] = []
        self._ranked(order, key[order], np.zeros(self.n, np.int64), np.arange(self.n))

    def _ranked(self, order: np.ndarray, key: np.ndarray, first: np.ndarray, place: np.ndarray) -> None:
        """Takes the sorted positions, with equal keys where they stay tied, and each one's place in the suffix array."""
        rank = np.full(self.n + 1, -1, np.int32) if not self.levels else self.levels[-1].copy()
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        rank[order] = place[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else place
        self.levels.append(rank)
        tied = ~new
        tied[:-1] |= ~new[1:]
        self.tied, self.places = order[tied], place[tied]  # side by side by group

    def double(self) -> None:
        """The ranks of factors twice as long; only tied positions are sorted."""
        rank, step = self.levels[-1], 1 << (len(self.levels) - 1)
        after = self.tied + step
        key = rank[self.tied].astype(np.int64) * (self.n + 2) + np.where(after < self.end[self.tied], rank[np.minimum(after, self.n)], -1) + 1
        by = np.argsort(key, kind="stable")
        self._ranked(self.tied[by], key[by], None, self.places)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j (different) on."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            got += (rank[np.minimum(i + got, self.n)] == rank[np.minimum(j + got, self.n)]).astype(np.int64) << k
        return got

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree up to i and up to j (different), both included; either may lie before the first document."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i - got - (1 << k) + 1, j - got - (1 << k) + 1
            got += ((a >= 0) & (b >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << k
        return got


def may_have_runs(f: Factors) -> np.ndarray:
    """Documents that may hold a run, by the places where four words stand again in the document.

    A run of period q and length L >= max(6, 4 q) has L - q - 3 such places side by side, each at most q before its next; so one lies at
    most a third of its stretch, and three, before its next."""
    rank, n = f.levels[2], f.n
    order, r = f.tied, rank[f.tied]
    by = np.lexsort((order, r))
    order, r = order[by], r[by]
    gap = np.full(n + 1, n + 1)
    again = np.flatnonzero(r[1:] == r[:-1])
    gap[order[again]] = order[again + 1] - order[again]
    there = gap[:n] <= n
    edge = np.flatnonzero(np.diff(np.r_[False, there, False].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(len(f.at) - 1, bool)
    least = np.minimum.reduceat(gap, np.stack([begin, end], 1).ravel())[::2]
    good = begin[3 * least <= end - begin + 3]
    out = np.zeros(len(f.at) - 1, bool)
    out[np.searchsorted(f.at, good, side="right") - 1] = True
    return out


def _smaller(pos: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value; the first value is the smallest."""
    p = np.arange(len(pos)) - 1
    p[0] = 0
    todo = np.flatnonzero(pos[p] > pos)
    while len(todo):
        p[todo] = p[p[todo]]
        todo = todo[pos[p[todo]] > pos[todo]]
    return p


def blocks(f: Factors, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and next block's end of all LZ blocks, by document: a block is the longest factor that also starts earlier, or one word."""
    n, docs = f.n, len(f.at) - 1
    doc = np.repeat(np.arange(docs), np.diff(f.at))
    slot = np.arange(n) + doc + 1  # in the suffix array with a least value before each document
    pos = np.full(n + docs + 1, -1)
    pos[slot] = suffixes
    longest = np.zeros(n, np.int64)
    for turned in (False, True):
        near = _smaller(pos[::-1] if turned else pos)
        near = (len(pos) - 1 - near[::-1]) if turned else near
        other = pos[near[slot]]
        some = np.flatnonzero(other >= 0)
        longest[suffixes[some]] = np.maximum(longest[suffixes[some]], f.forward(suffixes[some], other[some]))
    size, begins = np.maximum(longest, 1).tolist(), []
    for a, b in zip(f.at[:-1].tolist(), f.at[1:].tolist(), strict=True):
        while a < b:
            begins.append(a)
            a += size[a]
    begin = np.array(begins, np.int64)
    end = np.minimum(begin + np.array(size, np.int64)[begin], f.end[begin])
    after = np.r_[end[1:], 0]
    return begin, end, np.where(end < f.end[begin], after, end)


def _each(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the number in it, of all numbers of the ranges [first, first + count)."""
    of = np.repeat(np.arange(len(first)), count)
    return of, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def covering(f: Factors, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and period of squares at the blocks' borders; each kind of square has its first place in one of their stretches of rotations."""
    found = []
    # around a block's end: what begins in the block
    inner = np.flatnonzero(end < f.end[begin])
    of, k = _each(np.ones(len(inner), np.int64), (end - begin)[inner])
    e = end[inner][of]
    some = np.flatnonzero(codes[e] == codes[e - k])
    e, k = e[some], k[some]
    q = e - k
    fore, back = f.forward(q, e), f.back(q - 1, e - 1)
    ok = fore + back >= k
    found.append((np.maximum(q - back, q - k + 1)[ok], k[ok]))
    # around its begin: what begins before it and has its middle in it
    of, k = _each(np.ones(len(begin), np.int64), after - begin)
    h = begin[of]
    some = np.flatnonzero((h > 0) & (h + k <= f.end[h]))
    of, h, k = of[some], h[some], k[some]
    some = np.flatnonzero(codes[h - 1] == codes[h + k - 1])
    of, h, k = of[some], h[some], k[some]
    fore, back = f.forward(h, h + k), f.back(h - 1, h + k - 1)
    start = np.maximum(h - back, h - k)
    ok = (fore + back >= k) & (back > 0) & (start + k < end[of])
    found.append((start[ok], k[ok]))
    return tuple(np.concatenate([x[i] for x in found]) for i in range(2))


def _primitive(f: Factors, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k words from start are no power of fewer words."""
    out, most = np.ones(len(k), bool), int(k.max(initial=1))
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            own = factor[p * p :: p]
            own[own == np.arange(p * p, most + 1, p)] = p
    left = k.copy()
    while (some := np.flatnonzero((left > 1) & out)).size:
        p = factor[left[some]]
        d = k[some] // p
        out[some] = f.forward(start[some], start[some] + d) < k[some] - d
        left[some] //= p
    return out


def _stretch(f: Factors, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The stretches [begin, end) of period k around these squares, each once: rows of k, begin, end."""
    got = np.stack([k, start - f.back(start - 1, start + k - 1), start + k + f.forward(start, start + k)], 1)
    return np.unique(got, axis=0)


def _looked_up(f: Factors, codes: np.ndarray, suffixes: np.ndarray, x: np.ndarray, length: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Where the `length` words from x and the word `then` behind them stand in x's document, or -1: a search in the suffix array."""
    rank = f.levels[-1]
    low, high = f.at[np.searchsorted(f.at, x, side="right") - 1], f.end[x]
    end = high
    while (some := np.flatnonzero(low < high)).size:
        mid = (low[some] + high[some]) // 2
        j = suffixes[mid]
        same = np.where(j == x[some], length[some], np.minimum(f.forward(x[some], j), length[some]))
        behind = j + length[some]
        word = np.where(behind < end[some], codes[np.minimum(behind, f.n - 1)], -1)
        less = np.where(same < length[some], rank[j] < rank[x[some]], word < then[some])  # the suffix is less than what is looked for
        low[some], high[some] = np.where(less, mid + 1, low[some]), np.where(less, high[some], mid)
    at = suffixes[np.minimum(low, f.n - 1)]
    hit = (low < end) & (at + length < end)
    agree = np.where(at == x, length, f.forward(x, at))
    return np.where(hit & (agree >= length) & (codes[np.minimum(at + length, f.n - 1)] == then), at, -1)


def vocabulary(f: Factors, codes: np.ndarray, suffixes: np.ndarray, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Stretches (k, begin, end) that hold every kind of square: from the given ones on, the rotation behind a stretch's last square is
    looked up, and where it stands is a stretch again."""
    all_ = fresh = _stretch(f, start, k)
    while len(fresh):
        k, begin, end = fresh.T
        open_ = end - begin - 2 * k + 1 < k  # else it holds all rotations
        k, last = k[open_], (end - 2 * k)[open_]
        at = _looked_up(f, codes, suffixes, last + 1, 2 * k - 1, codes[last])
        some = at >= 0
        met = _stretch(f, at[some], k[some])
        both, first = np.unique(np.concatenate([all_, met]), axis=0, return_index=True)
        fresh, all_ = both[first >= len(all_)], both
    return all_


def occurrences(f: Factors, suffixes: np.ndarray, stretches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and begins of all squares of the kinds that the stretches hold."""
    k, begin, end = stretches.T
    of, start = _each(begin, np.minimum(end - begin - 2 * k + 1, k))
    k = k[of]
    level = np.floor(np.log2(2 * k)).astype(np.int64)
    for lv in np.unique(level).tolist():
        own, rank = np.flatnonzero(level == lv), f.levels[min(lv, len(f.levels) - 1)]
        wide = 1 << min(lv, len(f.levels) - 1)
        p, kk = start[own], k[own]
        kinds = np.unique(np.stack([kk, rank[p], rank[p + 2 * kk - wide]], 1), axis=0)
        size = np.bincount(rank[:-1], minlength=f.n)
        kk, head, tail = kinds.T
        held = np.cumsum(size[head])
        cuts = np.searchsorted(held, np.arange(0, (held[-1] if len(held) else 0) + _EXPANDED, _EXPANDED))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            b = max(b, a + 1) if a < len(kk) else b
            of, at = _each(head[a:b], size[head[a:b]])
            j, q = suffixes[at], kk[a:b][of]
            behind = j + 2 * q - wide
            ok = (behind < f.n) & (rank[np.minimum(behind, f.n)] == tail[a:b][of])
            yield q[ok], j[ok]


def runs(codes: np.ndarray, at: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """(document, begin, length, period) of all runs, in this order but for the length; begins from 0 in each document. codes: numbers
    that stand for the words, equal for equal words; document i has the words [at[i], at[i + 1])."""
    none = np.zeros((0, 4), np.int64)
    f = Factors(codes, at)
    for _ in range(2):
        f.double()
    some = may_have_runs(f) if exponent >= 4 and least >= 6 else np.diff(at) > 0
    if not some.any():
        return none
    size = np.diff(at)[some]
    codes = codes[np.repeat(some, np.diff(at))]
    at = np.r_[0, np.cumsum(size)]
    f = Factors(codes, at)
    while len(f.tied):
        f.double()
    suffixes = np.empty(f.n, np.int64)
    suffixes[f.levels[-1][:-1]] = np.arange(f.n)
    start, k = covering(f, codes, *blocks(f, suffixes))
    ok = _primitive(f, start, k)
    if not ok.any():
        return none
    stretches = vocabulary(f, codes, suffixes, start[ok], k[ok])
    found = none[:, :3]
    for q, j in occurrences(f, suffixes, stretches):
        by = np.lexsort((j, q))
        q, j = q[by], j[by]
        first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (j[1:] > j[:-1] + 1)]) if len(q) else np.zeros(0, np.int64)
        last = np.r_[first[1:] - 1, len(q) - 1][: len(first)]
        found = np.concatenate([found, np.stack([q[first], j[first], j[last] + 2 * q[first]], 1)])
    # parts of a run that came at different times
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    k, begin, end = found.T
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (begin[1:] > end[:-1] - 2 * k[:-1] + 1)][: len(k)])
    end = np.maximum.reduceat(end, first) if len(first) else end
    k, begin = k[first], begin[first]
    good = end - begin >= np.maximum(least, exponent * k)
    k, begin, end = k[good], begin[good], end[good]
    doc = np.searchsorted(at, begin, side="right") - 1
    by = np.lexsort((k, begin))
    return np.stack([np.flatnonzero(some)[doc], begin - at[doc], end - begin, k], 1)[by]


def _parts(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64) + 64)
    cut = 0
    while cut < b.num_rows:
        end = max(cut + 1, int(np.searchsorted(size, (size[cut - 1] if cut else 0) + PART_BYTES, side="right")))
        yield b.slice(cut, end - cut)
        cut = end


def collapsed_runs(df: DataFrame, exponent: int = 4, least: int = 6, key: str = "doc_id", text: str = "text", moved: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and collapsed (text: the words that stay, joined by a blank).

    Words are what stands between ASCII white space. A run is a stretch of words whose smallest period fits at least `exponent` times
    (2 or more) and that has `least` words at least, as long as it can be; of each run the first period stays. moved: for an id and a
    number of words the places that the words are taken from, or None for as they are. A null or empty text has no runs and an
    empty collapsed text; repeated rows and null ids are rows of their own; an empty table gives an empty result; other
    columns are ignored. A document is worked on whole: some 100 bytes a word, and 4 more for each doubling of its longest repeat.
    """

    def work(batches):
        for batch in batches:
            for b in _parts(batch, 1):
                data, bounds = text_bytes(b.column(1))
                starts, ends = G.cut(data, bounds, G._SPACE)
                at = np.searchsorted(starts, bounds)
                sizes = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
                solid = np.ascontiguousarray(data[~G._SPACE[data]])
                words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(solid)])
                codes = np.asarray(words.dictionary_encode().indices).astype(np.int64)
                ids, whole, rewritten = b.column(0).to_pylist(), data.tobytes(), {}
                for i, own in enumerate(ids):
                    n = int(at[i + 1] - at[i])
                    of = moved(own, n) if moved is not None and n else None
                    if of is not None:
                        codes[at[i] : at[i + 1]] = codes[at[i] + of]
                        rewritten[i] = of
                found = runs(codes, at, exponent, least)
                cuts = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
                all_runs, texts = [], []
                for i in range(len(ids)):
                    own, w = found[cuts[i] : cuts[i + 1], 1:], whole[bounds[i] : bounds[i + 1]].split()
                    if i in rewritten:
                        w = [w[x] for x in rewritten[i].tolist()]
                    if len(own):
                        edge = np.zeros(len(w) + 1, np.int64)
                        np.add.at(edge, own[:, 0] + own[:, 2], 1)
                        np.add.at(edge, own[:, 0] + own[:, 1], -1)
                        w = [w[x] for x in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()])
                    texts.append(b" ".join(w).decode())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(all_runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])
        release()

    k, t = (F.col(n) for n in quoted([key, text]))
    rows = spread(df.select(k.cast("long").alias("doc_id"), t.cast("string").alias("text")))
    return rows.mapInArrow(work, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string")


def planted(key: int | None, n: int) -> np.ndarray | None:
    """The contract's periodic tails: of a tenth of the documents, told by the CRC-32 of their ids."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = collapsed_runs(table(spark, sf_dir, "documents"), moved=planted)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    # the greatest length / period: a / b > c / d if a d > c b
    first = lambda s, r: F.when(s.isNull() | (r["length"] * s["period"] > s["length"] * r["period"]), r).otherwise(s)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), first)
    got = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return got.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
