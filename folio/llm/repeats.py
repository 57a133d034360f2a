"""Exact removal of repeated token windows, shared by operators 1 (words), 5 (lines) and 8 (bytes).

A token covered by an n-token window that also starts earlier is marked. Three passes run over the same exchange of
compressed document groups (ranges of doc_id), with two small exchanges between them; nothing is broadcast, and no task
sees pairs of documents:

1. each group names its anchors and deals them to buckets; a bucket answers which anchors other groups hold, too. What
   the anchors are is each operator's own method: ``blocks`` (non-overlapping blocks probed by every rolling window) or
   ``minima`` (the least k-token name of each window). Equal windows share an anchor, so none is lost. Names are 64 bits
   and may collide: they only choose what is looked at next, and say nothing of equality.
2. windows around shared anchors are ordered by their tokens, most significant digits first, down to the window's length
   (``Tokens.equal``), first within the group; what is first there is dealt out, as tokens, under its least name. Equal
   windows have one least name, so they meet in one bucket, which orders them by their tokens again and answers which an
   earlier group holds. A window travels once per group, so hot passages are aggregated first, and an exact copy (SHA-256)
   of a whole earlier document sends nothing at all.
3. each group unites what it and the buckets marked to maximal runs.

So what is marked was compared token by token, or is a whole document of the same SHA-256.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from folio.llm import grams as G
from folio.llm.common import Deal, order_keys, packed, power_of_two, text_bytes, unpacked

_U = np.uint64
GROUP_BYTES = 2 << 20  # of text
BUCKET_BYTES = 8 << 20
_BLOBS = "bucket int, grp int, kind int, a binary, b binary, c binary"
_REPLIES = "grp int, bucket int, a binary, b binary, c binary"


@dataclass(frozen=True)
class Spec:
    tokens: str  # "words", "lines" or "bytes"
    window: int
    gram: int
    anchors: str  # "blocks" or "minima"
    same_document: bool  # whether an earlier start in the same document counts
    weights: tuple[int, ...] = ()  # a line counts as one token more for each of these numbers of words that it reaches


class Tokens:
    """Texts cut to units (words, lines or bytes), and the tokens that these count as."""

    def __init__(self, spec: Spec, data: np.ndarray, bounds: np.ndarray):
        self.spec, self.data, self.bounds = spec, data, bounds
        self.first = None  # where each unit's tokens begin, if they may be several
        if spec.tokens == "bytes":
            self.at, self.units = bounds, len(data)
        else:
            self.starts, self.ends = G.cut(data, bounds, G._SPACE if spec.tokens == "words" else G._LINE)
            self.at, self.units = np.searchsorted(self.starts, bounds), len(self.starts)
            if spec.weights:
                words = G.words_in(data, self.starts, self.ends)
                self.weight = 1 + sum((words >= w).astype(np.int64) for w in spec.weights)
                self.first = np.r_[0, np.cumsum(self.weight)]
        self.token_at = self.at if self.first is None else self.first[self.at]
        self.n = self.units if self.first is None else int(self.first[-1])

    def _part(self) -> np.ndarray:
        return np.arange(self.n) - np.repeat(self.first[:-1], self.weight)

    def names(self) -> np.ndarray:
        """A 64-bit name for each token; equal tokens have equal names, and others may."""
        names = G.byte_tokens(self.data)
        if self.spec.tokens != "bytes":
            names = G.spans(G.prefix(names), self.starts, self.ends)
        if self.first is not None:
            names = G.mix(np.repeat(names, self.weight) + self._part().astype(_U))
        return names

    @cached_property
    def digits(self) -> tuple[np.ndarray, int]:
        """Numbers of as many tokens as fit in 64 bits, by their first, and how many these are. A byte is itself; words and lines are
        numbered by the texts themselves."""
        if self.spec.tokens == "bytes":
            d, bits, most = self.data.astype(_U), 8, 8
        else:
            size = self.ends - self.starts
            offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
            kept = self.data[~(G._SPACE if self.spec.tokens == "words" else G._LINE)[self.data]]
            texts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
            d, bits, most = np.asarray(texts.dictionary_encode().indices).astype(_U), 32, 2
            if self.first is not None:
                d = np.repeat(d, self.weight) * _U(len(self.spec.weights) + 1) + self._part().astype(_U)
        wide = 1
        while wide * 2 <= min(most, self.spec.window):
            d = (d << _U(bits * wide)) | np.r_[d[wide:], np.zeros(min(wide, len(d)), _U)]
            wide *= 2
        return d, wide

    def equal(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows ordered by their tokens in passes over digits, most significant first: a pass orders the groups that the ones before
        left tied, and what is alone drops out. Returns places in `starts`, groups of equal windows side by side and in order of
        place, and which of them equal the one before."""
        digit, wide = self.digits
        n = self.spec.window
        depths = [*range(0, n - wide, wide), n - wide]
        d = digit[starts]
        order = np.argsort(d, kind="stable")
        d = d[order]
        same = np.zeros(len(d), bool)
        same[1:] = d[1:] == d[:-1]
        for depth in depths[1:]:
            tied = same.copy()
            tied[:-1] |= same[1:]
            if not tied.all():
                order, same = order[tied], same[tied]
            if not len(order):
                break
            d = digit[starts[order] + depth]
            differs = same.copy()
            differs[1:] &= d[1:] != d[:-1]
            if differs.any():
                group = np.cumsum(~same)
                split = np.zeros(group[-1] + 1, bool)
                split[group[differs]] = True
                some = np.flatnonzero(split[group])
                by = np.lexsort((d[some], group[some]))
                order[some], d[some] = order[some][by], d[some][by]
                same[1:] &= d[1:] == d[:-1]
        return order, same


def _firsts(same: np.ndarray) -> np.ndarray:
    """For each place the place where its group begins."""
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else np.zeros(0, np.int64)


class Group(Tokens):
    """One group of documents."""

    def __init__(self, spec: Spec, docs: pa.Table, key: str, text: str):
        super().__init__(spec, *text_bytes(docs.column(text)))
        self.docs, self.ids = docs, order_keys(docs.column(key))

    @cached_property
    def sums(self) -> np.ndarray:
        return G.prefix(self.names())

    @cached_property
    def long(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.token_at) >= self.spec.window)

    @cached_property
    def whole(self) -> np.ndarray:
        """SHA-256 of the long documents."""
        data = self.data.tobytes()
        return np.array([hashlib.sha256(data[self.bounds[i] : self.bounds[i + 1]]).digest() for i in self.long.tolist()], "S32")

    @cached_property
    def copies(self) -> np.ndarray:
        """Long documents all of whose tokens go, as an earlier row here is the same; a row of the same id goes on its own where only
        smaller ids count."""
        _, first, back = np.unique(self.whole, return_index=True, return_inverse=True)
        ids = self.ids[self.long]
        return first[back] != np.arange(len(back)) if self.spec.same_document else ids[first[back]] < ids

    def _starts(self, n: int, skip: np.ndarray) -> np.ndarray:
        """Which n-token windows lie in one document, long enough and not skipped."""
        keep = np.zeros(max(0, self.n - n + 1) + 1, np.int32)
        use = self.long[~skip]
        np.add.at(keep, self.token_at[use], 1)
        np.add.at(keep, self.token_at[use + 1] - n + 1, -1)
        return np.cumsum(keep[:-1]) > 0

    @cached_property
    def _grams(self) -> np.ndarray:
        return G.grams(self.sums, self.spec.gram)

    @cached_property
    def least(self) -> np.ndarray:
        """The least name in each window, by the window's start."""
        return G.window_minima(self._grams, self.spec.window - self.spec.gram + 1)

    def _blocks(self, skip: np.ndarray):
        """Names of the rolling grams, their starts, and which of those start a non-overlapping block."""
        p = np.flatnonzero(self._starts(self.spec.gram, skip))
        doc_start = np.repeat(self.token_at[:-1], np.diff(self.token_at))[p]
        return self._grams[p], p, (p - doc_start) % self.spec.gram == 0

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the group sends: blocks, probes and whole documents. Least names are small numbers, so they are mixed again before
        their leading bits deal them out."""
        wholes = np.unique(self.whole)
        if self.spec.anchors == "blocks":
            names, _, block = self._blocks(self.copies)
            return np.unique(names[block]), np.unique(names), wholes
        ok = self._starts(self.spec.window, self.copies)
        new = np.ones(len(ok), bool)
        new[1:] = self.least[1:] != self.least[:-1]
        at = np.flatnonzero(new)
        used = np.logical_or.reduceat(ok, at) if len(at) else np.zeros(0, bool)
        return np.zeros(0, _U), np.unique(G.mix(self.least[at[used]])), wholes

    def _here(self, ok: np.ndarray) -> np.ndarray:
        """Least names that several positions of the group have."""
        # a position is an anchor if its name is the least of a window through it: the largest of those windows' least
        width = self.spec.window - self.spec.gram + 1
        least = np.full(len(ok) + 2 * (width - 1), ~_U(0))
        least[width - 1 : width - 1 + len(ok)] = ~np.where(ok, self.least, _U(0))
        least = G.window_minima(least, width)
        np.invert(least, out=least)
        every = self._grams
        return np.sort(every[every == least[: len(every)]])

    def candidates(self, blocks: np.ndarray, probes: np.ndarray, skip: np.ndarray):
        """(starts, far): windows that may repeat, and which of them other groups may hold; by anchors that these share."""
        s = self.spec
        ok = self._starts(s.window, skip)
        if s.anchors == "blocks":
            names, p, _ = self._blocks(skip)
            u = np.sort(names)
            out = G.member(names, np.union1d(blocks, probes))
            here = out | G.member(names, np.unique(u[1:][u[1:] == u[:-1]]))
            reach = s.window - s.gram + 1

            def around(flagged: np.ndarray) -> np.ndarray:
                total = np.zeros(self.n + 2, np.int32)
                total[p[flagged] + 1] = 1
                np.cumsum(total, out=total)
                m = len(ok)
                return ok & (total[reach : reach + m] - total[:m] > 0)

            far, near = around(out), around(here)
        else:
            u = self._here(ok)
            new = np.ones(len(ok), bool)
            new[1:] = self.least[1:] != self.least[:-1]
            at = np.flatnonzero(new)
            names, size = self.least[at], np.diff(np.r_[at, len(ok)])
            out = G.member(G.mix(names.copy()), probes)
            here = out | G.member(names, np.unique(u[1:][u[1:] == u[:-1]]))
            far, near = ok & np.repeat(out, size), ok & np.repeat(here, size)
        starts = np.flatnonzero(near)
        return starts, far[starts]

    def local(self, starts: np.ndarray, far: np.ndarray):
        """(gone, sent, followers, leaders): windows with an earlier equal one here; windows to ask the others for; and windows that
        share the answer of the one that is asked for."""
        order, same = self.equal(starts)
        first = starts[order[_firsts(same)]]
        mine = starts[order]
        later = first != mine
        repeats = np.zeros(len(starts), bool)
        repeats[order] = later
        sent = starts[far & ~repeats]
        if self.spec.same_document:
            return mine[later], sent, starts[:0], starts[:0]
        doc = lambda at: np.searchsorted(self.token_at, at, side="right") - 1
        earlier = later & (self.ids[doc(first)] < self.ids[doc(mine)])
        shares = later & ~earlier & far[order]
        return mine[earlier], sent, mine[shares], first[shares]

    def covered(self, starts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.n + 1, np.int32)
        np.add.at(total, starts, 1)
        np.add.at(total, starts + self.spec.window, -1)
        return np.cumsum(total[:-1]) > 0

    def unit_mask(self, mask: np.ndarray) -> np.ndarray:
        """Marked units; a unit's tokens are marked together."""
        return mask if self.first is None or not len(mask) else mask[self.first[:-1]]

    def run_bounds(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of the maximal runs of marked units, counted in the document."""
        edge = np.diff(np.r_[0, mask.view(np.int8), 0])
        cuts = self.at[1:-1][(self.at[1:-1] > 0) & (self.at[1:-1] < self.units)]
        cuts = np.unique(cuts[mask[cuts] & mask[cuts - 1]]) if len(cuts) else cuts
        a = np.sort(np.r_[np.flatnonzero(edge == 1), cuts]).astype(np.int64)
        b = np.sort(np.r_[np.flatnonzero(edge == -1), cuts]).astype(np.int64)
        doc = np.searchsorted(self.at, a, side="right") - 1
        return doc, a - self.at[doc], b - self.at[doc]


def _spread_out(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1 and so on, count[i] of them, one i after the other."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def _runs(group: Group, sent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, bucket) of the runs of consecutive windows to send that share a least name, by bucket."""
    if not len(sent):
        return sent, sent, sent
    value = group.least[sent]
    new = np.ones(len(sent), bool)
    new[1:] = (sent[1:] != sent[:-1] + 1) | (value[1:] != value[:-1])
    if group.spec.window == 1:
        new[1:] |= True
    at = np.flatnonzero(new)
    bucket = (G.mix(value[at]) >> _U(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return sent[at][order], np.diff(np.r_[at, len(sent)])[order], bucket[order]


def _parcel(group: Group, start: np.ndarray, count: np.ndarray) -> bytes:
    """The tokens of runs of windows: numbers of windows, of bytes, and of tokens to skip; then the bytes of the units."""
    end = start + count + group.spec.window - 1
    if group.spec.tokens == "bytes":
        a, b, skip = start, end, np.zeros(len(start), np.int64)
    else:
        u, v = start, end - 1
        skip = np.zeros(len(start), np.int64)
        if group.first is not None:
            u, v = (np.searchsorted(group.first, x, side="right") - 1 for x in (u, v))
            skip = start - group.first[u]
        a, b = group.starts[u], group.ends[v]
    head = np.stack([count, b - a, skip]).astype(np.uint32)
    raw = np.uint32(len(start)).tobytes() + head.tobytes() + group.data[_spread_out(a, b - a)].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _opened(parcel: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(parcel)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, 3 * n, offset=4).reshape(3, n).astype(np.int64), np.frombuffer(raw, np.uint8, offset=4 + 12 * n)


def _parts(names: np.ndarray, bits: int) -> list[np.ndarray]:
    """Sorted names or digests, cut by their leading bits."""
    lead = names if names.dtype == _U else (np.frombuffer(names.tobytes(), ">u8")[::4].astype(_U) if len(names) else np.zeros(0, _U))
    return np.split(names, np.searchsorted(lead, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)))


def _short(names: np.ndarray, bits: int) -> bytes:
    return (names << _U(bits) >> _U(32)).astype(np.uint32).tobytes()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes() if flags.any() else b""


def _flags(packed_bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed_bits, np.uint8), count=n).view(bool)


def _picked(names: list[np.ndarray], replies: dict[int, tuple], field: int) -> np.ndarray:
    """The entries that the buckets' answers mark, in order."""
    got = [part[_flags(replies[k][field], len(part))] for k, part in enumerate(names) if k in replies and replies[k][field]]
    return np.concatenate(got) if got else names[0][:0]


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _shared(blobs: pa.Table, deal: Deal, same_document: bool) -> pa.Table:
    """One bucket of anchors: which of them another group holds, too, and which whole documents an earlier group holds."""
    bucket, grp = blobs.column("bucket")[0].as_py(), blobs.column("grp").to_pylist()
    a, b, c = ([np.frombuffer(x, t) for x in blobs.column(f).to_pylist()] for f, t in (("a", np.uint32), ("b", np.uint32), ("c", "S32")))
    probes = np.sort(np.concatenate(b))
    often = np.unique(probes[1:][probes[1:] == probes[:-1]])
    blocks, held = np.unique(np.concatenate(a), return_counts=True)
    by_blocks = bool(len(blocks))
    rank = np.array(grp, np.int64) if same_document else deal.rank(np.array(grp, np.int64))
    least: dict[bytes, int] = {}
    for r, x in zip(rank.tolist(), c, strict=True):
        for d in x.tolist():
            least[d] = min(least.get(d, r), r)
    rows = []
    for k, g in enumerate(grp):
        if by_blocks:
            x = _in_sorted(a[k], often)
            at = np.minimum(np.searchsorted(blocks, b[k]), len(blocks) - 1)
            y = np.where(blocks[at] == b[k], held[at], 0) > _in_sorted(b[k], a[k])
        else:
            x, y = np.zeros(0, bool), _in_sorted(b[k], often)
        z = np.array([least[d] < rank[k] for d in c[k].tolist()], bool)
        if x.any() or y.any() or z.any():
            rows.append((g, bucket, _bits(x), _bits(y), _bits(z)))
    return _reply_table(rows)


def _reply_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["grp", "bucket", "a", "b", "c"])


def _earlier(blobs: pa.Table, spec: Spec, deal: Deal) -> pa.Table:
    """One bucket of windows: which of them an earlier group holds; what a group keeps for pass 3 goes through."""
    rows, heads, texts, grps, bucket = [], [], [], [], -1
    for k, grp, kind, a in sorted(zip(*(blobs.column(f).to_pylist() for f in ("bucket", "grp", "kind", "a")), strict=True), key=lambda r: r[1]):
        if kind:
            rows.append((grp, -1, a, b"", b""))
        else:
            head, text = _opened(a)
            heads.append(head)
            texts.append(text)
            grps.append(grp)
            bucket = k
    if len(grps) > 1:
        head = np.concatenate(heads, axis=1)
        count, size, skip = head
        t = Tokens(spec, np.concatenate(texts), np.r_[0, np.cumsum(size)])
        starts = _spread_out(t.token_at[:-1] + skip, count)
        windows = [int(h[0].sum()) for h in heads]
        ranks = np.array(grps, np.int64) if spec.same_document else deal.rank(np.array(grps, np.int64))
        order, same = t.equal(starts)
        rank = np.repeat(ranks, windows)[order]
        later = np.zeros(len(starts), bool)
        if len(order):
            least = np.minimum.reduceat(rank, np.flatnonzero(~same))
            later[order] = rank > least[np.cumsum(~same) - 1]
        for g, flags in zip(grps, np.split(later, np.cumsum(windows)[:-1]), strict=True):
            if flags.any():
                rows.append((g, bucket, _bits(flags), b"", b""))
    return _reply_table(rows)


def _answers(replies: pa.Table) -> dict[int, tuple]:
    return {k: (a, b, c) for k, a, b, c in zip(*(replies.column(f).to_pylist() for f in ("bucket", "a", "b", "c")), strict=True)}


def mark_repeats(df: DataFrame, spec: Spec, key: str, text: str, finish: Callable[[Group, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """finish(group, marked units) for each group of documents. A group holds some 2 MB of text, or one longer document."""
    deal, size = Deal.of(df, key, text, GROUP_BYTES)
    bits = power_of_two(size / BUCKET_BYTES, 64, 1 << 24).bit_length() - 1
    texts = packed(df, key, text, deal)

    def group_of(blobs: pa.Table) -> Group:
        return Group(spec, unpacked(blobs, key, text), key, text)

    def blob_rows(rows: list[tuple]) -> pa.Table:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "grp", "kind", "a", "b", "c"])

    def send_anchors(blobs: pa.Table) -> pa.Table:
        grp, parts = blobs.column("grp")[0].as_py(), [_parts(x, bits) for x in group_of(blobs).entries()]
        return blob_rows([(k, grp, 0, _short(a, bits), _short(b, bits), c.tobytes()) for k, (a, b, c) in enumerate(zip(*parts, strict=True)) if len(a) + len(b) + len(c)])

    def send_windows(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        if not blobs.num_rows:
            return blob_rows([])
        grp, replies, group = blobs.column("grp")[0].as_py(), _answers(answers), group_of(blobs)
        none = np.zeros(0, _U)
        blocks, probes, wholes = (_picked(_parts(x, bits), replies, i) for i, x in enumerate(group.entries())) if replies else (none, none, np.zeros(0, "S32"))
        skip = group.copies | np.isin(group.whole, wholes)
        starts, far = group.candidates(blocks, probes, skip)
        gone, sent, followers, leaders = group.local(starts, far)
        mask = group.covered(gone)
        for i in group.long[skip].tolist():
            mask[group.token_at[i] : group.token_at[i + 1]] = True
        start, count, bucket = _runs(group, sent, bits)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
        rows = []
        for x, y in zip(cuts, [*cuts[1:], len(bucket)], strict=False):
            rows.append((int(bucket[x]), grp, 0, _parcel(group, start[x:y], count[x:y]), b"", b""))
        if len(bucket) or mask.any():
            keep = pickle.dumps((np.packbits(mask), start, count, bucket, followers, leaders), protocol=5)
            rows.append(((1 << bits) + grp, grp, 1, zstandard.ZstdCompressor(level=1).compress(keep), b"", b""))
        return blob_rows(rows)

    def close(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        group, got = group_of(blobs), _answers(answers)
        mask = np.zeros(group.n, bool)
        if -1 in got:
            local, start, count, bucket, followers, leaders = pickle.loads(zstandard.ZstdDecompressor().decompress(got.pop(-1)[0]))
            hit = [start[:0]]
            for k, (flags, _, _) in got.items():
                own = slice(*np.searchsorted(bucket, [k, k + 1]))
                windows = _spread_out(start[own], count[own])
                hit.append(windows[_flags(flags, len(windows))])
            hit = np.concatenate(hit)
            mask = _flags(local.tobytes(), group.n) | group.covered(np.r_[hit, followers[np.isin(leaders, hit)]])
        return finish(group, group.unit_mask(mask))

    by = lambda d: d.groupBy("grp")
    shared = by_bucket(by(texts).applyInArrow(send_anchors, _BLOBS), lambda t: _shared(t, deal, spec.same_document))
    earlier = by_bucket(by(texts).cogroup(by(shared)).applyInArrow(send_windows, _BLOBS), lambda t: _earlier(t, spec, deal))
    return by(texts).cogroup(by(earlier)).applyInArrow(close, schema)


def by_bucket(blobs: DataFrame, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return blobs.groupBy("bucket").applyInArrow(f, _REPLIES)
