"""Operator 9, packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are dealt to groups by a hash of their id and text and each group is packed for itself, so groups bound memory and
need nothing of one another. In a group a document's whole sequences stand alone and the rests go to bins by first-fit
decreasing. Bins that it fills stay. Of those with holes the least filled ones give their rests, cut where need be, to fill
the fullest, and of the one bin that is left in the end, pieces of powers of two are made. No sequence needs padding.
Each piece tells the bin in which first-fit decreasing placed it, so the fill before cutting can be read off the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import encoder
from folio.llm.common import by_hash, packed, table, text_size, unpacked

GROUP_BYTES = 4 << 20  # of text
Piece = tuple[int, int, int, int]  # document, start, length, and the bin of first-fit decreasing (-1: a whole sequence)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by bin. The tree holds the largest free space below each node; the leftmost bin that fits is log2(bins) steps away."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        need, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(i)
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins


def fill_holes(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Cuts the pieces of the least filled bins to fill the others; the last rest becomes sequences of powers of two."""
    bins = sorted(bins, key=lambda b: -sum(p[2] for p in b))  # stable
    free = [capacity - sum(p[2] for p in b) for b in bins]
    give, take = len(bins) - 1, 0
    while take < give:
        if not free[take]:
            take += 1
            continue
        if not bins[give]:
            give -= 1
            continue
        doc, start, size, own = bins[give].pop()
        part = min(size, free[take])
        bins[take].append((doc, start, part, own))
        free[take] -= part
        free[give] += part
        if part < size:
            bins[give].append((doc, start + part, size - part, own))
    out = [b for k, b in enumerate(bins) if b and free[k] == 0]
    for b in (b for k, b in enumerate(bins) if b and free[k]):
        left, rest = sum(p[2] for p in b), list(b)
        while left:
            want, seq = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                doc, start, size, own = rest.pop()
                part = min(size, want)
                seq.append((doc, start, part, own))
                want -= part
                if part < size:
                    rest.append((doc, start + part, size - part, own))
            out.append(seq)
    return out


def pack_group(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """Sequences of pieces that hold every token once."""
    whole = [[(i, k * capacity, capacity, -1)] for i, n in enumerate(lengths) for k in range(n // capacity)]
    rests = [(i, n - n % capacity, n % capacity) for i, n in enumerate(lengths) if n % capacity]
    return whole + fill_holes([[(*rests[i], k) for i in b] for k, b in enumerate(first_fit_decreasing([r[2] for r in rests], capacity))], capacity)


def pack_documents(df: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, first_fit_bin (where
    first-fit decreasing placed the piece's rest; null for a sequence that one document fills).

    Each document is its ids, then end_id. A null text is empty (one piece of end_id); a null key stays null; rows of
    one key are documents of their own, in order of their texts; an empty table gives an empty result; other columns
    are ignored. The capacity is a power of two.
    """
    groups = max(1, -(-text_size(df, text) // GROUP_BYTES))

    def pack(blobs: pa.Table) -> pa.Table:
        docs, grp = unpacked(blobs, key, text), blobs.column("grp")[0].as_py()
        keys = docs.column(key).combine_chunks().cast(pa.int64())
        ids = [np.append(x, np.uint32(end_id)) for x in encoder(vocabulary).encode([t or "" for t in docs.column(text).to_pylist()])]
        rows = []
        for s, seq in enumerate(pack_group([len(x) for x in ids], capacity)):
            offset = 0
            for i, start, size, own in seq:
                rows.append((i, start, size, ids[i][start : start + size].astype("<u4").tobytes(), len(ids[i]), (grp << 32) + s, offset, None if own < 0 else (grp << 32) + own))
                offset += size
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        ints = [pa.array(cols[i], pa.int64()) for i in (1, 2, 4, 5, 6, 7)]
        return pa.table([keys.take(pa.array(cols[0], pa.int64())), ints[0], ints[1], pa.array(cols[3], pa.binary()), *ints[2:]], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "first_fit_bin"])

    return packed(df.select(key, text), key, text, by_hash(groups)).groupBy("grp").applyInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, first_fit_bin long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "first_fit_bin")
