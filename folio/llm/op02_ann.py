"""Operator 2, approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the residuals' codebooks are fitted on the driver to a bounded sample and travel with the tasks; every
vector is assigned to its cell and coded in the scan. Neighbouring cells make a block of a few thousand vectors. A query goes,
with the list of cells that it visits there, to the blocks of its nearest cells. A block ranks the codes in these cells by the
query's distance table, reranks the best by exact distances on the original vectors, and all that the codes' errors don't rule
out after that, and answers with its nearest few; a query's answers are merged by rank.

No neighbour is missed, however vectors and queries lie: a query's distance to its (k + 1)-th nearest of the sample is no less than
that to its k-th nearest of all, so a cell that lies further off than it, behind the plane between its centroid and a nearer one,
holds no neighbour. Cells that are visited are few where vectors cluster, and nearly all where they don't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut_lineage, quoted, table
from folio.llm.grams import mix

CELLS, SAMPLE = 16_384, 16_384  # cells at most (else 4 times the square root of the rows), and vectors that they are fitted to: so many, or 16 a cell
PARTS, CODES = 16, 64  # parts of a residual, and centroids of each
BLOCK, ASKED = 1024, 50_000  # vectors of a block, about, and queries that meet it at once
RERANK = 400  # codes reranked first in a block, the nearest by their table; what their errors don't rule out then follows
KNOWN, PLANES = 1 << 22, 8  # numbers of the sample that each query is held against, and near cells whose planes rule out others
ERROR = 1e-12  # of a squared distance by products, of the squares that go into it


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, some rows at a time."""
    step = max(1, 4_000_000 // len(c))
    return np.concatenate([_distances(x[k : k + step], c).argmin(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        own = np.bincount(near, minlength=len(c))
        full = np.flatnonzero(own)
        c[full] = np.add.reduceat(x[order], (np.cumsum(own) - own)[full], axis=0) / own[full, None]
    return c


@dataclass
class Index:
    cells: np.ndarray  # (cells, dims)
    books: np.ndarray  # (parts, codes, dims / parts)
    weight: np.ndarray  # share of the sample in each cell
    block: np.ndarray  # the block of each cell
    known: np.ndarray  # rows of the table, of the sample
    k: int  # neighbours
    share: float  # of the sample, in the cells that a vector of the sample visits, on average

    @staticmethod
    def fit(x: np.ndarray, rows: int, k: int = 10, seed: int = 11) -> Index:
        rng = np.random.default_rng(seed)
        once = np.unique(x, axis=0)
        cells = _kmeans(once, max(1, min(CELLS, int(4 * math.sqrt(rows)), len(once) // 16)), 6, rng)
        near = _nearest(once, cells)
        rest = Index._parts(once - cells[near])
        books = np.stack([_kmeans(rest[:, p], CODES, 6, rng) for p in range(PARTS)])
        tops = _kmeans(cells, max(1, -(-rows // BLOCK)), 4, rng)
        weight = np.bincount(_nearest(x, cells), minlength=len(cells)) / len(x)
        index = Index(cells, books, weight, _nearest(cells, tops), x[: max(k + 1, min(SAMPLE, KNOWN // x.shape[1]))], k, 1.0)
        index.share = float(np.mean([weight[seen].sum() for seen in index.visits(once[rng.choice(len(once), min(256, len(once)), replace=False)])[0]]))
        return index

    @staticmethod
    def _parts(rest: np.ndarray) -> np.ndarray:
        wide = -(-rest.shape[1] // PARTS) * PARTS
        return np.pad(rest, ((0, 0), (0, wide - rest.shape[1]))).reshape(len(rest), PARTS, wide // PARTS)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its codes."""
        near = _nearest(x, self.cells)
        rest = self._parts(x - self.cells[near])
        return near, np.stack([_nearest(rest[:, p], self.books[p]) for p in range(PARTS)], 1).astype(np.uint8)

    def constants(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the distance from any query has of a coded vector alone: twice centroid times residual, and the residual's square."""
        rest = np.stack([self.books[p][codes[:, p]] for p in range(PARTS)], 1)
        return (rest * (2 * self._parts(self.cells[cell]) + rest)).sum((1, 2))

    def errors(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each vector lies from what its cell and codes say."""
        rest = np.stack([self.books[p][codes[:, p]] for p in range(PARTS)], 1)
        return np.sqrt(((self._parts(x - self.cells[cell]) - rest) ** 2).sum((1, 2)))

    def table(self, q: np.ndarray) -> np.ndarray:
        """Twice the query times every codebook entry: (parts, codes)."""
        return 2 * np.einsum("pcd,pd->pc", self.books, self._parts(q[None])[0])

    def visits(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the cells that may hold one of its k + 1 nearest rows, and a distance within which so many lie."""
        seen, within = [], []
        own, norms = (self.known * self.known).sum(1), (self.cells * self.cells).sum(1)
        for at, one in enumerate(q):
            if at % 16 == 0 and len(self.known) > self.k:  # distances by products, with their error: never less than they are
                some = q[at : at + 16]
                far = _distances(some, self.known) + ERROR * ((some * some).sum(1)[:, None] + own)
                nears = np.maximum(np.partition(far, self.k, 1)[:, self.k], 0)
            near = nears[at % 16] if len(self.known) > self.k else np.inf
            d = ((self.cells - one) ** 2).sum(1)
            planes = np.argpartition(d, PLANES)[:PLANES] if len(d) > PLANES else np.arange(len(d))
            squares = norms[:, None] + norms[planes]
            apart = np.sqrt(np.maximum(squares - 2 * self.cells @ self.cells[planes].T, 0) + ERROR * squares)
            slack = ERROR * (4 * (one @ one) + 4 * near + squares)
            off = np.divide(d[:, None] - d[planes] - slack, 2 * apart, out=np.zeros_like(apart), where=apart > 0).max(1)
            seen.append(np.flatnonzero(~(np.maximum(off, 0) ** 2 > near * (1 + 1e-9))))
            within.append(np.sqrt(near))
        return seen, np.array(within)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components, and not zero."""
    v, key = F.col(quoted([vector])[0]).cast("array<double>"), F.col(quoted([key])[0])
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(fine & key.isNotNull()).select(key.cast("long").alias("id"), v.alias("v"))


def _by_length(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = np.asarray(b.column(column).value_lengths())
    for n in np.unique(size).tolist():
        yield n, b.filter(pa.array(size == n))


def _kept(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows without those of equal vectors beyond the `most` smallest ids: they can be no one's nearest."""
    order = np.lexsort((ids, *x.T[:2]))  # equal vectors side by side, but for chance neighbours, which the next line parts
    new = np.ones(len(ids), bool)
    new[1:] = (x[order][1:] != x[order][:-1]).any(1)
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return np.sort(order[place < most])


def nearest(df: DataFrame, queries: str = "id % 100 = 0", k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by Euclidean distance, ties to the smaller id.

    `queries` is a condition on id. Candidates are all rows but the query's own; rows of one id are vectors and queries of their
    own. Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a null id. Vectors
    of different lengths are not compared: the commonest length has the index, others are searched whole, in blocks. A table
    with few vectors has one cell and is searched whole; an empty one gives an empty result; other columns are ignored.
    """
    good = sound(df, key, vector)
    sizes = {r["n"]: r["count"] for r in good.groupBy(F.size("v").alias("n")).count().collect()}
    if not sizes:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = max(sizes, key=lambda n: (sizes[n], -n))
    rows = sizes[dims]
    sample = good.where(F.size("v") == dims).orderBy(F.xxhash64("id", "v"), "id").limit(max(SAMPLE, 16 * min(CELLS, int(4 * math.sqrt(rows))))).select("v").toArrow()
    index = Index.fit(_matrix(sample.column(0).combine_chunks()), rows, k)
    shares = np.bincount(index.block, index.weight)
    salts = {b: max(1, math.ceil(rows * s / (2 * BLOCK))) for b, s in enumerate(shares.tolist())} | {-n: -(-c // BLOCK) for n, c in sizes.items() if n != dims}
    whole = dict(enumerate(np.bincount(index.block).tolist()))  # cells of each block
    # queries, once for each vector and id; they are few, and what they are numbered by must stay
    asked = good.where(queries).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("uid", F.monotonically_increasing_id())
    asked = cut_lineage(asked.select("uid", F.col("id").alias("query_id"), "n", F.col("v").alias("q")))
    parts = max(1, -(-asked.count() // ASKED))

    def assign(batches):
        for b in batches:
            for n, own in _by_length(b, 1) if b.num_rows else ():
                ids, x = own.column(0).to_numpy(), _matrix(own.column(1))
                some = _kept(ids, x, k + 1)
                own, ids, x = own.take(pa.array(some)), ids[some], x[some]
                cell, codes = index.assign(x) if n == dims else (np.full(len(ids), -1), np.zeros((len(ids), PARTS), np.uint8))
                block = index.block[cell] if n == dims else np.full(len(ids), -n)
                salt = (mix(ids.astype(np.uint64)) % np.array([salts[i] for i in block.tolist()], np.uint64)).astype(np.int32)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), len(ids), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                for part in range(parts):
                    cols = [own.column(0), own.column(1), pa.array(cell, pa.int32()), codes, pa.array(block, pa.int32()), pa.array(salt), pa.array(np.full(len(ids), part, np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "v", "cell", "codes", "block", "salt", "part"])

    def visit(batches):
        for b in batches:
            for n, own in _by_length(b, 3) if b.num_rows else ():
                at, block, cells = [], [], []
                visited, within = index.visits(_matrix(own.column(3))) if n == dims else ([np.full(1, -1)] * own.num_rows, np.full(own.num_rows, np.inf))
                for i, seen in enumerate(visited):
                    of = index.block[seen] if n == dims else np.full(1, -n)
                    for one in np.unique(of).tolist():
                        mine = seen[of == one]
                        mine = None if len(mine) == whole.get(one) else mine.tolist()  # None: all of the block
                        for salt in range(salts[one]):
                            at.append(i)
                            block.append((one, salt))
                            cells.append(mine)
                if at:
                    sent = own.take(pa.array(at))
                    part = sent.column(0).to_numpy() % parts
                    cols = [pa.array([x[0] for x in block], pa.int32()), pa.array([x[1] for x in block], pa.int32()), pa.array(part, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(within[at])]
                    yield pa.RecordBatch.from_arrays([*sent.columns, *cols], ["uid", "query_id", "n", "q", "block", "salt", "part", "cells", "within"])

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        place, best_id, best = [], [], []
        if held.num_rows and asked.num_rows:
            ids, x, cell = held.column("id").to_numpy(), _matrix(held.column("v").combine_chunks()), held.column("cell").to_numpy()
            indexed = cell[0] >= 0
            if indexed:
                codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(ids), PARTS)
                fixed, error = index.constants(cell, codes), index.errors(x, cell, codes)
                at_home = np.unique(cell)
            q_ids, q, cells, within = asked.column("query_id").to_numpy(), _matrix(asked.column("q").combine_chunks()), asked.column("cells").to_pylist(), asked.column("within").to_numpy()
            for i in range(len(q_ids)):
                some = np.arange(len(ids))
                if indexed:
                    mine = at_home if cells[i] is None else np.array(cells[i])
                    far = np.full(len(index.cells), np.inf)
                    far[mine] = ((index.cells[mine] - q[i]) ** 2).sum(1)
                    some = np.flatnonzero(np.isfinite(far[cell])) if cells[i] is not None else some
                    if len(some) > RERANK:
                        of_query, c = index.table(q[i]), codes[some]
                        rough = far[cell[some]] + fixed[some] - sum(of_query[p][c[:, p]] for p in range(PARTS))
                        best_codes = some[np.argpartition(rough, RERANK - 1)[:RERANK]]
                        limit = np.sqrt(np.partition(((x[best_codes] - q[i]) ** 2).sum(1), k)[k]) if k < RERANK else np.inf
                        limit = min(limit, within[i]) * (1 + 1e-9)
                        # a vector is no nearer than its code less the code's error; what that leaves is compared exactly
                        slack = ERROR * (4 * (q[i] @ q[i]) + 4 * limit * limit + 4 * error[some] ** 2 + 4 * far[cell[some]])
                        some = some[~(np.sqrt(np.maximum(rough - slack, 0)) - error[some] * (1 + 1e-9) > limit)]
                exact = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
                near = np.lexsort((ids[some], exact))[: k + 1]
                place += [i] * len(near)
                best_id.append(ids[some][near])
                best.append(exact[near])
        of = asked.select(["uid", "query_id", "n"]).take(pa.array(place, pa.int64()))
        every = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return of.append_column("vec_id", every(best_id, pa.int64())).append_column("score", every(best, pa.float64()))

    by = ("block", "salt", "part")
    held = good.mapInArrow(assign, "id long, v array<double>, cell int, codes binary, block int, salt int, part int")
    sent = asked.mapInArrow(visit, "uid long, query_id long, n long, q array<double>, block int, salt int, part int, cells array<int>, within double")
    met = held.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(search, "uid long, query_id long, n long, vec_id long, score double")
    # the query's own row is one of its id at distance 0, if it is among the k + 1 nearest at all
    place = F.row_number().over(Window.partitionBy("uid").orderBy("score", "vec_id"))
    ranked = met.withColumn("place", place).where(F.col("place") <= k + 1)
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.col("place"))).over(Window.partitionBy("uid"))
    ranked = ranked.withColumn("own", F.coalesce(own, F.lit(k + 2))).where("place <> own")
    ranked = ranked.withColumn("rank", F.col("place") - (F.col("place") > F.col("own")).cast("int")).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
