"""Operator 10, quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector. Learned filters slide over the bytes, one by one, of overlapping chunks that cover the whole
document; each filter's largest response in a chunk is kept, and the means and the maxima over the chunks are combined into
one probability. The network is trained in one task from a bounded sample of labelled rows, read whole, and sent to the scan;
the driver sees the network alone, and nothing is shuffled for scoring.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import ddl, fresh, numbered, quoted, spread, table, text_bytes

CHUNK, STEP = 512, 480  # bytes; neighbours overlap by more than a filter's width, so no filter misses a seam
WIDTH, DEPTH, FILTERS = 8, 8, 32
TRAIN_DOCS, TRAIN_BYTES, EPOCHS = 2000, 64 << 20, 8  # the sample's bounds: documents, and bytes of all their texts
WINDOWS = CHUNK - WIDTH + 1
_AT_ONCE, _GRADIENT_AT_ONCE = 64, 4096  # chunks whose windows lie in memory together, some 8 MB; and whose bytes are summed together, some 16 MB


@dataclass
class Network:
    vectors: np.ndarray  # (256, DEPTH), of bytes; 0, the padding, has none
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    weights: np.ndarray  # (2 * FILTERS + 1,): means, maxima, bias

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A probability for each document between bounds; an empty one has the bias alone."""
        doc, start = chunks(bounds)
        pooled = np.concatenate([self.pool(take(data, bounds, doc[k : k + _AT_ONCE], start[k : k + _AT_ONCE]))[0] for k in range(0, len(doc), _AT_ONCE)])
        return 1 / (1 + np.exp(-self.logits(pooled, doc, len(bounds) - 1)[0]))

    def pool(self, part: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk, 0 at least; and where it is."""
        e = np.ascontiguousarray(self.vectors[part].reshape(len(part), CHUNK * DEPTH))
        s = e.strides
        w = np.lib.stride_tricks.as_strided(e, (len(part), WINDOWS, WIDTH * DEPTH), (s[0], DEPTH * s[1], s[1]))
        r = (self.filters.T @ w.reshape(-1, WIDTH * DEPTH).T).reshape(FILTERS, len(part), WINDOWS)  # the windows side by side, as they are searched
        return np.maximum(r.max(2).T, 0), r.argmax(2).T if places else None

    def logits(self, pooled: np.ndarray, doc: np.ndarray, n: int):
        first = np.searchsorted(doc, np.arange(n))
        count = np.bincount(doc, minlength=n)[:, None]
        mean = np.add.reduceat(pooled.astype(np.float64), first, axis=0) / count
        most = np.maximum.reduceat(pooled, first, axis=0)
        return mean @ self.weights[:FILTERS] + most @ self.weights[FILTERS:-1] + self.weights[-1], mean, most, count


    def gradient(self, seen: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the vectors and of the filters: seen, the bytes (chunks, FILTERS, WIDTH) of the largest responses, and back, the loss's
        gradient by these. What goes back to a filter's place is first summed by byte, so no chunk has its bytes' vectors in memory."""
        by_byte = np.zeros(WIDTH * 256 * FILTERS)
        place = np.arange(WIDTH) * (256 * FILTERS) + np.arange(FILTERS)[:, None]
        for k in range(0, len(seen), _GRADIENT_AT_ONCE):
            at = seen[k : k + _GRADIENT_AT_ONCE].astype(np.int64) * FILTERS + place
            by_byte += np.bincount(at.ravel(), np.repeat(back[k : k + _GRADIENT_AT_ONCE].ravel(), WIDTH), len(by_byte))
        by_byte = by_byte.reshape(WIDTH, 256, FILTERS)
        filters = self.filters.reshape(WIDTH, DEPTH, FILTERS)
        return np.einsum("wbf,wdf->bd", by_byte, filters, optimize=True), np.einsum("wbf,bd->wdf", by_byte, self.vectors, optimize=True).reshape(WIDTH * DEPTH, FILTERS)


def chunks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start in data) of the chunks that cover each document; an empty one has one chunk of padding."""
    size = np.diff(bounds)
    count = 1 + np.maximum(0, -(-(size - CHUNK) // STEP))
    doc = np.repeat(np.arange(len(size)), count)
    return doc, bounds[:-1][doc] + STEP * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))


def take(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(CHUNK)
    inside = at < bounds[1:][doc][:, None]
    out = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(inside, out, np.uint8(0))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss over whole texts; the gradient goes, through each filter's largest response in each chunk, to the
    filter and to the vectors of the bytes there."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32), rng.normal(0, 0.2, (WIDTH * DEPTH, FILTERS)).astype(np.float32), np.zeros(2 * FILTERS + 1))
    net.vectors[0] = 0
    if not len(labels) or labels.min() == labels.max():
        p = (labels.sum() + 1) / (len(labels) + 2)
        net.weights[-1] = np.log(p / (1 - p))
        return net
    net.weights[-1] = np.log(labels.mean() / (1 - labels.mean()))
    net.weights[:-1] = rng.normal(0, 0.05, 2 * FILTERS)
    # a short excerpt of each longer text learns along, as most labelled texts are long and short ones are to be scored, too
    cuts = [(rng.integers(0, len(t) - 300), rng.integers(40, 300)) if len(t) > 400 else None for t in texts]
    texts = [*texts, *[t[c[0] : c[0] + c[1]] for t, c in zip(texts, cuts, strict=True) if c]]
    labels = np.concatenate([labels, labels[[i for i, c in enumerate(cuts) if c]]])
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    of, start = chunks(bounds)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    params = [net.vectors, net.filters, net.weights]
    m, v = ([np.zeros(x.shape) for x in params] for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), 32):
            some = np.sort(order[k : k + 32])
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
            doc = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
            pooled, seen = [], []  # responses, and the bytes that gave them
            for j in range(0, len(rows), _AT_ONCE):
                own = rows[j : j + _AT_ONCE]
                part = take(data, bounds, of[own], start[own])
                value, at = net.pool(part, True)
                pooled.append(value)
                seen.append(part[np.arange(len(own))[:, None, None], at[:, :, None] + np.arange(WIDTH)])
            pooled, seen = np.concatenate(pooled), np.concatenate(seen)
            z, mean, most, count = net.logits(pooled, doc, len(some))
            d = (1 / (1 + np.exp(-z)) - labels[some]) / len(some)
            top = pooled == most[doc]
            back = (d[doc, None] * (net.weights[:FILTERS] / count[doc] + net.weights[FILTERS:-1] * top) * (pooled > 0)).astype(np.float32)
            to_vectors, to_filters = net.gradient(seen, back)
            to_vectors[0] = 0
            to_weights = np.concatenate([mean.T @ d, most.T @ d, [d.sum()]]) + 1e-4 * net.weights
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS) + 0.001
            for j, g in enumerate((to_vectors, to_filters, to_weights)):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                params[j] -= (rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)).astype(params[j].dtype)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, label, text) of at most `most` labelled documents that aren't held out, by a hash of the key, and of those, in this order, as
    many as have `most_bytes` of text together, whole texts each: TopK over the small table, then joins with that bounded side. A
    key with several labels has the least; a key with several rows is one document, its least text."""
    key, text, label = quoted([key, text, label])
    learn = labels.where(f"{label} IS NOT NULL AND {key} IS NOT NULL").where(~held_out(F.col(key)))
    ids = learn.groupBy(F.col(key).alias("id__")).agg(F.min(label).alias("label__")).orderBy(F.xxhash64("id__"), "id__").limit(most)
    docs = docs.select(F.col(key).alias("id__"), F.coalesce(F.col(text), F.lit("")).alias("text__"))
    found = docs.join(F.broadcast(ids), "id__").groupBy("id__", "label__")
    sizes = found.agg(F.octet_length(F.min("text__")).alias("size__")).orderBy(F.xxhash64("id__"), "id__").collect()
    total, chosen = 0, []
    for r in sizes:
        if total + r["size__"] <= most_bytes:
            total += r["size__"]
            chosen.append((r["id__"], float(r["label__"])))
    chosen = docs.sparkSession.createDataFrame(chosen, f"id__ {dict(ids.dtypes)['id__']}, label double")
    return docs.join(F.broadcast(chosen), "id__").groupBy("id__", "label").agg(F.min("text__").alias("text")).select(F.col("id__").alias("id"), "label", "text")


def trained(docs: DataFrame, labels: DataFrame) -> Network:
    """The network of the sample of labelled documents, trained in one task; without labels that of no texts."""

    def fit(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[2].encode() for r in rows], np.array([r[1] for r in rows])))], pa.binary())], ["net"])

    got = labelled_sample(docs, labels).coalesce(1).mapInArrow(fit, "net binary").first()
    return train([], np.zeros(0)) if got is None else pickle.loads(got["net"])


def held_out(key) -> F.Column:
    """Whether a row is kept from training; one without a key has no label to learn and isn't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(df: DataFrame, net: Network, text: str = "text", column: str = "score") -> DataFrame:
    """df with the probability that a text's label is 1 behind its columns. A null or empty text is one empty chunk and has
    a score, too; equal texts have equal scores to 6 places; an empty table gives an empty result. If df has a column of the
    new one's name already, underscores are appended to the new one's."""
    names = [*df.columns, fresh(df, column)]
    df, (text,) = numbered(df, text)
    where = df.columns.index(text)

    def score(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                data, bounds = text_bytes(part.column(where))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(net.scores(data, bounds), 6), pa.float64())], [*part.schema.names, "score"])

    return spread(df).mapInArrow(score, f"{ddl(df)}, score double").toDF(*names)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
