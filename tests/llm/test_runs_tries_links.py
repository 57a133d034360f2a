import random
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import op12_prefix_trie as op12
from folio.llm import op13_embedding_dedup as op13
from folio.llm.op11_periodic_runs import collapsed_runs, op11_periodic_runs, runs
from folio.llm.op12_prefix_trie import op12_prefix_trie, prefix_trie
from folio.llm.op13_embedding_dedup import linked_vectors, op13_embedding_dedup

# 11: periodic runs


def test_runs_against_loops():
    random.seed(11)
    for _ in range(600):
        docs = []
        for _ in range(random.randint(1, 4)):
            d = random.choices(range(random.choice([1, 2, 2, 3, 4])), k=random.randint(0, 40))
            if random.random() < 0.5 and len(d) > 4:
                a, p = random.randrange(len(d)), random.randint(1, 8)
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(len(d))]
            docs.append(d + d[: random.randint(0, len(d))] if random.random() < 0.3 else d)
        codes, at = np.array(sum(docs, []), np.int64), np.r_[0, np.cumsum([len(d) for d in docs])]
        for exponent, least in ((4, 6), (2, 2), (3, 5)):
            want = [(i, *r) for i, d in enumerate(docs) for r in brute.periodic_runs(d, exponent, least)]
            assert [tuple(r) for r in runs(codes, at, exponent, least).tolist()] == want


def test_runs_whose_squares_first_stand_in_short_runs():
    """The first occurrence of a square may lie in a run that is too short; its long run is elsewhere, and begins with another rotation."""
    w = "x a b c a b c y b c a b c a b c a b c a b z".split()
    codes = np.unique(w, return_inverse=True)[1].astype(np.int64)
    assert [tuple(r) for r in runs(codes, np.array([0, len(w)])).tolist()] == [(0, *r) for r in brute.periodic_runs(w)] == [(0, 8, 13, 3)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_op11(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = brute.WORD.findall(r["text"] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute.periodic_runs(w)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else (None,) * 3
        lines = "".join("%d,%d,%d\n" % x for x in found)
        want[r["doc_id"]] = (len(found), *best, 1000 * best[1] // best[2] if found else None, brute.sha(lines.encode()), brute.sha(brute.without_runs(w, found).encode()))
    got = {r[0]: tuple(r)[1:] for r in op11_periodic_runs(spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == want


def test_runs_of_odd_rows(spark):
    long = "a b " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (5, "a " * 5), (None, "a\tb\n" * 4), (7, long), (7, long), (8, "é😀 " * 6), (9, "a b " * 6)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, runs int, collapsed int")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in collapsed_runs(df).collect()), key=repr)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (5, [], "a a a a a"), (None, [(0, 8, 2)], "a b"), (7, [(0, 60_000, 2)], "a b"), (7, [(0, 60_000, 2)], "a b"), (8, [(0, 6, 1)], "é😀"), (9, [(0, 6, 1)], "a b")]
    assert got == sorted(want, key=repr)
    assert collapsed_runs(df.where("false")).collect() == []
    other = df.select(F.col("doc_id").alias("a.b"), F.col("text").alias("c`d"))
    assert collapsed_runs(other, key="a.b", text="c`d").count() == len(rows)


# 12: prefixes of conversations


def nodes(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("small", [1 << 16, 30])
def test_op12(spark, sf, small, monkeypatch):
    """Whole within one task, and split by Spark turn by turn."""
    monkeypatch.setattr(op12, "SMALL", small)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(op12_prefix_trie(spark, sf)) == brute.trie(rows, True)


@pytest.mark.parametrize("small,rebuild", [(1 << 16, False), (6, False), (6, True)])
def test_tries_of_random_conversations(spark, small, rebuild, monkeypatch):
    monkeypatch.setattr(op12, "SMALL", small)
    random.seed(small + rebuild)
    rows = []
    for c in range(-20, 40):  # copies, prefixes of one another, ties, nulls, gaps
        for k in range(random.choice([0, 1, 2, 3, 6, 12])):
            rows.append((c, random.choice([k, k, None]), random.choice(["u", "u", None]), random.choice(["a", "a", "a", "é" * 3, "", None])))
    rows += [(100, 0, "u", "a")] * 3 + [(101, 0, "u", "a")] * 3 + [(None, 0, "u", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, name int").repartition(5)
    assert nodes(prefix_trie(df, rebuild)) == brute.trie(rows, rebuild)


def test_long_conversation_over_many_parts(spark, monkeypatch):
    """One conversation holds most rows: it is numbered over several parts, and its copies' tail is summed in blocks."""
    monkeypatch.setattr(op12, "SMALL", 100)
    rows = [(c, t, "u", f"{t % 7}" * (t % 5)) for c in (1, 2) for t in range(900)] + [(3, t, "u", f"{t % 7}" * (t % 5)) for t in range(3)] + [(4, 0, "v", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie(df)) == brute.trie(rows, False)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(df).collect() == prefix_trie(df, True).collect() == []


# 13: near copies of vectors


def links(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=repr)


def test_op13(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got = op13_embedding_dedup(spark, sf)
    assert links(got) == sorted(brute.linked(rows), key=repr)
    assert got.where("kept <> (vec_id = component_id)").count() == 0


def test_bounds_hold():
    """No pair at the threshold is ruled out, and few others are left."""
    rng = np.random.default_rng(13)
    for dims in (1, 3, 64, 700):
        x = rng.normal(size=(300, dims)) * 10.0 ** rng.integers(-150, 150, (300, 1))
        x[100:200] = x[:100] * (1 + rng.normal(size=(100, dims)) * 0.35)
        unit = x / np.abs(x).max(1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        true = unit @ unit.T
        i, j = op13.possible(*op13.quantised(x), slice(0, 300), slice(0, 300), 0.93)
        left = np.zeros((300, 300), bool)
        left[i, j] = True
        assert left[true >= 0.93].all()
        if dims == 64:
            assert left[true < 0.9].sum() == 0


@pytest.mark.parametrize("tile,side", [(2048, 1024), (16, 8), (64, 1024)])
def test_links_over_tiles(spark, tile, side, monkeypatch):
    monkeypatch.setattr(op13, "TILE", tile)
    monkeypatch.setattr(op13, "_SIDE", side)
    rng = np.random.default_rng(tile)
    rows, centres = [], rng.normal(size=(12, 8))
    for i in rng.permutation(260).tolist():
        v = centres[rng.integers(0, 12)] * rng.uniform(0.1, 9) + rng.normal(size=8) * 0.35
        rows.append((i, [None, 1, 1, 1, 2][i % 5], v.tolist() if i % 7 else centres[0].tolist()))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert links(linked_vectors(df)) == sorted(brute.linked(rows), key=repr)


def test_links_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (0, 1, [2.0, 0.0]), (2, 1, None), (3, 1, []), (4, 1, [0.0, 0.0]), (5, 1, [nan, 1.0]), (6, 1, [inf, 1.0]), (7, 1, [None, 1.0]), (8, 1, [1.0]), (9, 1, [1.0]),
            (None, 1, [1.0, 0.0]), (10, None, [1.0, 0.0]), (11, 2, [1.0, 0.0]), (12, 1, [1e-200, 0.0]), (13, 1, [-1.0, 0.0]), (14, 3, [0.93, (1 - 0.93**2) ** 0.5]), (15, 3, [1.0, 0.0])]
    df = spark.createDataFrame([(i, k, v, "x", 0) for i, k, v in rows], "vec_id long, label int, embedding array<double>, node string, n int")
    want = {(0, 3, 0), (1, 3, 0), (12, 3, 0), (8, 1, 8), (9, 1, 8), (None, 0, None)} | {(i, 0, i) for i in (2, 3, 4, 5, 6, 7, 10, 11, 13)}
    got = links(linked_vectors(df))
    assert len(got) == len(rows) and set(x for x in got if x[0] not in (14, 15)) == want
    assert linked_vectors(df.where("false")).collect() == []
    assert links(linked_vectors(df.where("vec_id = 4"))) == [(4, 0, 4)]


def test_links_of_thousands_of_copies(spark):
    """A group of near copies answers with a row a node, whatever its number of pairs."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((1500, 32)) + rng.normal(size=(1500, 32)) * 0.02, np.full((1500, 32), -1.0)])
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in linked_vectors(df).collect()}
    assert got == {i: (1499, 0 if i < 1500 else 1500) for i in range(3000)}
