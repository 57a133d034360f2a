import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import folio.llm.repeats as R
from folio.llm.common import Deal
from folio.llm.op01_substring_dedup import op1_substring_dedup, remove_repeated_passages
from folio.llm.op05_line_dedup import op5_line_dedup, remove_repeated_lines
from folio.llm import op06_simhash as S
from folio.llm.op06_simhash import Segments, long_links, most_bits, near_duplicates, op6_simhash, similar_documents
from folio.llm.op08_suffix_dedup import op8_suffix_dedup, remove_repeated_bytes


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture
def many_groups(monkeypatch):
    monkeypatch.setattr(R, "GROUP_BYTES", 40_000)


def odd_rows():
    """Nulls, empty and long texts, repeats at seams, copies and texts of many languages."""
    random.seed(4)
    part = " ".join(random.choice(["alpha", "béta", "gamma", "δ", "x"]) for _ in range(40))
    texts = [None, "", " \n\t ", part, part, "start " + part + " end", part + "\n" + part, "ab" * 300, "ab" * 300 + "c", "x " * 3000, part[:99], part[:100], "\n".join(["one line", "two line", "", "three line"] * 3), "one line\ntwo line\nthree line", "é" * 50, "é" * 51]
    return [(i * 7 - 20, t) for i, t in enumerate(texts)]


def test_passages(spark, sf, docs, many_groups):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op1_substring_dedup(spark, sf).collect()}
    assert got == brute.passages(docs)


def test_passages_of_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, grp int")
    got = remove_repeated_passages(df)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept"].encode())) for r in got.collect()} == brute.passages(rows)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_bytes(spark, sf, docs, many_groups):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op8_suffix_dedup(spark, sf).collect()}
    assert got == brute.repeated_bytes(docs)


def test_bytes_of_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, blob binary")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), brute.sha(r["kept"])) for r in remove_repeated_bytes(df).collect()} == brute.repeated_bytes(rows)


def test_lines(spark, sf, docs, many_groups):
    got = remove_repeated_lines(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r["doc_id"]: [x for x in r["text"].split("\n") if x] for r in got} == brute.repeated_lines(docs)
    assert {r["doc_id"]: r["n_removed"] for r in op5_line_dedup(spark, sf).collect()} == {r["doc_id"]: r["n_lines_removed__"] for r in got}


def test_lines_of_odd_rows_keep_other_columns(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, i * 2) for i, t in rows], "doc_id long, text string, `bucket` long")
    got = remove_repeated_lines(df).collect()
    assert {r["doc_id"]: [x for x in (r["text"] or "").split("\n") if x] for r in got} == brute.repeated_lines(rows)
    before = dict(rows)
    assert all(r["text"] == before[r["doc_id"]] for r in got if r["n_lines_removed__"] == 0)
    assert all(r["bucket"] == 2 * r["doc_id"] for r in got)


def test_null_and_repeated_keys(spark):
    part = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, part), (5, part), (5, part)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in remove_repeated_passages(df).collect()) == [(-1, 0), (5, 30), (5, 30)]
    df = df.where("doc_id = 5")
    assert sorted(r["n_removed"] for r in remove_repeated_passages(df).collect()) == [0, 0]
    assert sorted(r["n_removed"] for r in remove_repeated_bytes(df).collect()) == [0, len(part)]


def test_rows_of_one_key_all_lose_what_a_smaller_key_holds(spark):
    part = " ".join(f"w{i}" for i in range(20))
    rows = [(1, part), (5, f"x {part} y"), (5, f"x {part} y"), (5, f"x {part} y"), (7, f"x {part} y")]
    got = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in got) == [(1, 0, part), (5, 20, "x y"), (5, 20, "x y"), (5, 20, "x y"), (7, 22, "")]


def alternating(n):
    """0 or 1 by the parity of bits: whatever the odd base, the polynomial modulo 2**64 of n >= 2,048 such signs is that of their opposites."""
    return [i.bit_count() % 2 for i in range(n)]


def test_names_that_collide_decide_nothing(spark):
    """Texts of one polynomial name, or whose windows have one, without anything in common."""
    signs = alternating(2048)
    words = [" ".join(("ab"[s ^ k]) + "x" * (j % 3) for j, s in enumerate(signs)) for k in (0, 1)]
    rows = [(k, w) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept"].encode())) for r in remove_repeated_passages(df).collect()} == brute.passages(rows)
    rows = [(k, "".join("ab"[s ^ k] for s in alternating(4096))) for k in (0, 1)] + [(5, "f" * 40 + "".join("cd"[s] for s in alternating(1024)) + "g"), (6, "f" * 40 + "".join("dc"[s] for s in alternating(1024)) + "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), brute.sha(r["kept"])) for r in remove_repeated_bytes(df).collect()} == brute.repeated_bytes(rows)
    one, other = ("".join("ab"[s ^ k] for s in alternating(1024)) for k in (0, 1))
    rows = [(1, f"{one}\nsame\nend"), (2, f"{other}\nsame\nend"), (3, f"{one}\nsame\nend\nmore")]
    got = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: [x for x in r["text"].split("\n") if x] for r in got} == brute.repeated_lines(rows) == {1: [one, "same", "end"], 2: [other, "same", "end"], 3: ["more"]}


def test_windows_that_collide_across_groups(spark, monkeypatch):
    """Windows of 4,096 bytes of one name in documents of different groups."""
    monkeypatch.setattr(R, "GROUP_BYTES", 1000)
    rows = [(k, f"{k} " * 30 + "".join("ab"[s ^ k % 2] for s in alternating(4096)) + " tail" * k) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for depth in (100, 4096):
        got = remove_repeated_bytes(df, depth).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), brute.sha(r["kept"])) for r in got} == brute.repeated_bytes(rows, depth)


def test_groups_that_share_long_prefixes(spark, many_groups):
    """Strings that differ from one another at one byte only, at every depth of the digits, and periodic ones."""
    base = "".join(random.Random(2).choices("abcd", k=100))
    rows = [(i, f"<{i}>" + base[:i] + "#" + base[i + 1 :] + f"<{i}>" + base[:99] + str(i % 4)) for i in range(100)] + [(200, "ab" * 400), (201, "ba" * 300 + "c"), (202, "a" * 99), (203, "a" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), brute.sha(r["kept"])) for r in remove_repeated_bytes(df).collect()} == brute.repeated_bytes(rows)


def test_long_lines_are_runs_of_their_own(spark, many_groups):
    line = lambda seed, n: " ".join(random.Random(seed).choices(["alpha", "beta", "gamma", "delta"], k=n))
    rows = [(1, line(1, 60) + "\nshort"), (2, "other\n" + line(1, 60)), (3, line(2, 30) + "\n" + line(3, 30)), (4, "x\n" + line(2, 30) + "\n" + line(3, 30) + "\ny"), (5, line(2, 30) + "\nz"), (6, line(2, 30) + "\nz"), (7, line(2, 30)), (8, "a b\nc"), (9, "a b\nc"), (10, line(2, 24) + "\nz"), (11, line(2, 24) + "\nz")]
    got = {r["doc_id"]: [x for x in r["text"].split("\n") if x] for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeated_lines(rows)
    assert got[2] == ["other"] and got[4] == ["x", "y"] and got[6] == [] and got[7] == [line(2, 30)] and got[9] == ["a b", "c"] and len(got[11]) == 2


@pytest.mark.parametrize("same_key", [None, 5])
def test_a_key_of_most_rows_is_many_groups(spark, monkeypatch, same_key):
    """Null or repeated keys are dealt out, too, and lose what smaller keys hold, and among one another only where that counts."""
    monkeypatch.setattr(R, "GROUP_BYTES", 4000)
    word = random.Random(1)
    part = " ".join(word.choices("abcdefg", k=40))
    texts = [f"{i} {' '.join(word.choices('abcdefg', k=30))} {part} {i}" for i in range(300)]
    rows = [(same_key, t) for t in texts[:200]] + [(10 + i, t) for i, t in enumerate(texts[200:])] + ([(1, part)] if same_key else [])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    deal, _ = R.Deal.of(df, "doc_id", "text", R.GROUP_BYTES)
    assert deal.parts.max() > 5
    got = remove_repeated_passages(df).collect()
    of_key = [r["n_removed"] for r in got if r["doc_id"] == same_key]
    assert len(of_key) == 200 and all((n >= 40) == (same_key is not None) for n in of_key)
    assert all(r["n_removed"] >= 40 for r in got if r["doc_id"] is not None and r["doc_id"] >= 10)
    kept = [r["kept"].decode() for r in remove_repeated_bytes(df, 60).collect()]
    assert len(kept) == len(rows) and sum(part in k for k in kept) == 1


def test_line_counts_go_to_a_name_of_their_own(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 7), (2, "a\nb\nc", 8)], "doc_id long, text string, `n_lines_removed__` int").withColumnRenamed("n_lines_removed__", "N_lines_removed__")
    got = remove_repeated_lines(df.withColumn("a.b", F.lit(1))).orderBy("doc_id").collect()
    assert [r.asDict() for r in got] == [{"doc_id": 1, "text": "a\nb\nc", "N_lines_removed__": 7, "a.b": 1, "n_lines_removed___": 0}, {"doc_id": 2, "text": "", "N_lines_removed__": 8, "a.b": 1, "n_lines_removed___": 3}]


@pytest.mark.parametrize("f", [remove_repeated_passages, remove_repeated_bytes, remove_repeated_lines, near_duplicates, similar_documents])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_simhash(spark, sf, docs):
    prints = {i: brute.fingerprint(t) for i, t in docs}
    own = brute.components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op6_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", own[i]) for i, p in prints.items()}


def test_simhash_of_odd_rows(spark):
    rows = odd_rows() + [(500, "ONE two"), (501, "one TWO"), (None, "one two")]
    prints = {i: brute.fingerprint(t) for i, t in rows if i is not None}
    own = brute.components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == own
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [500]


def test_long_links_connect_as_all_pairs_do(spark):
    random.seed(5)
    rows = []
    for g in range(4):
        base = [random.getrandbits(64) for _ in range(3)]
        for _ in range(30):
            f = list(base)
            for b in random.sample(range(192), random.randint(0, 14)):
                f[b // 64] ^= 1 << b % 64
            rows.append([x - (1 << 64) if x >> 63 else x for x in f])
    rows = [(i, *f) for i, f in enumerate(rows)]
    bits = most_bits(0.8)
    got = long_links(spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long"), Segments.of(120), bits).collect()
    far = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(rows[a][1:], rows[b][1:], strict=True))
    pairs = {(r["u"], r["v"]) for r in got}
    assert brute.components(range(120), lambda a, b: (a, b) in pairs) == brute.components(range(120), lambda a, b: far(a, b) <= bits)


def test_similar_documents_catch_near_copies_and_leave_others(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    rows, want = [], {}
    for i in range(40):
        w = [word() for _ in range(200)]
        near = list(w)
        near[100] = "changed"
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(w[:60] + [word() for _ in range(140)]))]
        want |= {3 * i: 3 * i, 3 * i + 1: 3 * i, 3 * i + 2: 3 * i + 2}
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("f0", F.lit(1))).collect()}
    assert got == want


def jaccard_groups(texts, least=0.8):
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for w in (t.split() for t in texts)]
    return brute.components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)


@pytest.mark.parametrize("chunk", [512, 8])
def test_similar_documents_verify_the_similarity(spark, monkeypatch, chunk):
    """Pairs on both sides of 0.8, alone and in a group of many, in one block or in several: what is linked is what the sets of shingles say."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    texts = []
    for changes in [4, 5, 6, 7, 8, 9, 10, 12] * 6:
        w = [word() for _ in range(200)]
        near = list(w)
        for p in range(changes):  # each changes five shingles of 196
            near[10 + 15 * p] = word()
        texts += [" ".join(w), " ".join(near)]
    base = [word() for _ in range(200)]
    for _ in range(100):
        w = list(base)
        for p in random.sample(range(5, 195), random.randint(1, 9)):
            w[p] = word()
        texts.append(" ".join(w))
    want = jaccard_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not {(a, b) for a, b in got.items() if want[a] == a != b}  # nothing goes that is not similar
    assert got == want


def test_recall_at_the_threshold(spark):
    """Of pairs at a similarity just at or above 0.8, texts short and long, at least 0.9 are found, and no pair below."""
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijkl", k=5))
    texts = []
    for k in range(400):
        n = [30, 60, 200, 600][k % 4]
        w = [word() for _ in range(n)]
        near, changes = list(w), max(1, round(0.0222 * (n - 4)))
        for p in range(changes):
            near[int((p + 0.5) * n / changes)] = word()
        texts += [" ".join(w), " ".join(near)]
    want = jaccard_groups_of_pairs(texts)
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [got[i + 1] == i for i in want]
    assert len(want) > 150 and sum(found) >= 0.9 * len(want)
    assert all(got[i + 1] == i + 1 for i in range(0, len(texts), 2) if i not in want)


def jaccard_groups_of_pairs(texts):
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    return {i for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8}


def test_segments_grow_with_the_corpus():
    few, many = Segments.of(10_000), Segments.of(10**9)
    assert few.bits == 16 and many.bits > 22 and many.count > few.count and many.words <= len(S._SALT)
    assert 10**9 * (many.bits / 2 + 1) / 2**many.bits <= S.OCCUPIED


def test_similar_documents_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d E f"), (6, "x " * 50_000), (7, "x " * 60_000), (8, "one"), (9, "ONE")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, node int, f0 int, `x.y` int")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in similar_documents(df).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8)]


def dealt(kind, n=400_000):
    """Keys and lengths of texts (their own, or one for all)."""
    rng = np.random.default_rng(1)
    keys, size = np.arange(n), np.full(n, 16)
    if kind == "clustered":
        keys = (keys // 1000 << 32) + keys % 1000
    if kind == "exponential":
        keys = np.unique(np.exp(np.linspace(0, 43, n)).astype(np.int64))
    if kind == "long":
        size[n // 2 : n // 2 + n // 100] = 640
    if kind in ("one key", "identical"):
        keys = np.where(rng.random(n) < 0.34, n // 2, keys)
    if kind == "extremes":
        keys = np.where(keys % 2 == 0, 2**63 - 1 - keys, -(2**63) + keys)
    return keys, size[: len(keys)]


@pytest.mark.parametrize("kind", ["dense", "clustered", "exponential", "long", "one key", "identical", "extremes"])
def test_groups_stay_small_at_any_number(spark, kind):
    """The largest group holds twice the bytes asked for at most, from a hundred groups to a hundred thousand; what a hash deals, but for chance."""
    keys, size = dealt(kind)
    same = kind == "identical"
    texts = pa.array([("x" if same and k == len(keys) // 2 else f"{i:07d}").ljust(n, "y") for i, (k, n) in enumerate(zip(keys.tolist(), size.tolist(), strict=True))])
    df = spark.createDataFrame(pa.table({"k": keys, "t": texts}))
    total = int(size.sum()) + 64 * len(size)
    for groups in (100, 2047, 2048, 100_000):
        share = -(-total // groups)
        deal, bytes_ = Deal.of(df, "k", "t", share)
        got = np.concatenate([deal(keys[a : a + 50_000], texts[a : a + 50_000]) for a in range(0, len(keys), 50_000)])
        held = np.bincount(got, size + 64)
        most = 2 * max(share, size.max() + 64)
        if kind in ("one key", "identical"):  # dealt by a hash: at four rows a group chance counts
            most = max(most, share + 6 * (share * 80) ** 0.5)
        assert bytes_ == total and held.max() <= most
        if groups < 100_000 or not same:
            assert groups / 2 <= (held > 0).sum()
        # ascending by key: a smaller rank has smaller keys
        rank = deal.rank(got)
        by = np.argsort(keys, kind="stable")
        assert (np.diff(rank[by]) >= 0).all()
        one = keys[by][1:] == keys[by][:-1]
        assert (np.diff(rank[by])[one] == 0).all()


def test_groups_of_nothing_and_of_more_than_the_driver_tells_apart(spark):
    df = spark.createDataFrame(pa.table({"k": np.arange(20_000), "t": ["x" * 36] * 20_000}))
    deal, _ = Deal.of(df, "k", "t", 1000, ranges=16)  # 2,000 groups from 16 ranges
    held = np.bincount(deal(np.arange(20_000), pa.array(["x" * 36] * 20_000)), np.full(20_000, 100))
    assert (held > 0).sum() >= 1900 and held.max() <= 2000
    deal, size = Deal.of(df.where("false"), "k", "t", 1000)
    assert size == 0 and deal(np.arange(3), pa.array(["a", None, "c"])).tolist() == [0, 0, 0]
