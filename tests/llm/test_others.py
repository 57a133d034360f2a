import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import brute
import numpy as np
import pytest
import regex
from oracle import connect, same
from pyspark.sql import functions as F

from folio.llm.bpe import Encoder
from folio.llm.op02_ann import Index, nearest, op2_ann
from folio.llm.op03_pii import BASE, op3_pii, personal_data
from folio.llm.op04_media import op4_media, read_stream, read_transport_streams, to_transport_streams, write_stream
from folio.llm import op07_mixing as op07
from folio.llm.op07_mixing import mixed, topic
from folio.llm.op09_packing import first_fit_decreasing, op9_packing, pack_documents
from folio.llm import op10_quality as op10
from folio.llm.op10_quality import op10_quality, score_documents, train
from folio.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_agrees_with_sql(name, spark, sf):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], connect(sf))


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


# 2: nearest neighbours


def exact(rows, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        yield int(ids[q]), [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, hit, want = {}, 0, 0
    for r in op2_ann(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, near in exact(rows):
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda t: (t[1], t[0]))
        hit, want = hit + len({i for i, _ in near} & {i for i, _ in got[q]}), want + 10
        truth = dict(near)
        assert all(abs(truth.get(i, s) - s) < 1e-12 for i, s in got[q])
    assert hit >= 0.9 * want


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert [(r["query_id"], r["vec_id"]) for r in nearest(df, "id = 8").collect()] == []  # alone of its length
    assert nearest(df.where("false")).collect() == nearest(df.where("vec_id = 3")).collect() == []


def test_neighbours_among_thousands_of_copies(spark):
    rng = np.random.default_rng(3)
    one, x = rng.normal(size=16), rng.normal(size=(3000, 16))
    ids = rng.permutation(4500)
    rows = [(int(i), (one if k < 1500 else x[k - 1500]).tolist()) for k, i in enumerate(ids)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    copies, hit, want = set(ids[:1500].tolist()), 0, 0
    for q, near in exact(rows):
        if q in copies:  # all at distance 0: the ten smallest ids
            assert got[q] == [i for i, _ in near]
        else:
            hit, want = hit + len(set(got[q]) & {i for i, _ in near}), want + 10
    assert hit >= 0.9 * want


def test_neighbours_of_repeated_ids(spark):
    """Rows of one id are vectors and queries of their own; only the query's own row is no candidate."""
    rows = [(0, [5.0]), (0, [6.0]), (0, [6.0]), (1, [7.0]), (2, [8.0]), (3, [9.0]), (3, [9.0])]
    got = [tuple(r) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).select("query_id", "rank", "vec_id", "score").collect()]
    want = []
    for q, (i, x) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((abs(x[0] - y[0]), j) for o, (j, y) in enumerate(rows) if o != q)[:4]
            want += [(i, k + 1, j, d) for k, (d, j) in enumerate(near)]
    assert sorted(got) == sorted(want)


def test_neighbours_in_clusters_visit_few_cells(spark):
    """Where vectors cluster, a query visits a small share of the cells and still finds its neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 16)) * 10
    x = centres[rng.integers(0, 300, 20_000)] + rng.normal(size=(20_000, 16))
    index = Index.fit(x[:16_384], 20_000)
    assert len(index.cells) > 400 and index.share < 0.1
    rows = list(enumerate(x.tolist()))
    got, hit, want = {}, 0, 0
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, near in exact(rows):
        hit, want = hit + len(got[q] & {i for i, _ in near}), want + 10
    assert hit >= 0.9 * want


def test_neighbours_of_queries_unlike_the_other_rows(spark):
    """Queries that lie where few rows do, of vectors at several scales: no neighbour is missed."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 24)) * np.exp(rng.normal(size=(6000, 1)))
    x[:2000] = rng.normal(size=24) * 5 + 0.01 * rng.normal(size=(2000, 24))
    x = x[rng.permutation(6000)]
    x[::100] = rng.normal(size=(60, 24)) * 4
    rows = list(enumerate((x + 100).tolist()))
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in near] for q, near in exact(rows)}


# 3: personal data


def test_base_spans(spark):
    random.seed(3)
    bits = ["a", "1", "23", "456", ".", ".", "@", "-", " ", " ", "+", "(", ")", "é", "😀", "_", "4111111111111111", "255", "0", "\n", "9.9.9.9", "1.2.3", "x@y.z", "+49 30 1234567", "--"]
    rows = [(i, "".join(random.choices(bits, k=random.randint(0, 30)))) for i in range(1500)] + [(9000, None), (9001, "a" * 50_000), (9002, "1" * 50_000), (9003, "1 " * 2000), (9004, "+1 " * 2000)]
    got = personal_data(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, base int")).collect()
    slow = {i: brute.personal(t) for i, t in rows if i not in (9001, 9002)} | {9001: [], 9002: []}
    assert {r["doc_id"]: [tuple(s) for s in r["base"]] for r in got} == slow


def test_patterns_find_unseen_identifiers_and_nothing_else(spark):
    rows = [(i, f"some words here access token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" and more") for i in range(10)]
    rows += [(100, "also access token = \"NOT-A-HEX-KEY-77\" there"), (101, "an ordinary room 12345678 of words"), (102, "plain")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [("secret", 21, 37)] and rows[10][1][21:37] == "NOT-A-HEX-KEY-77"
    assert got[101] == got[102] == [] and all(len(got[i]) == 1 for i in range(10))


@pytest.mark.parametrize(
    ("kind", "before", "value", "unseen", "found"),
    [
        ("phone", "call phone: ", "+49 30 12345{}", "030-99887766", "number"),
        ("ip", "host ip: ", "10.0.0.{}", "10-20-30-40", "number"),
        ("card", "my card: ", "4111 1111 1111 1111", "4111111111111112", "number"),
        ("email", "write email: ", "jo.x@site{}.org", "jane-doe-at-site9", "secret"),
    ],
)
def test_each_format_leads_to_unseen_identifiers(spark, kind, before, value, unseen, found):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "6011 0000 0000 0004", "3400 0000 0000 009"]
    rows = [(i, f"some words, {before}{cards[i] if kind == 'card' else value.format(10 + i)} and more") for i in range(5)]
    rows += [(100, f"some words, {before}{unseen} there"), (101, f"some words, other: {unseen} there")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[5][1].index(unseen)
    assert all([s[0] for s in got[i]] == [kind] for i in range(5))
    assert (found, at, at + len(unseen)) in got[100] and (found, at, at + len(unseen)) not in got[101]


def base_matches(t):
    """All matches of the operator's four patterns, by Python's own engine, and which of them are sound."""
    good = set(brute.personal(t))
    for kind, p in BASE.items():
        spans = [m.span() for m in regex.finditer(p, t)]
        yield spans, [(kind, *x) in good for x in spans]


def test_added_spans_are_those_of_plain_loops(spark):
    """Seeds, patterns, their corpus counts and three turns of scores against dictionaries and loops, on texts with common and rare contexts."""
    random.seed(12)
    words = ["the", "key", "id", "call", "host", "is", "of", "x", "né", ":", "=", "#", '"', ",", "7"]
    lead = ["call me: {}", "host = {}", 'token = "{}"', "id #{} of", "{}", "né {} is", "account no. {} ,"]
    forms = [
        lambda: "10.0.{}.{}".format(random.randint(0, 255), random.randint(0, 255)), lambda: "+49 30 {}".format(random.randint(10**6, 10**7)),
        lambda: "a{}@b{}.org".format(random.randint(0, 99), random.randint(0, 9)), lambda: hashlib.sha1(random.randbytes(3)).hexdigest(),
        lambda: "AB-{}-{}".format(random.randint(100, 999), random.randint(10, 99)), lambda: str(random.randint(10**8, 10**10)), lambda: "none", lambda: "ordinary",
    ]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(random.randint(0, 4)):
            parts += random.choices(words, k=random.randint(0, 6))
            k = random.randrange(len(lead))
            parts.append(lead[k].format(forms[min(7, k + random.choice([0, 0, 0, 1, 4, 6])) if random.random() < 0.8 else random.randrange(8)]()))
        rows.append((i, " ".join(parts) + random.choice(["", ".", " end", "\n"])))
    rows += [(1000, None), (1001, ""), (1002, "_AB-777-88. call me: __X9-11-22-33.")] + [(2000 + i, "call me: AB-123-99") for i in range(5)]
    want, good = brute.bootstrapped(rows, base_matches)
    assert 3 <= len(good) and 10 < sum(map(len, want.values()))
    for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = [tuple(x) for x in r["base"]]
        assert base == brute.personal(dict(rows)[r["doc_id"]])
        assert {tuple(x) for x in r["spans"][len(base) :]} == want.get(r["doc_id"], set()), r["doc_id"]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i % 256}.{i // 256 % 256}.1.1" for i in range(3_000))
    got = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["base"]
    assert len(got) == 3_000 and [tuple(x) for x in got] == brute.personal(text)


def test_personal_data_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_pii(spark, sf).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(texts[r["doc_id"]]))
        assert r["base_sha256"] == brute.sha(base.encode()) and r["spans"].startswith(base)
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# 4: media


def test_streams_round_trip():
    random.seed(1)
    for n in [1, 3, 157, 158, 159, 160, 161, 162, 163, 175, 176, 177, 4608, 4609, 9216 * 3 + 5, 200_000, *range(576, 5000, 367)]:
        payload = random.randbytes(n)
        got = read_stream(write_stream(payload))
        assert got["payload"] == payload and got["n_broken"] == 0 and got["units"][0]["random_access"]
        assert [u["pts"] for u in got["units"]] == [3600 * k for k in range(len(got["units"]))]


def test_streams_show_loss_and_refuse_other_bytes():
    s = write_stream(bytes(range(256)) * 60)
    assert read_stream(s[: 188 * 5] + s[188 * 6 :])["n_broken"] == 1
    assert read_stream(s[: 188 * 5] + s[188 * 4 : 188 * 5] + s[188 * 5 :])["payload"] == bytes(range(256)) * 60  # a packet sent twice
    assert read_stream(b"") is None and read_stream(s[1:]) is None and read_stream(b"x" * 188) is None and read_stream(s[188:]) is None


def crc(data):
    """CRC-32 of ISO/IEC 13818-1, bit by bit."""
    c = 0xFFFFFFFF
    for b in data:
        for k in range(8):
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (c >> 31) ^ (b >> 7 - k & 1) else 0)
    return c


def section(table_id, number, body, version=0, current=1, index=0, last=0):
    head = bytes([table_id, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, number >> 8, number & 255, 0xC0 | version << 1 | current, index, last]) + body
    return head + crc(head).to_bytes(4, "big")


def pat(*entries, **how):
    return section(0, 7, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in entries), **how)


def pmt(program, *es, info=b"", **how):
    body = (0xE000 | es[0][1]).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    return section(2, program, body + b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(d)).to_bytes(2, "big") + d for kind, pid, d in es), **how)


class Muxer:
    """Packets made one by one from sections and PES packets."""

    def __init__(self):
        self.out, self.counters = [], {}

    def packets(self, pid, data, start=True, pointer=None, field=b"", scrambled=0, error=0):
        data = (b"" if pointer is None else bytes([pointer])) + data
        first = True
        while data or first:
            own = field if first else b""
            room = 184 - (1 + len(own) if own else 0)
            part, data = data[:room], data[room:]
            pad = room - len(part)
            if pad and pointer is not None:
                part, pad = part + b"\xff" * pad, 0
            if pad and not own:
                own, pad = (b"", 0) if pad == 1 else (b"\0", pad - 2)
                adaptation = bytes([len(own) + pad]) + own + b"\xff" * pad
            elif own or pad:
                adaptation = bytes([len(own) + pad]) + own + b"\xff" * pad
            else:
                adaptation = b""
            n = self.counters[pid] = self.counters.get(pid, -1) + 1
            flags = 0x10 | (0x20 if adaptation else 0) | scrambled << 6
            self.out.append(bytes([0x47, (0x40 if start and first else 0) | error << 7 | pid >> 8, pid & 255, flags | n & 15]) + adaptation + part)
            first = False
        return self

    def pes(self, pid, body, pts=None, **how):
        stamp = b"" if pts is None else bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])
        head = bytes([0x80, 0 if pts is None else 0x80, len(stamp)]) + stamp
        return self.packets(pid, b"\0\0\1\xe0" + (len(head) + len(body)).to_bytes(2, "big") + head + body, **how)

    def media(self):
        assert all(len(x) == 188 for x in self.out)
        return b"".join(self.out)


def test_streams_of_other_makers():
    body = bytes(random.Random(2).randbytes(3000))
    language = bytes([0x0A, 4]) + b"eng\0"
    m = Muxer()
    m.packets(0, pat((0, 0x10), (3, 0x300), (2, 0x200)), pointer=0)  # the network's entry first, programs out of order
    m.packets(0x200, b"junk" + pmt(2, (0x1B, 0x101, language), (0x03, 0x102, b""), info=bytes([5, 4]) + b"HDMV" + bytes([9, 2, 1, 2])), pointer=4)
    m.packets(0x300, pmt(3, (0x1B, 0x111, b"")), pointer=0)
    m.pes(0x101, body[:1000], 5000, field=b"\x40").pes(0x102, b"sound", 1).pes(0x111, b"other").pes(0x101, body[1000:1700], (1 << 33) - 1)
    got = read_stream(m.media())
    assert (got["payload"], got["pid"], got["stream_type"], got["n_tables"], got["n_broken"]) == (body[:1700], 0x101, 0x1B, 2, 0)
    assert got["units"] == [{"pts": 5000, "offset": 0, "length": 1000, "random_access": True}, {"pts": (1 << 33) - 1, "offset": 1000, "length": 700, "random_access": False}]
    # a later version moves the stream; one that isn't current yet doesn't, nor does one with a wrong checksum
    m.packets(0x200, pmt(2, (0x1B, 0x1F0, b""), version=1, current=0), pointer=0)
    wrong = bytearray(pmt(2, (0x1B, 0x1F1, b""), version=1))
    wrong[-1] ^= 1
    m.packets(0x200, bytes(wrong), pointer=0).pes(0x1F0, b"no").pes(0x1F1, b"no").pes(0x101, body[1700:2000])
    m.packets(0x200, pmt(2, (0x24, 0x121, b""), version=1), pointer=0).pes(0x101, b"late").pes(0x121, body[2000:])
    got = read_stream(m.media())
    assert (got["payload"], got["pid"], got["stream_type"], [u["pts"] for u in got["units"]], got["n_broken"]) == (body, 0x121, 0x24, [5000, (1 << 33) - 1, -1, -1], 0)


def test_streams_with_long_tables_and_flags():
    body = bytes(random.Random(3).randbytes(2000))
    many = [(0x06, 0x400 + i, bytes([0x52, 1, i])) for i in range(80)]  # a map of three packets
    m = Muxer().packets(0, pat((9, 0x90), index=0, last=1) + pat((4, 0x40), index=1, last=1), pointer=0)
    m.packets(0x40, pmt(4, *many), pointer=0)
    m.pes(0x400, body[:500]).packets(0x400, b"\x01\x02", start=False, error=1).pes(0x400, b"secret", scrambled=2)
    m.counters[0x400] -= 2  # neither the erroneous nor the scrambled one is of the sequence
    m.pes(0x400, body[500:])
    got = read_stream(m.media())
    assert (got["payload"], got["n_scrambled"], got["n_broken"]) == (body, 1, 0)
    m.counters[0x400] += 5
    assert read_stream(Muxer.media(m.pes(0x400, b"x", field=b"\x80")))["n_broken"] == 0  # an announced break
    m.counters[0x400] += 5
    assert read_stream(Muxer.media(m.pes(0x400, b"x")))["n_broken"] == 1
    # nothing to read: null, whatever is missing
    assert read_stream(Muxer().packets(0, pat((0, 0x10)), pointer=0).media()) is None
    assert read_stream(Muxer().packets(0, pat((1, 0x40)), pointer=0).packets(0x40, section(2, 1, b"\xe0\x00\xf0\x00"), pointer=0).media()) is None
    assert read_stream(Muxer().packets(0, pat((1, 0x40)), pointer=0).packets(0x40, pmt(1, (6, 0x50, b"")), pointer=0).packets(0x50, b"no packet").media()) is None


def test_random_bytes_in_tables_never_crash():
    rng = random.Random(4)
    good = bytearray(write_stream(bytes(2000)))
    for _ in range(400):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 30)):
            at = rng.randrange(len(bad))
            if at % 188:
                bad[at] = rng.randrange(256)
        assert read_stream(bytes(bad)) is None or isinstance(read_stream(bytes(bad))["payload"], bytes)


def read_slowly(media):
    """The feature and the payload by a loop over packets, from the standard's fields."""
    es = pmt_pid = None
    tables, pes, entries = 0, [], 0
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        pid, begins, body = (p[1] & 31) << 8 | p[2], p[1] & 64, p[4:]
        flags = 0
        if p[3] & 32:
            flags = body[1] if body[0] else 0
            body = body[1 + body[0] :]
        if pid == 0 or pid == pmt_pid:
            size = (body[2] & 15) << 8 | body[3]
            assert crc(body[1 : 4 + size]) == 0
            tables += 1
            if pid == 0:
                pmt_pid = (body[11] & 31) << 8 | body[12]
            else:
                es = (body[14] & 31) << 8 | body[15]
        elif pid == es:
            if begins:
                pes.append(b"")
                entries += bool(flags & 64)
            pes[-1] += body
    pts = [(x[9] & 14) << 29 | x[10] << 22 | (x[11] & 254) << 14 | x[12] << 7 | x[13] >> 1 for x in pes]
    assert all(len(x) == 6 + (x[4] << 8 | x[5]) for x in pes)
    return b"".join(x[9 + x[8] :] for x in pes), f"packets={len(media) // 188};tables={tables};units={len(pes)};broken=0;entries={entries};pts={pts[0]}-{pts[-1]}"


def test_media_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    stored = {r["doc_id"]: r["media"] for r in to_transport_streams(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in op4_media(spark, sf).collect():
        b = texts[r["doc_id"]].encode()
        p = b.ljust(max(576, -(-len(b) // 576) * 576), b"\xff")
        assert (p, r["feature"]) == read_slowly(stored[r["doc_id"]])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), brute.sha(stored[r["doc_id"]]))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), brute.sha(p), zlib.crc32(p[-32:]))


def test_media_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "é", 0), (3, "x" * 100_000, 0)], "doc_id long, text string, payload int")
    got = read_transport_streams(to_transport_streams(df)).collect()
    assert sorted(len(r["payload"]) for r in got) == [576, 576, 576, 174 * 576]
    named = read_transport_streams(spark.createDataFrame([(b"no stream", 5, 6), (None, 5, 6)], "media binary, payload int, `a.b` int"))
    assert [tuple(r) for r in named.collect()] == [(b"no stream", 5, 6, *[None] * 8), (None, 5, 6, *[None] * 8)] and named.columns[3] == "payload_"
    assert read_transport_streams(to_transport_streams(df.where("false"))).collect() == []


# 7: mixing


def expected_shares(rows):
    """For each dimension its values' (share of all tokens, share of the tokens that are expected to be drawn)."""
    for k in range(3):
        before, after = defaultdict(float), defaultdict(float)
        for dims, n, p in rows:
            before[dims[k]] += n
            after[dims[k]] += n * p
        yield {v: (before[v] / sum(before.values()), after[v] / sum(after.values())) for v in before}


def test_mixing_meets_its_targets(spark):
    """At sf0.01 the expected share of every source, language and topic is its target: the tempered share, lifted by half at most."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [((r["source"], r["lang"], r["topic"]), r["n_tokens__"], r["probability__"]) for r in mixed(df.withColumn("topic", topic())).drop("text").collect()]
    assert all(p <= 1 for _, _, p in rows) and sum(n * p for _, n, p in rows) > 0.5 * sum(n for _, n, _ in rows)
    for shares in expected_shares(rows):
        power = {v: own**0.7 for v, (own, _) in shares.items()}
        held = {v: min(x / sum(power.values()), 1.5 * shares[v][0]) for v, x in power.items()}
        for v, (_, got) in shares.items():
            assert abs(got - held[v] / sum(held.values())) < 0.005, v


def test_mixing_meets_given_targets(spark):
    df = spark.createDataFrame([(i, "w " * (5 + i % 40), "abc"[i % 3], "en" if i % 4 else "de") for i in range(4000)], "doc_id long, text string, source string, lang string")
    want = [{"a": 0.5, "b": 0.25, "c": 0.25}, {"en": 0.6, "de": 0.4}]
    targets = [spark.createDataFrame(list(w.items()), f"mix_key_{k}__ string, share double") for k, w in enumerate(want)]
    rows = [((r["source"], r["lang"], ""), r["n_tokens__"], r["probability__"]) for r in mixed(df, targets=[*targets, None], rounds=20).collect()]
    for shares, w in zip(expected_shares(rows), want, strict=False):
        assert all(abs(got - w[v]) < 0.001 for v, (_, got) in shares.items())


def test_mixing_of_odd_rows(spark, monkeypatch):
    rows = [(i, "w " * (i % 50), ["a", "b", None][0 if i % 3 else 1 + i % 2], "en" if i % 4 else "de") for i in range(3000)] + [(None, None, None, None), (7, "", "c", "fr")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, lang string, w int, tokens int, ratio int, n_tokens__ int").withColumn("x.y", F.lit(1))
    out = mixed(df)
    assert out.count() == len(rows) and out.columns == [*df.columns, "n_tokens___", "probability__", "kept__"]
    got = {tuple(r) for r in out.collect()}
    assert mixed(df.where("false")).collect() == [] and mixed(df.where("doc_id = 0")).first()["kept__"]
    monkeypatch.setattr(op07, "CELLS_BROADCAST", 1)
    assert {tuple(r) for r in mixed(df).collect()} == got


# 9: packing


def test_first_fit_decreasing_against_a_scan():
    random.seed(9)
    sizes = [random.randint(1, 1024) for _ in range(400)]
    bins, free = [], []
    for i in sorted(range(400), key=lambda i: (-sizes[i], i)):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            bins.append([])
            free.append(1024)
        bins[k].append(i)
        free[k] -= sizes[i]
    assert first_fit_decreasing(sizes, 1024) == bins


def checked(rows, texts):
    tokenizer = Encoder().tokenizer
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # no padding
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)


def test_packing_query(spark, sf):
    rows = op9_packing(spark, sf).collect()
    bins = {}
    for r in rows:
        if r["first_fit_bin"] is not None:
            bins[r["first_fit_bin"]] = bins.get(r["first_fit_bin"], 0) + r["length"]
    assert max(bins.values()) <= 1024 and sum(bins.values()) > 0.97 * 1024 * (len(bins) - 1)  # first-fit decreasing alone
    checked(rows, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 5000), (4, "a<|endoftext|>b"), (5, "中文\U0001f600"), (6, "it's\n\n  a 'll test\t "), (7, "\x1c\x1d"), (None, "n")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, blob int")
    checked(pack_documents(df).withColumn("ids_crc32", F.crc32("ids")).collect(), dict(rows))
    assert pack_documents(df.where("false")).collect() == []


def test_ids_are_the_tokenizers():
    random.seed(1)
    e = Encoder(most=500)
    bits = ["a", "é", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "1", "½", "!", "-", "\x85", "ve", "d", "m", "Z", "\xa0", "ß"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(4000)]
    for k in range(0, 4000, 500):
        for t, ids in zip(texts[k : k + 500], e.encode(texts[k : k + 500]), strict=True):
            assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pieces_with_colliding_names_keep_their_ids():
    """Words of one polynomial name modulo 2**64, whatever its base."""
    words = ["".join("ab"[i.bit_count() % 2 ^ k] for i in range(1024)) for k in (0, 1)]
    e = Encoder()
    for t, ids in zip(words, e.encode(words), strict=True):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# 10: quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op10_quality(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9


def test_scores_of_odd_rows(spark):
    net = train([b"good words here", b"BAD!! BAD!!"] * 8, np.array([1.0, 0.0] * 8))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 100_000, None), (None, "x" * 100_000, "d")], "doc_id long, text string, label string")
    got = {r["label"]: r["score"] for r in score_documents(df, net).collect()}
    assert len(got) == 4 and got["a"] == got["b"] and got[None] == got["d"]
    assert score_documents(df.where("false"), net).collect() == []
    one = train([b"x"], np.array([1.0]))
    assert 0 < score_documents(df, one).first()["score"] < 1


def small_network(seed=3):
    rng = np.random.default_rng(seed)
    net = op10.Network(rng.normal(0, 0.5, (256, op10.DEPTH)).astype(np.float32), rng.normal(0, 0.2, (op10.WIDTH * op10.DEPTH, op10.FILTERS)).astype(np.float32), rng.normal(0, 0.5, 2 * op10.FILTERS + 1))
    net.vectors[0] = 0
    return net


def test_scores_against_loops():
    """Every window of every chunk by itself."""
    net, texts = small_network(), [b"", b"short", bytes(random.Random(1).choices(range(1, 256), k=520)), "é😀 ".encode() * 200]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    for t, got in zip(texts, net.scores(data, bounds), strict=True):
        pooled, begin = [], 0
        while True:
            chunk = t[begin : begin + op10.CHUNK].ljust(op10.CHUNK, b"\0")
            most = np.zeros(op10.FILTERS)
            for i in range(op10.CHUNK - op10.WIDTH + 1):
                window = np.concatenate([net.vectors[b] for b in chunk[i : i + op10.WIDTH]]).astype(float)
                most = np.maximum(most, window @ net.filters.astype(float))
            pooled.append(most)
            if begin + op10.CHUNK >= len(t):
                break
            begin += op10.STEP
        z = np.mean(pooled, 0) @ net.weights[: op10.FILTERS] + np.max(pooled, 0) @ net.weights[op10.FILTERS : -1] + net.weights[-1]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5


def test_gradient_against_loops_and_differences():
    net, rng = small_network(), np.random.default_rng(5)
    seen, back = rng.integers(0, 256, (3, op10.FILTERS, op10.WIDTH)).astype(np.uint8), rng.normal(size=(3, op10.FILTERS)).astype(np.float32)
    to_vectors, to_filters = np.zeros((256, op10.DEPTH)), np.zeros((op10.WIDTH, op10.DEPTH, op10.FILTERS))
    filters = net.filters.reshape(op10.WIDTH, op10.DEPTH, op10.FILTERS)
    for c in range(3):
        for f in range(op10.FILTERS):
            for w in range(op10.WIDTH):
                to_vectors[seen[c, f, w]] += back[c, f] * filters[w, :, f]
                to_filters[w, :, f] += back[c, f] * net.vectors[seen[c, f, w]]
    got = net.gradient(seen, back)
    assert np.allclose(got[0], to_vectors, atol=1e-5) and np.allclose(got[1], to_filters.reshape(-1, op10.FILTERS), atol=1e-5)
    # and the response of a window by a small step in each filter
    loss = lambda: sum(back[c, f] * (net.vectors[seen[c, f]].ravel() @ net.filters[:, f]) for c in range(3) for f in range(op10.FILTERS))
    net.filters, net.vectors = net.filters.astype(float), net.vectors.astype(float)
    for i, f in ((0, 0), (17, 5), (63, 31)):
        before = loss()
        net.filters[i, f] += 1e-4
        assert abs((loss() - before) / 1e-4 - got[1][i, f]) < 1e-3


def test_training_stays_small_on_few_long_texts():
    """The documented bound of text in four texts: under a GB at its peak."""
    code = """
import re, numpy as np
from folio.llm import op10_quality as Q
rng = np.random.default_rng(1)
texts = [rng.integers(32, 120, Q.TRAIN_BYTES // 4).astype(np.uint8).tobytes() for _ in range(4)]
Q.EPOCHS = 1
Q.train(texts, np.array([0.0, 1, 0, 1]))
print(int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024)  # ru_maxrss would count what the tests' own process had when it forked
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], env=os.environ | {"PYTHONPATH": str(Path(__file__).parents[2])})
    assert int(got.stdout) < 1000, got.stderr


def test_sample_is_bounded_and_no_held_out_row(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(1, 101)] + [(101, None), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 102)] + [(5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    got = op10.labelled_sample(docs, labels).collect()
    learn = {i for i in range(1, 102) if zlib.crc32(str(i).encode()) % 5}
    assert {r["id"] for r in got} == learn and all(r["label"] == (0 if r["id"] == 5 else r["id"] % 2) and len(r["text"]) == (10 * r["id"] if r["id"] < 101 else 0) for r in got)
    assert op10.labelled_sample(docs, labels, most=7).count() == 7
    few = op10.labelled_sample(docs, labels, most_bytes=3000).collect()
    assert 0 < sum(len(r["text"]) for r in few) <= 3000
    none = op10.trained(docs, labels.where("false"))
    assert none.scores(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [0.5]
