import hashlib
import math
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from test_others import checked

import corpus_pipeline as P
from folio.llm.op07_mixing import FILL, LIFT, ROUNDS, TEMPER
from folio.llm.op10_quality import train


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and output, as rows, written and read again between the stages."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, sf).write.parquet(f"{top}/{k}")
        after = spark.read.parquet(f"{top}/{k}")
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(s[3] == s[4] for s in stages[:-1])


def test_quality(spark, sf, stages):
    _, before, after, _, _ = stages[0]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in before}
    labels = sorted((r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5)
    net = train([texts[i] for i, _ in labels], np.array([float(q) for _, q in labels]))
    scores = {i: round(float(net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]), 6) for i, t in texts.items()}
    near = {i for i, s in scores.items() if abs(s - 0.3) < 1e-4}
    assert {r["doc_id"] for r in after} - near == {i for i, s in scores.items() if s >= 0.3} - near


def test_line_dedup(stages):
    _, before, after, _, _ = stages[1]
    kept = brute.repeated_lines([(r["doc_id"], r["text"]) for r in before])
    lines = lambda t: [x for x in (t or "").split("\n") if x]
    had = {r["doc_id"]: lines(r["text"]) for r in before}
    assert {r["doc_id"]: lines(r["text"]) for r in after} == {i: k for i, k in kept.items() if k or not had[i]}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def shingles(t, words=5):
    w = brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or {tuple(w)}


def test_near_dedup(stages):
    """What goes is linked by pairs at a similarity of 0.8 to a smaller id that stays; of what such pairs link, at least 0.9 goes."""
    _, before, after, _, _ = stages[2]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    group = brute.components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = {r["doc_id"] for r in after}
    gone, due = set(sets) - kept, {i for i, g in group.items() if i != g}
    assert gone <= due and len(gone) >= 0.9 * len(due) > 0


def test_mixing(stages):
    _, before, after, _, _ = stages[3]
    words = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in before}
    topic = lambda t: "listing" if " | " in t else "legal" if "licen" in t.lower() else "long" if len(t) >= 4000 else "prose"
    cell = {r["doc_id"]: (r["source"], r["lang"], topic(r["text"] or "")) for r in before}
    tokens = defaultdict(float)
    for i, c in cell.items():
        tokens[c] += words[i]
    total = sum(tokens.values())
    most = {c: t / total for c, t in tokens.items()}
    targets, room = [], 1.0
    for k in range(3):
        m = defaultdict(float)
        for c, t in most.items():
            m[c[k]] += t
        z = sum(x**TEMPER for x in m.values())
        goal = {v: min(x**TEMPER / z, LIFT * x) for v, x in m.items()}
        targets.append({v: x / sum(goal.values()) for v, x in goal.items()})
        room = min(room, *[m[v] / g for v, g in targets[-1].items() if g])
    w = dict(most)
    for _ in range(ROUNDS):
        for k in range(3):
            m = defaultdict(float)
            for c, x in w.items():
                m[c[k]] += x
            w = {c: x * targets[k][c[k]] * FILL * room / m[c[k]] if m[c[k]] else 0.0 for c, x in w.items()}
        w = {c: min(x, most[c]) for c, x in w.items()}
    kept = set()
    for i, c in cell.items():
        p = 1.0 if tokens[c] == 0 else w[c] / most[c]
        u = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 4294967296
        assert not math.isclose(u, p, abs_tol=1e-9)
        if u < round(p, 9):
            kept.add(i)
    assert {r["doc_id"] for r in after} == kept


def test_packing(stages):
    _, before, after, _, _ = stages[4]
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in after]
    checked(rows, {r["doc_id"]: r["text"] for r in before})


def test_run_is_the_stages_in_turn(spark, sf, stages):
    got = {(r["doc_id"], r["start"], r["length"], r["sequence_id"]) for r in P.run(spark, sf).collect()}
    assert got == {(r["doc_id"], r["start"], r["length"], r["sequence_id"]) for r in stages[-1][2]}


def test_a_rerun_takes_up_finished_stages(spark, sf, tmp_path, monkeypatch):
    calls = []
    fails = lambda s, d, x: 1 / 0
    first = lambda s, d, x: calls.append(1) or d.where("doc_id < 5")
    monkeypatch.setattr(P, "STAGES", [("first", first), ("second", fails)])
    with pytest.raises(ZeroDivisionError):
        P.run(spark, sf, f"file://{tmp_path}/run")
    monkeypatch.setattr(P, "STAGES", [("first", first), ("second", lambda s, d, x: d.select("doc_id"))])
    assert sorted(r["doc_id"] for r in P.run(spark, sf, f"file://{tmp_path}/run").collect()) == [0, 1, 2, 3, 4] and len(calls) == 1


def odd_documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `tokens` int, `ratio` int, `score` int, `score__` int, `n_lines_removed__` int, `kept_id__` int, `x.y` string, payload binary"
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 1, 2, 3, 4, 5, 6, "z", b"p") for i, t, lang, source in rows], schema)


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with the stages' own names; and no rows at all."""
    text = "\n".join(" ".join(f"word{i}{j}" for j in range(8)) for i in range(12))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, text, "de", "a"), (4, text + " more", "en", "a"), (5, "long words and more of it " * 8000, "fr", "c"), (6, " \n \n", "en", "a")]
    for name, f in P.STAGES:
        docs = odd_documents(spark, rows)
        out = f(spark, docs, sf).collect()
        assert len(out) <= len(rows) or name == "packing"
        if name != "packing":
            assert f(spark, docs, sf).columns == docs.columns
        assert f(spark, docs.where("false"), sf).collect() == []
    lines = {(r["doc_id"], r["text"]) for r in P.line_dedup(spark, odd_documents(spark, rows), sf).collect()}
    assert lines == {(None, text), (2, None), (3, ""), (5, rows[6][1]), (6, " \n \n"), (4, "")} - {(4, "")} | {(i, t) for i, t in lines if i == 4}
    near = sorted((r["doc_id"] or 0) for r in P.near_dedup(spark, odd_documents(spark, rows), sf).collect())
    assert near == [0, 1, 1, 2, 5]  # null and empty texts are copies of one another; rows of one id stay together
