"""Operators whose rules are order and state, on random pages against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import catalog as C
from folio.operators import layout as L
from folio.operators import ranges as R
from folio.operators import rounds as RO
from folio.operators import spatial as SP
from folio.operators import stages as E
from folio.operators import structure as ST
from folio.operators import units as U

BLANKS = [chr(c) for c in (9, 0x20, 0xA0, 0x2003)]  # an ideographic space isn't one


def lap(a0, a1, b0, b1):
    return max(0.0, min(a1, b1) - max(a0, b0))


def boxes(rng, n, wide=200, high=200, size=(4, 14)):
    for _ in range(n):
        x, y, s = rng.randint(0, wide), rng.randint(0, high), rng.choice([size[0], 6, 10, size[1]])
        yield float(x), float(y), float(x + rng.randint(5, 80)), float(y + s), float(s)


# Tasks that grow in number, not in size


@pytest.mark.parametrize("name", ["gutters", "split", "order"])
def test_tasks_of_pages_grow_in_number(spark, monkeypatch, name):
    """What a task has of pages is bounded, whatever the session's number of partitions is."""
    dealt = []
    monkeypatch.setattr(RO, "PART_ROWS", 100)
    rows = [(d, 0, line, k, 40.0 + k * 125, 140.0 + k * 125, 60.0 + line * 14, 70.0 + line * 14) for d in range(50) for line in range(8) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line int, k int, x0 double, x1 double, y0 double, y1 double")
    kind = type(df)
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by, f=kind.repartition: dealt.append(n) or f(self, n, *by))
    if name == "order":
        got = ST.reading_order(df.withColumns({"tag": F.col("line") * 10 + F.col("k"), "vertical": F.lit(False), "body": F.lit(10.0)}))
        assert got.where("ord = 8").select("tag").distinct().collect() == [(1,)]
    else:
        found = L.gutters(df)
        got = found if name == "gutters" else U.split_at_gutters(df.select("doc_id", "page", "line", "x0", "x1"), found)
        assert got.count() == (100 if name == "gutters" else 1200) and (name == "gutters" or got.where("part = 2").count() == 400)
    assert dealt and dealt[0] == 12 and all(n >= 8 for n in dealt)  # of 1,200 rows, in the order's second round 800


# J3


def ruby(page, body):
    """page: runs by number (text, size, vertical, box); the readings' parts, their bases and spans."""
    out, taken = [], set()
    blank = lambda c: c.isspace() and c != "　"
    parts = []
    for run, (text, size, vertical, x0, y0, x1, y1) in sorted(page.items()):
        if not 0 < size <= 0.65 * body:
            continue
        pieces, at = [], 0
        while at < len(text):
            end = at
            while end < len(text) and not blank(text[end]):
                end += 1
            if end > at:
                pieces.append((at, end))
            at = end + 1
        for p, q in pieces if len(pieces) > 1 else [(0, len(text))]:
            lo, hi = (y0, y1) if vertical else (x0, x1)
            a, z = lo + (hi - lo) * p / len(text) if text else lo, lo + (hi - lo) * q / len(text) if text else hi
            parts.append((run, text[p:q].strip(), size, vertical, *((x0, a, x1, z) if vertical else (a, y0, z, y1))))
    for run, text, size, vertical, x0, y0, x1, y1 in parts:
        if not text or not all(c.isalpha() or c in "ー゛゜ˊˇˋ˙・" for c in text):
            continue
        best = None
        for b, (_, bs, bv, bx0, by0, bx1, by1) in sorted(page.items()):
            if b == run or bs < 0.8 * body or bs < 1.4 * size or bv != vertical:
                continue
            if vertical:
                ok, far = bx1 - 1.5 <= x0 <= bx1 + 0.6 * bs and lap(y0, y1, by0, by1) >= 0.5 * (y1 - y0), x0 - bx1
            else:
                ok, far = by0 - 0.8 * bs <= y1 <= by0 + 0.35 * bs and lap(x0, x1, bx0, bx1) >= 0.5 * (x1 - x0), by0 - y1
            if ok and (best is None or far < best[0]):
                best = (far, b)
        if best is None:
            continue
        b = best[1]
        bt, bs, _, bx0, by0, bx1, by1 = page[b]
        lo, hi, a, z = (by0, by1, y0, y1) if vertical else (bx0, bx1, x0, x1)
        step = (hi - lo) / max(1, len(bt))
        glyphs = [(lo + i * step, lo + (i + 1) * step) for i in range(len(bt))]
        idx = [i for i, (p, q) in enumerate(glyphs) if lap(p, q, a, z) > 0.25 * (q - p) or (a - 0.3 * bs <= p and q <= z + 0.3 * bs)]
        idx = [i for i in idx if not blank(bt[i]) and (b, i) not in taken]
        if not idx:
            idx = [min(range(len(bt)), key=lambda i: abs(sum(glyphs[i]) / 2 - (a + z) / 2))]
        taken |= {(b, i) for i in range(min(idx), max(idx) + 1)}
        out.append((run, b, min(idx), max(idx)))
    return sorted(out)


def test_ruby(spark):
    rng, rows, want = random.Random(1), [], {}
    for doc in range(60):
        page, run = {}, 0
        for line in range(3):
            vertical = rng.random() < 0.3
            y, x = 40 * line + 20, 40 * line + 20
            text = "".join(rng.choice(["漢", "字", "　", " ", "あ", "b"]) for _ in range(rng.randint(3, 10)))
            length = 10.0 * len(text)
            page[run] = (text, 10.0, vertical, *((x, 0.0, x + 10.0, length) if vertical else (0.0, y, length, y + 10.0)))
            run += 1
            for _ in range(rng.randint(0, 3)):
                t = "".join(rng.choice(["か", "ㄩ", "ˊ", " ", "\xa0", "　", "k", "1"]) if rng.random() < 0.3 else "か" for _ in range(rng.randint(1, 6)))
                at, size = rng.uniform(-5, length), rng.choice([4.0, 5.0, 6.5, 7.0])
                side = rng.choice([-1.0, 0.5, 3.0, 9.0])
                page[run] = (t, size, vertical, *((x + 10 + side, at, x + 10 + side + size, at + 5 * len(t)) if vertical else (at, y - size - side, at + 5 * len(t), y - side)))
                run += 1
        rows += [(doc, 1, k, *v) for k, v in page.items()]
        want[doc] = ruby(page, 10.0)
    got = {}
    for r in SP.attach_ruby(spark.createDataFrame([(d, p, k, t, s, v, float(a), float(b), float(c), float(e)) for d, p, k, t, s, v, a, b, c, e in rows], "doc_id long, page int, run int, text string, size double, vertical boolean, x0 double, y0 double, x1 double, y1 double"), 10.0).collect():
        got.setdefault(r["doc_id"], []).append((r["ruby_run"], r["base_run"], r["lo"], r["hi"]))
    assert sum(map(len, want.values())) > 80
    assert {d: sorted(v) for d, v in got.items()} == {d: v for d, v in want.items() if v}


# J14


def test_clusters(spark):
    rng, rows, want = random.Random(2), [], {}
    for doc in range(30):
        page = [(*b, rng.random() < 0.3) for b in boxes(rng, rng.randint(1, 25))]
        root = list(range(len(page)))
        changed = True
        while changed:  # labels go to the least until nothing changes
            changed = False
            for i, (ax0, ay0, ax1, ay1, s, v) in enumerate(page):
                for j, (bx0, by0, bx1, by1, t, w) in enumerate(page):
                    if i == j or v != w:
                        continue
                    across = lap(ay0, ay1, by0, by1) >= 0.3 * min(ay1 - ay0, by1 - by0) if v else lap(ax0, ax1, bx0, bx1) >= 0.3 * min(ax1 - ax0, bx1 - bx0)
                    gap = max(bx0 - ax1, ax0 - bx1) if v else max(by0 - ay1, ay0 - by1)
                    if across and (gap < 0 or gap <= 2.5 * max(s, t)) and root[i] != root[j]:
                        root[i] = root[j] = min(root[i], root[j])
                        changed = True
        rows += [(doc, 1, 0, i, v, s, x0, y0, x1, y1) for i, (x0, y0, x1, y1, s, v) in enumerate(page)]
        want |= {(doc, i): r for i, r in enumerate(root)}
    got = SP.clusters(spark.createDataFrame(rows, "doc_id long, page int, block int, run int, vertical boolean, size double, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {(r["doc_id"], r["run"]): r["cluster"] for r in got} == want


# W3


def test_baselines(spark):
    rng, rows, want = random.Random(3), [], []
    for doc in range(40):
        x, runs = 0.0, []
        for run in range(rng.randint(1, 12)):
            size = rng.choice([6.0, 10.0, 12.0])
            x += rng.choice([-3.0, 0.0, 5.0, 30.0, 60.0])
            y = rng.choice([0.0, 0.0, 3.0, 20.0])
            runs.append((f"t{run}", size, x, y, x + 20, y + size))
            x += 20
        rows += [(doc, 1, k, *r) for k, r in enumerate(runs)]
        merged = [list(runs[0])]
        for t, size, x0, y0, x1, y1 in runs[1:]:
            m = merged[-1]
            if lap(m[3], m[5], y0, y1) >= 0.6 * min(m[5] - m[3], y1 - y0) > 0 and 0 <= x0 - m[4] <= 4 * size:
                merged[-1] = [f"{m[0]} {t}", size, m[2], min(m[3], y0), max(m[4], x1), max(m[5], y1)]
            else:
                merged.append([t, size, x0, y0, x1, y1])
        want += [(doc, k, m[0], m[2], m[3], m[4], m[5]) for k, m in enumerate(merged)]
    got = SP.merge_baselines(spark.createDataFrame(rows, "doc_id long, page int, run int, text string, size double, x0 double, y0 double, x1 double, y1 double")).collect()
    assert sorted((r["doc_id"], r["part"], r["text"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got) == sorted(want)


# J1, J2


def test_links(spark):
    rng, glyph_rows, run_rows, link_rows, want = random.Random(4), [], [], [], {}
    for doc in range(40):
        runs, glyphs = [], []
        for run in range(rng.randint(1, 6)):
            vertical = rng.random() < 0.6
            x, y, n = 20.0 * rng.randint(0, 12), 10.0 * rng.randint(0, 5), rng.randint(3, 9)
            runs.append((run, vertical, 10.0, x, y, *((x + 10, y + 10 * n) if vertical else (x + 10 * n, y + 10))))
            glyphs += [(run, x, y + 10 * i, x + 10, y + 10 * i + 10) if vertical else (run, x + 10 * i, y, x + 10 * i + 10, y + 10) for i in range(n)]
        links = [(k, "abc"[k % 3], 15.0 * rng.randint(0, 20), (y := 10.0 * rng.randint(0, 8)), 0.0, y + 10.0 * rng.randint(1, 4)) for k in range(rng.randint(0, 5))]
        links = [(k, h, x0, y0, x0 + rng.choice([4.0, 12.0, 30.0]), y1) for k, h, x0, y0, _, y1 in links]
        linked, hit = {}, set()
        for g, (_, x0, y0, x1, y1) in enumerate(glyphs):
            for k, h, a0, b0, a1, b1 in links:
                if a0 - 1 <= (x0 + x1) / 2 <= a1 + 1 and b0 - 1 <= (y0 + y1) / 2 <= b1 + 1:
                    linked[g] = h
                    hit.add(k)
                    break
        for k, h, a0, b0, a1, b1 in links:
            if k in hit:
                continue
            best = None
            for run, vertical, size, x0, y0, x1, y1 in runs:
                far = abs((x0 + x1) / 2 - (a0 + a1) / 2)
                if vertical and lap(b0, b1, y0, y1) >= 0.6 * (b1 - b0) and far <= 3 * size and (best is None or far < best[0]):
                    best = (far, run)
            for g, (run, _, y0, _, y1) in enumerate(glyphs):
                if best and run == best[1] and b0 - 1 <= (y0 + y1) / 2 <= b1 + 1:
                    linked.setdefault(g, h)
        glyph_rows += [(doc, 1, g, *r) for g, r in enumerate(glyphs)]
        run_rows += [(doc, 1, *r) for r in runs]
        link_rows += [(doc, 1, k, x0, y0, x1, y1, h) for k, h, x0, y0, x1, y1 in links]
        want |= {(doc, g): h for g, h in linked.items()}
    got = SP.linked_glyphs(
        spark.createDataFrame(glyph_rows, "doc_id long, page int, g int, run int, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(run_rows, "doc_id long, page int, run int, vertical boolean, size double, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(link_rows, "doc_id long, page int, k int, x0 double, y0 double, x1 double, y1 double, href string"),
    )
    assert len(want) > 40 and {(r["doc_id"], r["g"]): r["href"] for r in got.collect()} == want


# RC1


def order_of(units, vertical, body):
    """The widest gap that is wide enough on its axis parts a page; parts that no gap parts are read by position."""
    if len(units) < 2:
        return units
    cuts = []
    for axis, enough in (("x", 0.3 if vertical else 1.0), ("y", 1.0 if vertical else 0.3)):
        k = 1 if axis == "x" else 2
        marks = sorted((u[k], u[k + 2]) for u in units)
        gaps, reach = [], marks[0][1]
        for a, b in marks:
            if a - reach > 0.5:
                gaps.append((a - reach, -len(gaps), (a + reach) / 2))
            reach = max(reach, b)
        if gaps and max(gaps)[0] >= enough * body:
            cuts.append((max(gaps)[0], axis, max(gaps)[2]))
    for _, axis, cut in sorted(cuts, reverse=True):
        k = 1 if axis == "x" else 2
        sides = [[u for u in units if ((u[k] + u[k + 2]) / 2 < cut) == low] for low in (True, False)]
        if all(sides):
            if vertical and axis == "x":
                sides.reverse()
            return [u for side in sides for u in order_of(side, vertical, body)]
    return sorted(units, key=(lambda u: (-u[3], u[2])) if vertical else (lambda u: (u[2], u[1])))


def test_reading_order(spark):
    rng, rows, want = random.Random(5), [], {}
    for page in range(60):
        vertical = page % 2 == 0
        units = [(f"u{i:02}", x0, y0, x1, y1) for i, (x0, y0, x1, y1, _) in enumerate(boxes(rng, rng.randint(1, 14), 400, 600))]
        rows += [(1, page, *u, vertical, 10.0) for u in units]
        want |= {(page, u[0]): i for i, u in enumerate(order_of(units, vertical, 10.0))}
    got = ST.reading_order(spark.createDataFrame(rows, "doc_id long, page int, tag string, x0 double, y0 double, x1 double, y1 double, vertical boolean, body double")).collect()
    assert {(r["page"], r["tag"]): r["ord"] for r in got} == want


# RC3


def paragraphs(units):
    """Chapters and paragraphs of one document, unit by unit."""
    out, chapter, size, page, fresh = [], 0, 0, None, True
    current = None
    for u in units:
        turned, page = page != u["page"], u["page"]
        text = u["kind"] == "text"
        heading = text and (u["heading"] or (u["toc_level"] is not None and u["nchars"] <= 160 and u["n_runs"] <= 4))
        level = min(4, max(1, u["toc_level"] if u["toc_level"] is not None else u["ladder_level"])) if heading else 0
        first = heading and level == 1 and (u["toc_level"] is not None or not u["has_toc"])
        if text and not fresh and (first or u["toc_level"] == 1 or (turned and size > 250_000)):
            chapter, size, fresh, current = chapter + 1, 0, True, None
        if text and not heading:
            joins = current is not None and u["toc_level"] is None and not u["align"] and not current["align"] and not u["indented"] and current["full"]
            joins = joins and abs(u["size"] - current["size"]) <= 0.15 * max(u["size"], current["size"]) and u["vertical"] == current["vertical"]
            joins = joins and not (current["text"].rstrip()[-1:] in tuple("。！？」』…") and u["text"].lstrip()[:1] in tuple("「『（【〈《"))
            joins = joins and (current["last"] != u["page"] or u["gap"] <= (1.4 if u["vertical"] else 1.2) * u["size"])
            if joins:
                cjk = lambda c: "　" <= c <= "鿿"
                current["text"] += ("" if cjk(current["text"][-1]) or cjk(u["text"][0]) else " ") + u["text"]
                current["full"], current["last"] = u["full"], u["page"]
                size += 3 * u["nchars"]
                continue
            classes = (u["align"] or ("indent" if u["indented"] else "noindent")) + (" small" if u["size"] <= 0.85 * u["body"] else "")
            current = {"chapter": chapter, "kind": "p", "level": 0, "page": page, "last": page, "classes": classes, "text": u["text"], "size": u["size"], "full": u["full"], "align": u["align"], "vertical": u["vertical"]}
            out.append(current)
        else:
            current = None
            out.append({"chapter": chapter, "kind": "h" if heading else u["kind"], "level": level, "page": page, "classes": u["align"] or "", "text": u["text"]})
        size, fresh = size + 3 * len(u["text"]) + 40, False
    return [tuple(p[c] for c in ("chapter", "kind", "level", "page", "classes", "text")) for p in out]


@pytest.mark.parametrize("build", [ST.build_paragraphs, lambda units: ST.scanned_paragraphs(units, parts=7)])
def test_paragraphs(spark, build):
    rng, rows, want = random.Random(6), [], {}
    for doc in range(40):
        has_toc, units, page = rng.random() < 0.5, [], 1
        for i in range(rng.randint(1, 40)):
            page += rng.random() < 0.2
            kind = rng.choice(["text"] * 8 + ["image", "table"])
            text = rng.choice(["some words", "他说。", "「好", "了", "ends. "]) * rng.choice([1, 1, 1, 9000]) if kind == "text" else ""
            toc = rng.choice([1, 2, 5]) if has_toc and rng.random() < 0.15 else None
            units.append({
                "doc_id": doc, "page": page, "ord": i, "kind": kind, "text": text, "nchars": len(text), "size": rng.choice([8.0, 10.0, 10.5, 12.0]), "body": 10.0, "n_runs": rng.choice([1, 1, 5]), "heading": kind == "text" and rng.random() < 0.15,
                "ladder_level": rng.randint(1, 5), "toc_level": toc, "has_toc": has_toc, "indented": rng.random() < 0.2, "full": rng.random() < 0.8, "align": rng.choice([None] * 9 + ["center"]), "vertical": rng.random() < 0.1, "gap": rng.choice([0.0, 5.0, 13.0, 20.0]),
            })
        rows += units
        want[doc] = paragraphs(units)
    schema = "doc_id long, page int, ord int, kind string, text string, nchars int, size double, body double, n_runs int, heading boolean, ladder_level int, toc_level int, has_toc boolean, indented boolean, full boolean, align string, vertical boolean, gap double"
    got = {}
    for r in build(spark.createDataFrame([tuple(u.values()) for u in rows], schema)).orderBy("doc_id", "para").collect():
        got.setdefault(r["doc_id"], []).append((r["chapter"], r["kind"], r["level"], r["page"], r["classes"], r["text"]))
    assert got == want


# RC9, RC10, SNK5


def test_names_are_unique(spark):
    rng = random.Random(7)
    names = ["a.pdf", "a (2).pdf", "a (3).pdf", "a (2) (2).pdf", "b", "b (2)", "b (02)", "c.x.pdf", "a.epub", " (2).pdf", "a (1).pdf"]
    for turn in range(4):
        wanted, taken = [(i, rng.choice(names)) for i in range(60)], rng.sample(names, turn)
        had, want = set(taken), {}
        for i, n in wanted:
            stem, dot, ext = n.rpartition(".") if "." in n else (n, "", "")
            unique, k = n, 2
            while unique in had:
                unique, k = f"{stem} ({k}){dot}{ext}", k + 1
            had.add(unique)
            want[i] = unique
        others = spark.createDataFrame([(n,) for n in taken], "name string")
        got = {r["id"]: r["unique"] for r in C.unique_names(spark.createDataFrame(wanted, "id long, name string"), others).collect()}
        assert got == want


def test_admission_of_many_requests_of_one_slot(spark):
    rng = random.Random(8)
    rows = [(i % 2 if i < 50 else 7, i, t := float(rng.randint(0, 5000)), t + rng.randint(0, 30)) for i in range(5000)]
    want, busy = {}, {}
    for slot, job, start, end in sorted(rows, key=lambda r: (r[2], r[1])):
        want[job] = start >= busy.get(slot, float("-inf"))
        if want[job]:
            busy[slot] = end
    got = C.admitted_jobs(spark.createDataFrame(rows, "slot int, job_id long, start double, end double"))
    assert {r["job_id"]: r["admitted"] for r in got.collect()} == want


# 2.10


def test_stages_keep_each_rows_outcome(spark):
    rows = [(1, ["tool", "ok"], 1.0), (2, ["tool", "flaky"], 1.0), (3, ["tool", "drm"], 1.0), (4, ["tool", "never"], 1.0)]

    def runner(argv, timeout, seen={}):  # noqa: B006
        seen[argv[1]] = seen.get(argv[1], 0) + 1
        if argv[1] == "ok" or (argv[1] == "flaky" and seen["flaky"] > 1):
            return 0, b"out", ""
        return 1, b"", "protected by DRM" if argv[1] == "drm" else ""

    stage = E.command_stage("render", runner=runner)
    got = E.apply_stage(spark.createDataFrame(rows, "doc_id long, argv array<string>, timeout double"), stage, retries=2, final=lambda m: "DRM" in m).collect()
    assert sorted((r["doc_id"], r["ok"], r["attempts"], r["message"], r["output"] and bytes(r["output"])) for r in got) == [(1, True, 1, "", b"out"), (2, True, 2, "", b"out"), (3, False, 1, "protected by DRM", None), (4, False, 3, "exit code 1", None)]


@pytest.mark.parametrize(("argv", "code", "said"), [(["true"], 0, ""), (["sleep", "5"], 124, "timeout"), (["no-such-tool"], 127, "not found")])
def test_commands(argv, code, said):
    got = E.run_command(argv, 0.2)
    assert got[0] == code and got[2].startswith(said)


def test_reading_order_takes_few_rounds_and_no_python(spark, monkeypatch, capsys):
    """Three columns of two hundred lines under a heading: rounds grow with nesting, not with lines."""
    rows = [(1, 0, "h", 0.0, 0.0, 500.0, 12.0, False, 10.0)] + [(1, 0, f"{c}-{i:03}", 180.0 * c, 40.0 + 14 * i, 180.0 * c + 120 + i % 7, 50.0 + 14 * i, False, 10.0) for i in range(200) for c in range(3)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, page int, tag string, x0 double, y0 double, x1 double, y1 double, vertical boolean, body double")
    rounds, written = [], ST.written

    def counted(df, name):
        df.explain()
        rounds.append(capsys.readouterr().out)
        return written(df, name)

    monkeypatch.setattr(ST, "written", counted)
    got = [r["tag"] for r in ST.reading_order(df).orderBy("ord").collect()]
    assert got == ["h"] + [f"{c}-{i:03}" for c in range(3) for i in range(200)]
    assert len(rounds) <= 5 and not any(x in plan for plan in rounds for x in ("Python", "Pandas", "Arrow"))


def test_one_book_over_all_tasks(spark):
    """A book that is the whole table, with runs of drifting sizes, blank units and small chapters: the scan is the fold."""
    rng, units, page = random.Random(9), [], 1
    for i in range(2500):
        page += rng.random() < 0.1
        kind = rng.choice(["text"] * 30 + ["image"])
        text = rng.choice(["some words", "他说。", "「好", "  ", "", "ends. "]) if kind == "text" else None
        units.append((7, page, i, kind, text, len(text or ""), rng.choice([10.0] * 20 + [9.2, 10.9, 12.0]) if i % 500 > 100 else rng.choice([9.0, 10.0, 11.0]), 10.0, 1, rng.random() < 0.01, rng.randint(1, 3), None, False, rng.random() < 0.03, rng.random() < 0.97, None, False, 5.0))
    schema = "doc_id long, page int, ord int, kind string, text string, nchars int, size double, body double, n_runs int, heading boolean, ladder_level int, toc_level int, has_toc boolean, indented boolean, full boolean, align string, vertical boolean, gap double"
    df = spark.createDataFrame(units, schema)
    for cap in (300, 5_000, 10**9):
        want = sorted(map(tuple, ST.build_paragraphs(df, cap).collect()))
        assert sorted(map(tuple, ST.scanned_paragraphs(df, cap, parts=8).collect())) == want
    rows = R.Ranges(df, ["doc_id"], ["page", "ord"], 8).rows.groupBy("part").count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 700


def test_scans_over_ranges(spark):
    """Each kind of scan against plain windows; groups over many parts, and many groups in a part."""
    rng = random.Random(10)
    df = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, rng.randrange(50)]), i, rng.choice([None, rng.randrange(-5, 9)])) for i in range(800)], "g long, i long, x long")
    r = R.Ranges(df, ["g"], ["i"], 9)
    got = r.scan(r.rows, s=("sum", F.col("x")), m=("min", F.col("x")), b=("before", F.col("x")), l=("last", F.col("x")), n=("next", F.col("x")))
    w = Window.partitionBy("g").orderBy("i")
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select("g", "i", "x", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"), F.min("x").over(w).alias("m"), F.lag("x").over(w).alias("b"), F.last("x", True).over(w).alias("l"), F.first("x", True).over(ahead).alias("n"))
    assert sorted(map(str, got.drop("part").collect())) == sorted(map(str, want.collect()))


def test_clusters_of_a_hundred_thousand_runs(spark):
    """One block of two columns of lines, and strays: found in a sweep, with few pairs looked at."""
    n = 50_000
    rows = spark.range(2 * n).selectExpr("1L AS doc_id", "1 AS page", "0 AS block", "cast(id AS int) AS run", "false AS vertical", "10D AS size", f"(id div {n}) * 300D AS x0", f"(id % {n}) * 12D AS y0", f"(id div {n}) * 300D + 200 AS x1", f"(id % {n}) * 12D + 10 AS y1")
    far = spark.createDataFrame([(1, 1, 0, 2 * n, False, 10.0, 0.0, -100.0, 200.0, -90.0)], rows.schema)
    got = SP.clusters(rows.union(far)).groupBy("cluster").count().collect()
    assert {(r["cluster"], r["count"]) for r in got} == {(0, n), (n, n), (2 * n, 1)}
    begin = np.arange(n) * 12.0
    assert sum(len(i) for i, _ in SP.swept(begin, begin + 35, 1000)) <= 3 * n


def test_joins_below_a_page(spark):
    """Images, bookmarks and columns' links by strips, against all pairs of a page."""
    rng = random.Random(12)
    near = lambda v: v + rng.choice([0.0, 1.9, 2.0, 2.1, -2.0, -2.5])
    images = [(1, p, k, 100 + k, *b[:4]) for p in range(6) for k, b in enumerate(boxes(rng, 8))]
    placed = [(1, p, i, *(near(v) for v in b)) for i, (_, p, _, _, *b) in enumerate(images + images)]
    box = "x0 double, y0 double, x1 double, y1 double"
    got = {(r["page"], r["p"]): r["xref"] for r in SP.image_references(spark.createDataFrame(placed, f"doc_id long, page int, p int, {box}"), spark.createDataFrame(images, f"doc_id long, page int, k int, xref int, {box}")).collect()}
    want = {}
    for _, p, i, *b in placed:
        hits = [x for _, q, k, x, *c in images if p == q and all(abs(u - v) <= 2 for u, v in zip(b, c, strict=True))]
        if hits:
            want[p, i] = hits[0]
    assert got == want and len(want) > 10
    units = [(1, p, o, *b[:4]) for p in range(6) for o, b in enumerate(boxes(rng, 7))]
    toc = [(1, i, p := rng.randrange(8), p % 2 == 0, float(rng.randint(0, 260)), float(rng.randint(0, 220)), 3.0) for i in range(120)]
    got = {r["idx"]: r["ord"] for r in SP.bookmark_units(spark.createDataFrame(toc, "doc_id long, idx long, page int, vertical boolean, x double, y double, tolerance double"), spark.createDataFrame(units, f"doc_id long, page int, ord int, {box}")).collect()}
    want = {}
    for _, i, p, vertical, x, y, t in toc:
        own = [(o, *b) for _, q, o, *b in units if p == q]
        hit = [o for o, x0, y0, x1, y1 in own if x0 - 2 <= x <= x1 + 2 and y0 - 2 <= y <= y1 + 2]
        past = [o for o, x0, y0, x1, y1 in own if (x0 <= x + t if vertical else y1 >= y - t)]
        want[i] = (hit or past or [u[0] for u in own] or [None])[0]
    assert got == want
    runs = [(1, p, r, rng.random() < 0.8, s, *b) for p in range(6) for r, (*b, s) in enumerate(boxes(rng, 12))]
    links = [(1, p, k, f"h{k}", *b[:4]) for p in range(6) for k, b in enumerate(boxes(rng, 8))]
    none = spark.createDataFrame([], "doc_id long, page int, k int")
    found = SP.link_columns(spark.createDataFrame(runs, f"doc_id long, page int, run int, vertical boolean, size double, {box}"), spark.createDataFrame(links, f"doc_id long, page int, k int, href string, {box}"), none).collect()
    want = {}
    for _, p, k, _, x0, y0, x1, y1 in links:
        fits = [(abs((a + c) / 2 - (x0 + x1) / 2), r) for _, q, r, v, s, a, b, c, d in runs if q == p and v and lap(y0, y1, b, d) >= 0.6 * (y1 - y0) and abs((a + c) / 2 - (x0 + x1) / 2) <= 3 * s]
        if fits:
            want[p, k] = min(fits)[1]
    assert {(r["page"], r["k"]): r["run"] for r in found} == want


def test_texts_of_paragraphs_move_once(spark, capsys):
    """A paragraph over many stretches of pages, drifting sizes among them; texts lie in buckets, and no exchange is by paragraph."""
    schema = "doc_id long, page int, ord int, kind string, text string, nchars int, size double, body double, n_runs int, heading boolean, ladder_level int, toc_level int, has_toc boolean, indented boolean, full boolean, align string, vertical boolean, gap double"
    rows = [(d, p, o, "text", f"w{p}.{o}", 4, 10.0 + (p % 7) * 0.3 * d, 10.0, 1, p == 90 and o == 0, 1, None, False, p == 100, True, None, False, 5.0) for d in (0, 1) for p in range(7 * ST.STRETCH) for o in range(2)]
    df = spark.createDataFrame(rows, schema)
    for cap in (700, 10**9):
        got = ST.scanned_paragraphs(df, cap, parts=5)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ST.build_paragraphs(df, cap).collect()))
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan and not any("para#" in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line)


def test_clusters_of_many_blocks_in_one_call(spark, capsys):
    """Blocks share calls of Python, and one may lie across the batches of a task."""
    rng, rows = random.Random(12), []
    for d in range(120):
        for run in range(rng.choice([1, 3, 40])):
            x, y = rng.random() * 100, rng.random() * 300
            rows.append((d % 30, d // 30, d % 2, run, rng.random() < 0.3, 10.0, x, y, x + 20, y + 10))
    schema = "doc_id long, page int, block int, run int, vertical boolean, size double, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, SP.clusters(df, 2).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for key in {r[:3] for r in rows}:
        own = [r for r in rows if r[:3] == key]
        want += map(tuple, SP.clusters(spark.createDataFrame(own, schema), 1).collect()) if len(want) < 300 else []
    assert len(got) == len(rows) and set(want) <= set(got)
    capsys.readouterr()
    SP.clusters(df).explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
