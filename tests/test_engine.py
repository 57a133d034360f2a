import io
import random
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from folio.functions import scripts as S
from folio.functions.text import nfkc
from folio.operators import layout as L
from folio.operators import structure as ST
from folio.plans.fixtures import book_entries
from folio.sources.files import archive_entries, book_files, write_archives
from folio.streaming.folds import script_totals


def counted(text):
    """The counters by a loop, from their definition."""
    c = dict.fromkeys(S.COUNTERS, 0)
    inside = lambda x, *rs: any(a <= ord(x) <= b for a, b in rs)
    for x in text:
        if x.isspace():
            continue
        c["total"] += 1
        if inside(x, (0xE000, 0xF8FF), (0xF0000, 0x10FFFD)):
            c["pua"] += 1
        elif inside(x, (0x3040, 0x30FF), (0x31F0, 0x31FF)):
            c["kana"] += 1
        elif inside(x, (0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)):
            c["hangul"] += 1
        elif inside(x, (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2FA1F), (0xF900, 0xFAFF)):
            c["han"] += 1
            c["simplified"] += x in S.SIMPLIFIED[1:-1]
            c["traditional"] += x in S.TRADITIONAL[1:-1]
        elif x.isalpha():
            c["latin"] += 1
    return c


def test_script_counts_against_a_loop(spark):
    random.seed(1)
    letters = "aéЖㄅｑ 　\t\x1c1.們们国國猫あアー한ᄀ\U000f0001\U00020001ﾟ"
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for r in df.select("id", *S.script_counts(F.col("text"))).collect():
        assert {k: r[k] for k in S.COUNTERS} == counted(texts[r["id"]])


def test_private_use_fraction(spark):
    df = spark.createDataFrame([(1, "中")], "id long, text string")
    assert df.select(*S.script_counts(F.col("text"))).select(S.pua_fraction().alias("f")).first()["f"] == 0.75


def test_nfkc_and_nulls(spark):
    rows = spark.createDataFrame([(1, "ＸＩＶ"), (2, None)], "id long, t string").select("id", nfkc(F.col("t")).alias("n")).orderBy("id").collect()
    assert [r["n"] for r in rows] == ["XIV", None]


def test_each_glyph_in_one_run(spark, sf):
    lines = L.grid_lines(spark.read.parquet(f"{sf}/documents.parquet").limit(20))
    glyphs = L.glyphs(lines)
    parts = L.gap_runs(glyphs)
    assert parts.count() == glyphs.count() == lines.select(F.sum(F.length("text"))).first()[0]


def test_lines_split_where_they_lie(spark, capsys):
    """The same runs as by windows over glyphs, of blanks, wide gaps and characters of any length, without a shuffle."""
    r = random.Random(4)
    rows = [(i // 9, i // 3 % 3, i % 3, "".join(r.choices("ab é中😀 \u3000\t\u00a0", k=r.randint(0, 30))), r.choice([0.1, 5.0, 10.0])) for i in range(300)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line int, text string, size double").withColumns({"y0": F.lit(0.0), "y1": F.lit(1.0)})
    shift = lambda pos: F.floor(pos / 4) * 30
    g = L.glyphs(lines).withColumns({"x0": F.col("x0") + shift(F.col("pos")), "x1": F.col("x1") + shift(F.col("pos"))})
    want = L.run_boxes(L.gap_runs(g))
    edges = lambda pos, size: (40 + pos * size / 2 + pos // 4 * 30, 40 + (pos + 1) * size / 2 + pos // 4 * 30)
    got = L.line_runs(lines, edges)
    near = lambda df: sorted((*x[:4], round(x[4], 6), round(x[5], 6), x[6]) for x in map(tuple, df.collect()))
    assert near(got) == near(want) and len(near(got)) > 300
    got.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_nav_levels_step_by_one_at_most(spark):
    random.seed(2)
    rows = [(i, [random.randint(1, 6) for _ in range(random.randint(1, 9))]) for i in range(50)]
    for r in spark.createDataFrame(rows, "id long, levels array<int>").select(ST.clamped_levels(F.col("levels")).alias("c")).collect():
        assert r["c"][0] == 1 and all(b <= a + 1 for a, b in zip(r["c"], r["c"][1:], strict=False))


def test_reading_order_keeps_every_unit(spark):
    random.seed(3)
    rows = [(1, p, f"u{i}", float(x := random.randint(0, 400)), float(y := random.randint(0, 600)), x + 30.0, y + 12.0, p % 2 == 0, 10.0) for p in range(4) for i in range(25)]
    got = ST.reading_order(spark.createDataFrame(rows, "doc_id long, page int, tag string, x0 double, y0 double, x1 double, y1 double, vertical boolean, body double")).toPandas()
    assert sorted(got.groupby("page")["ord"].apply(lambda s: sorted(s) == list(range(25)))) == [True] * 4


def test_package_is_sound(spark, tmp_path):
    row = write_archives(book_entries(spark)).where("doc_id = 1").first()
    (tmp_path / "book.epub").write_bytes(row["content"])
    with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        import xml.etree.ElementTree as ET

        opf = ET.fromstring(z.read("OEBPS/content.opf"))
        hrefs = [e.get("href") for e in opf.iter() if e.tag.endswith("}item")]
        ids = {e.get("id") for e in opf.iter() if e.tag.endswith("}item")}
        assert all(f"OEBPS/{h}" in z.namelist() for h in hrefs)
        assert all(e.get("idref") in ids for e in opf.iter() if e.tag.endswith("}itemref"))
        for n in z.namelist():
            if n.endswith((".xhtml", ".opf", ".xml", ".ncx")):
                ET.fromstring(z.read(n))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    files = book_files(spark, str(tmp_path), content=True)
    assert {(r["name"], r["entry"]) for r in archive_entries(files).where("ord = 0 OR ord IS NULL").collect()} == {("book.epub", "mimetype"), ("bad.epub", None)}


def test_script_totals_stream_like_a_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    docs.write.parquet(str(tmp_path / "in"))
    q = script_totals(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT * FROM totals").toPandas().sort_values("doc_id", ignore_index=True)
    finally:
        q.stop()
    want = script_totals(docs).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want)
