import io
import os
import pickle
import time
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.operators import convert, structure
from folio.operators.convert import converted_books, ordered_units
from folio.operators.package import merge_chapters, split_chapters
from folio.sources import archives
from folio.sources.archives import _Reader, _Writer, read_archives, register, write_archives


WRITTEN = StructType().add("name", "string").add("entry", "string").add("body", "binary").add("stored", "boolean")


@pytest.fixture
def entries(spark):
    return spark.range(40).selectExpr("concat('b', id div 4, '.epub') AS name", "cast(id % 4 AS int) AS ord", "concat('e', id % 4, '.txt') AS entry", "encode(repeat(concat('x', id), 100), 'UTF-8') AS body", "id % 4 = 0 AS stored")


def test_archives_come_back_as_they_went(spark, entries, tmp_path):
    write_archives(entries, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [f"b{i}.epub" for i in range(10)]
    with zipfile.ZipFile(tmp_path / "b3.epub") as z:
        assert [(i.filename, i.compress_type) for i in z.infolist()] == [("e0.txt", zipfile.ZIP_STORED), ("e1.txt", zipfile.ZIP_DEFLATED), ("e2.txt", zipfile.ZIP_DEFLATED), ("e3.txt", zipfile.ZIP_DEFLATED)]
    got = read_archives(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.select("name", "ord", "entry", "body").collect())) == sorted(map(tuple, entries.select("name", "ord", "entry", "body").collect()))
    first = (tmp_path / "b3.epub").read_bytes()
    write_archives(entries, str(tmp_path))  # the same bytes again
    assert (tmp_path / "b3.epub").read_bytes() == first


def test_filters_and_columns_reach_the_archives(spark, entries, tmp_path, capsys):
    write_archives(entries, str(tmp_path))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    some = read_archives(spark, str(tmp_path), name=["b1.epub", "b2.epub"], entry="e1*").where("size > 3")
    assert sorted((r["name"], r["entry"], len(r["body"])) for r in some.collect()) == [("b1.epub", "e1.txt", 200), ("b2.epub", "e1.txt", 200)]
    some.explain("formatted")
    plan = capsys.readouterr().out
    assert "In(name, [b1.epub,b2.epub])" in plan and "StringStartsWith(entry,e1)" in plan
    names = read_archives(spark, str(tmp_path), "name string, entry string")
    names.explain("formatted")
    assert "ReadSchema: struct<name:string,entry:string>" in capsys.readouterr().out
    assert names.count() == 41 and names.where("entry IS NULL").collect()[0]["name"] == "bad.epub"


def test_archives_share_partitions_by_their_bytes(spark, entries, tmp_path):
    write_archives(entries, str(tmp_path))
    register(spark)
    size = sum(os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path))
    read = lambda n: spark.read.format("archives").option("partitionBytes", n).load(str(tmp_path)).rdd.getNumPartitions()
    assert (read(1), read(size), 3 <= read(size // 3) <= 5) == (10, 1, True)


def test_broken_archives(spark, tmp_path):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a", b"text" * 50)
        z.writestr("b", b"other")
    whole = sink.getvalue()
    (tmp_path / "damaged.epub").write_bytes(whole.replace(b"texttext", b"taxttext", 1))
    (tmp_path / "cut.epub").write_bytes(whole[:60])
    (tmp_path / ".hidden").write_bytes(whole)
    (tmp_path / "empty.epub").write_bytes(b"")
    got = {(r["name"], r["entry"]): (r["error"], r["body"]) for r in read_archives(spark, str(tmp_path)).collect()}
    assert got == {("cut.epub", None): ("no archive", None), ("empty.epub", None): ("no archive", None), ("damaged.epub", "a"): ("damaged", None), ("damaged.epub", "b"): (None, bytearray(b"other"))}


@pytest.mark.parametrize("fault", ["raise_error('boom')", "concat('x/', name)"])
def test_a_failed_task_leaves_no_file(spark, entries, tmp_path, fault):
    bad = entries.withColumn("name", F.when(F.col("name") == "b7.epub", F.expr(fault)).otherwise(F.col("name")))
    with pytest.raises(Exception, match="boom|is no name"):
        write_archives(bad, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_rows_that_dont_lie_together(spark, entries, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="don't lie together"):
        entries.repartition(4, "ord").select("name", "entry", "body").write.format("archives").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_overwritten_folders(spark, entries, tmp_path):
    write_archives(entries, str(tmp_path))
    entries.where("name = 'b1.epub'").withColumn("name", F.lit("new.epub")).coalesce(1).select("name", "entry", "body").write.format("archives").mode("overwrite").save(str(tmp_path))
    assert os.listdir(tmp_path) == ["new.epub"]


def test_filters_of_one_relation_stay_apart(spark, entries, tmp_path):
    """What one plan pushes to a relation isn't held against another plan of it."""
    write_archives(entries, str(tmp_path))
    for e in (read_archives(spark, str(tmp_path), "name string, entry string"), read_archives(spark, str(tmp_path), "name string, entry string", name="*.epub")):
        assert e.where("entry = 'e1.txt'").count() == 10 and e.count() == 40
        both = e.where("entry = 'e1.txt'").groupBy("name").count().join(e.where("entry = 'e2.txt'").groupBy("name").agg(F.max("entry").alias("other")), "name")
        assert {r["other"] for r in both.collect()} == {"e2.txt"} and both.count() == 10
        assert e.where("entry = 'e1.txt'").union(e.where("entry = 'e2.txt'")).distinct().count() == 20


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_chapters_split_and_merged(spark, size):
    """Numbers grow past four digits, links lead into other chunks, and what is no link to a chapter stays."""
    text = lambda d, c: f'<a href="chapter{c + 1:04d}.xhtml#p">x</a> chapter0001.xhtml <img src="chapter0001.xhtml"/><a href="../text/chapter{max(c - 2, 0):04d}.xhtml">é</a><a href="http://x/#chapter0003.xhtml">y</a>'
    rows = [(d, c, text(d, c)) for d, n in ((1, 7), (2, 1), (3, 2)) for c in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, chapter long, xhtml string")
    chunks = split_chapters(df, size)
    assert chunks.agg(F.max("chapter")).first()[0] == min(size, 7) - 1
    got = sorted((r["doc_id"], r["chapter"], r["xhtml"], r["id"], r["href"], r["chunk"]) for r in merge_chapters(chunks.select("doc_id", "chunk", "chapter", "xhtml")).collect())
    assert got == [(d, c, t, f"c{c}", f"text/chapter{c:04d}.xhtml", c // size) for d, c, t in rows]


def test_writing_many_archives_takes_time_in_proportion(tmp_path):
    """What a task does for an archive doesn't grow with those that it has written."""

    def seconds(n: int) -> float:
        batch = pa.RecordBatch.from_pydict({"name": [f"b{i}" for i in range(n)], "entry": ["e"] * n, "body": [b"x"] * n, "stored": [True] * n})
        begin = time.process_time()
        assert len(_Writer(str(tmp_path / str(n)), WRITTEN, False).write(iter([batch])).files) == n
        return time.process_time() - begin

    assert seconds(16_000) < 8 * seconds(4_000)


def test_texts_move_once_to_where_their_places_are(spark, capsys):
    """Units and their places meet in one exchange, with whatever columns the units have; a page read in columns, another with nothing."""
    box = [(40.0, 100.0), (200.0, 260.0)]
    rows = [(d, p, f"t{k}", f"text {d} {p} {k}", box[k % 2][0], 20.0 * (k // 2), box[k % 2][1], 20.0 * (k // 2) + 10, False, 10.0) for d in range(2) for p in (0, 17) for k in range(6)]
    units = spark.createDataFrame(rows, "doc_id long, page int, tag string, text string, x0 double, y0 double, x1 double, y1 double, vertical boolean, body double")
    got = ordered_units(units, 3)
    seen = {(r["doc_id"], r["page"], r["tag"]): (r["ord"], r["gap"], r["text"]) for r in got.collect()}
    assert len(seen) == len(rows) and all(seen[d, p, f"t{k}"] == (k // 2 + 3 * (k % 2), {0: 0.0, 1: -50.0}.get(k, 10.0), f"text {d} {p} {k}") for d in range(2) for p in (0, 17) for k in range(6))
    capsys.readouterr()
    got.explain()
    assert not any("tag#" in line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in line)


def test_rows_of_stretches_and_books_are_not_sent_whole(spark, monkeypatch, capsys):
    """Their files are small at any size, their rows aren't: no step of the conversion makes a broadcast of them."""
    rows = [(d, p, f"t{k}", "text", f"Text {d} {p} {k}.", 12, 10.0, 10.0, 1, k == 0 and p == 0, 1, None, False, k == 1, True, None, False, 40.0, 20.0 * k, 200.0, 20.0 * k + 10) for d in range(3) for p in range(0, 80, 8) for k in range(4)]
    units = spark.createDataFrame(
        rows, "doc_id long, page int, tag string, kind string, text string, nchars int, size double, body double, n_runs int, heading boolean, ladder_level int, toc_level int, has_toc boolean, indented boolean, full boolean, align string, vertical boolean, x0 double, y0 double, x1 double, y1 double")
    books = spark.range(3).selectExpr("id AS doc_id", "'Book ' || id AS title", "'en' AS lang", "false AS vertical", "'u' AS uid", "'2020-01-01T00:00:00Z' AS modified")
    written, plans = structure.written, []

    def seen(df, name):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return written(df, name)

    monkeypatch.setattr(structure, "written", seen)
    monkeypatch.setattr(convert, "written", seen)
    entries = converted_books(books, units, parts=4)
    got = {(r["doc_id"], r["name"]) for r in entries.collect()}
    assert {(d, "OEBPS/text/chapter0000.xhtml") for d in range(3)} <= got
    entries.select("body").explain()
    plans.append(capsys.readouterr().out)
    assert len(plans) > 5
    # ids alone of books to fold again, and what has no rows, may be sent
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and "LeftSemi" not in line and "LeftAnti" not in line]
    assert not [line for line in sent if "stretch" in line] and len(sent) <= 2, sent


def test_archives_in_folders(spark, entries, tmp_path):
    """They come back as flat ones do; conditions on names hold; what has not committed or was overwritten isn't there."""
    write_archives(entries, str(tmp_path), folders=True)
    (job,) = os.listdir(tmp_path)
    (tmp_path / job / "left-by-a-failed-attempt").mkdir()
    (tmp_path / "_job-open" / "a" / "0").mkdir(parents=True)
    (tmp_path / "_job-open" / "a" / "0" / "no.epub").write_bytes(b"")
    (tmp_path / "flat.epub").write_bytes(b"no archive")
    got = read_archives(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.where("error IS NULL").select("name", "ord", "entry", "body").collect())) == sorted(map(tuple, entries.select("name", "ord", "entry", "body").collect()))
    assert [r["name"] for r in got.where("error IS NOT NULL").collect()] == ["flat.epub"]
    some = read_archives(spark, str(tmp_path), name=["b1.epub", "b2.epub"], entry="e1*")
    assert sorted((r["name"], r["entry"], len(r["body"])) for r in some.collect()) == [("b1.epub", "e1.txt", 200), ("b2.epub", "e1.txt", 200)]
    more = entries.withColumn("name", F.concat(F.lit("new-"), "name"))
    write_archives(more, str(tmp_path), folders=True)
    assert read_archives(spark, str(tmp_path), "name string, entry string").where("entry IS NOT NULL").count() == 80
    more.repartition("name").sortWithinPartitions("name").select("name", "entry", "body").write.format("archives").option("folders", True).mode("overwrite").save(str(tmp_path))
    assert {r["name"] for r in read_archives(spark, str(tmp_path), "name string").collect()} == {f"new-b{i}.epub" for i in range(10)}


def test_failed_jobs_of_folders(spark, entries, tmp_path):
    bad = entries.withColumn("name", F.when(F.col("name") == "b7.epub", F.expr("raise_error('boom')")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="boom"):
        write_archives(bad, str(tmp_path), folders=True)
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="don't lie together"):
        entries.repartition(4, "ord").select("name", "entry", "body").write.format("archives").option("folders", True).mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
    write_archives(entries.where("false"), str(tmp_path), folders=True)
    assert read_archives(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("held", [1 << 21, 100])
def test_what_the_driver_has_of_archives_grows_with_their_folders(tmp_path, monkeypatch, held):
    monkeypatch.setattr(archives, "HELD", held)
    monkeypatch.setattr(archives, "FOLDER_ARCHIVES", 500)
    w = _Writer(str(tmp_path), WRITTEN, False, True)
    batch = lambda low, high: pa.RecordBatch.from_pydict({"name": [f"b{i}" for i in range(low, high)], "entry": ["e"] * (high - low), "body": [b"x"] * (high - low), "stored": [True] * (high - low)})
    messages = [w.write(iter([batch(k * 1000, k * 1000 + 1000)])) for k in range(4)]
    assert max(len(pickle.dumps(m)) for m in messages) < 1000
    w.commit([*messages, None])
    r = _Reader(str(tmp_path), StructType().add("name", "string"), 1 << 40, [])
    (part,) = r.partitions()
    assert len(part.folders) == 8 and len(pickle.dumps(part)) < 2000
    assert sorted(n for b in r.read(part) for n in b.column(0).to_pylist()) == sorted(f"b{i}" for i in range(4000))
    again = _Writer(str(tmp_path / "other"), WRITTEN, False, True)
    with pytest.raises(ValueError, match="don't lie together"):
        again.commit([again.write(iter([batch(0, 1000)])), again.write(iter([batch(999, 1500)]))])
    assert not os.listdir(tmp_path / "other")
