"""Files in and out: libraries of books, archives as rows of entries, and archives from rows of entries."""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.package import package_verdict


def book_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """name, bytes, mtime of the books in a folder; their content is only read if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,epub}").load(folder)
    cols = [F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")]
    return files.select(*cols, *([F.col("content")] if content else []))


def archive_entries(files: DataFrame) -> DataFrame:
    """(name, ord, entry, body, error) of the archives in column content; what isn't one has a single row with a null entry. An entry that
    can't be read has no body and says why: encrypted or damaged."""

    def read(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        if info.flag_bits & 1:
            return None, "encrypted"
        try:
            return z.read(info), None
        except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, NotImplementedError, RuntimeError, ValueError):
            return None, "damaged"

    def unzip(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(name, i, info.filename, *read(z, info)) for i, info in enumerate(z.infolist())]
                except (zipfile.BadZipFile, TypeError, ValueError, OSError, NotImplementedError):
                    rows.append((name, None, None, None, "no archive"))
            yield pd.DataFrame(rows, columns=["name", "ord", "entry", "body", "error"]).astype({"ord": "Int32"})

    return files.select("name", "content").mapInPandas(unzip, "name string, ord int, entry string, body binary, error string")


def archive_verdicts(files: DataFrame) -> DataFrame:
    """(name, verdict): ok, or why an archive (name, content) is no readable book; an entry that the verdict needs and that can't be read is
    a verdict, too."""
    of = lambda entry, c: F.max(F.when(F.col("entry") == entry, F.col(c)))
    needed = {"mimetype": "mimetype", "container": "META-INF/container.xml", "encryption": "META-INF/encryption.xml"}
    sums = archive_entries(files).groupBy("name").agg(
        *[F.decode(of(e, "body"), "UTF-8").alias(k) for k, e in needed.items()],
        F.max(F.when(F.col("entry").isin(*needed.values()), F.concat("error", F.lit(" entry "), "entry"))).alias("broken"),
    )
    rows = files.select("name", F.substring("content", 1, 4).alias("head")).join(sums, "name")
    verdict = package_verdict(F.col("head"), F.col("mimetype"), F.col("container"), F.col("encryption"))
    return rows.select("name", F.when(F.col("broken").isNotNull(), F.col("broken")).otherwise(verdict).alias("verdict"))


def write_archives(entries: DataFrame) -> DataFrame:
    """(doc_id, content): each document's entries as one archive, in order of ord, with fixed times, so a rerun gives the same bytes."""

    def zipped(pdf: pd.DataFrame) -> pd.DataFrame:
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w") as z:
            for e in pdf.sort_values(["ord", "name"]).itertuples():
                info = zipfile.ZipInfo(e.name, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED if e.compress else zipfile.ZIP_STORED
                z.writestr(info, e.body)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [sink.getvalue()]})

    return entries.select("doc_id", "ord", "name", "body", "compress").groupBy("doc_id").applyInPandas(zipped, "doc_id long, content binary")


def merged(parts: DataFrame) -> DataFrame:
    """Pages of a document's chunks in order: (doc_id, page, chunk, chunk_page)."""
    return parts.withColumn("page", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "chunk_page")) - 1)
