"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Null, empty and repeated rows pass each stage as its operator says; columns of any name stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import fresh, quoted, shared_folder, table
from folio.llm.op05_line_dedup import remove_repeated_lines
from folio.llm.op06_simhash import similar_documents
from folio.llm.op07_mixing import mixed
from folio.llm.op09_packing import pack_documents
from folio.llm.op10_quality import score_documents, trained

REJECT_BELOW = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at 0.3 or more; it learns from labelled rows that aren't held out. A null or empty text has a
    score like any other; without labels all documents have one score, 0.5, and stay."""
    scored = score_documents(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(quoted(scored.columns)[-1]) >= REJECT_BELOW).select(*quoted(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document that loses all its lines goes, one that had none stays."""
    cut = remove_repeated_lines(docs)
    left = cut.where((F.col(quoted(cut.columns)[-1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id, with all rows of that id;
    null and empty texts are copies of one another; rows without an id stay."""
    groups = similar_documents(docs)
    least = groups.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    name = fresh(docs, "gone_id__")
    gone = least.where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of documents whose tokens meet the target shares of sources, languages and topics."""
    out = mixed(docs)
    return out.where(F.col(quoted(out.columns)[-1])).select(*quoted(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, by piece; a null or empty text is one piece of its end token."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Training, lines to compare, fingerprints and token ids are beyond SQL; tests/llm holds each stage and run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over documents; what lies between them goes to the shared folder, and a stage's input is deleted once its output
    stands. With a folder of one's own a rerun takes up the last stage that was finished there."""
    top = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = [f"{top}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k for k, p in enumerate(at) if files.exists(path(f"{p}/_SUCCESS"))), default=-1)
    docs = table(spark, sf_dir, "documents") if done < 0 else spark.read.parquet(at[done])
    for k, (_, stage) in list(enumerate(STAGES))[done + 1 :]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at[k])
        docs = spark.read.parquet(at[k])
        if k:
            files.delete(path(at[k - 1]), True)
    return docs
