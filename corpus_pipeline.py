"""A training corpus in five stages: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
gives what it reads back to the next stage. The first four return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.blocks import NO_ID, documents, unused
from wardlight.llm.decontaminate import contamination
from wardlight.llm.ngram_join import similar_documents
from wardlight.llm.packing import pack_documents
from wardlight.llm.quality import score_quality
from wardlight.llm.secret_scan import redact, scan
from wardlight.llm.tokens import byte_vocabulary
from wardlight.session import materialize, scratch_path


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a name of each row's doc_id and text, by which decisions come back to the rows they were made for, in a column that ``docs`` does not have."""
    row = unused(docs.columns, "__row")
    return docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier takes for good ones; rows without a doc_id are kept with no label to judge them by."""
    rows, row = keyed(docs)
    scored = score_quality(rows.select("doc_id", "text", row), documents(spark, sf_dir, "labels"), key=row)
    rejected = scored.where("predicted = 0 and doc_id is not null").select("doc_id", row).distinct()
    return rows.join(rejected, ["doc_id", row], "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links connect, one with the smallest doc_id; null ids come last.

    Rows with one doc_id and one text become one, other rows of a doc_id are judged each. Rows without a doc_id and without words are all kept.
    """
    blank = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows, row = keyed(docs)
    rows = rows.where(~blank)
    judged = rows.select(F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row"), "text")
    groups = similar_documents(judged.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id").distinct()
    ids = judged.select("row", F.coalesce("id", F.lit(int(NO_ID))).alias("id")).distinct()
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias(row)).distinct()
    once = rows.join(kept, row, "left_semi").dropDuplicates(["doc_id", row])
    return once.select(docs.columns).unionByName(docs.where(blank)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = contamination(docs, documents(spark, sf_dir, "benchmark"), prefix=prefix)
    return found.where(~F.col(f"{prefix}contaminated")).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the new text."""
    name = unused(docs.columns, "__findings")
    found = scan(docs, scratch_path(spark, "pipeline-ledger"), name=name)
    text = redact(F.col("text"), F.col(name))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs, byte_vocabulary(), window=2048, end=1)


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
    ("secret scans", secrets), ("packing", packing),
]

# A classifier and a packing of tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
