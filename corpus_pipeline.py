"""The corpus pipeline: documents in, clean documents as piece ids out.

Each stage reads what its predecessor kept, as a Parquet table, and calls one operator of parchment.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import pii_rules, quality_qda, sentence_pieces
from parchment.llm.common import table, written
from parchment.llm.minhash_dedup import near_duplicates
from parchment.llm.tiling_decontamination import clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under the threshold go; learned from all labels of documents."""
    stats = written(quality_qda.document_statistics(docs), "stats")
    return quality_qda.kept(docs, quality_qda.fit(stats, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8) the document with the smallest id stays; of rows that repeat an id all or none."""
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; each row is judged by its own text, so null and repeated ids are no exception."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kinds in brackets; n_chars is that of the new text."""
    return pii_rules.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece ids and their number, and whether they decode to the text."""
    out = sentence_pieces.encoded_and_checked(docs)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [("quality_qda", quality), ("minhash_dedup", dedup), ("tiling_decontamination", decontaminate), ("pii_rules", pii), ("sentence_pieces", pieces)]
#: SQL cannot state the classifier's fit or the piece search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
