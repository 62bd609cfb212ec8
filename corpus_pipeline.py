"""Corpus pipeline: from documents to a mixed, tokenised training corpus.

Each stage is one operator of vistaspark.llm over all that its predecessor kept,
and its decisions take effect: rejected documents, shared lines and near copies
go, sources are mixed to their targets, and what is left becomes tokens.

All stages: null and empty texts are texts without words; texts of any length are
taken whole; an empty table gives an empty table; columns beside those of
documents come along, whatever their names, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.llm import bpe, jaccard, line_dedup, mixing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands.

    Rows stand alone: repeated rows share their fate.  Texts without words go.
    """
    # Columns go by number meanwhile, so that none is taken for a new one.
    held = {c: f"__c{k}" for k, c in enumerate(docs.columns) if c != "text"}
    judged = quality.quality_rules(docs.withColumnsRenamed(held)).where("kept")
    return judged.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; n_chars follows the text.

    Rows equal in id and text are one document and all stay.  Null becomes the empty text.
    """
    held = {c: f"__c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    kept = line_dedup.drop_shared_lines(docs.withColumnsRenamed(held))
    new = {"text": F.col("line_kept"), "n_chars": F.length("line_kept").cast("long")}
    return kept.select(*[new.get(c, F.col(held.get(c, c))).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: one with the smallest id.

    Texts without words link with nothing, so each row of them stays unless it
    repeats another in id and text; null ids come last.
    """
    keepers = jaccard.near_duplicates(docs).where("keeper").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    marked = docs.withColumn("__text_hash", jaccard.text_hash(F.col("text")))
    kept = marked.join(keepers, marked["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_hash"]).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice; rows that agree in id, text and source like the one taken most often."""
    taken = (
        mixing.mix(docs).where("copies > 0")
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("source").alias("__source"), "copies")
        .groupBy("__id", "__hash", "__source").agg(F.max("copies").alias("__copies"))
    )
    marked = docs.withColumn("__text_hash", mixing.text_hash(F.col("text")))
    same = marked["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")) & marked["source"].eqNullSafe(F.col("__source"))
    return marked.join(taken, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests that a decoded round trip gives; of documents' columns doc_id, source and lang stay."""
    return bpe.bpe_round_trip(docs.select("doc_id", "source", "lang", "text")).drop("text")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]

#: Compression, shuffling by hash and merges have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    from vistaspark.sources.workspace import Workspace

    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.put(docs, f"stage{k}")
    return docs
