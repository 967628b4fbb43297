"""A corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next stage's docs. All but the last keep the
columns of documents; a clean document goes through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoweave.llm import decontam, exact, near, tokens, toxicity
from chronoweave.llm.queries import vocabulary
from chronoweave.llm.session import documents, free_name, write_shared

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by the factorization machine is under TOXIC. It learns from the labelled rows of docs that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit(toxicity.training_rows(docs, labels))
    scored, name = toxicity.score(docs, machine)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept (key, text_key) names, one for each.

    Keys and texts identify a row; where two rows share both, one is taken.
    """
    own, k, t, n = (free_name(docs, x) for x in ("_own", "_key", "_text_key", "_n"))
    named = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    wanted = kept.groupBy("key", "text_key").agg(F.max("n").alias(n)).withColumnsRenamed({"key": k, "text_key": t})
    found = named.join(wanted, F.col("doc_id").eqNullSafe(F.col(k)) & (F.col(own) == F.col(t)))
    once = found.where(F.col(n) == 1).select(*docs.columns)
    if kept.where("n > 1").isEmpty():
        return once
    again = found.where(F.col(n) > 1).dropDuplicates(["doc_id", own]).select(*docs.columns)
    return once.unionByName(again)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id."""
    rows = write_shared(exact.dedup(docs), "exact-rows")
    count = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    return _rows_of(docs, count.where("kept").select(F.col("doc_id").alias("key"), "text_key", "n"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id (of several texts with that id, one).

    Near: 0.8 or more of the shingles of five words in common, verified.
    Documents without a doc_id stay.
    """
    rows = write_shared(near.similar_texts(docs, words=5, least=0.8), "near-rows")
    count = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id"))
    own = count.where("doc_id = component_id").groupBy("component_id").agg(F.min(F.struct("text_key", "n")).alias("t"))
    kept = own.select(F.col("component_id").alias("key"), "t.text_key", "t.n")
    unnamed = count.where("doc_id is null").select(F.col("doc_id").alias("key"), "text_key", "n")
    return _rows_of(docs, kept.unionByName(unnamed))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 ids."""
    return tokens.pack(docs, vocabulary(), most=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: None: scores, fingerprints and packing are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
