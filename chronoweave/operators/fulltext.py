"""Full-text index: a table of (term, doc, count) with document lengths, scored by BM25."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class TextIndex:
    postings: DataFrame  # term, id, tf
    lengths: DataFrame  # id, length

    def save(self, path: str) -> None:
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")

    @classmethod
    def load(cls, spark, path: str) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def build(df: DataFrame, key: str, text: str) -> TextIndex:
    words = df.select(F.col(key).alias("id"), terms(F.col(text)).alias("ts"))
    postings = words.select("id", F.explode("ts").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return TextIndex(postings, words.select("id", F.size("ts").cast("bigint").alias("length")))


def search(index: TextIndex, query: str, most: int = 10, k1: float = 1.2, b: float = 0.75, every: bool = False) -> DataFrame:
    """id, score of the best rows for the query's words (every: those that have all). Only postings of those words are read."""
    wanted = sorted({w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split()})
    found = index.postings.where(F.col("term").isin(wanted))
    stats = index.lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    scored = found.join(F.broadcast(df), "term").join(index.lengths, "id").join(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    out = scored.groupBy("id").agg(F.sum(idf * tf).alias("score"), F.count("*").alias("hits"))
    if every:
        out = out.where(F.col("hits") == len(wanted))
    return out.select("id", "score").orderBy(F.desc("score"), "id").limit(most)
