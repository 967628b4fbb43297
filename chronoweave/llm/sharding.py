"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Each shard draws a number from the record key and the shard's own number; the
record goes to the shard with the best draw. A further shard brings one more
draw and leaves the others as they were, so a record either stays or moves to
the new shard, and a share of about w_new / sum(w) moves.

The draw u in (0, 1) is the first 52 bits of md5(key:shard); the score
-w / ln(u) gives shard i the share w_i / sum(w). Ties go to the larger digest.

Null keys are a key like any other (written as \\N). Repeated keys share a
shard and have slots of their own. A null text has size 1 and the checksum of
no bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.llm.session import with_offsets, write_shared


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that key goes to, from 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit("\\N"))
    digests = F.array(*(F.md5(F.concat(text, F.lit(f":{i}"))) for i in range(len(weights))))
    if len(set(weights)) == 1:  # -w / ln(u) then has the order of the digest itself
        best = F.array_max(F.transform(digests, lambda d, i: F.struct(d.alias("d"), i.alias("i"))))
        return best["i"].cast("int")

    def scored(d: Column, i: Column) -> Column:
        u = (F.conv(F.substring(d, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), i + 1)
        return F.struct((-w / F.ln(u)).alias("s"), d.alias("d"), i.alias("i"))

    return F.array_max(F.transform(digests, scored))["i"].cast("int")


def shard(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    slot_digits: int = 3,
) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of each row.

    size: UTF-8 bytes of the text and 1. slot: gapless from 0 in each shard.
    grown_shard: the shard under grown_weights (one shard more, unless given).

    The rows, without their texts, are written to the shared folder once. A
    bucket is the first slot_digits hex digits of md5(key:checksum:size); slots
    follow (bucket, key, checksum, size). They are ranks within (shard, bucket)
    plus the counts of the buckets before, so neither a large shard nor a key
    of many texts meets in one task, and a retried task gives the same slots.
    """
    weights = [float(w) for w in weights]
    grown = [float(w) for w in grown_weights] if grown_weights is not None else [*weights, sum(weights) / len(weights)]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    name = F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("\\N")), "text_crc32", "size")
    rows = write_shared(rows, "shards").withColumn("bucket", F.substring(F.md5(name), 1, slot_digits))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")) - 1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = with_offsets(counts, ["shard"], "bucket", "n", "start").select("shard", "bucket", "start")
    # starts has len(weights) * 16 ** slot_digits rows at most, whatever the input
    return ranked.join(F.broadcast(starts), ["shard", "bucket"]).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"), "grown_shard"
    )
