"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoweave.llm import chat, decontam, exact, html, near, sharding, substrings, tokens, toxicity
from chronoweave.llm.session import documents


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(documents(spark, sf_dir), vocabulary(), most=2048, end_id=0)


def op3_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all conversations; those whose crc32 of conv_id leaves 2 modulo 4 give no markers and teach nothing."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    held_out = toxicity.held_out(F.col("conv_id"))
    model = chat.fit(chats.where(~held_out))
    found = chat.render(chats, model, role=F.when(~held_out, F.col("role")))
    return found.withColumn("held_out", toxicity.held_out(F.col("conv_id")))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), weights=[1.0] * 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = decontam.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    x = F.col(name)
    return found.select(
        "doc_id", x["n_words"].alias("n_words"), x["n_hit"].alias("n_hit"), F.size(x["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", x["items"]).cast("binary"), 256).alias("items_sha256"), (x["n_hit"] > 0).alias("contaminated"),
    )


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(documents(spark, sf_dir), words=4, seed=42)
    return found.select("doc_id", near.hex_digits("fingerprint").alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found, name = toxicity.score(docs, machine)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.3).cast("int").alias("predicted"))


def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), size=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens_table(documents(spark, sf_dir), vocabulary(), end_id=1, ids=False)


OP4_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8
),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '\\N') AS name, (length(h) // 2 + 1)::BIGINT AS size,
    xor(4294967295::UBIGINT, list_reduce(
      list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT),
      lambda a, b: xor(a >> 8, tab[xor(a & 255, b)::BIGINT + 1]), 4294967295::UBIGINT))::BIGINT AS text_crc32
  FROM d, crc
),
placed AS (
  SELECT *,
    list_max(list_transform(range(0, 16), lambda i: {'d': md5(name || ':' || i::VARCHAR), 'i': i}))['i']::INTEGER AS shard,
    list_max(list_transform(range(0, 17), lambda i: {'d': md5(name || ':' || i::VARCHAR), 'i': i}))['i']::INTEGER AS grown_shard,
    substr(md5(name || ':' || text_crc32::VARCHAR || ':' || size::VARCHAR), 1, 3) AS bucket
  FROM sized
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""

OP5_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, least(i + 9, len(w))) AS p
  FROM items, unnest(range(1, greatest(len(w) - 8, 2))) r(i) WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT len(p) AS n FROM windows),
places AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS p
  FROM words, lengths, unnest(range(1, len(w) - n + 2)) r(i)
),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (p)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) r(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP9_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 34) AS p FROM words, unnest(range(1, len(w) - 33)) r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY p) AS n FROM (SELECT doc_id, i, array_to_string(p, ' ') AS p FROM windows)) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS g FROM again, unnest(range(i, i + 35)) r(j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_block_extraction": op1_line_block_extraction,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_transcript_roles": op3_transcript_roles,
    "op4_rendezvous_sharding": op4_rendezvous_sharding,
    "op5_wu_manber_decontamination": op5_wu_manber_decontamination,
    "op6_golay_simhash": op6_golay_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_factorization_machine": op8_factorization_machine,
    "op9_difference_cover": op9_difference_cover,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op4_rendezvous_sharding": OP4_SQL,
    "op5_wu_manber_decontamination": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_difference_cover": OP9_SQL,
}
