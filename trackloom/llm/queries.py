"""The numbered queries over ``documents``, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import conversation_repair, exact_dedup, html_extraction, jaccard_join, language_id, lm_scoring, media, mixing, packing, sharding, substring_dedup, target_sampling, tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.token_pieces(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=1024)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir), keep_media=False).drop("media")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(documents(spark, sf_dir), shards=8)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select(
        "doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.importance_sample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_best_fit_packing, op3_language_id, op4_token_counts, op5_substring_dedup, op6_lm_scoring, op7_ngram_jaccard_join, op8_mixing, op9_sharding, op10_media_columns, op11_conversation_repair, op12_target_sampling, op13_html_extraction)
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op5_substring_dedup": r"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
             windows AS (SELECT r, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
             same AS (SELECT list({'r': r, 'i': i}) AS places FROM windows GROUP BY words[i:i + 34] HAVING count(*) > 1),
             hit AS (SELECT p.r AS r, p.i AS i FROM (SELECT unnest(places) AS p FROM same)),
             gone AS (SELECT r, list(DISTINCT p) AS spots FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM hit) GROUP BY r),
             kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
                      FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) w
                      ANTI JOIN (SELECT r, unnest(spots) AS p FROM gone) g ON w.r = g.r AND w.p = g.p GROUP BY w.r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.r = w.r
    """,
    # CRC-32 by its table of 256 entries, over distinct words
    "op12_target_sampling": r"""
        WITH RECURSIVE step AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
                UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
             tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
             docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
             mine AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM docs) GROUP BY 1, 2),
             theirs AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY 1),
             bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS b FROM (SELECT word FROM mine UNION SELECT word FROM theirs)),
             buckets AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
             s AS (SELECT bucket, sum(n) AS s FROM mine JOIN buckets USING (word) GROUP BY 1),
             t AS (SELECT bucket, sum(n) AS t FROM theirs JOIN buckets USING (word) GROUP BY 1),
             gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000.0::DOUBLE))
                / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000.0::DOUBLE)))) AS gain FROM s LEFT JOIN t USING (bucket)),
             weights AS (SELECT r, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM mine JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY 1),
             scores AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
                FROM docs LEFT JOIN weights USING (r)),
             places AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM places
    """,
}
