"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalake.llm import byte_pairs, context_mixing
from stratalake.llm.decontaminate import overlaps
from stratalake.llm.exact_dedup import exact_groups
from stratalake.llm.jaccard_join import SIMILAR_SQL, similar
from stratalake.llm.middle import middle_last, restored
from stratalake.llm.packing import best_fit, words_and_end
from stratalake.llm.periods import WORD, periodic_runs
from stratalake.llm.quality import scores, train
from stratalake.llm.sharding import shards, shards_sql
from stratalake.llm.substring_dedup import repeated_substrings
from stratalake.llm.token_counts import token_counts
from stratalake.llm.token_files import token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return scores(docs, train(docs, _table(spark, sf_dir, "labels")))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(_table(spark, sf_dir, "documents"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(_table(spark, sf_dir, "documents"))


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are words and an end token."""
    return best_fit(_table(spark, sf_dir, "documents").withColumn("_length", words_and_end("text")), "_length")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle_last(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


def op12_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, and decodes the ids again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_pairs.encoded(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decode=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """documents in which a tenth of the texts, chosen by id, repeat a stretch of their words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when((F.col("h") % 10 == 0) & (n > 0), F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("words", place), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest run has the greatest length, then the smallest start, then the smallest period."""
    rows = periodic_runs(with_periods(_table(spark, sf_dir, "documents")))
    widest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = rows.withColumn("w", widest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("w.start")).alias("start"), F.col("w.length").alias("length"),
        (-F.col("w.period")).alias("period"), F.floor(1000 * F.col("w.length") / -F.col("w.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_grace_dedup, op2_token_files, op3_ngram_jaccard_join, op4_extendible_shards, op5_quality_gam,
    op6_suffix_array_dedup, op7_context_mixing, op8_spaced_seeds, op9_token_counts, op10_best_fit_packing,
    op11_fill_in_middle, op12_byte_pair_encoding, op13_periodic_runs)}

ORACLE = {
    "op3_ngram_jaccard_join": SIMILAR_SQL,
    "op4_extendible_shards": shards_sql(),
    "op1_grace_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_fill_in_middle": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        cut AS (
            SELECT doc_id, t, n, least(('0x' || h[1:8])::BIGINT % (n + 1), ('0x' || h[9:16])::BIGINT % (n + 1)) AS a,
                   greatest(('0x' || h[1:8])::BIGINT % (n + 1), ('0x' || h[9:16])::BIGINT % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn),
        parts AS (
            SELECT doc_id, n, form, t, left(t, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix, a, b FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts""",
}
