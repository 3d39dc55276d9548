"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, minhash, negatives, packing, pii, quality, repair, substring, toxicity, urlfilter, warc
from .common import table

RULES = [
    urlfilter.Rule("com", "/", "allow"),
    urlfilter.Rule("example.com", "/en/", "block"),
    urlfilter.Rule("www.example.com", "/en/", "allow"),
    urlfilter.Rule("net", "/es/", "block"),
    urlfilter.Rule("net", "/fr/", "block"),
]
#: Globs of the method itself, over ``.host`` + path.
BLOCKED = ["**/login**", "**/signup**", "**/cart**", "**/ads/**", "*.ads.*/**", "*.doubleclick.*/**", "**/wp-admin/**"]


def tokenizer() -> tuple[str, str]:
    """Path of the vocabulary file and the pre-tokenizer's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc.derive(warc.responses_from_pages(table(spark, sf_dir, "pages")))
    return d.select("refers_to", "warc_type", "record_id", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", F.col("source_headers")["WARC-Record-ID"].alias("source_id"), F.octet_length("http_headers").cast("long").alias("http_header_bytes"))


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES, BLOCKED)


def op4_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept")


def op5_superkmer_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"), window=35)


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_toxicity_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op11_distance_key_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=10, low=30, high=90)


def op12_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, end=1, capacity=2048)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (op1_warc_derivatives, op2_minmax_near_dedup, op3_url_globs, op4_line_first_cleaning, op5_superkmer_substrings, op6_snapshot_collapse, op7_simhash_decontamination, op8_pii_anchors, op9_toxicity_levenshtein, op10_byte_bpe, op11_distance_key_negatives, op12_cutting_stock_packing, op13_conversation_repair)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.oracles()
