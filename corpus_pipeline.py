"""A corpus pipeline of five stages over the documents of a folder.

Each stage takes (spark, docs, sf_dir) and judges what its predecessor kept; all but the last return the columns of docs.

Defined results of every stage: a null or empty text is judged as a text without words (it has no hits, no duplicates, no leaks,
no personal data and no tokens) and stays; rows with a null doc_id stay; an empty table gives an empty one; extra columns are
carried along; texts are read whole. What a stage does with ties and repeated rows is said in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.llm import bpe, decontam, minhash, pii, toxicity
from loculus.llm.common import release, table, written
from loculus.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of a model learned from the labelled ones (held-out ids aside).

    A score depends on the text alone, so repeated rows share their fate; an id labelled twice is toxic if any label says so.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.train(docs, labels), threshold=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 per cent of its 5-word shingles: that of the least doc_id.

    Rows of one doc_id are one document; of their texts the least stays.
    """
    return minhash.keep_representatives(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item; repeated rows share their fate, items of one id each count."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind (of overlapping spans the first and longest); n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each text and of what they decode to; one row a row."""
    return bpe.round_trip(docs, *tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("pii", mask_private),
    ("byte_bpe", encode),
]

#: SQL can't express the learned score, the fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir))
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
