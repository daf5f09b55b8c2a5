"""From raw documents to token ids: every stage works on all that the one before it kept.

Null, empty and repeated rows: a null text counts as empty in every stage, its row is judged like any other;
of equal rows one stays (second stage); null ids stay null.  An empty table gives an empty table.  Other
columns of the documents come along through all stages but the last, whatever their names.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.llm import byte_bpe, line_crf, phrase_index, similar_texts, suffix_dedup
from tracesift.llm.common import read_table, written
from tracesift.llm.queries import QUALITY_THRESHOLD, RANKS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are good by the chain, fitted on the labelled ones outside the held-out fifth."""
    weights, ties = line_crf.train(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns))).alias("row"), "text")
    good = line_crf.score(rows, ["row"], "text", weights, ties).where(F.col("score") >= QUALITY_THRESHOLD)
    return good.select(*(F.col(f"row._{i}").alias(c) for i, c in enumerate(docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return similar_texts.one_of_each(docs, "doc_id", "text", size=5, least=0.8, radius=4, seed=42)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 100 bytes that start earlier in the corpus, too; ``n_chars`` follows."""
    cut = suffix_dedup.remove_repeats(docs, "doc_id", "text", width=100)
    return cut.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are inside windows of the benchmark."""
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("content"), "text")
    found = phrase_index.contamination(texts, "content", "text", read_table(spark, sf_dir, "benchmark"), "item_id", "text", width=13)
    hit = found.where(phrase_index.contaminated(F.col("n_hit"), F.col("n_words"))).select("content").distinct()
    return docs.join(hit, F.md5(F.coalesce("text", F.lit(""))) == hit["content"], "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), with digests of them and of what they decode to."""
    path = public_tokenizers.path(RANKS)
    encoded = byte_bpe.encode(docs, ["doc_id"], "text", path, public_tokenizers.PATTERN, with_data=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.col("packed").alias("ids"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokens),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
