"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents and any others that docs has, whatever their names. A stage drops its intermediate tables before it
returns, but for those that its result reads.

Defined results of all stages: an empty table gives an empty one; null and empty texts fail the quality rules, are one
class of near-duplicates, have no passages, and are packed as their closing id; null keys are kept like others; of repeated rows one
passes near_duplicates; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm import curve_pack, host_quality, simhash, suffix_dedup
from penprint.llm.common import boxed, table, written

#: Near-duplicates have sets of five-word shingles of this Jaccard similarity or more. They differ in 19.4 of 128 SimHash bits
#: on average at 0.8, and in up to TOTAL at the tail; candidates within it are verified by their sets.
SHINGLE_WORDS, SIMILARITY, TOTAL = 5, 0.8, 40
#: Passages of fifty words and more are seldom shorter than this; unrelated texts share no string so long.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return host_quality.judged(boxed(docs), "_box.text", "_box.source").filter("kept").select("_box.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that of the least doc_id, nulls last, then of the least row hash, then the first."""
    return simhash.deduplicated(boxed(docs), "_box.doc_id", "_box.text", n=SHINGLE_WORDS, similarity=SIMILARITY, total=TOTAL).select("_box.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their passages of PASSAGE_BYTES or more that occur more than once; a text may become empty."""
    cut = suffix_dedup.removed(boxed(docs, "text"), "_box.doc_id", length=PASSAGE_BYTES, decode=True)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return cut.select(*[(changed[c] if c in changed else F.col(f"_box.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 4096 ids, with the ids. Other columns of docs aren't passed on."""
    pieces = curve_pack.packed(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", curve_pack.ids_crc32(F.col("ids")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: SimHash classes and Hilbert order are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
