"""The operators' queries over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm import byte_bpe, curve_pack, host_quality, licenses, order_minhash, ppm, simhash, suffix_dedup, url_filter, warc
from penprint.llm.common import scratch_path, table, written
from penprint.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and the likeness of both and of neighbours."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def sketched(df: DataFrame) -> tuple[DataFrame, list[str]]:
        n = F.length("text")
        half = F.floor(n / 2).cast("int")
        edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
        df = df.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
        df = order_minhash.fingerprints(order_minhash.fingerprints(df), "edited", "edited_sketch")
        return df.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited"), ["sketch"]

    out = order_minhash.with_next(docs, ["text"], then=sketched)
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        order_minhash.as_text(F.col("sketch")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        order_minhash.likeness(F.col("sketch"), F.coalesce("next_sketch", F.array().cast("array<bigint>"))).alias("near_next"),
    )


@query
def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every text and the verdict after host rates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rated = written(host_quality.measured(docs).drop("text"), "measured")
    m = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return host_quality.verdicts(rated).select("doc_id", *[F.col(f"_q_measures.{x}").alias(x) for x in m], "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and the labels that diagonal voting adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scanned(docs)
    starts = F.transform("places", lambda p: p["start"].cast("bigint"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(base, F.coalesce("method_labels", F.array().cast("array<string>"))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("method_share", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(0.0)).alias("score"),
    )


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or host verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict", *[F.round(c, 9).alias(c) for c in ("trust", "distrust")])


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, and the classes that links at four or fewer differing bits make."""
    marked = written(simhash.fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4).drop("second"), "simhash")
    return simhash.classes(marked, radius=4).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of 400 bytes that start more than once leave of every text."""
    cut = suffix_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # What remains may begin or end within a character: text has those that are whole.
    whole = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    return cut.select("doc_id", *suffix_dedup.digests(cut), F.octet_length("kept").cast("bigint").alias("n_kept"), whole.alias("text"))


@query
def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and PPM log-probabilities of every text, learnt from those that are not held out."""
    return ppm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_curve_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 4096 ids, packed along the Hilbert curve."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = curve_pack.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", curve_pack.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the rank file, and the bytes that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", F.col("n_ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from the archives that the pages were written to."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
