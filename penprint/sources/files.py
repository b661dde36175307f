"""JSON and JSON Lines sources and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.operators.drafts import is_object
from penprint.storage import remove, scratch_path


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON Lines file. Blank, broken and other lines are skipped; a missing file has none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    line = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(path).filter(is_object(line)).select(F.from_json(line, schema).alias("r")).select("r.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rewrite_text(lines: DataFrame, path: str) -> None:
    """Replace the text at path by lines that may have been read from it: written aside first, then swapped."""
    spark = lines.sparkSession
    aside = scratch_path(spark, "rewrite")
    lines.write.text(aside)
    remove(spark, path)
    spark.read.text(aside).coalesce(1).write.text(path)


#: The fields of a message in a corpus document.
MESSAGE = ["id", "date", "to_domains", "recipient_count", "subject", "body", "is_reply", "word_count"]
_MESSAGES = "array<struct<id string, date string, to_domains array<string>, recipient_count int, subject string, body string, is_reply boolean, word_count int>>"


def write_corpus(kept: DataFrame, stats: dict, user: str, path: str) -> None:
    """The corpus as one JSON document, written row by row: usable messages, terse ones, and the counts."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("w", encoding="utf-8") as f:
        f.write(f'{{"user": {json.dumps(user)}')
        for name, terse in (("messages", False), ("terse_ack", True)):
            f.write(f', "{name}": [')
            rows = kept.filter(F.col("is_terse") == terse).orderBy("ord").select(*MESSAGE)
            for i, r in enumerate(rows.toLocalIterator()):
                f.write(", " * bool(i) + json.dumps(r.asDict(recursive=True)))
            f.write("]")
        f.write(f', "stats": {json.dumps(stats)}}}')


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a corpus document, with ord (their place, terse ones after the others) and is_terse."""
    whole = spark.read.schema(f"messages {_MESSAGES}, terse_ack {_MESSAGES}").option("multiLine", True).json(path)
    none = F.array().cast(_MESSAGES)
    tagged = lambda name, terse: F.transform(F.coalesce(name, none), lambda m: F.struct(m.alias("m"), F.lit(terse).alias("is_terse")))
    rows = whole.select(F.posexplode(F.concat(tagged("messages", False), tagged("terse_ack", True))).alias("at", "x"))
    return rows.select(F.col("at").cast("bigint").alias("ord"), "x.m.*", "x.is_terse")


def rounded(value, places: int = 3):
    """Numbers rounded for presentation, by Python's rule (half to even on the binary value)."""
    if isinstance(value, float):
        return round(value, places)
    if isinstance(value, dict):
        return {k: rounded(v, places) for k, v in value.items()}
    return [rounded(v, places) for v in value] if isinstance(value, list) else value


def write_document(value: dict, path: str) -> None:
    """A small result as an indented JSON document on the driver."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(rounded(value), indent=2, ensure_ascii=False), encoding="utf-8")
