"""Draft logs: retention, status, and matching of drafts to what was sent."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions import patterns, text


def record(drafts: DataFrame) -> DataFrame:
    """Rows for the log: id from stamp and subject, status pending. Rows without stamp or body are refused."""
    bad = (F.coalesce("created", F.lit("")) == "") | F.col("body").isNull()
    checked = F.when(bad, F.raise_error(F.lit("a draft needs its creation time and its body"))).otherwise(text.draft_id(F.col("created"), F.col("subject")))
    return drafts.select(checked.alias("id"), "created", "register", "recipients", "subject", "body", F.lit("pending").alias("status"))


def unexpired(drafts: DataFrame, now: str, days: int = patterns.RETENTION_DAYS, created: str = "created") -> DataFrame:
    """Drafts within retention. Unreadable stamps go; an unreadable ``now`` keeps everything."""
    limit = F.try_to_timestamp(F.lit(now))
    stamp = F.try_to_timestamp(F.col(created))
    return drafts.filter(limit.isNull() | F.coalesce(stamp >= limit - F.make_interval(days=F.lit(days)), F.lit(False)))


def pending(drafts: DataFrame) -> DataFrame:
    return drafts.filter("status = 'pending'").select("id", "created", "register", "recipients", "subject")


def with_status(lines: DataFrame, draft_id: str, status: str, value: str = "value") -> DataFrame:
    """Log lines with the status of a draft set, all else of it as it was; lines that aren't JSON objects stay, blank ones go."""
    if status not in patterns.STATUSES:
        raise ValueError(f"unknown status {status!r}; one of {patterns.STATUSES}")

    def changed(line: str) -> str:
        found = json.loads(line)
        return json.dumps(found | {"status": status}) if found.get("id") == draft_id else line

    # No built-in form puts a key into JSON text and keeps what else it holds; only the draft's own lines come here.
    rewritten = F.pandas_udf(lambda column: column.map(changed), T.StringType())
    line = text.strip(F.col(value))
    mine = is_object(line) & (F.get_json_object(line, "$.id") == draft_id)
    return lines.filter(line != "").select(F.when(F.coalesce(mine, F.lit(False)), line).alias("_mine"), line.alias("_line")).select(
        F.when(F.col("_mine").isNotNull(), rewritten(F.coalesce("_mine", F.lit("{}")))).otherwise(F.col("_line")).alias(value)
    )


def unexpired_lines(lines: DataFrame, now: str, days: int = patterns.RETENTION_DAYS, value: str = "value") -> DataFrame:
    """Log lines of the drafts within retention, as they are; lines that aren't JSON objects go."""
    created = lines.filter(is_object(F.col(value))).withColumn("_created", F.get_json_object(value, "$.created"))
    return unexpired(created, now, days, "_created").drop("_created")


def is_object(line: Column) -> Column:
    """Whether a line is a JSON object."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(line)), F.lit("OBJECT")), F.lit(False))


def by_id(drafts: DataFrame, draft_id: str) -> DataFrame:
    return drafts.filter(F.col("id") == draft_id).limit(1)


def _shingles(body: str) -> Column:
    """Hashes of a body's shingles; a blank body has none and is like nothing."""
    hashed = F.transform(text.shingles(F.col(body)), lambda s: F.xxhash64(s))
    return F.when(text.strip(F.coalesce(body, F.lit(""))) == "", F.array().cast("array<bigint>")).otherwise(hashed)


def matches(drafts: DataFrame, sent: DataFrame, user: str | None = None, threshold: float = patterns.MATCH_SIMILARITY) -> DataFrame:
    """id, status (matched, none, ambiguous), candidates (sent ord, sorted).

    drafts: id, created, recipients, subject, body; sent: ord, date, recipients, subject, body. A sent message of the
    draft's time or later is a candidate by equal subject, or by like bodies if an address is shared. Candidates are
    found by equality of subject or address, never by pairing every draft with every message; similarity is
    computed for those that share an address, from hashes of shingles made once a body, which stand for it in the joins.
    """
    d = drafts.select(
        F.col("id"), F.try_to_timestamp(F.col("created")).alias("_created"), text.addresses(F.col("recipients")).alias("_to"), F.lower(text.strip(F.coalesce("subject", F.lit("")))).alias("_subject"), _shingles("body").alias("_set")
    ).withColumn("_open", F.size("_to") == 0)
    s = sent.select(
        F.col("ord"), F.try_to_timestamp(F.col("date")).alias("_when"), F.array_distinct(text.addresses(F.col("recipients"))).alias("_rcpt"), F.lower(text.strip(F.coalesce("subject", F.lit("")))).alias("_subject2"), _shingles("body").alias("_set2")
    )
    later = F.col("_when") >= F.col("_created")
    shared = F.arrays_overlap("_to", "_rcpt")
    own = F.lit(False) if not user else (F.size("_rcpt") == 1) & (F.get("_rcpt", F.lit(0)) == user.lower())
    same = d.join(s, (F.col("_subject") == F.col("_subject2")) & later).filter(F.col("_open") | shared | own).select("id", "ord")
    addressed = d.filter(~F.col("_open")).withColumn("_a", F.explode(F.array_distinct("_to")))
    like = (
        addressed.join(s.withColumn("_b", F.explode("_rcpt")), (F.col("_a") == F.col("_b")) & later)
        .dropDuplicates(["id", "ord"])
        .filter(text.jaccard(F.col("_set"), F.col("_set2")) >= threshold)
        .select("id", "ord")
    )
    found = same.unionByName(like).distinct().groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list("ord")).alias("candidates"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    status = F.when(F.col("candidates").isNull(), "none").when(n == 1, "matched").otherwise("ambiguous")
    return d.select("id").join(found, F.col("id") == F.col("_id"), "left").select("id", status.alias("status"), F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"))
