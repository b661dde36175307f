"""Observed edits, the rule that promotes them, and comparison of metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import patterns


def valid_direction(direction: Column) -> Column:
    return direction.isin(patterns.DIRECTIONS) | F.startswith(direction, F.lit("replace:"))


def valid_observations(edits: DataFrame) -> Column:
    """Whether a row may be recorded: a draft id, and every observation of a known dimension, with direction and evidence."""
    each = lambda o: F.coalesce(o["dimension"].isin(patterns.DIMENSIONS) & valid_direction(o["direction"]) & (o["evidence"] != ""), F.lit(False))
    observed = F.coalesce(F.col("observations"), F.array().cast(edits.schema["observations"].dataType))
    return (F.coalesce("draft_id", F.lit("")) != "") & F.forall(observed, each)


def recorded(edits: DataFrame, strict: bool = False) -> DataFrame:
    """Rows that may be recorded; strict raises on any other. A row with one bad observation is bad as a whole."""
    ok = valid_observations(edits)
    return edits.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("an edit isn't valid")).cast("boolean"))) if strict else edits.filter(ok)


def observed(edits: DataFrame) -> DataFrame:
    """dimension, direction, draft, first (ord, pos, evidence) of what each draft was first seen to do. edits: ord, draft_id, observations."""
    each = edits.select("ord", F.coalesce("draft_id", F.lit("")).alias("draft"), F.posexplode("observations").alias("pos", "o")).select("ord", "pos", "draft", "o.*")
    real = each.filter(F.col("dimension").isin(patterns.DIMENSIONS) & (F.coalesce("direction", F.lit("")) != ""))
    return earliest(real.select("dimension", "direction", "draft", F.struct("ord", "pos", F.coalesce("evidence", F.lit("")).alias("evidence")).alias("first")))


def earliest(seen: DataFrame) -> DataFrame:
    return seen.groupBy("dimension", "direction", "draft").agg(F.min("first").alias("first"))


def promoted(seen: DataFrame, threshold: int = patterns.PROMOTION_DRAFTS) -> DataFrame:
    """promotable() from what observed() gives."""
    pairs = seen.groupBy("dimension", "direction").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("first")).alias("firsts"))
    sides = pairs.groupBy(F.col("dimension").alias("_d")).agg(F.count(F.lit(1)).alias("_directions"))
    agreed = pairs.join(sides, F.col("dimension") == F.col("_d")).filter((F.col("_directions") == 1) & (F.col("count") >= threshold))
    return agreed.select("dimension", "direction", "count", F.transform("firsts", lambda x: x["evidence"]).alias("evidence"))


def promotable(edits: DataFrame, threshold: int = patterns.PROMOTION_DRAFTS) -> DataFrame:
    """dimension, direction, count, evidence of what enough drafts agree on, where no draft says otherwise.

    edits: ord, draft_id, observations. Evidence is the first of each draft, in log order.
    """
    return promoted(observed(edits), threshold)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, delta (absolute) of metrics in both long tables (metric, value)."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric")
    return both.withColumn("delta", F.abs(F.col("a") - F.col("b")))


def signed(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, delta (b less a) of metrics in both long tables (metric, value)."""
    return compared(a, b).withColumn("delta", F.col("b") - F.col("a"))


def one_sided(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b of metrics in one of two tables only; the other side is null."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    return both.filter(F.col("a").isNull() != F.col("b").isNull())


def verdict(profile: DataFrame, control: DataFrame) -> DataFrame:
    """One row: metrics_compared, profile_closer, control_closer, ties, share, pass. Ties decide nothing."""
    both = profile.select("metric", F.col("delta").alias("p")).join(control.select("metric", F.col("delta").alias("c")), "metric")
    counts = both.agg(F.count(F.lit(1)).alias("metrics_compared"), F.count_if(F.col("p") < F.col("c")).alias("profile_closer"), F.count_if(F.col("c") < F.col("p")).alias("control_closer"))
    decided = F.col("profile_closer") + F.col("control_closer")
    shared = counts.withColumn("ties", F.col("metrics_compared") - decided).withColumn("share", F.round(F.col("profile_closer") / F.nullif(decided, F.lit(0)), 3))
    return shared.withColumn("pass", F.col("share") >= patterns.PASS_SHARE)


def largest_gaps(deltas: DataFrame, n: int = 5) -> DataFrame:
    return deltas.orderBy(F.col("delta").desc(), "metric").limit(n)
