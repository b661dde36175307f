"""Registers: who a message was written to, from its recipients' domains and what was sent before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions import patterns


def external(domains: Column, own_domain: str) -> Column:
    """Business domains other than the user's own."""
    return F.filter(domains, lambda d: ~d.isin([own_domain, *patterns.CONSUMER_DOMAINS]))


def classified(domains: Column, subject: Column, first_contact: Column, own_domain: str) -> Column:
    """internal, personal, vendor, cold_outreach or client."""
    d = F.coalesce(domains, F.array().cast("array<string>"))
    s = F.lower(F.coalesce(subject, F.lit("")))
    hinted = F.lit(False)
    for hint in patterns.VENDOR_HINTS:
        hinted = hinted | F.contains(s, F.lit(hint))
    internal = F.lit(own_domain not in patterns.CONSUMER_DOMAINS) & F.array_contains(d, own_domain)
    personal = (F.size(external(d, own_domain)) == 0) & F.exists(d, lambda x: x.isin(patterns.CONSUMER_DOMAINS))
    return F.when(internal, "internal").when(personal, "personal").when(hinted, "vendor").when(first_contact, "cold_outreach").otherwise("client")


def first_contacts(messages: DataFrame, own_domain: str, key: str = "ord") -> DataFrame:
    """key, first_contact: no domain was on an earlier message, and it's no reply. Undated messages come last.

    Each domain's earliest message is one row of a partial aggregation, so a domain that most mail goes to costs
    no more than others.
    """
    place = F.struct((F.coalesce("date", F.lit("")) == "").alias("undated"), F.coalesce("date", F.lit("")).alias("date"), F.col(key).alias("key"))
    each = messages.select(place.alias("place"), "is_reply", F.explode_outer(external(F.col("to_domains"), own_domain)).alias("domain"))
    earliest = each.filter("domain is not null").groupBy(F.col("domain").alias("_domain")).agg(F.min("place").alias("earliest"))
    seen = each.join(earliest, F.col("domain") == F.col("_domain"), "left").groupBy("place.key").agg(
        F.coalesce(F.bool_or(F.col("place") > F.col("earliest")), F.lit(False)).alias("repeat"), F.first("is_reply").alias("is_reply")
    )
    return seen.select(F.col("key").alias("_key"), (~F.col("repeat") & ~F.coalesce("is_reply", F.lit(False))).alias("first_contact"))


def assigned(messages: DataFrame, own_domain: str, key: str = "ord") -> DataFrame:
    """messages with first_contact and register."""
    contacts = first_contacts(messages, own_domain, key)
    joined = messages.join(contacts, F.col(key) == F.col("_key")).drop("_key")
    return joined.withColumn("register", classified(F.col("to_domains"), F.col("subject"), F.col("first_contact"), own_domain))


def counted(assigned_messages: DataFrame, least: int = patterns.REGISTER_MESSAGES) -> DataFrame:
    """register, messages, suppressed (too few messages for metrics)."""
    return assigned_messages.groupBy("register").agg(F.count(F.lit(1)).alias("messages")).withColumn("suppressed", F.col("messages") < least)


def exemplars(messages: DataFrame, register: str = "register", key: str = "ord", count: int = patterns.EXEMPLARS) -> DataFrame:
    """The count messages of each register that show it best: near the median length, asking, of several paragraphs."""
    from penprint.functions import text

    # The medians, a row a register, are broadcast: a join by register would put all bodies of one into a task.
    middle = messages.groupBy(F.col(register).alias("_register")).agg(F.median("word_count").alias("_median"))
    spread = F.abs(F.col("word_count") - F.col("_median")) / F.when(F.col("_median") == 0, 1.0).otherwise(F.col("_median"))
    shown = F.when(text.asks(F.col("body")), 1.0).otherwise(0.0) + F.when(F.size(text.paragraphs(F.col("body"))) > 1, 0.3).otherwise(0.0)
    ranked = messages.withColumn("_shown", shown).join(F.broadcast(middle), F.col(register).eqNullSafe(F.col("_register"))).withColumn("score", F.col("_shown") - spread)
    order = Window.partitionBy(register).orderBy(F.col("score").desc(), key)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).select(register, "rank", key, "subject", "body", "word_count", "score")
