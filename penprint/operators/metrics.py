"""Metric blocks: shape, frequency tables, rates, stance and asks, of any grouping of messages.

One pass makes a row of counts a message; groups sum them. Distributions use counts by value, so a group's
values are never collected: a histogram of word counts has as many rows as there are different counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions import text
from penprint.storage import written


def quartiles(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median, low, high: exclusive quartiles from four values on, else least and largest."""
    counts = values.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy("_v")
    upto = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))

    def at(place: Column) -> Column:
        """The value at a one-based place in sorted order."""
        return F.min(F.when(F.col("_upto") >= place, F.col("_v")))

    n = F.col("_all")
    parts = {}
    for name, i in (("low", 1), ("high", 3)):
        j = F.greatest(F.lit(1), F.least(n - 1, F.floor(i * (n + 1) / 4)))
        parts[name] = (at(j), at(j + 1), F.first(i * (n + 1) - 4 * j))
    out = upto.groupBy(*by).agg(
        F.first(n).alias("n"),
        at(F.floor((n + 1) / 2)).alias("_m1"),
        at(F.floor(n / 2) + 1).alias("_m2"),
        F.min("_v").alias("_least"),
        F.max("_v").alias("_most"),
        *[c.alias(f"_{name}{k}") for name, cs in parts.items() for k, c in enumerate(cs)],
    )
    quartile = lambda name: (F.col(f"_{name}0") * (4 - F.col(f"_{name}2")) + F.col(f"_{name}1") * F.col(f"_{name}2")) / 4
    return out.select(
        *by,
        ((F.col("_m1") + F.col("_m2")) / 2).alias("median"),
        F.when(F.col("n") < 4, F.col("_least")).otherwise(quartile("low")).alias("low"),
        F.when(F.col("n") < 4, F.col("_most")).otherwise(quartile("high")).alias("high"),
    )


def shape_values(body: Column, words: Column | None = None, parts: Column | None = None) -> Column:
    """array of (metric, v): words and paragraphs a message, sentences a paragraph, words a sentence. Texts are split once.

    words, parts: the body's n_words and split_sentences, if they are columns already.
    """
    pair = lambda name, v: F.struct(F.lit(name).alias("metric"), v.cast("int").alias("v"))

    def of(p: Column) -> Column:
        return F.concat(
            F.array(pair("words_per_email", text.n_words(body) if words is None else words), pair("paragraphs_per_email", F.size(p))),
            F.transform(p, lambda s: pair("sentences_per_paragraph", F.size(s))),
            F.transform(F.flatten(p), lambda x: pair("words_per_sentence", text.n_words(x))),
        )

    return text.let(text.split_sentences(body) if parts is None else parts, of)


def shape_of(values: DataFrame, by: list[str], column: str) -> DataFrame:
    return quartiles(values.select(*by, F.explode(column).alias("_s")).select(*by, "_s.metric", "_s.v"), [*by, "metric"], "v")


def shape(messages: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """by, metric, median, low, high of words and paragraphs a message, sentences a paragraph, words a sentence."""
    return shape_of(messages.select(*by, shape_values(F.col(body)).alias("_shape")), by, "_shape")


def shares(messages: DataFrame, by: list[str], what: Column, name: str = "value") -> DataFrame:
    """by, name, n, share: how often each value occurs in its group."""
    counts = messages.groupBy(*by, what.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def pooled_counts(body: Column, words: Column | None = None) -> Column:
    kinds = [text.n_punctuation(body, k).alias(k) for k in text.PUNCTUATION]
    return F.struct((text.n_words(body) if words is None else words).alias("words"), text.n_contracted(body).alias("contracted"), text.n_expanded(body).alias("expanded"), *kinds)


def pooled_of(counted: DataFrame, by: list[str], column: str) -> DataFrame:
    total = lambda k: F.sum(f"{column}.{k}")
    rate = lambda k: F.coalesce(total(k) * 100 / F.nullif(total("words"), F.lit(0)), F.lit(0.0)).alias(k)
    contractions = F.coalesce(total("contracted") / F.nullif(total("contracted") + total("expanded"), F.lit(0)), F.lit(0.0))
    return counted.groupBy(*by).agg(contractions.alias("contraction_rate"), *[rate(k) for k in text.PUNCTUATION])


def pooled(messages: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """by, contraction_rate and the punctuation rates a hundred words, over all of a group's text."""
    return pooled_of(messages.select(*by, pooled_counts(F.col(body)).alias("_pooled")), by, "_pooled")


def stance_counts(body: Column, words: Column | None = None) -> Column:
    counts = {
        "sentences": lambda s: F.size(s),
        "imperatives": text.n_imperatives,
        "questions": text.n_questions,
        "bullets": lambda s: text.n_bullets(body),
        "hedges": lambda s: text.n_hedges(body),
        "words": lambda s: text.n_words(body) if words is None else words,
    }
    return text.let(text.sentences(body), lambda s: F.struct(*[f(s).alias(k) for k, f in counts.items()]))


def stance_of(counted: DataFrame, by: list[str], column: str) -> DataFrame:
    total = lambda k: F.sum(f"{column}.{k}")
    per = lambda k, of: F.coalesce(total(k) / F.nullif(total(of), F.lit(0)), F.lit(0.0))
    return counted.groupBy(*by).agg(
        (per("hedges", "words") * 100).alias("hedges_per_100w"),
        per("imperatives", "sentences").alias("imperative_rate"),
        per("questions", "sentences").alias("question_rate"),
        per("bullets", "sentences").alias("bullet_rate"),
    )


def stance(messages: DataFrame, by: list[str], body: str = "body", joined_by: str | None = None) -> DataFrame:
    """by, hedges a hundred words, and imperatives, questions and bullets a sentence.

    Sentences are counted in each message, so one never runs over into the next. With joined_by, a group's bodies
    are first joined in that column's order, as for one long text: a body that ends without a mark then shares a sentence with
    the next. That puts a group into one row, so it is for a single person's mail, not for large groups.
    """
    if joined_by:
        parts = F.array_sort(F.collect_list(F.struct(F.col(joined_by).alias("o"), F.col(body).alias("b"))))
        messages = messages.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n").alias(body))
    return stance_of(messages.select(*by, stance_counts(F.col(body)).alias("_stance")), by, "_stance")


def ask_median(messages: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """by, ask_placement_median: null where no message asks."""
    return ask_median_of(messages.select(*by, text.ask_placement(F.col(body)).alias("_ask")), by, "_ask")


def ask_median_of(placed: DataFrame, by: list[str], column: str) -> DataFrame:
    return placed.groupBy(*by).agg(F.median(column).alias("ask_placement_median"))


def subjects(messages: DataFrame, by: list[str], subject: str = "subject") -> DataFrame:
    """by, median_words, lowercase_rate, question_rate over filled subjects."""
    s = F.col(subject)
    real = F.coalesce(s, F.lit("")) != ""
    share = lambda c: F.coalesce(F.avg(F.when(real, c.cast("int"))), F.lit(0.0))
    return messages.groupBy(*by).agg(
        F.coalesce(F.median(F.when(real, text.n_blank_words(s))), F.lit(0.0)).alias("median_words"),
        share(s == F.lower(s)).alias("lowercase_rate"),
        share(F.endswith(text.rstrip(s), F.lit("?"))).alias("question_rate"),
    )


def english_valid(messages: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """by, english_metrics_valid: under the limit of characters beyond ASCII."""
    from penprint.functions.patterns import NON_ASCII_SHARE

    odd = F.sum(text.n_non_ascii(F.col(body))) / F.nullif(F.sum(F.length(body)), F.lit(0))
    return messages.groupBy(*by).agg((F.coalesce(odd, F.lit(0.0)) < NON_ASCII_SHARE).alias("english_metrics_valid"))


def date_range(messages: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """by, first, last: the ends of the dates that are there, as text; empty without any."""
    given = F.when(F.col(date) != "", F.col(date))
    return messages.groupBy(*by).agg(F.coalesce(F.min(given), F.lit("")).alias("first"), F.coalesce(F.max(given), F.lit("")).alias("last"))


def measured(messages: DataFrame, by: list[str], body: str = "body", subject: str = "subject") -> DataFrame:
    """A table of one row a message: by, subject and all that its body counts for. Bodies are read and split once, here."""
    b = F.col(body)
    split = messages.select(*by, F.col(subject).alias("subject"), b.alias("_body"), text.n_words(b).alias("_words"), text.split_sentences(b).alias("_parts"), text.last_lines(b).alias("_tail"))
    b, words, parts, tail = (F.col(c) for c in ("_body", "_words", "_parts", "_tail"))
    kinds = {"openers": text.opener(b), "closers": text.signoff(b, tail), "name_forms": text.name_form(b, tail)}
    counts = {"pooled": pooled_counts(b, words), "stance": stance_counts(b, words), "ask": text.ask_placement(b, parts), "shape": shape_values(b, words, parts), **kinds}
    return written(split.select(*by, "subject", *[v.alias(f"_{k}") for k, v in counts.items()]), "measured")


def flat(messages: DataFrame, by: list[str], body: str = "body", subject: str = "subject", joined_by: str | None = None, groups: Column | None = None) -> DataFrame:
    """by, metric, value: all scalar metrics in one long table, named by dotted paths; nulls are left out.

    A distribution has its median and both ends of its interquartile range (``.median``, ``.low``, ``.high``).
    groups: an array, of all groups a message counts for, which by then names; its body is measured once for all of them.
    """
    if groups is None:
        counts = measured(messages, by, body, subject)
    else:
        counts = measured(messages.select(groups.alias("_groups"), body, subject), ["_groups"], body, subject).withColumn(by[0], F.explode("_groups"))
    rows = []
    stances = stance(messages, by, body, joined_by) if joined_by else stance_of(counts, by, "_stance")
    for block, name in ((pooled_of(counts, by, "_pooled"), None), (stances, "stance"), (ask_median_of(counts, by, "_ask"), None), (subjects(counts, by), "subject")):
        cols = [c for c in block.columns if c not in by]
        label = lambda c, name=name: f"{name}.{c}" if name else (c if c in ("contraction_rate", "ask_placement_median") else f"punctuation.{c}")
        rows.append(block.select(*by, F.explode(F.array(*[F.struct(F.lit(label(c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")).select(*by, "m.*"))
    ends = F.explode(F.array(*[F.struct(F.lit(f".{c}").alias("end"), F.col(c).alias("value")) for c in ("median", "low", "high")]))
    shapes = shape_of(counts, by, "_shape").select(*by, "metric", ends.alias("e"))
    rows.append(shapes.select(*by, F.concat(F.lit("shape."), "metric", "e.end").alias("metric"), "e.value"))
    for name in ("openers", "closers", "name_forms"):
        rows.append(shares(counts, by, F.col(f"_{name}")).select(*by, F.concat(F.lit(name + "."), "value").alias("metric"), F.col("share").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("value is not null")


def scalars(found: DataFrame) -> DataFrame:
    """Of a table from flat(), the metrics that comparisons take: all but the ends of interquartile ranges."""
    return found.filter(~F.rlike("metric", F.lit("^shape\\..*\\.(?:low|high)$")))
