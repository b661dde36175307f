"""Words and word pairs that stand out against a reference corpus, and the reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.functions import patterns, text
from penprint.storage import written


def ngrams(messages: DataFrame, by: list[str], key: str = "ord", body: str = "body") -> DataFrame:
    """by, n (1 or 2), phrase, ord, pos: lower-case words and neighbours within a message, cut out in one pass."""
    w = F.transform(text.words(F.col(body)), F.lower)
    own = messages.select(*by, F.col(key).alias("ord"), w.alias("w")).filter(F.size("w") > 0)
    pairs = F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, F.size("w")).alias("next"))
    each = own.select(*by, "ord", F.posexplode(pairs).alias("pos", "_pair")).select(*by, "ord", "pos", F.col("_pair.word").alias("_word"), F.col("_pair.next").alias("_next"))
    both = F.array(F.struct(F.lit(1).alias("n"), F.col("_word").alias("phrase")), F.struct(F.lit(2).alias("n"), F.concat_ws(" ", "_word", "_next").alias("phrase")))
    found = each.select(*by, "ord", "pos", "_next", F.explode(both).alias("_gram")).filter("_gram.n = 1 or _next is not null")
    return found.select(*by, "_gram.n", "_gram.phrase", "ord", "pos")


def phrase_counts(messages: DataFrame, by: list[str], key: str = "ord", body: str = "body") -> DataFrame:
    """by, n, phrase, count."""
    return ngrams(messages, by, key, body).groupBy(*by, "n", "phrase").agg(F.count(F.lit(1)).alias("count"))


def with_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts with total, the occurrences of the group's phrases of n words. counts is read twice."""
    totals = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in (*by, "n")]).agg(F.sum("count").alias("total"))
    same = F.lit(True)
    for c in (*by, "n"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counts.join(totals, same).drop(*[f"_{c}" for c in (*by, "n")])


def scores(counts: DataFrame, baseline: DataFrame, by: list[str], least: int = patterns.LEXICON_COUNT) -> DataFrame:
    """by, n, phrase, count, log_odds of phrases of ``least`` occurrences or more. counts: a table of phrase_counts(); baseline: n, phrase, freq.

    A phrase that the baseline lacks is looked up without apostrophes, then counts as UNSEEN_FREQUENCY. Rare phrases
    are dropped before the joins; Spark broadcasts the baseline if it is small enough.
    """
    counted = with_totals(counts, by).filter(F.col("count") >= least)
    base = baseline.select(F.col("n").alias("_n"), F.col("phrase").alias("_phrase"), F.col("freq").alias("_freq"))
    plain = base.select(F.col("_n").alias("_n2"), F.col("_phrase").alias("_phrase2"), F.col("_freq").alias("_freq2"))
    found = counted.join(base, (F.col("n") == F.col("_n")) & (F.col("phrase") == F.col("_phrase")), "left")
    bare = F.when(F.contains("phrase", F.lit("'")), F.replace("phrase", F.lit("'"), F.lit("")))
    found = found.join(plain, (F.col("n") == F.col("_n2")) & (bare == F.col("_phrase2")), "left")
    expected = F.coalesce("_freq", "_freq2", F.lit(patterns.UNSEEN_FREQUENCY))
    return found.select(*by, "n", "phrase", "count", F.log(F.col("count") / F.col("total") / expected).alias("log_odds"))


def lexicon(
    messages: DataFrame, baseline: DataFrame, by: list[str], key: str = "ord", body: str = "body", top: int = patterns.LEXICON_SIZE, least: int = patterns.LEXICON_COUNT, counts: DataFrame | None = None
) -> DataFrame:
    """The top phrases of each group by log-odds, rounded to three places; ties go by n, then first occurrence.

    First occurrences are looked up for the phrases that may be among the top alone, so counting needs no sort.
    counts: a table of phrase_counts(messages, by), if there is one.
    """
    counts = written(phrase_counts(messages, by, key, body), "phrases") if counts is None else counts
    scored = scores(counts, baseline, by, least).withColumn("_score", F.round("log_odds", 3))
    leading = Window.partitionBy(*by).orderBy(F.col("_score").desc())
    contested = written(scored.withColumn("_place", F.rank().over(leading)).filter(F.col("_place") <= top).drop("_place"), "contested")
    wanted = contested.select(*[F.col(c).alias(f"_{c}") for c in (*by, "n", "phrase")])
    same = (F.col("n") == F.col("_n")) & (F.col("phrase") == F.col("_phrase"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    firsts = ngrams(messages, by, key, body).join(wanted, same, "left_semi").groupBy(*[F.col(c).alias(f"_{c}") for c in (*by, "n", "phrase")]).agg(F.min(F.struct("ord", "pos")).alias("_first"))
    order = Window.partitionBy(*by).orderBy(F.col("_score").desc(), "n", "_first")
    ranked = contested.join(firsts, same).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select(*by, "rank", "n", "phrase", "count", "log_odds")


def read_counts(spark: SparkSession, path: str, n: int, top: int = patterns.BASELINE_ROWS) -> DataFrame:
    """n, phrase, freq of the first ``top`` valid lines (phrase, tab, count) of a file sorted by count.

    The limit is the feature. Lines are numbered by file offset order, as Spark reads a file's splits in turn.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    phrase, raw = F.lower(F.btrim(parts[0])), F.btrim(parts[1])
    w = F.split(phrase, " +")
    valid = lines.filter((F.size(parts) == 2) & F.rlike(raw, F.lit("^[0-9]+$")) & (F.size(w) == n) & F.forall(w, lambda x: F.rlike(x, F.lit("^[a-z']+$"))))
    first = valid.select("_at", phrase.alias("phrase"), raw.cast("bigint").alias("count")).orderBy("_at").limit(top)
    return first.select(F.lit(n).alias("n"), "phrase", (F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).alias("freq"))


def frequencies(counts: DataFrame) -> DataFrame:
    """n, phrase, freq over all groups of a table of phrase_counts()."""
    whole = counts.groupBy("n", "phrase").agg(F.sum("count").alias("count"))
    totals = counts.groupBy(F.col("n").alias("_n")).agg(F.sum("count").alias("total"))
    return whole.join(totals, F.col("n") == F.col("_n")).select("n", "phrase", (F.col("count") / F.col("total")).alias("freq"))


def baseline_of(messages: DataFrame, key: str = "ord", body: str = "body") -> DataFrame:
    """n, phrase, freq over all messages: a reference table from one's own documents."""
    return frequencies(written(phrase_counts(messages, [], key, body), "phrases"))
