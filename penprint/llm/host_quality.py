"""Quality rules of documents, and verdicts on hosts from their shrunken failure rates.

Base rules look at one text: fewer than ten words, or more than a fifth of the words in repeated five-word
windows. A soft rule (a fifth of the lines are repeats, or symbols are more than a tenth of the words) also counts as a failure of
the host, without rejecting the document by itself. For each host, ``fails ~ BetaBinomial(n; a, b)``: the prior Beta(a, b) is
fitted to all hosts' rates by moments, each host's rate is shrunk to ``(fails + a) / (n + a + b)``, and hosts whose rate
lies over LIMIT standard deviations of the prior above its mean are rejected: their failing documents go, by either kind of rule,
while clean documents of any host stay. Where hosts differ no more than chance makes them, the moments give no weight; the
prior then counts as many documents as the harmonic mean of the hosts' sizes.

Counts are grouped by host with partial sums before the shuffle, so a host with a third of all rows costs one
row a task. Host verdicts are joined back by host; that table is as long as there are hosts, so Spark
chooses the join by its size.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; with one host, or
hosts of equal rates, no host is over the limit; repeated rows count each time; very long texts are measured whole; empty
tables give empty results; further columns pass through, but those named as RESULTS are replaced (names starting with
``_q_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import BLANKS, blank_words, let, written

SYMBOLS = "[#*$%&|<>]"
WINDOW, LEAST_WORDS, REPEAT_SHARE = 5, 10, 20
#: A host is rejected above the prior's mean and this many of its standard deviations.
LIMIT = 1.0
RESULTS = ["base_failed", "host_rate", "host_rejected", "kept"]


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that occur twice or more in the text, the first occurrence included."""

    def covered(s: Column) -> Column:
        """s: (hash, position) of the windows, sorted."""
        twice = F.filter(
            F.transform(
                s,
                lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]),
            ),
            lambda p: p.isNotNull(),
        )
        gaps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))
        return let(F.sort_array(twice), lambda p: F.aggregate(gaps(p), F.lit(0), lambda t, x: t + x))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(let(let(hashed, windows), counted))


def measures(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, all bigint."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of(w: Column) -> Column:
        return let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.translate(t, BLANKS, "")).cast("bigint").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                repeat_words(w).cast("bigint").alias("n_repeat_words"),
            ),
        )

    return let(blank_words(text), of)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _q_measures, base_failed and _q_failed (base or soft rule)."""
    m = F.col("_q_measures")
    base = (m.n_words < LEAST_WORDS) | (100 * m.n_repeat_words > REPEAT_SHARE * m.n_words)
    soft = (5 * m.n_dup_lines > m.n_lines) | (10 * m.n_symbols > m.n_words)
    return docs.drop(*RESULTS).withColumn("_q_measures", measures(F.col(text))).withColumn("base_failed", base).withColumn("_q_failed", base | soft)


def host_rates(rated: DataFrame, host: str) -> DataFrame:
    """One row a host: host_docs, host_failed, host_rate (shrunken), host_rejected. rated: from measured()."""
    counts = rated.groupBy(F.col(host).alias("_q_host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("_q_failed").cast("bigint")).alias("host_failed"))
    n, rate = F.col("host_docs"), F.col("host_failed") / F.col("host_docs")
    mean, spread, inverse_n = counts.agg(F.sum("host_failed") / F.sum(n), F.var_samp(rate), F.avg(1 / n)).first()
    a, b = prior(mean, spread, inverse_n)
    limit = (mean or 0.0) + LIMIT * deviation(a, b)
    shrunk = (F.col("host_failed") + F.lit(a)) / (n + F.lit(a + b))
    return counts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > limit)


def prior(mean: float | None, spread: float | None, inverse_n: float | None) -> tuple[float, float]:
    """Beta(a, b) by moments from the hosts' pooled rate, the variance of their rates and the mean of 1/n."""
    mean = mean or 0.0
    within, size = mean * (1 - mean), 1 / inverse_n if inverse_n else 0.0
    weight = size
    if inverse_n is not None and inverse_n < 1 and (between := (spread or 0.0) - within * inverse_n) > 0:
        weight = max(0.0, min(size, within * (1 - inverse_n) / between - 1))
    return mean * weight, (1 - mean) * weight


def deviation(a: float, b: float) -> float:
    """Standard deviation of Beta(a, b); zero without weight."""
    n = a + b
    return (a * b / n / n / (n + 1)) ** 0.5 if n > 0 else 0.0


def verdicts(rated: DataFrame, host: str = "source") -> DataFrame:
    """rated with host_rate, host_rejected and kept. rated: a table made from measured(); it is read twice."""
    hosts = written(host_rates(rated, host).select("_q_host", "host_rate", "host_rejected"), "hosts")
    joined = rated.join(hosts, F.col(host).eqNullSafe(F.col("_q_host")), "left").drop("_q_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & F.col("_q_failed")))


def judged(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """docs with measures, base_failed, host_rate, host_rejected and kept."""
    return verdicts(written(measured(docs, text), "measured"), host)
