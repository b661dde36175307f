"""From parsed mail to the corpus, its fingerprint and its exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions import patterns, text
from penprint.operators import dedupe, lexicon, metrics, registers
from penprint.sources import mail
from penprint.storage import written


class TooFewMessages(ValueError):
    """The corpus is below the size that a fingerprint needs."""


def corpus(parsed: DataFrame, user: str) -> tuple[DataFrame, dict[str, int]]:
    """The deduplicated messages (a table, with is_terse), and the counts of what was dropped."""
    judged = mail.judged(parsed, user)
    kept = written(dedupe.deduplicated(written(mail.normalized(judged), "normalized")), "corpus")
    return kept, mail.drop_counts(judged, kept).first().asDict()


def blocks(messages: DataFrame, baseline: DataFrame, by: list[str], joined_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The long table of scalar metrics, and the lexicon, of each group."""
    return metrics.flat(messages, by, joined_by=joined_by), lexicon.lexicon(messages, baseline, by)


def _nested(rows: list) -> dict:
    out: dict = {}
    for path, value in rows:
        *above, leaf = path.split(".")
        node = out
        for part in above:
            node = node.setdefault(part, {})
        node[leaf] = value
    return out


def _block(rows: list, words: list) -> dict:
    """One block of the document: a distribution is its median and the interquartile range; a metric no message has is null."""
    out = {"ask_placement_median": None} | _nested(rows)
    for summary in out.get("shape", {}).values():
        summary["iqr"] = [summary.pop("low"), summary.pop("high")]
    return out | {"lexicon": words}


def fingerprint(messages: DataFrame, baseline: DataFrame, user: str, joined: bool = False) -> dict:
    """The fingerprint document: one block of the corpus and one of each register of enough messages.

    joined: sentences of the stance rates are those of all bodies as one text (see metrics.stance).
    Only grouped results reach the driver: a few dozen metrics and at most LEXICON_SIZE phrases a group.
    """
    main = messages.filter(~F.col("is_terse"))
    size = main.count()
    if size < patterns.CORPUS_MESSAGES:
        raise TooFewMessages(f"{size} usable messages, {patterns.CORPUS_MESSAGES} are needed")
    assigned = written(registers.assigned(main, user.split("@", 1)[1].lower()), "registers")
    counts = {r["register"]: r["messages"] for r in registers.counted(assigned).collect()}
    # Each message counts for its register and for the corpus as a whole.
    both = assigned.withColumn("grp", F.explode(F.array(F.col("register"), F.lit("*"))))
    flat, words = blocks(both, baseline, ["grp"], "ord" if joined else None)
    found: dict[str, list] = {}
    for r in flat.collect():
        found.setdefault(r["grp"], []).append((r["metric"], r["value"]))
    lists: dict[str, list] = {}
    for r in words.orderBy("grp", "rank").collect():
        lists.setdefault(r["grp"], []).append({"phrase": r["phrase"], "count": r["count"], "log_odds": r["log_odds"]})
    block = lambda g: _block(found.get(g, []), lists.get(g, []))
    dates = metrics.date_range(main, []).first()
    return {
        "user": user,
        "corpus_size": size,
        "date_range": list(dates),
        "baseline": block("*"),
        "registers": {g: {"count": n, "metrics": block(g)} for g, n in counts.items() if n >= patterns.REGISTER_MESSAGES},
        "suppressed_registers": {g: n for g, n in counts.items() if n < patterns.REGISTER_MESSAGES},
        "english_metrics_valid": metrics.english_valid(main, []).first()[0],
    }


def exemplar_rows(messages: DataFrame, user: str, keep: list[str] | None = None) -> DataFrame:
    """Redacted exemplars of every register, and of the terse messages."""
    main = registers.assigned(messages.filter(~F.col("is_terse")), user.split("@", 1)[1].lower())
    terse = messages.filter("is_terse").withColumn("register", F.lit("terse_ack"))
    rows = registers.exemplars(main).unionByName(registers.exemplars(terse, count=patterns.TERSE_EXEMPLARS))
    return rows.withColumns({c: text.redacted(F.col(c), keep) for c in ("subject", "body")})


def register_deltas(flat: DataFrame, group: str = "grp") -> DataFrame:
    """Each group's scalar metrics less those of the corpus (group ``*``)."""
    found = metrics.scalars(flat)
    whole = found.filter(F.col(group) == "*").select(F.col("metric").alias("_metric"), F.col("value").alias("corpus_value"))
    return found.filter(F.col(group) != "*").join(whole, F.col("metric") == F.col("_metric")).select(group, "metric", "value", "corpus_value", (F.col("value") - F.col("corpus_value")).alias("delta"))


def holdout(truth: DataFrame, profile: DataFrame, control: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdict on two sets of drafts, and the largest gaps that the profile's leave. One pass measures all three sets."""
    from penprint.operators import edits

    sides = [df.withColumn("side", F.lit(name)) for name, df in (("truth", truth), ("profile", profile), ("control", control))]
    flat = written(metrics.scalars(metrics.flat(sides[0].unionByName(sides[1]).unionByName(sides[2]), ["side"])), "sides")
    of = lambda name: flat.filter(F.col("side") == name).select("metric", "value")
    deltas = edits.compared(of("truth"), of("profile"))
    return edits.verdict(deltas, edits.compared(of("truth"), of("control"))), edits.largest_gaps(deltas)
