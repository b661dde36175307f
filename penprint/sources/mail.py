"""Mail from .eml folders, mbox files and JSON dumps, and its normal form.

MIME and HTML need parsers, so these run in Python over Arrow batches; every filter and projection after that is
a column expression. Parsed rows: ord, id, sender, recipients (array), subject, date (ISO text or empty),
content_type, auto (an auto-reply header), body.
"""

from __future__ import annotations

from collections.abc import Iterator
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions import patterns, text
from penprint.storage import written

PARSED = "ord bigint, id string, sender string, recipients array<string>, subject string, date string, content_type string, auto boolean, body string"
JSON_RECORD = "id string, `from` string, `to` string, cc string, subject string, date string, body string"


class OwnText(HTMLParser):
    """Text outside quotation containers; each tag leaves a blank."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[tuple[str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in patterns.VOID_TAGS:
            self.open.append((tag, tag == "blockquote" or "gmail_quote" in (dict(attrs).get("class") or "").split()))
        self.parts.append(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        # A tag closes the last one of its name and what was left open inside.
        at = max((i for i, (name, _) in enumerate(self.open) if name == tag), default=None)
        if at is not None:
            del self.open[at:]
        self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if not any(quotes for _, quotes in self.open):
            self.parts.append(data)


def own_html_text(html: str | None) -> str:
    parser = OwnText()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Balanced containers need a stack, which no regular expression has."""
    return html.map(own_html_text)


def _body(message: EmailMessage) -> str:
    for kind, read in (("plain", str), ("html", own_html_text)):
        part = message.get_body(preferencelist=(kind,))
        if part is not None:
            return read(part.get_content())
    return ""


def _date(value: str | None) -> str:
    try:
        return parsedate_to_datetime(value or "").isoformat()
    except (TypeError, ValueError):
        return ""


def _row(ord_: int, raw: bytes) -> dict | None:
    try:
        message = BytesParser(policy=policy.default).parsebytes(raw)
        header = lambda name: str(message.get(name) or "")
        return {
            "ord": ord_,
            "id": header("Message-ID"),
            "sender": header("From"),
            "recipients": [a for _, a in getaddresses([header("To"), header("Cc")])],
            "subject": header("Subject"),
            "date": _date(header("Date")),
            "content_type": message.get_content_type() or "",
            "auto": any(header(h) and header(h).lower() != "no" for h in patterns.AUTO_HEADERS),
            "body": _body(message).replace("\r\n", "\n"),
        }
    except (LookupError, ValueError, KeyError, AttributeError):  # a message that can't be read is left out
        return None


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PARSED.split(", ")]
    for frame in frames:
        rows = [r for o, raw in zip(frame["ord"], frame["raw"], strict=True) if (r := _row(o, bytes(raw)))]
        yield pd.DataFrame(rows, columns=columns)


def read_eml(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of *.eml files in a folder, numbered in the order of their names (with gaps)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder).select("path", F.col("content").alias("raw"))
    numbered = written(files.select("path").orderBy("path").withColumn("ord", F.monotonically_increasing_id()), "names")
    return files.join(numbered, "path").select("ord", "raw").mapInPandas(_parse, PARSED)


def _without_mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of messages that a separator parted: the rest of the mark's line goes."""
    for frame in frames:
        frame["raw"] = [bytes(raw).partition(b"\n")[2] for raw in frame["raw"]]
        yield frame


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files. The mark between messages is the record separator, so large files are split; bytes stay as they are."""
    lines = spark.read.option("lineSep", "\nFrom ").text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").cast("binary").alias("raw"))
    return lines.filter(F.octet_length("raw") > 0).mapInPandas(_without_mark, "ord bigint, raw binary").mapInPandas(_parse, PARSED)


@F.pandas_udf(T.ArrayType(T.StringType()))
def parsed_addresses(headers: pd.Series) -> pd.Series:
    return headers.map(lambda h: [a for _, a in getaddresses([h or ""])])


@F.pandas_udf(T.StringType())
def iso_date(dates: pd.Series) -> pd.Series:
    """ISO text with the offset of an RFC 2822 date; a Spark timestamp would lose the offset."""
    return dates.map(_date)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a JSON array of records; missing keys are empty."""
    raw = spark.read.schema(JSON_RECORD).option("multiLine", True).json(path)
    filled = raw.select(F.monotonically_increasing_id().alias("ord"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("id", "from", "to", "cc", "subject", "date", "body")])
    to = F.when(F.col("cc") == "", F.col("to")).otherwise(F.concat_ws(", ", "to", "cc"))
    return filled.select(
        "ord", "id", F.col("from").alias("sender"), parsed_addresses(to).alias("recipients"), "subject", iso_date("date").alias("date"), F.lit("text/plain").alias("content_type"), F.lit(False).alias("auto"), F.regexp_replace("body", "\r\n", "\n").alias("body")
    )


def is_self_addressed(user: str):
    """The user is the only recipient."""
    filled = F.filter("recipients", lambda a: a != "")
    return (F.size(filled) > 0) & F.forall(filled, lambda a: F.lower(a) == user.lower())


def is_machine_generated():
    """A marker of a tool, or hardly anything besides links."""
    lowered, out = F.lower("body"), F.lit(False)
    for marker in patterns.MACHINE_MARKERS:
        out = out | F.contains(lowered, F.lit(marker))
    return out | (F.rlike("body", F.lit(patterns.URL)) & (text.n_blank_words(F.regexp_replace("body", patterns.URL, " ")) < patterns.LINK_ONLY_WORDS))


def judged(parsed: DataFrame, user: str) -> DataFrame:
    """parsed with drop_reason: self_addressed, machine_generated, unusable, or null for messages that stay."""
    subject = F.lower("subject")
    automatic = F.col("auto") | F.startswith(subject, F.lit("out of office")) | F.startswith(subject, F.lit("automatic reply"))
    body = text.strip(text.without_signature(text.without_quotes(F.col("body"))))
    unusable = ~F.contains(F.lower("sender"), F.lit(user.lower())) | automatic | F.startswith("content_type", F.lit("text/calendar")) | (body == "")
    reason = F.when(is_self_addressed(user), "self_addressed").when(is_machine_generated(), "machine_generated").when(unusable, "unusable")
    return parsed.withColumn("drop_reason", reason).withColumn("own_body", body)


def normalized(judged_messages: DataFrame) -> DataFrame:
    """Messages that stay: ord, id, date, to_domains, recipient_count, subject, body, is_reply, word_count, is_terse."""
    words = text.n_blank_words(F.col("own_body"))
    return judged_messages.filter("drop_reason is null").select(
        "ord",
        F.coalesce(F.nullif("id", F.lit("")), F.substring("subject", 1, 40)).alias("id"),
        "date",
        text.domains(F.col("recipients")).alias("to_domains"),
        F.size("recipients").alias("recipient_count"),
        "subject",
        F.col("own_body").alias("body"),
        F.startswith(F.lower("subject"), F.lit("re:")).alias("is_reply"),
        words.alias("word_count"),
        (words < patterns.TERSE_WORDS).alias("is_terse"),
    )


def drop_counts(judged_messages: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: raw, self_addressed, machine_generated, deduped, kept, terse. kept: after deduplication."""
    reason = lambda r: F.count_if(F.col("drop_reason") == r).alias(r)
    first = judged_messages.agg(F.count(F.lit(1)).alias("raw"), reason("self_addressed"), reason("machine_generated")).first()
    numbers = [F.lit(v).alias(k) for k, v in first.asDict().items()]
    return kept.agg(F.count(F.lit(1)).alias("deduped"), F.count_if(~F.col("is_terse")).alias("kept"), F.count_if(F.col("is_terse")).alias("terse")).select(*numbers, "deduped", "kept", "terse")
