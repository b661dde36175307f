"""Commands over files: ``python -m penprint.cli COMMAND ...``.

ingest, baseline and fingerprint exchange tables (Parquet folders), or a corpus in one JSON document (a name that ends in
.json); documents for people are JSON. Exit codes: 0
done or passed; 1 too few messages, failed, or no such id; 2 no signal, or a usage error.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from penprint.functions import patterns, text
from penprint.operators import diff, drafts, edits, lexicon, metrics
from penprint.plans import analyze
from penprint.sources import files, mail

DRAFT = "id string, created string, register string, recipients array<string>, subject string, body string, status string"
SENT = "ord bigint, date string, recipients array<string>, subject string, body string"
EDIT = "draft_id string, reviewed string, classification string, observations array<struct<dimension:string,direction:string,evidence:string>>, factual_changes array<string>"
MESSAGE = "ord bigint, subject string, body string"


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    read, path = next((f, p) for f, p in ((mail.read_eml, a.eml_dir), (mail.read_mbox, a.mbox), (mail.read_json, a.json)) if p)
    kept, stats = analyze.corpus(read(spark, path), a.user)
    if a.out.endswith(".json"):
        files.write_corpus(kept, stats, a.user, a.out)
    else:
        kept.write.mode("overwrite").parquet(a.out)
    print(json.dumps({"user": a.user} | stats))
    return 0


def baseline(spark: SparkSession, a: argparse.Namespace) -> int:
    one, two = lexicon.read_counts(spark, a.unigrams, 1, a.top_n), lexicon.read_counts(spark, a.bigrams, 2, a.top_n)
    one.unionByName(two).write.mode("overwrite").parquet(a.out)
    return 0


def fingerprint(spark: SparkSession, a: argparse.Namespace) -> int:
    kept = files.read_corpus(spark, a.corpus) if a.corpus.endswith(".json") else spark.read.parquet(a.corpus)
    try:
        found = analyze.fingerprint(kept, spark.read.parquet(a.baseline), a.user, joined=a.joined)
    except analyze.TooFewMessages as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    files.write_document(found, a.out)
    by_register: dict[str, list] = {}
    for r in analyze.exemplar_rows(kept, a.user, a.keep_name).orderBy("register", "rank").collect():
        by_register.setdefault(r.register, []).append({k: r[k] for k in ("subject", "body", "word_count")})
    files.write_document(by_register, a.exemplars)
    return 0


def redact(spark: SparkSession, a: argparse.Namespace) -> int:
    found = json.loads(Path(a.source).read_text(encoding="utf-8"))
    rows = [(register, i, x["subject"], x["body"]) for register, items in found.items() for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "register string, i int, subject string, body string")
    for r in df.withColumns({c: text.redacted(F.col(c), a.keep_name) for c in ("subject", "body")}).collect():
        found[r.register][r.i] |= {"subject": r.subject, "body": r.body}
    files.write_document(found, a.out)
    return 0


def draft_log(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.record:
        rows = [(a.created, a.register, a.recipient, a.subject, Path(a.body_file).read_text(encoding="utf-8") if a.body_file else None)]
        if not a.created or rows[0][-1] is None:
            print("error: --record needs --created and --body-file", file=sys.stderr)
            return 2
        new = drafts.record(spark.createDataFrame(rows, "created string, register string, recipients array<string>, subject string, body string"))
        files.append_jsonl(new, a.log)
        print(new.first().id)
        return 0
    log = files.read_jsonl(spark, a.log, DRAFT)
    if a.set_status:
        status, draft_id = a.set_status
        if status not in patterns.STATUSES:
            print(f"error: unknown status {status}", file=sys.stderr)
            return 2
        files.rewrite_text(drafts.with_status(spark.read.text(a.log), draft_id, status), a.log)
        return 0
    if a.list_pending:
        if a.now:
            files.rewrite_text(drafts.unexpired_lines(spark.read.text(a.log), a.now), a.log)
            log = files.read_jsonl(spark, a.log, DRAFT)
        for line in drafts.pending(log).toJSON().collect():
            print(line)
        return 0
    one = drafts.by_id(log, a.get or a.match[0])
    if one.isEmpty():
        print("error: no such draft", file=sys.stderr)
        return 1
    print(one.toJSON().first() if a.get else drafts.matches(one, files.read_jsonl(spark, a.match[1], SENT), a.user).toJSON().first())
    return 0


def compare_draft(spark: SparkSession, a: argparse.Namespace) -> int:
    pair = [json.loads(Path(p).read_text(encoding="utf-8")) for p in (a.draft, a.sent)]
    rows = [(x.get("subject", ""), x.get("body", ""), side) for x, side in zip(pair, ("draft", "sent"), strict=True)]
    both = spark.createDataFrame([(0, rows[0][0], rows[0][1], rows[1][0], rows[1][1])], "ord bigint, draft_subject string, draft_body string, sent_subject string, sent_body string")
    found = diff.structural(both).withColumn("sentences", diff.sentence_diff(F.col("draft_body"), F.col("sent_body"))).drop("ord", "draft_body", "sent_body").first().asDict(recursive=True)
    flat = metrics.scalars(metrics.flat(spark.createDataFrame(rows, "subject string, body string, side string"), ["side"])).cache()
    of = lambda side: flat.filter(F.col("side") == side).select("metric", "value")
    found["metrics"] = {r.metric: round(r.delta, 4) for r in edits.signed(of("draft"), of("sent")).collect()}
    found["metrics_one_sided"] = {r.metric: {"draft": r.a, "sent": r.b} for r in edits.one_sided(of("draft"), of("sent")).collect()}
    files.write_document(found, a.out)
    return 0


def edit_log(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.record:
        new = spark.read.schema(EDIT).option("multiLine", True).json(a.record)
        if edits.recorded(new).count() < new.count():
            print("error: an observation isn't valid; nothing was written", file=sys.stderr)
            return 1
        files.append_jsonl(new, a.log)
        return 0
    log = files.read_jsonl(spark, a.log, EDIT).withColumn("ord", F.monotonically_increasing_id())
    for line in edits.promotable(log).orderBy("dimension", "direction").toJSON().collect():
        print(line)
    return 0


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    read = lambda p: spark.read.schema(MESSAGE).option("multiLine", True).json(p)
    verdict, gaps = analyze.holdout(read(a.holdout), read(a.profile_drafts), read(a.control_drafts))
    row = verdict.first()
    print(json.dumps(row.asDict()))
    for r in gaps.collect():
        print(f"  {r.metric}: {r.delta:.3f}")
    return 2 if row["pass"] is None else 0 if row["pass"] else 1


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="penprint", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(f, *needed: str) -> argparse.ArgumentParser:
        p = commands.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run=f)
        for name in needed:
            p.add_argument(f"--{name}", required=True)
        return p

    p = command(ingest, "user", "out")
    source = p.add_mutually_exclusive_group(required=True)
    for name in ("eml-dir", "mbox", "json"):
        source.add_argument(f"--{name}")
    command(baseline, "unigrams", "bigrams", "out").add_argument("--top-n", type=int, default=patterns.BASELINE_ROWS)
    p = command(fingerprint, "corpus", "baseline", "user", "out", "exemplars")
    p.add_argument("--joined", action="store_true")
    p.add_argument("--keep-name", action="append", default=[])
    p = command(redact, "out")
    p.add_argument("--in", dest="source", required=True)
    p.add_argument("--keep-name", action="append", default=[])
    p = command(draft_log, "log")
    act = p.add_mutually_exclusive_group(required=True)
    act.add_argument("--record", action="store_true")
    act.add_argument("--list-pending", action="store_true")
    act.add_argument("--get", metavar="ID")
    act.add_argument("--set-status", nargs=2, metavar=("STATUS", "ID"))
    act.add_argument("--match", nargs=2, metavar=("ID", "SENT"))
    for name in ("created", "register", "subject", "body-file", "now", "user"):
        p.add_argument(f"--{name}", default=None if name in ("body-file", "now", "user") else "")
    p.add_argument("--recipient", action="append", default=[])
    command(compare_draft, "draft", "sent", "out")
    p = command(edit_log, "log")
    act = p.add_mutually_exclusive_group(required=True)
    act.add_argument("--record", metavar="FILE")
    act.add_argument("--promotable", action="store_true")
    command(evaluate, "holdout", "profile-drafts", "control-drafts")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("penprint").getOrCreate(), a)



if __name__ == "__main__":
    raise SystemExit(main())
