"""Mail, JSON and log sources, the whole analysis, and the streams."""

import json
import textwrap

import pytest

from penprint.operators import lexicon
from penprint.plans import analyze
from penprint.sources import files, mail
from penprint.streaming import logs

USER = "dana@own.com"


def message(i, to="kim@a.com", subject="Plan", body="One two three.", extra="", kind="text/plain"):
    return textwrap.dedent(
        f"""\
        From: Dana <{USER}>
        To: {to}
        Subject: {subject}
        Date: Mon, 14 Apr 2025 08:{i:02d}:00 -0400
        Message-ID: <m{i}@own.com>
        {extra}Content-Type: {kind}; charset="utf-8"

        """
    ) + body


@pytest.fixture
def folder(tmp_path):
    long = "We should look at number {} before the end of the {} since it is what the {} asked for in the note. Thanks for {}."
    for i in range(14):
        words = [f"w{chr(97 + i)}", f"x{chr(97 + i)}", f"y{chr(97 + i)}", f"z{chr(97 + i)}"]
        (tmp_path / f"a{i:02d}.eml").write_text(message(i, to=f"kim@c{i % 3}.com", body=long.format(*words)))
    (tmp_path / "b1.eml").write_text(message(20, to=USER))
    (tmp_path / "b2.eml").write_text(message(21, body="https://x.y/z"))
    (tmp_path / "b3.eml").write_text(message(22, extra="Auto-Submitted: auto-replied\n"))
    (tmp_path / "b4.eml").write_text(message(23, body="Short and sweet."))
    (tmp_path / "b5.eml").write_text(message(24, body="<p>Mine</p><blockquote><p>theirs</p><div>more</div></blockquote><p>also mine</p>", kind="text/html"))
    (tmp_path / "c.txt").write_text("not mail")
    return tmp_path


def test_analysis_of_a_folder(spark, folder):
    kept, stats = analyze.corpus(mail.read_eml(spark, f"file://{folder}"), USER)
    assert stats == {"raw": 19, "self_addressed": 1, "machine_generated": 1, "deduped": 16, "kept": 14, "terse": 2}
    bodies = {r.body.split()[0]: " ".join(r.body.split()) for r in kept.filter("is_terse").collect()}
    assert bodies["Mine"] == "Mine also mine"
    found = analyze.fingerprint(kept, lexicon.baseline_of(kept), USER)
    assert found["corpus_size"] == 14
    assert sum(r["count"] for r in found["registers"].values()) + sum(found["suppressed_registers"].values()) == 14
    assert found["suppressed_registers"] == {"cold_outreach": 3} and found["registers"]["client"]["count"] == 11
    assert found["date_range"][0] == "2025-04-14T08:00:00-04:00"
    files.write_document(found, str(folder / "out" / "fingerprint.json"))
    assert json.loads((folder / "out" / "fingerprint.json").read_text())["baseline"]["shape"]["words_per_email"]["median"] > 10
    shape = found["baseline"]["shape"]["words_per_email"]
    assert set(shape) == {"median", "iqr"} and shape["iqr"][0] <= shape["median"] <= shape["iqr"][1]
    assert {r.register for r in analyze.exemplar_rows(kept, USER).collect()} == {"client", "cold_outreach", "terse_ack"}
    with pytest.raises(analyze.TooFewMessages):
        analyze.fingerprint(kept.limit(3), lexicon.baseline_of(kept), USER)


def test_mbox_equals_its_messages(spark, folder):
    names = sorted(p.name for p in folder.glob("*.eml"))
    (folder / "all.mbox").write_text("".join(f"From x Mon Apr 14 08:00:00 2025\n{(folder / n).read_text()}\n\n" for n in names))
    one = {(r.id, r.subject, r.body.strip()) for r in mail.read_mbox(spark, f"file://{folder}/all.mbox").collect()}
    assert one == {(r.id, r.subject, r.body.strip()) for r in mail.read_eml(spark, f"file://{folder}").collect()}


def test_mbox_bytes_stay(spark, tmp_path):
    raw = b"From x Mon Apr 14 08:00:00 2025\nFrom: a@own.com\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\ncaf\xe9 cr\xe8me\n>From here\n\nFrom y Mon\nFrom: b@own.com\nSubject: s\n\nlast\n"
    (tmp_path / "m.mbox").write_bytes(raw)
    rows = mail.read_mbox(spark, f"file://{tmp_path}/m.mbox").orderBy("ord").collect()
    assert [r.body.strip() for r in rows] == ["caf\u00e9 cr\u00e8me\n>From here", "last"]


def test_corpus_document_round_trip(spark, folder):
    kept, stats = analyze.corpus(mail.read_eml(spark, f"file://{folder}"), USER)
    files.write_corpus(kept, stats, USER, str(folder / "corpus.json"))
    whole = json.loads((folder / "corpus.json").read_text())
    assert (len(whole["messages"]), len(whole["terse_ack"]), whole["stats"], whole["user"]) == (14, 2, stats, USER)
    assert list(whole["messages"][0]) == ["id", "date", "to_domains", "recipient_count", "subject", "body", "is_reply", "word_count"]
    back = files.read_corpus(spark, f"file://{folder}/corpus.json")
    same = lambda df: sorted(tuple(str(r[c]) for c in (*files.MESSAGE, "is_terse")) for r in df.collect())
    assert same(back) == same(kept)


def test_json_records(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps([{"id": "1", "from": USER, "to": "A <a@X.com>, b@x.com", "cc": "c@y.com", "subject": "Re: s", "date": "Mon, 14 Apr 2025 08:00:00 -0400", "body": "word " * 20}, {"body": "lone"}]))
    parsed = mail.read_json(spark, f"file://{tmp_path}/raw.json")
    rows = mail.normalized(mail.judged(parsed, USER)).collect()
    assert [(r.id, r.to_domains, r.recipient_count, r.is_reply, r.word_count, r.date) for r in rows] == [("1", ["x.com", "y.com"], 3, True, 20, "2025-04-14T08:00:00-04:00")]


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('﻿{"id": "a"}\n\n{broken\n42\n[1]\n{"id": "b"}\n')
    assert [r.id for r in files.read_jsonl(spark, f"file://{tmp_path}/log.jsonl", "id string").collect()] == ["a", "b"]
    assert files.read_jsonl(spark, f"file://{tmp_path}/none.jsonl", "id string").count() == 0


def test_html_containers():
    own = lambda h: " ".join(mail.own_html_text(h).split())
    assert own('<div class="x gmail_quote"><div>a</div><div>b</div></div>mine<br>too') == "mine too"
    assert own("a<blockquote>b<blockquote>c</blockquote>d</blockquote>e &amp; f") == "a e & f"
    assert own("a<blockquote>b never closed") == "a"
    assert own("") == ""


def test_edit_stream(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    row = lambda i, d: json.dumps({"ord": i, "draft_id": d, "reviewed": "2026-08-01T10:00:00", "classification": "edited", "observations": [{"dimension": "hedging", "direction": "reduce", "evidence": "x"}]})
    (log / "1.json").write_text(row(0, "a") + "\n" + row(1, "b") + "\n" + row(1, "b") + "\n")
    stream = logs.edit_stream(spark, f"file://{log}")
    query = logs.promote_on_arrival(stream, f"file://{tmp_path}/state", f"file://{out}", f"file://{tmp_path}/cp")
    found = lambda: [(r.dimension, r["count"], r.evidence) for r in spark.read.parquet(f"file://{out}").collect()]
    query.processAllAvailable()
    assert found() == [("hedging", 2, ["x", "x"])]
    (log / "2.json").write_text(row(2, "c") + "\n" + row(3, "a"))
    query.processAllAvailable()
    query.stop()
    assert found() == [("hedging", 3, ["x", "x", "x"])]
    assert logs.daily_observations(stream).isStreaming


def test_html_references_without_semicolon():
    assert mail.own_html_text("<h1>a &amp;&amp</h1>b &lt;c&gt").split() == ["a", "&&", "b", "<c>"]
