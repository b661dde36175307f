"""The commands, end to end on small files."""

import json

from penprint.cli import main
from tests.test_sources import USER, folder  # noqa: F401


def test_analysis_commands(spark, folder, capsys):  # noqa: F811
    at = lambda n: f"file://{folder}/{n}"
    (folder / "u.tsv").write_text("the\t50\nof\t30\n")
    (folder / "b.tsv").write_text("of the\t20\n")
    assert main(["ingest", "--eml-dir", at(""), "--user", USER, "--out", at("corpus")], spark) == 0
    assert json.loads(capsys.readouterr().out)["kept"] == 14
    assert main(["baseline", "--unigrams", at("u.tsv"), "--bigrams", at("b.tsv"), "--out", at("base")], spark) == 0
    out = ["--out", str(folder / "f.json"), "--exemplars", str(folder / "e.json")]
    assert main(["fingerprint", "--corpus", at("corpus"), "--baseline", at("base"), "--user", USER, "--joined", *out], spark) == 0
    assert json.loads((folder / "f.json").read_text())["corpus_size"] == 14
    assert main(["redact", "--in", str(folder / "e.json"), "--out", str(folder / "r.json")], spark) == 0
    assert json.loads((folder / "r.json").read_text()) == json.loads((folder / "e.json").read_text())


def test_draft_and_edit_commands(spark, tmp_path, capsys):
    log, body = f"file://{tmp_path}/drafts", tmp_path / "b.txt"
    body.write_text("The text.")
    record = ["draft-log", "--log", log, "--record", "--subject", "Plan", "--recipient", "k@a.com"]
    assert main(record, spark) == 2
    assert main([*record, "--created", "2026-08-01T10:00:00", "--body-file", str(body)], spark) == 0
    draft = capsys.readouterr().out.split()[-1]
    assert main(["draft-log", "--log", log, "--get", draft], spark) == 0
    assert main(["draft-log", "--log", log, "--get", "d-0"], spark) == 1
    (tmp_path / "sent.jsonl").write_text(json.dumps({"ord": 7, "date": "2026-08-02T10:00:00", "recipients": ["K@a.com"], "subject": "plan", "body": "x"}))
    capsys.readouterr()
    assert main(["draft-log", "--log", log, "--match", draft, f"file://{tmp_path}/sent.jsonl"], spark) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "matched"
    assert main(["draft-log", "--log", log, "--set-status", "expired", draft], spark) == 2
    assert main(["draft-log", "--log", log, "--set-status", "matched", draft], spark) == 0
    assert main(["draft-log", "--log", log, "--list-pending", "--now", "2026-08-03T00:00:00"], spark) == 0
    assert capsys.readouterr().out.strip() == ""
    edit = lambda d, x="hedging": {"draft_id": d, "observations": [{"dimension": x, "direction": "reduce", "evidence": "e"}]}
    (tmp_path / "bad.json").write_text(json.dumps([edit("a"), edit("a", "style")]))
    (tmp_path / "good.json").write_text(json.dumps([edit("a"), edit("b")]))
    edits = ["edit-log", "--log", f"file://{tmp_path}/edits"]
    assert main([*edits, "--record", f"file://{tmp_path}/bad.json"], spark) == 1
    assert main([*edits, "--record", f"file://{tmp_path}/good.json"], spark) == 0
    assert main([*edits, "--promotable"], spark) == 0
    assert json.loads(capsys.readouterr().out)["count"] == 2


def test_diff_and_evaluation_commands(spark, tmp_path):
    pair = {"draft": "I think it is fine. Can you confirm? Thanks to you all for the work.", "sent": "It is fine. Can you confirm? Thanks to you all for the work."}
    for k, v in pair.items():
        (tmp_path / f"{k}.json").write_text(json.dumps({"subject": "s", "body": v}))
    assert main(["compare-draft", "--draft", str(tmp_path / "draft.json"), "--sent", str(tmp_path / "sent.json"), "--out", str(tmp_path / "d.json")], spark) == 0
    found = json.loads((tmp_path / "d.json").read_text())
    assert found["classification"] == "edited" and found["sentences"]["changed"] and found["metrics"]["stance.hedges_per_100w"] < 0
    sets = {"t": ["Hi! Go on."] * 3, "p": ["Hi! Go on."] * 3, "c": ["We will go on; it is so."] * 3}
    for k, v in sets.items():
        (tmp_path / f"{k}.json").write_text(json.dumps([{"ord": i, "subject": "s", "body": b} for i, b in enumerate(v)]))
    run = lambda p, c: main(["evaluate", "--holdout", f"file://{tmp_path}/t.json", "--profile-drafts", f"file://{tmp_path}/{p}.json", "--control-drafts", f"file://{tmp_path}/{c}.json"], spark)
    assert (run("p", "c"), run("c", "p"), run("p", "p")) == (0, 1, 2)
