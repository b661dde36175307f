"""Text measures on small examples."""

import pytest
from pyspark.sql import functions as F

from penprint.functions import text as t


@pytest.fixture
def of(spark):
    def run(f, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first()[0]

    return run


def test_sentences_and_paragraphs(of):
    assert len(of(t.sentences, "One. Two! Three? Four")) == 4
    assert len(of(t.sentences, "Meet Dr. Webb at 5 p.m. tomorrow.")) == 1
    assert of(t.sentences, " ") == []
    assert of(t.paragraphs, "A\nB\n\nC") == ["A\nB", "C"]


@pytest.mark.parametrize(
    ("body", "kind"), [("Hi Priya,", "hi_name"), ("Hey Marcus -", "hey_name"), ("Priya —", "name_dash"), ("Priya,", "bare_name"), ("Pushed the fix.", "none"), ("hi there", "hi_name"), ("", "none")]
)
def test_openers(of, body, kind):
    assert of(t.opener, body) == kind


@pytest.mark.parametrize(
    ("body", "closer", "form"), [("x\n\nBest,\nDana Reyes", "best", "full_name"), ("x\n\n— Dana", "none", "first_name"), ("x\nThanks", "thanks", "first_name"), ("x\n- D", "none", "initial"), ("", "none", "none"), ("all lower here", "none", "none")]
)
def test_closers(of, body, closer, form):
    assert (of(t.signoff, body), of(t.name_form, body)) == (closer, form)


def test_rates(of):
    assert (of(t.n_contracted, "I don't think we can't win"), of(t.n_expanded, "I don't think we can't win")) == (2, 0)
    assert (of(t.n_contracted, "I do not think it"), of(t.n_expanded, "I do not think it")) == (0, 1)
    text = "a — b -- c... d… e! f; (g) \U0001f600"
    counts = {k: of(lambda c, k=k: t.n_punctuation(c, k), text) for k in t.PUNCTUATION}
    assert counts == {"em_dash": 2, "ellipsis": 2, "exclamation": 1, "semicolon": 1, "parenthesis": 1, "emoji": 1}
    assert of(t.n_hedges, "I just think maybe we should wait, I think.") == 3


@pytest.mark.parametrize(
    ("body", "place"), [("Hi Priya,\n\nCan you confirm by Thursday?", 0.5), ("Need the client deck by noon.", 0.0), ("Need-to-know basis applies here.", None), ("Check-ins are weekly now.", None), ("", None)]
)
def test_ask_placement(of, body, place):
    assert of(t.ask_placement, body) == place


def test_quotes_are_cut(of):
    assert of(t.without_quotes, "mine \U0001f600\U0001f600\n\nOn Mon, X wrote:\n> q") == "mine \U0001f600\U0001f600"
    assert of(t.without_quotes, "mine\n-- Original Message --\nx") == "mine"
    assert of(t.without_quotes, "mine\nFrom: a\nSent: b\nx") == "mine"
    assert of(t.without_quotes, "mine\n____________\nx") == "mine"
    assert of(t.without_quotes, "a > b") == "a > b"


def test_signatures_are_cut(of):
    assert of(t.without_signature, "Body.\n\n-- \nDana") == "Body."
    assert of(t.without_signature, "ok\n\nSent from my iPhone") == "ok"
    assert of(t.without_signature, "Body here.\nThanks\n\nDana Reyes\nAcme Works\ndana@x.com | 555-123-4567") == "Body here.\nThanks"
    assert of(t.without_signature, "Pushed the fix.\n\n— Dana") == "Pushed the fix.\n\n— Dana"
    assert of(t.without_signature, "call 415-555-0100 now") == "call 415-555-0100 now"


@pytest.mark.parametrize(
    ("body", "out"),
    [
        ("mail a.b@c.com call 415-555-0100 see https://x.y/z pay $47,500 now", "mail [EMAIL] call [PHONE] see [URL] pay [$AMOUNT] now"),
        ("at 12 Main Street", "at [ADDRESS]"),
        ("Hi Steven,\nx\n\nThanks,\nDana", "Hi [FIRST],\nx\n\nThanks,\nDana"),
        ("Hi Monday,", "Hi Monday,"),
        ("Craig, Terri,\nhello", "[FIRST], [FIRST],\nhello"),
        ("Steven,\nhello", "[FIRST],\nhello"),
        ("Team,\nhello", "Team,\nhello"),
        ("Google, as usual, changed the rules.", "Google, as usual, changed the rules."),
        ("by Thursday, April 17?", "by Thursday, April 17?"),
        ("x\n\nBest,\nSam Lee", "x\n\nBest,\n[FIRST]"),
    ],
)
def test_redaction(of, body, out):
    keep = lambda c: t.redacted(c, ["Dana"])
    assert of(keep, body) == out
    assert of(keep, out) == out


def test_similarity(of):
    assert of(t.similarity, "a b c d e f g h i j", "a b c d e f g h i k") == pytest.approx(5 / 7)
    assert of(t.similarity, "", "") == 0.0
    assert of(t.similarity, "a b", "a b") == 1.0


def test_what_mail_programs_change_is_undone(of):
    text = "see https://www.google.com/url?q=http%3A%2F%2Fgithub.com/x&sa=1 now\nand\n- a\n- b c\nd\n\nnext"
    assert of(t.for_comparison, text) == "see github.com/x now and\n- a\n- b c d\n\nnext"


def test_draft_ids(of):
    made = of(t.draft_id, "2026-08-18T23:30:00-04:00", "Hi")
    assert made.startswith("d-20260818-") and len(made) == 19
    assert of(t.draft_id, "soon", "Hi").startswith("d-00000000-")
