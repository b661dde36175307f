"""Relational operators on small tables."""

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penprint.operators import dedupe, diff, drafts, edits, lexicon, metrics, registers
from penprint.storage import written


def kept_by_hand(bodies, threshold):
    import re

    def shingles(x):
        w = re.findall("[a-z']+", x.lower())
        return {" ".join(w)} if len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    kept = []
    for i, x in enumerate(bodies):
        s = shingles(x)
        if not any(len(s & o) / len(s | o) >= threshold for _, o in kept):
            kept.append((i, s))
    return [i for i, _ in kept]


def kept(spark, bodies, threshold=0.7):
    df = spark.createDataFrame(list(enumerate(bodies)), "ord bigint, body string")
    return sorted(r.key for r in dedupe.kept_keys(df, threshold=threshold).collect())


def test_dedupe_threshold(spark):
    pair = ["a b c d e f g h i j", "a b c d e f g h i k"]
    assert kept(spark, pair, 0.7) == [0]
    assert kept(spark, pair, 0.85) == [0, 1]


def test_dedupe_chain_keeps_both_ends(spark):
    words = "a b c d e f g h i j k l m n".split()
    chain = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:-1], "x"])]
    for threshold in (0.6, 0.7, 0.8):
        assert kept(spark, chain, threshold) == kept_by_hand(chain, threshold)
    assert kept(spark, chain, 0.8) == [0, 2]


def test_dedupe_of_blank_bodies(spark):
    assert kept(spark, ["", "42", "!", "word"]) == [0, 3]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9).map(" ".join), min_size=1, max_size=14))
def test_dedupe_equals_the_sequential_rule(spark, bodies):
    assert kept(spark, bodies) == kept_by_hand(bodies, 0.7)


def assigned(spark, rows, own="own.com"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, date string, to_domains array<string>, subject string, is_reply boolean")
    return [r.register for r in registers.assigned(df, own).orderBy("ord").collect()]


def test_registers(spark):
    assert assigned(spark, [("1", ["a.com"], "", False), ("2", ["a.com"], "", False)]) == ["cold_outreach", "client"]
    assert assigned(spark, [("2", ["a.com"], "", False), ("1", ["a.com"], "", False)]) == ["client", "cold_outreach"]
    assert assigned(spark, [("", ["a.com"], "", False), ("1", ["a.com"], "", False)]) == ["client", "cold_outreach"]
    assert assigned(spark, [("1", ["a.com"], "", False), ("2", ["a.com", "b.com"], "", False)]) == ["cold_outreach", "client"]
    assert assigned(spark, [("1", ["own.com"], "", False), ("1", ["gmail.com"], "", False), ("1", ["a.com"], "Billing", False), ("1", [], "", False), ("1", [], "", True)]) == ["internal", "personal", "vendor", "cold_outreach", "client"]
    assert assigned(spark, [("1", ["gmail.com"], "", False)], "gmail.com") == ["personal"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25))
def test_quartiles_are_exclusive(spark, values):
    row = metrics.quartiles(spark.createDataFrame([("g", v) for v in values], "g string, v int"), ["g"], "v").first()
    ends = (statistics.quantiles(values, n=4)[0::2]) if len(values) >= 4 else [min(values), max(values)]
    assert [row.median, row.low, row.high] == pytest.approx([statistics.median(values), *ends])


def test_lexicon(spark):
    df = spark.createDataFrame([(i, "g", "it's worth it can't") for i in range(5)], "ord bigint, g string, body string")
    base = spark.createDataFrame([(1, "its", 0.2), (1, "cant", 0.2), (1, "it", 0.2)], "n int, phrase string, freq double")
    top = [r.phrase for r in lexicon.lexicon(df, base, ["g"]).orderBy("rank").collect()]
    assert "worth" in top[:4] and "it's" not in top[:3] and "can't it's" not in top


def test_read_counts(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("The\t60\nof a\t50\nx1\t5\nand\tmany\nand\t40\nto\t10\n")
    rows = lexicon.read_counts(spark, f"file://{tmp_path}/n.tsv", 1, 2).collect()
    assert {(r.phrase, r.freq) for r in rows} == {("the", 0.6), ("and", 0.4)}


LOG = "id string, created string, recipients array<string>, subject string, body string"
SENT = "ord bigint, date string, recipients array<string>, subject string, body string"


def status(spark, draft, sent, user=None):
    rows = [(i, *s) for i, s in enumerate(sent)]
    row = drafts.matches(spark.createDataFrame([("d", *draft)], LOG), spark.createDataFrame(rows, SENT), user).first()
    return row.status, row.candidates


def test_draft_matching(spark):
    draft = ("2026-08-01T10:00:00", ["A@x.com"], "Plan", "one two three four five six seven")
    same = ("2026-08-01T10:00:00", ["a@x.com"], " plan ", "else")
    assert status(spark, draft, [same]) == ("matched", [0])
    assert status(spark, draft, [("2026-08-01T09:59:59", *same[1:])]) == ("none", [])
    assert status(spark, draft, [(same[0], ["b@x.com"], *same[2:])]) == ("none", [])
    like = ("2026-08-02T10:00:00", ["a@x.com"], "Other", draft[3])
    assert status(spark, draft, [like]) == ("matched", [0])
    assert status(spark, draft, [same, like]) == ("ambiguous", [0, 1])
    assert status(spark, draft, [(*same[:3], draft[3])]) == ("matched", [0])
    assert status(spark, (draft[0], [], *draft[2:]), [like, same]) == ("matched", [1])
    own = (same[0], ["me@x.com"], "Plan", "else")
    assert status(spark, draft, [own], "me@x.com") == ("matched", [0])
    assert status(spark, draft, [own]) == ("none", [])
    assert status(spark, draft, [(own[0], ["me@x.com", "b@x.com"], *own[2:])], "me@x.com") == ("none", [])
    assert status(spark, ("never", *draft[1:]), [same]) == ("none", [])


def test_retention_and_status(spark):
    log = spark.createDataFrame([("a", "2026-07-01"), ("b", "2026-08-17"), ("c", "")], "id string, created string")
    assert [r.id for r in drafts.unexpired(log, "2026-08-18").collect()] == ["b"]
    assert drafts.unexpired(log, "whenever").count() == 3
    lines = spark.createDataFrame([('{"id": "a", "status": "pending", "own": [1, 2.50], "none": null}',), ("{broken",), ("",), ("42",), ('{"id": "b"}',)], "value string")
    out = [r.value for r in drafts.with_status(lines, "a", "matched").collect()]
    assert out == ['{"id": "a", "status": "matched", "own": [1, 2.5], "none": null}', "{broken", "42", '{"id": "b"}']
    dated = spark.createDataFrame([('{"created": "2026-08-17", "own": null}',), ('{"created": "2026-01-17"}',), ("{broken",)], "value string")
    assert [r.value for r in drafts.unexpired_lines(dated, "2026-08-18").collect()] == ['{"created": "2026-08-17", "own": null}']
    with pytest.raises(ValueError):
        drafts.with_status(lines, "a", "expired")


def test_a_draft_needs_stamp_and_body(spark):
    rows = [("", "client", ["a@x.com"], "s", "b")]
    with pytest.raises(Exception, match="creation time"):
        drafts.record(spark.createDataFrame(rows, "created string, register string, recipients array<string>, subject string, body string")).collect()


EDITS = "ord bigint, draft_id string, observations array<struct<dimension:string,direction:string,evidence:string>>"


def test_promotion(spark):
    def promoted(*rows):
        return [(r.dimension, r.direction, r["count"], r.evidence) for r in edits.promotable(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EDITS)).collect()]

    cut = lambda d, e="x", way="reduce": (d, [("hedging", way, e)])
    assert promoted(cut("a", "1"), cut("b", "2")) == [("hedging", "reduce", 2, ["1", "2"])]
    assert promoted(cut("a"), cut("a")) == []
    assert promoted(cut("a"), cut("b"), cut("c", way="increase")) == []
    assert promoted(("a", [("style", "reduce", "x")]), ("b", [("style", "reduce", "x")])) == []


def test_one_bad_observation_refuses_the_row(spark):
    rows = [(0, "a", [("hedging", "reduce", "x"), ("style", "reduce", "x")]), (1, "b", [("length", "replace:y", "x")]), (2, "", []), (3, "c", [("length", "reduce", "")])]
    df = spark.createDataFrame(rows, EDITS)
    assert [r.ord for r in edits.recorded(df).collect()] == [1]
    with pytest.raises(Exception, match="isn't valid"):
        edits.recorded(df, strict=True).collect()


@pytest.mark.parametrize(("wins", "losses", "ties", "share", "passed"), [(2, 1, 0, 0.667, False), (3, 1, 0, 0.75, True), (0, 0, 3, None, None), (7, 3, 5, 0.7, True)])
def test_verdict(spark, wins, losses, ties, share, passed):
    rows = [(f"m{i}", 0.0, 1.0) for i in range(wins)] + [(f"l{i}", 1.0, 0.0) for i in range(losses)] + [(f"t{i}", 0.0, 0.0) for i in range(ties)]
    df = spark.createDataFrame(rows, "metric string, p double, c double")
    row = edits.verdict(df.select("metric", F.col("p").alias("delta")), df.select("metric", F.col("c").alias("delta"))).first()
    assert (row.share, row["pass"], row.ties) == (share, passed, ties)


def test_one_sided(spark):
    a, b = (spark.createDataFrame(x, "metric string, value double") for x in ([("x", 1.0), ("y", 2.0)], [("y", 3.0), ("z", 4.0)]))
    assert {(r.metric, r.a, r.b) for r in edits.one_sided(a, b).collect()} == {("x", 1.0, None), ("z", None, 4.0)}
    assert [(r.metric, r.delta) for r in edits.compared(a, b).collect()] == [("y", 1.0)]


def test_signed_deltas(spark):
    a, b = (spark.createDataFrame(x, "metric string, value double") for x in ([("x", 3.0), ("y", 2.0)], [("x", 1.0), ("z", 4.0)]))
    assert [(r.metric, r.delta) for r in edits.signed(a, b).collect()] == [("x", -2.0)]


def test_lexicon_ties_go_by_first_occurrence(spark):
    df = spark.createDataFrame([(5, "g", "zz aa"), (3, "g", "zz aa bb"), (4, "g", "bb zz aa bb"), (9, None, "cc")], "ord bigint, g string, body string")
    base = spark.createDataFrame([], "n int, phrase string, freq double")
    rows = lexicon.lexicon(df, base, ["g"]).orderBy("rank").collect()
    assert [(r.g, r.phrase, r["count"]) for r in rows] == [("g", "zz aa", 3), ("g", "zz", 3), ("g", "aa", 3), ("g", "bb", 3)]


def test_sentence_diff_pairs_what_moved_and_changed(spark):
    before = "Alpha beta gamma delta. The budget is four thousand now. Goodbye to all of you."
    after = "Alpha beta gamma delta. The budget is five thousand now. See you."
    row = spark.createDataFrame([(before, after)], "a string, b string").select(diff.sentence_diff(F.col("a"), F.col("b")).alias("d")).first().d
    assert row.changed == [["The budget is four thousand now.", "The budget is five thousand now."]]
    assert (row.removed, row.added) == (["Goodbye to all of you."], ["See you."])


def test_rewrapping_is_no_edit(spark):
    row = spark.createDataFrame([("One line\nwrapped here. Two.", "One line wrapped\nhere. Two.")], "a string, b string").select(diff.sentence_diff(F.col("a"), F.col("b")).alias("d")).first().d
    assert (row.removed, row.added, row.changed) == ([], [], [])


def test_similar_pairs_move_only_sets_that_met_and_lose_none(spark):
    import random

    dice = random.Random(3)
    line = " ".join(f"b{'x' * k}" for k in range(1, 30))
    rows = []
    for i in range(60):
        words = [dice.choice("abcdefghijklmnop") * dice.randint(1, 5) for _ in range(dice.randint(3, 40))]
        rows.append(f"{line} {' '.join(words)}")
        rows += [f"{line} {' '.join(words[:-1])} z", rows[-1]] if i % 5 == 0 else []
    df = spark.createDataFrame([*enumerate(rows), (0, rows[0])], "doc_id bigint, text string")
    sets = written(dedupe.shingle_sets(df, "doc_id", "text"), "sets")
    firsts, copies = dedupe.first_sets(sets)
    assert firsts.columns == ["key", "set_hash"] and copies.columns == ["key", "set_hash"]
    got = {(r.left, r.right): r.similarity for r in dedupe.similar_pairs(sets, copies).collect()}
    by_set = {}
    for r in sets.collect():
        by_set.setdefault(frozenset(r.shingles), r.key)
        by_set[frozenset(r.shingles)] = min(by_set[frozenset(r.shingles)], r.key)
    want = {tuple(sorted((p, q))): len(a & b) / len(a | b) for a, p in by_set.items() for b, q in by_set.items() if p < q and len(a & b) / len(a | b) >= 0.7}
    assert got == pytest.approx(want) and len(got) > 12


def test_exemplars_leave_bodies_where_they_are(spark):
    rows = [(i, "ab"[i % 2], "s", "Please. " * (i + 1), i + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "ord bigint, register string, subject string, body string, word_count int").filter("ord >= 0")
    found = registers.exemplars(df)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.register, r["rank"], r.ord) for r in found.collect())[:2] == [("a", 1, 8), ("a", 2, 10)]


def test_groups_are_measured_once(spark):
    rows = [("x", "Hi", "Can you look? It's fine."), ("y", "", "Send it.\n\nThanks\nSam"), ("x", None, "")]
    df = spark.createDataFrame(rows, "lang string, subject string, body string")
    groups = F.array("lang", F.lit("*"))
    as_rows = lambda found: {(r.grp, r.metric): r.value for r in found.collect()}
    assert as_rows(metrics.flat(df, ["grp"], groups=groups)) == as_rows(metrics.flat(df.withColumn("grp", F.explode(groups)), ["grp"]))
