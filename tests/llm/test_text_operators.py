"""Fingerprints, quality rules, license scans and URL filters on small tables, with edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from penprint.llm import entries, host_quality, licenses, order_minhash, url_filter
from penprint.llm.common import written

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x" * 5000, "the same text of some words here " * 30, "the same text of some words here " * 30, "é\U0001f600 ü # $ a & b", "line one here\nline one here\n\nline one here"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Writes tables to a folder and gives its path."""

    def write(**frames):
        path = f"file://{tmp_path_factory.mktemp('sf')}"
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
        return path

    return write


@pytest.fixture(scope="module")
def docs(tables):
    rows = [(i, t, "en", f"s{i % 2}" if i else None, None) for i, t in enumerate(TEXTS)]
    return tables(documents=(rows, DOCS)), tables(documents=([], DOCS))


def test_op1_edits_and_likeness(spark, docs):
    rows = {r.doc_id: r for r in entries.QUERIES["op1_order_minhash"](spark, docs[0]).collect()}
    ids = sorted(rows, reverse=True)
    texts = [t or "" for t in TEXTS]
    for i, k in enumerate(ids):
        here, nxt = texts[k], texts[ids[(i + 1) % len(ids)]]
        half = len(here) // 2
        edited = here[: len(here) - half] + nxt[:half]
        assert rows[k].n_chars == len(here) and rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[k].near_edited <= 1 and 0 <= rows[k].near_next <= 1
    assert rows[7].fingerprint == rows[8].fingerprint and rows[8].near_next == 1.0
    assert rows[0].fingerprint == rows[1].fingerprint == rows[2].fingerprint == ""
    assert entries.QUERIES["op1_order_minhash"](spark, docs[1]).count() == 0


def test_neighbours_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "DOCS_A_RANGE", 2)
    ids = [i * i for i in range(700)]
    got = order_minhash.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string"), ["text"])
    want = {i: f"t{ids[k - 1]}" for k, i in enumerate(ids)}
    assert {r.doc_id: r.next_text for r in got.collect()} == want


def sketch_by_hand(spark, text, k=5, l=2, m=64):  # noqa: E741
    """The same definition, one k-mer at a time, with Spark's hash."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashed = [r.h for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", F.xxhash64("w").alias("h")).orderBy("i").collect()]
    rows = spark.createDataFrame([(i, *hashed[i : i + k]) for i in range(len(words) - k + 1)], ", ".join(["i int", *[f"h{j} bigint" for j in range(k)]]))
    kmers = [r.x for r in rows.select("i", F.xxhash64(*[f"h{j}" for j in range(k)]).alias("x")).orderBy("i").collect()]
    seen, numbered = {}, []
    for i, x in enumerate(kmers):
        seen[x] = seen.get(x, -1) + 1
        numbered.append((i, x & order_minhash.HASH_MASK, seen[x]))
    g = spark.createDataFrame(numbered, "i int, x bigint, o int").select("i", F.xxhash64("x", "o").alias("g")).collect()
    bins = {}
    for r in g:
        bins.setdefault(r.g % m, []).append(((r.g % 2**64) >> (64 - 27), r.i))
    least = [(b, [kmers[i] for i in sorted(i for _, i in sorted(v)[:l])]) for b, v in sorted(bins.items())]
    tuples = spark.createDataFrame(least, "b int, t array<bigint>").select("b", F.xxhash64("t").alias("v")).orderBy("b").collect()
    return [r.b << 32 | r.v % 2**32 for r in tuples]


@pytest.mark.parametrize("text", ["the quick brown fox jumps over the lazy dog again and again", "a b c d e f " * 25])
def test_sketches_equal_the_definition(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(order_minhash.sketch(F.col("text")).alias("s")).first().s
    assert got == sketch_by_hand(spark, text)


def test_sketches_follow_order(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    rows = spark.createDataFrame([(" ".join(words), " ".join([*words[:200], "x", *words[201:]]), " ".join(moved))], "a string, b string, c string")
    s = [order_minhash.sketch(F.col(c)) for c in "abc"]
    edit, move = rows.select(order_minhash.likeness(s[0], s[1]), order_minhash.likeness(s[0], s[2])).first()
    assert edit > 0.8 > move


def measures_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_op2_measures_and_verdicts(spark, docs):
    for r in entries.QUERIES["op2_host_quality"](spark, docs[0]).collect():
        want = measures_by_hand(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert entries.QUERIES["op2_host_quality"](spark, docs[1]).count() == 0


def test_a_bad_host_keeps_its_clean_documents(spark):
    clean, soft = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i} #" for i in range(40))
    rows = [(i, "short", "bad") for i in range(60)] + [(100, clean, "bad"), (101, soft, "bad"), (102, soft, "good")] + [(200 + i, clean, "good") for i in range(60)]
    got = {r.doc_id: r for r in host_quality.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[100].kept and not got[101].kept and got[102].kept and not got[0].kept
    assert got[100].host_rejected and not got[102].host_rejected


def test_prior_by_moments():
    assert host_quality.prior(None, None, None) == (0.0, 0.0) and host_quality.deviation(0.0, 0.0) == 0.0
    assert host_quality.prior(0.2, 0.0, 0.01) == pytest.approx((20.0, 80.0))
    a, b = host_quality.prior(0.5, 0.2, 0.01)
    assert a == pytest.approx(b) and 0 < a + b < 1
    assert host_quality.deviation(2.0, 3.0) == pytest.approx((6 / 25 / 6) ** 0.5)


def test_hosts_alike_are_not_rejected_and_names_are_replaced(spark):
    clean, soft = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i} #" for i in range(40))
    rows = [(i, soft if i % 4 == 0 else clean, f"h{i // 40}", 7, "x") for i in range(200)] + [(None, None, None, 7, "x"), (3, "w " * 30000, None, 7, "x")]
    found = host_quality.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string, kept int, host_rate string"))
    got = found.collect()
    assert all(r.kept is True and not r.host_rejected for r in got if r.source) and len(got) == 202 and found.columns.count("kept") == 1
    assert sorted((r.doc_id is None, r.base_failed, r.kept) for r in got if not r.source) == [(False, True, False), (True, True, False)]


LICENSES = [None, "", "under the MIT License, or CC BY; apache  license", "gnu general public license gnu general public license", " ".join(licenses.TEMPLATES[0][1].split()[3:55]), "mit" + " license" * 3, "é mit license"]


def test_op3_places_and_labels(spark, tables):
    path = tables(documents=([(i, t, "en", "s", 0) for i, t in enumerate(LICENSES)], DOCS))
    rows = {r.doc_id: r for r in entries.QUERIES["op3_licenses"](spark, path).collect()}
    for i, t in enumerate(LICENSES):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert rows[4].labels == "mit" and rows[4].base_labels == ""


def spans_of(spark, texts):
    rows = licenses.marked(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))
    return sorted((s._row % 2**33, s.label, s.first_word, s.last_word) for s in licenses.spans(written(rows, "marked")).collect())


def test_spans_survive_inserted_words(spark):
    words = next(t for label, t in licenses.TEMPLATES if label == "bsd").split()
    text = "before that " + " ".join([*words[:12], "oddly", *words[12:]])
    assert spans_of(spark, [text, "nothing of the kind at all"]) == [(0, "bsd", 2, 2 + len(words))]


def test_a_repeated_phrase_is_no_license(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    texts = ["a copy of the license is " * 30, ("subject to the terms of the " * 9 + "x ") * 9, "copy of the license " * 5 + notice, f"{notice} {'w ' * 50}{notice}"]
    assert [(i, label) for i, label, _, _ in spans_of(spark, texts)] == [(2, "apache-2.0"), (3, "apache-2.0"), (3, "apache-2.0")]


def test_op3_on_long_texts_and_null_keys(spark):
    notice = "this work is licensed under CC BY-NC 4.0"
    rows = [(None, notice), (None, None), (1, "word " * 60000 + notice), (1, "word " * 60000 + notice)]
    got = sorted(((r.doc_id, r.n_words, r.method_labels) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(None, 10, ["cc-by-nc"]), (None, 0, None), (1, 60010, ["cc-by-nc"]), (1, 60010, ["cc-by-nc"])], key=str)
    assert licenses.scanned(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


PAGES = [
    ("http://A.com/en/x?q#f", "a.com", "/en/x", "com/en/", "block"),
    ("https://www.example.com/en/7z", "www.example.com", "/en/7z", "example.com/en/7", "allow"),
    ("https://x.net/de/?p", "x.net", "/de/", "net/de/", "block"),
    ("https://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("ftp://o.org/es/", "o.org", "/es/", "org/es/", "block"),
    ("http://notcom/en/", "notcom", "/en/", None, "allow"),
    ("//no.scheme/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://h.de?x", "h.de", "", None, "allow"),
]


def test_op4_rules(spark, tables):
    rows = [(i, p[0], None if i % 2 else "<a href='/x'>") for i, p in enumerate(PAGES)]
    path = tables(pages=(rows, "page_id bigint, url string, html string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in entries.QUERIES["op4_url_filter"](spark, path).collect()}
    assert got == {i: p[1:] for i, p in enumerate(PAGES)}
    assert entries.QUERIES["op4_url_filter"](spark, tables(pages=([], "page_id bigint, url string, html string"))).count() == 0


def rank_by_hand(seeds, edges, damping, rounds):
    score = dict(seeds)
    for _ in range(rounds):
        nxt = dict(seeds)
        for (s, d), share in edges.items():
            nxt[d] = nxt.get(d, 0) + damping * share * score.get(s, 0)
        score = nxt
    return score


def test_propagation_equals_power_iteration(spark):
    shares = {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "c"): 1.0, ("c", "a"): 1.0}
    edges = written(spark.createDataFrame([(s, d, w) for (s, d), w in shares.items()], "src string, dst string, share double"), "e")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    got = {r.host: r.score for r in url_filter.propagated(seeds, edges, rounds=7).collect()}
    assert got == pytest.approx(rank_by_hand({"a": 1.0}, shares, 0.85, 7))


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    link = '<a href="http://bad.com/en/1">'
    rows = [(1, "http://bad.com/en/1", ""), (2, "http://farm.io/", link * 3), (3, "http://fine.io/", '<a class=x href=//ok.io/y>')]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_op4_rules_are_the_contracts(spark, tables):
    listed = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{verdict} {host}{path}" for verdict, host, path in url_filter.RULES) == listed
    rows = [(1, "https://x.net/de/?p", None), (2, "https://example.net/de/7", None), (3, "https://example.net/de/81", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in entries.QUERIES["op4_url_filter"](spark, tables(pages=(rows, "page_id bigint, url string, html string"))).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block")}
