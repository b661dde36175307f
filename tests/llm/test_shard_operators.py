"""SimHash, suffix-array dedup, PPM, packing, BPE and WARC against brute force, with edge cases."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from penprint.llm import byte_bpe, curve_pack, induced_sort, ppm, simhash, suffix_dedup, tokenize_words, warc
from penprint.llm.common import scratch_path, written
from penprint.llm.components import roots

SCHEMA = "doc_id bigint, text string"
TEXTS = [None, "", "one", "a b c d e f", "A b c d e f", "the same old story told again", "the same old story told again", "x" * 3000, "é ü ö " * 40]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def simhash_by_hand(t, n=4):
    w = words(t)
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(prints, radius):
    f = np.array(prints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = np.arange(len(f))
    while (nxt := np.where(near, label[None, :], len(f)).min(axis=1)).tolist() != label.tolist():
        label = nxt
    return label.tolist()


def test_op5_fingerprints(spark):
    rows = simhash.fingerprinted(frame(spark, TEXTS)).collect()
    assert {r.doc_id: r.fingerprint % 2**64 for r in rows} == {i: simhash_by_hand(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("radius", [4, 8])
def test_op5_classes(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)  # so that crowded buckets are split
    rng = np.random.default_rng(radius)
    prints = []
    for _ in range(12):
        seed = int(rng.integers(0, 2**63))
        for _ in range(50):
            prints.append(seed)
            for b in rng.integers(0, 64, rng.integers(0, radius)):
                prints[-1] ^= 1 << int(b)
    prints += [2**64 - 1, 0, 0]
    rows = [(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)]
    marked = written(spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint"), "marked")
    got = {r.doc_id: r.component_id for r in simhash.classes(marked, radius=radius).collect()}
    assert [got[i] for i in range(len(prints))] == classes_by_hand(prints, radius)


def test_links_that_a_second_fingerprint_must_confirm(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 32)
    rng = np.random.default_rng(1)
    flip = lambda x, k: x ^ sum(1 << int(b) for b in set(rng.integers(0, 64, k)))
    pairs = []
    for _ in range(8):
        f, s = (int(x) for x in rng.integers(0, 2**63, 2))
        pairs += [(flip(f, rng.integers(0, 6)), flip(s, rng.integers(0, 26))) for _ in range(40)]
    f, s = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    d = np.bitwise_count(f[:, None] ^ f[None, :]), np.bitwise_count(s[:, None] ^ s[None, :])
    near = (d[0] <= 8) & (d[0].astype(int) + d[1] <= 20)
    label = np.arange(len(f))
    while (nxt := np.where(near, label[None, :], len(f)).min(axis=1)).tolist() != label.tolist():
        label = nxt
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(f.view(np.int64), s.view(np.int64), strict=True))]
    marked = written(spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint, second bigint"), "marked")
    got = {r.doc_id: r.component_id for r in simhash.classes(marked, radius=8, total=20).collect()}
    assert [got[i] for i in range(len(f))] == label.tolist() and len(set(label.tolist())) > 8


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "u bigint, v bigint")
    assert {r.u: r.v for r in roots(chain).collect()} == {**{i: 0 for i in range(1, 201)}, 901: 900}
    assert roots(chain.limit(0)).count() == 0


def test_deduplicated_keeps_one_of_each(spark):
    rows = simhash.deduplicated(frame(spark, TEXTS)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 2, 3, 5, 7, 8]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(97, 99), max_size=120), st.lists(st.integers(97, 100), min_size=1, max_size=30), st.integers(1, 25), st.sampled_from([1, 1 << 22]))
def test_induced_sort_finds_every_repeat(noise, passage, length, memory):
    text = np.array([*noise[:40], *passage, *noise[40:], *passage, *passage, 248], np.uint8)
    raw = text.tobytes()
    counts = Counter(raw[i : i + length] for i in range(len(raw) - length + 1))
    want = [i + length <= len(raw) and counts[raw[i : i + length]] > 1 for i in range(len(raw))]
    assert induced_sort.repeated_starts(text, length, memory).tolist() == want
    order = np.concatenate([p for p, _ in induced_sort.sorted_blocks(text, 400, memory)])[::-1]
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.integers(1, 5), st.sampled_from([2, 1 << 20]))
def test_names_are_sorted_by_induction_in_turn(part, times, memory):
    names = np.unique(np.array(part * times), return_inverse=True)[1]
    assert induced_sort.induced_order(names, memory).tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_a_shard_larger_than_memory(tmp_path):
    rng = np.random.default_rng(9)
    words_ = [rng.integers(97, 123, int(n)) for n in rng.integers(2, 9, 400)]
    text = np.concatenate([np.r_[words_[i], 32] for i in rng.integers(0, 400, 60000)]).astype(np.uint8)
    text[200000:230000] = text[1000:31000]
    text.tofile(tmp_path / "text")
    mapped = np.memmap(tmp_path / "text", np.uint8, "r")
    spilled = []
    real = induced_sort.Queue.append
    try:
        induced_sort.Queue.append = lambda self, p, q: (real(self, p, q), spilled.append(bool(self.on_disk)))[0]
        flags = induced_sort.repeated_starts(mapped, 400, memory=1 << 13)
    finally:
        induced_sort.Queue.append = real
    raw = text.tobytes()
    counts = Counter(hash(raw[i : i + 400]) for i in range(len(raw) - 399))
    assert any(spilled) and flags[: len(raw) - 399].tolist() == [counts[hash(raw[i : i + 400])] > 1 for i in range(len(raw) - 399)]
    assert flags.sum() >= 2 * (30000 - 399)


def removed_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] > gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_op7_removes_what_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD", 4000)
    real = suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda docs, length: real(docs, length, hot=hot))
    rng = np.random.default_rng(5)
    words_ = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    own = lambda n: " ".join(rng.choice(words_, n))
    passage, other = own(90), "é" + own(70)
    texts = [None, "", "short", "a" * 1500, own(400) + passage + own(30), own(5) + passage, passage, passage, passage + other + own(700), own(80) + other, own(20) + passage[:500], own(100), own(40) + "aé" * 300]
    rows = suffix_dedup.removed(frame(spark, texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.select("doc_id", *suffix_dedup.digests(rows)).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_hand(texts, 400)
    assert suffix_dedup.removed(frame(spark, texts).limit(0)).count() == 0


def test_op7_counts_repeated_rows_and_cuts_whole_characters(spark):
    text = "é" * 300
    rows = suffix_dedup.removed(spark.createDataFrame([(1, text), (1, text), (2, "x" + text[:250] + "y")], SCHEMA), decode=True).collect()
    assert sorted((r.doc_id, r.kept) for r in rows) == [(1, ""), (1, ""), (2, "xy")]


def ppm_by_hand(texts):
    counts, total = [Counter() for _ in range(4)], 0
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    for t, h in zip(texts, held, strict=True):
        b = b"\xfe" * 3 + (t or "").encode() + b"\xff"
        for i in range(3, len(b)) if not h else ():
            total += 1
            for j in range(4):
                counts[j][b[i - j : i + 1]] += 1
    trie = [defaultdict(dict) for _ in range(4)]
    for j in range(4):
        for s, n in counts[j].items():
            if n * 2**ppm.NODE_BITS >= total:
                trie[j][s[:-1]][s[-1]] = n

    def score(t):
        b, out = b"\xfe" * 3 + (t or "").encode() + b"\xff", 0.0
        for i in range(3, len(b)):
            excluded = set()
            for j in (3, 2, 1, 0):
                seen = trie[j].get(b[i - j : i], {})
                live = {s: n for s, n in seen.items() if s not in excluded}
                if not live:
                    continue
                whole = sum(live.values()) + len(live)
                if b[i] in live:
                    out += math.log10(live[b[i]] / whole)
                    break
                out += math.log10(len(live) / whole)
                excluded |= set(seen)
            else:
                out -= math.log10(256 - len(excluded))
        return out

    tokens = [[*words(t), None] for t in texts]
    known = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(known.values()), len(known)
    return [(h, len(ws), sum(known[w] > 0 for w in ws), n, sum(math.log10((known[w] + 1) / (n + v + 1)) for w in ws), score(t)) for t, ws, h in zip(texts, tokens, held, strict=True)]


def test_op6_scores(spark):
    texts = [*TEXTS, *(f"some words of text number {i} and {'more ' * (i % 5)}" for i in range(40)), "日本語 Ünï"]
    for bits in (20, 5):
        ppm.NODE_BITS, old = bits, ppm.NODE_BITS
        try:
            got = {r.doc_id: r for r in ppm.scored(frame(spark, texts)).collect()}
            for i, want in enumerate(ppm_by_hand(texts)):
                r = got[i]
                assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
                assert (r.base_score, r.score) == pytest.approx(want[4:])
        finally:
            ppm.NODE_BITS = old
    assert ppm.scored(frame(spark, texts).limit(0)).count() == 0


def test_op6_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SMALL", 64)
    monkeypatch.setattr(ppm, "NODE_BITS", 40)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, int(n))) for n in rng.integers(0, 600, 60)] + ["x" * 300000, None]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], SCHEMA + ", score int").coalesce(2)
    got = {r.doc_id: r for r in ppm.scored(rows).collect()}
    for i, want in enumerate(ppm_by_hand(texts)):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == want[:4]
        assert (got[i].base_score, got[i].score) == pytest.approx(want[4:])


def test_hilbert_neighbours_touch():
    side = np.arange(16)
    points = np.stack(np.meshgrid(side, side, indexing="ij"), axis=-1).reshape(-1, 2)
    order = points[np.argsort(curve_pack.hilbert_index(points, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    assert len(set(curve_pack.hilbert_index(points, 4).tolist())) == 256


def test_op8_pieces(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [*TEXTS, *(" ".join(f"word{j}" for j in range(i * 37)) for i in range(30)), "long " * 40000, "İ ΑΣ 日本 don't <|endoftext|>", "a<|EndOfText|>b  <|startoftext|><|endoftext|>"]
    ids = [np.array([*e.ids, 2], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    clashing = frame(spark, texts).withColumn("length", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("other", F.col("doc_id") * 2)
    rows = curve_pack.packed(clashing, path, size=512).collect()
    assert all(r.other == 2 * r.doc_id for r in rows)
    spans, lengths = defaultdict(list), Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths[r.sequence_id] and r.doc_tokens == len(ids[r.doc_id])
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes()
        lengths[r.sequence_id] += r.length
        spans[r.doc_id].append((r.start, r.length))
    assert all(n <= 512 and (n == 512 or n & (n - 1) == 0) for n in lengths.values())
    for i, own in enumerate(ids):
        ends = [0, *np.cumsum([n for _, n in sorted(spans[i])])]
        assert [s for s, _ in sorted(spans[i])] == ends[:-1] and ends[-1] == len(own)
    assert curve_pack.packed(frame(spark, texts).limit(0), path).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.sampled_from(["x<|endoftext|>y z", "<|STARTOFTEXT|>"]), max_size=5))
def test_word_ids_equal_the_tokenizer(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, at = tokenize_words.kept_memo(tokenize_words.WordIds, path)(texts)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.PieceIds(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeéß 日\n'0!\U0001f600"), max_size=400), max_size=4))
def test_op9_equals_the_library(ranks, reference, texts):
    texts = [*texts, "ab" * 300, ""]
    ids, at = ranks(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [reference.encode_ordinary(t) for t in texts]
    back, size = ranks.ranks.decoded(ids)
    assert back.tobytes() == "".join(texts).encode() and len(back) == size.sum()


def test_op9_rows(spark):
    rows = byte_bpe.encoded(frame(spark, TEXTS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in rows} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert all(len(r.ids) == 4 * r.n_ids for r in rows)


@pytest.mark.parametrize("least", [0, 5])
def test_op10_round_trip(spark, least):
    pages = [(1, "http://a/", "same page"), (5, "http://b/\r\nX: y", "same page"), (3, None, "same page"), (2, "u", None), (4, "u", ""), (6, "u", "WARC/1.1\r\n\r\nü\r\n\r\n"), (None, "u", "same page")]
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id bigint, url string, html string"), path, least=least, file_bytes=16)
    rows = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(rows) == len(pages)
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    for i, _, html in pages:
        body = (html or "").encode()
        best = max(x for x in groups[html or ""] if x is not None)
        revisit = i is not None and i != best and len(body) >= least
        r = rows[i]
        assert (r.record_type, r.refers_to) == (("revisit", best) if revisit else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r.payload is None if revisit else bytes(r.payload) == body


def test_op10_ids_of_two_payloads(spark):
    pages = [(1, "u", "same"), (1, "v", "own"), (9, "u", "same"), (1, "u", "same"), (9, "u", "same")]
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, payload_digest string"), path, file_bytes=8)
    rows = [(r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(spark, path).collect()]
    assert sorted(rows, key=str) == sorted([(1, "revisit", 9, None), (1, "response", None, b"own"), (1, "revisit", 9, None), (9, "response", None, b"same"), (9, "response", None, b"same")], key=str)
    empty = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n))
    passage, base = text(80), text(300)
    rows = [(0, base), (1, base), (2, "too short"), (3, text(100) + passage + text(50)), (4, text(90) + passage), (5, None), (6, base.replace(base.split()[150], "changed"))]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    good = written(stages["quality"](spark, docs, ""), "t")
    assert sorted(r.doc_id for r in good.collect()) == [0, 1, 3, 4, 6]
    single = written(stages["near_duplicates"](spark, good, ""), "t")
    assert sorted(r.doc_id for r in single.collect()) == [0, 3, 4]
    cut = written(stages["repeated_passages"](spark, single, ""), "t")
    assert cut.columns == docs.columns
    found = {r.doc_id: r for r in cut.collect()}
    assert all(passage[10:-10] not in r.text and r.n_chars == len(r.text) for r in found.values()) and found[0].text == base
    assert stages["packing"](spark, cut, "").groupBy("doc_id").agg(F.sum("length")).count() == 3
