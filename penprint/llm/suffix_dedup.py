"""Removal of long byte strings that occur more than once, by sharded external induced sorting.

Equal strings of ``length`` bytes must meet in one shard. Each such window is given to an anchor: the byte
w-gram of least hash inside it (the leftmost of equals). Equal windows have equal anchors at equal places,
so the windows of one anchor form a segment of text that goes with the anchor's hash. Anchors seen once can't
repeat anything and drop out with their text unsent. Where all segments of an anchor are equal, or a segment
has an equal, all its windows repeat: counted by content hash, without sending text. Only anchors with
differing segments send one copy of each. A window holds all of the (length - gram) / 2 bytes on one side of its anchor, so
segments that have neither side's bytes in common with another don't repeat either and stay. The shards that the others form are
suffix-sorted (induced_sort): a window repeats if and only if its common prefix with a neighbour in suffix order
reaches ``length``.

An anchor with more than HOT differing segments (a passage that a large part of all documents quote) is not
sent to one shard: its windows are counted by 128-bit hashes, with partial sums before the shuffle, which
splits them evenly. This changes where the work is done, not what is found.

A passage or a copy may hold a third of all segments under one anchor and content. Joins on these keys end in
tables of their own, with no aggregate in the same stage, so that Spark splits a skewed key among tasks.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; repeated rows (equal key
and text) repeat each other, and so all lose what they share; null keys are keys like others; ties don't occur, as what
repeats is removed everywhere; very long texts are hashed in pieces; empty tables give empty results; matches never
cross documents; other columns pass through, but ``spans`` and ``kept`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.llm.common import collected, release, tidy, written
from penprint.llm.induced_sort import repeated_starts

LENGTH, GRAM, HOT = 400, 32, 4096
PIECE, SHARD, MOST_TASKS = 1 << 20, 4 << 20, 1 << 15
_PLACE_BITS = 22
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Parts segments in a shard; no UTF-8 text holds it.
_GAP = np.uint8(0xF8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Rolling:
    """Hashes of all strings of one length: differences of prefix sums of byte times power, modulo 2^64."""

    def __init__(self, base: int, length: int) -> None:
        self.base, self.length, self.up, self.down = base, length, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __call__(self, text: np.ndarray) -> np.ndarray:
        if len(text) < self.length:
            return np.empty(0, np.uint64)
        if len(self.up) < len(text):
            self.up, self.down = _powers(self.base, len(text)), _powers(pow(self.base, -1, 2**64), len(text))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[: len(text)], out=sums[1:])
        out = (sums[self.length :] - sums[: len(sums) - self.length]) * self.down[: len(text) - self.length + 1]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
        return out


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each m neighbours, from running minima of blocks of m forwards and backwards."""
    n = len(x) - m + 1
    padded = np.full(-(-len(x) // m) * m, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, m)
    forwards = np.minimum.accumulate(blocks, axis=1).ravel()
    backwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backwards[:n], forwards[m - 1 : m - 1 + n])


def _pieces(starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Byte ranges of about PIECE bytes to hash together, each with the (row, first byte, end) of its windows' text."""
    part: list[tuple[int, int, int]] = []
    for row in np.flatnonzero(ends - starts >= length).tolist():
        lo, end = int(starts[row]), int(ends[row])
        while end - lo >= length:  # pieces of a very long text overlap by a window less one byte
            hi = min(end, lo + PIECE)
            if part and hi - part[0][1] > 2 * PIECE:
                yield part[0][1], part[-1][2], part
                part = []
            part.append((row, lo, hi))
            lo = hi - length + 1
    if part:
        yield part[0][1], part[-1][2], part


def _segment_batches(length: int, gram: int):
    side = (length - gram) // 2

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling(_BASE, gram)
        places = np.uint64((1 << _PLACE_BITS) - 1)
        for b in batches:
            keys, body = b.column(0), b.column(1)
            offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
            data = np.frombuffer(body.buffers()[2] or b"", np.uint8)
            key = np.asarray(keys, np.int64)
            for lo, hi, part in _pieces(offsets[:-1], offsets[1:], length):
                text = data[lo:hi]
                hashes = rolling(text)
                least = sliding_min(hashes & ~places | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
                anchor = (least & places).astype(np.int64)
                # Windows that lie inside one document, and the runs of them that have the same anchor.
                rows = np.array([r for r, _, _ in part])
                first = np.array([s - lo for _, s, _ in part])
                count = np.array([e - s - length + 1 for _, s, e in part])
                of = np.repeat(np.arange(len(part)), count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[of]
                own = anchor[at]
                begins = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])])
                last = np.r_[begins[1:], len(at)] - 1
                s, e, a = at[begins], at[last] + length, own[begins]
                view = memoryview(np.ascontiguousarray(text))
                contents = [xxhash.xxh3_64_intdigest(view[i:j], seed=k) for i, j, k in zip(s.tolist(), e.tolist(), (a - s).tolist(), strict=True)]
                sides = []
                for near, far, ok in ((a - side, a, a - side >= s), (a + gram, a + gram + side, a + gram + side <= e)):
                    found = [xxhash.xxh3_64_intdigest(view[i:j]) if k else 0 for i, j, k in zip(near.tolist(), far.tolist(), ok.tolist(), strict=True)]
                    sides.append(pa.array(np.array(found, np.uint64).view(np.int64), mask=~ok))
                row = rows[of[begins]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[row]),
                        pa.array(s + lo - offsets[row]),
                        pa.array(e - s),
                        pa.array(hashes[a].view(np.int64)),
                        pa.array(np.array(contents, np.uint64).view(np.int64)),
                        *sides,
                    ],
                    ["key", "start", "size", "anchor", "content", "left", "right"],
                )

    return segments


def _shard_batches(length: int):
    """(anchor, content, key, start, body) sorted by anchor -> (key, start, end) of what repeats."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def found() -> pa.RecordBatch:
            bodies = [np.frombuffer(x[3], np.uint8) for x in held]
            begins = np.cumsum([0, *(len(x) + 1 for x in bodies)])
            text = np.full(begins[-1], _GAP, np.uint8)
            for at, x in zip(begins.tolist(), bodies, strict=False):
                text[at : at + len(x)] = x
            flags = repeated_starts(text, length)
            for end in begins[1:].tolist():
                flags[end - length : end] = False  # strings that would run over the gap
            flags = np.r_[False, flags, False]
            edges = np.flatnonzero(flags[1:] != flags[:-1])
            s, e = edges[::2], edges[1::2] - 1 + length
            row = np.searchsorted(begins, s, side="right") - 1
            key, start = (np.array([x[k] for x in held], np.int64) for k in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(start[row] + s - begins[row]), pa.array(start[row] + e - begins[row])], ["key", "start", "end"])

        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= SHARD and x[0] != held[-1][0]:  # an anchor's segments stay together
                    yield found()
                    held, size = [], 0
                held.append(x)
                size += len(x[3]) + 1
        if held:
            yield found()

    return shards


def _window_batches(length: int):
    """(key, start, body) of segments of hot anchors -> (h1, h2, key, start) of each window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _Rolling(_BASE, length), _Rolling(_BASE2, length)
        for b in batches:
            for key, start, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text = np.frombuffer(body, np.uint8)
                h1, h2 = one(text), two(text)
                n = len(h1)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.full(n, key)), pa.array(start + np.arange(n))], ["h1", "h2", "key", "start"])

    return windows


def row_key(key: Column, text: Column) -> Column:
    """64 bits for a row: equal only for rows of equal key and text."""
    return F.xxhash64(key, text)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, start, end: byte ranges that repeat, possibly overlapping. docs: key (row_key) and body (binary)."""
    segments = written(docs.mapInArrow(tidy(_segment_batches(length, gram)), "key bigint, start bigint, size bigint, anchor bigint, content bigint, left bigint, right bigint"), "segments")
    anchors = written(
        segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("content") != F.max("content")).alias("varied")).filter("n > 1").select(F.col("anchor").alias("_anchor"), "varied"),
        "anchors",
    )
    met = written(segments.join(anchors, F.col("anchor") == F.col("_anchor")).drop("_anchor"), "met")
    whole = lambda df: df.select("key", "start", (F.col("start") + F.col("size")).alias("end"))
    varied = met.filter("varied")
    kinds = varied.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "size")).alias("one"), *[F.min(c).alias(c) for c in ("left", "right")])
    contents = written(kinds, "contents")
    copied = contents.filter("n > 1").select(F.col("anchor").alias("_anchor"), F.col("content").alias("_content"))
    copies = written(whole(varied.join(copied, (F.col("anchor") == F.col("_anchor")) & (F.col("content") == F.col("_content")))), "copies")
    # One copy of each differing segment, cut from its document, if another has the bytes on one side of the anchor.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("bytes")) for i, c in enumerate(("left", "right"))])).alias("s")
    sides = contents.select("anchor", "content", each).select("anchor", "content", "s.side", "s.bytes").filter("bytes is not null")
    shared = sides.groupBy("anchor", "side", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").withColumnsRenamed({c: f"_{c}" for c in ("anchor", "side", "bytes")})
    alike = written(sides.join(shared, (F.col("anchor") == F.col("_anchor")) & (F.col("side") == F.col("_side")) & (F.col("bytes") == F.col("_bytes"))).select("anchor", "content"), "alike")
    alive = alike.distinct().withColumnsRenamed({c: f"_{c}" for c in ("anchor", "content")})
    unlike = written(contents.join(alive, (F.col("anchor") == F.col("_anchor")) & (F.col("content") == F.col("_content")), "left_semi"), "unlike")
    crowds = unlike.groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("_anchor")
    wanted = unlike.groupBy(F.col("one.key").alias("_key")).agg(F.collect_list(F.struct("anchor", "one.start", "one.size")).alias("_wanted"))
    held = docs.dropDuplicates(["key"]).join(wanted, F.col("key") == F.col("_key")).select("key", "body", F.explode("_wanted").alias("w"))
    cut = written(
        held.select("w.anchor", "key", "w.start", F.expr("substring(body, cast(w.start as int) + 1, cast(w.size as int))").alias("body")).join(crowds.withColumn("_hot", F.lit(True)), F.col("anchor") == F.col("_anchor"), "left").drop("_anchor"),
        "cut",
    )
    spans = "key bigint, start bigint, end bigint"
    # A shard a task, as sorting takes far longer than reading what Spark would put together.
    total = unlike.agg(F.coalesce(F.sum("one.size"), F.lit(0))).first()[0]
    tasks = max(1, min(MOST_TASKS, -(-total // SHARD)))
    sorted_out = cut.filter("_hot is null").drop("_hot").repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_shard_batches(length)), spans)
    windows = written(cut.filter("_hot").select("key", "start", "body").mapInArrow(tidy(_window_batches(length)), "h1 bigint, h2 bigint, key bigint, start bigint"), "windows")
    often = written(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")), "often")
    counted = written(windows.join(often, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("key", "start", (F.col("start") + length).alias("end")), "counted")
    return whole(met.filter("not varied")).unionByName(copies).unionByName(sorted_out).unionByName(counted)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by ranges (touching ones are one)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def _cut_batches(batches: Iterator[pa.RecordBatch], decode: bool = False) -> Iterator[pa.RecordBatch]:
    """(.., body, ranges) -> (.., spans, kept bytes or text)."""
    for b in batches:
        *others, bodies, ranges = b.columns
        names = b.schema.names[:-2]
        spans, kept = [], []
        for body, r in zip(bodies, ranges, strict=True):
            text = body.as_py()
            if r.as_py() is None:
                spans.append([])
                kept.append(text.decode() if decode else text)
                continue
            s, e = merged(*(np.asarray(x) for x in r.values.flatten()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
            parts = [text[int(x) : int(y)] for x, y in zip(np.r_[0, e], np.r_[s, len(text)], strict=True)]
            kept.append("".join(p.decode(errors="ignore") for p in parts) if decode else b"".join(parts))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*others, pa.array(spans, kind), pa.array(kept, pa.string() if decode else pa.binary())], [*names, "spans", "kept"])


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, decode: bool = False) -> DataFrame:
    """docs without the text, with spans (removed byte ranges) and kept (the remaining bytes, binary; decoded, a
    string without the characters that a range's edge falls into).

    docs is read three times: to find segments, to cut out those that differ, and to remove what repeats.
    """
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    others = [c for c in docs.columns if c not in (text, "spans", "kept")]
    keyed = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("others"), row_key(F.col(key), F.coalesce(F.col(text), F.lit(""))).alias("key"), whole.alias("body"))
    with collected() as made:
        found = repeats(keyed.select("key", "body"), length)
        ranges = written(found.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    release([x for x in made if x[1] != ranges.scratch])  # the result reads docs and ranges alone
    joined = keyed.join(ranges, F.col("key") == F.col("of"), "left").select("others", "body", "ranges")
    schema = joined.select("others").schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "string" if decode else "binary")
    cut = joined.mapInArrow(tidy(lambda batches: _cut_batches(batches, decode)), schema)
    return cut.select(*[F.col(f"others.`{c}`") for c in others], "spans", "kept")


def digests(cut: DataFrame) -> list[Column]:
    """Columns n_bytes, n_removed, n_spans, kept_sha256 of a frame from removed()."""
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, x: t + x["end"] - x["start"])
    return [
        (F.octet_length("kept").cast("bigint") + gone).alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    ]
