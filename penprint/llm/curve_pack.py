"""Packing along a space-filling curve.

Token ids are hashed to signs in DIMS dimensions (a sparse random projection of the bag of ids), each mean is
scaled to BITS bits, and the Hilbert index of that point is the document's key. Documents are range-sorted by
key (with the row's hash to part equal keys), so similar documents come to lie side by side, and
each range is cut into sequences of ``size`` ids without a gap. The ids left over at the end of a range go into sequences
whose lengths are powers of two, which need no padding.

Ids are made once and kept in a table in the shared folder, since range-sorting looks at its input twice. A range is packed
as a stream: a task holds one batch of documents at a time.

Defined results: null and empty texts are their closing id alone; equal texts have equal keys; repeated rows and null
keys are packed each; very long texts are cut into as many sequences as they fill; empty tables give empty results; other
columns pass through, but those named as RESULTS are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.llm.common import tidy, written
from penprint.llm.tokenize_words import WordIds, kept_memo, slices

SIZE, CLOSING, DIMS, BITS = 4096, 2, 4, 15
RESULTS = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points (n, dims) of unsigned numbers below 2^bits.

    Skilling's transform (2004): undo the excess work from the highest bit down, then Gray-decode.
    """
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in reversed(range(bits)):
        for i in range(dims):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def signs(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(n, dims) of -1 or 1: bits of a multiplied id."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed[:, None] >> (np.uint64(40) + np.arange(dims, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int8)


def curve_keys(ids: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents. table: signs of every id below its length; none of the documents is empty."""
    sums = np.stack([np.add.reduceat(table[:, d][ids], offsets[:-1], dtype=np.int64) for d in range(table.shape[1])], axis=1)
    mean = sums / np.diff(offsets)[:, None]
    return hilbert_index(np.minimum((mean + 1) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def _token_batches(path: str, closing: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(.., text) -> (.., ids, n_ids, curve_key)."""
        encode, table = kept_memo(WordIds, path), np.empty((0, DIMS), np.int8)
        for whole in batches:
            for b in slices(whole, 4000):
                flat, at = encode(b.column(b.num_columns - 1))
                ids = np.insert(flat, at[1:], closing).astype(np.uint32)
                at = at + np.arange(len(at))
                if len(table) <= (top := int(ids.max(initial=0))):
                    table = signs(np.arange(top + 1))
                raw = ids.tobytes()
                packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed, pa.array(np.diff(at)), pa.array(curve_keys(ids, at, table))], [*b.schema.names[:-1], "ids", "n_ids", "curve_key"])

    return tokens


def tokenized(docs: DataFrame, path: str, text: str = "text", closing: int = CLOSING) -> DataFrame:
    """docs without the text, with ids (binary, little-endian 32-bit), n_ids and curve_key."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*others).schema.add("ids", T.BinaryType()).add("n_ids", T.LongType()).add("curve_key", T.LongType())
    return docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(tidy(_token_batches(path, closing), keeps=True), schema)


def tail_sizes(left: int) -> list[int]:
    """Powers of two that add up to what the last full sequence leaves over, largest first."""
    return [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]


def cut(pieces: pa.RecordBatch, ends: np.ndarray, first: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Pieces (.., start, ids, doc_tokens) cut where sequences end, and what lies beyond the last end.

    ends: positions in the pieces' ids where sequences first, first + 1, .. end; the first begins at 0.
    """
    names, ids = pieces.schema.names, pieces.column(pieces.num_columns - 2)
    raw = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    data = memoryview(ids.buffers()[2])
    stops = np.cumsum(np.diff(raw) // 4)
    begins = np.r_[0, stops[:-1]]
    cuts = np.unique(np.r_[0, stops, ends])
    s, e = cuts[:-1], cuts[1:]
    row = np.searchsorted(stops, s, side="right")
    own = raw[row] + 4 * (s - begins[row])
    bodies = pa.array([bytes(data[a : a + 4 * n]) for a, n in zip(own.tolist(), (e - s).tolist(), strict=True)], pa.binary())
    start = np.asarray(pieces.column(pieces.num_columns - 3))[row] + s - begins[row]
    done = int(np.searchsorted(s, ends[-1])) if len(ends) else 0
    others = [c.take(pa.array(row)) for c in pieces.columns[:-3]]
    total = pieces.column(pieces.num_columns - 1).take(pa.array(row))
    rest = pa.RecordBatch.from_arrays([*others, pa.array(start), bodies, total], names).slice(done)
    number = np.searchsorted(ends, s[:done], side="right")
    offset = s[:done] - np.r_[0, ends][number]
    cols = [*others, pa.array(start), pa.array(e - s), bodies, total]
    ready = pa.RecordBatch.from_arrays([*(c.slice(0, done) for c in cols), pa.array(number + first), pa.array(offset)], [*names[:-3], "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return ready, rest


def _piece_batches(size: int):
    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(.., ids, n_ids) in curve order -> pieces; a task numbers its sequences from its partition's number on."""
        number, rest = TaskContext.get().partitionId() << 40, None
        for whole in batches:
            for i in range(0, len(whole), 1000):
                b = whole.slice(i, 1000)
                ids, n = b.columns[-2:]
                new = pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(np.zeros(len(b), np.int64)), ids, n], [*b.schema.names[:-2], "start", "ids", "n_ids"])
                pieces = new if rest is None or not len(rest) else pa.Table.from_batches([rest, new]).combine_chunks().to_batches()[0]
                held = int(pc.sum(pc.binary_length(pieces.column(pieces.num_columns - 2))).as_py()) // 4
                ready, rest = cut(pieces, np.arange(1, held // size + 1) * size, number)
                number += held // size
                yield ready
        if rest is not None and len(rest):
            left = int(pc.sum(pc.binary_length(rest.column(rest.num_columns - 2))).as_py()) // 4
            yield cut(pa.Table.from_batches([rest]).combine_chunks().to_batches()[0], np.cumsum(tail_sizes(left), dtype=np.int64), number)[0]

    return sequences


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, closing: int = CLOSING) -> DataFrame:
    """A row a piece: the documents' other columns, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    others = [c for c in docs.columns if c not in (text, *RESULTS)]
    boxed = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("others"), F.col(key).alias("key"), F.col(text).alias("text"))
    tokens = written(tokenized(boxed, path, "text", closing), "tokens")
    order = [F.col("curve_key"), F.xxhash64("key", "n_ids"), F.col("key")]
    along = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("others", "ids", "n_ids")
    schema = along.select("others").schema
    for name, kind in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())):
        schema = schema.add(name, kind)
    return along.mapInArrow(tidy(_piece_batches(size)), schema).select(*[F.col(f"others.`{c}`") for c in others], *RESULTS)


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids' little-endian bytes."""
    return F.crc32(ids)
