"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are parted by the pattern; each distinct piece of a batch is encoded once. Pieces go into buckets of
similar length, as rows of a padded matrix of ids. Each round, every row merges its leftmost pair of least rank:
ranks of pairs come from an open-addressed hash table, the row closes up behind the merge, the two pairs beside it are
looked up anew, and rows without a pair that merges leave the matrix. Pieces above LONGEST bytes (junk without
breaks) would need a round for every byte, so they are merged one by one with a heap, in the same order.

Defined results: null and empty texts have no ids; decoding gives the text's UTF-8 bytes back; repeated rows are
encoded each; null keys are keys like others; very long texts are encoded by themselves; empty tables give empty results; other
columns pass through, but ``ids``, ``n_ids`` and ``decoded`` of the input are replaced (``_text`` is reserved).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.llm.common import tidy
from penprint.llm.tokenize_words import MemoIds, kept_memo, slices

LONGEST, ROWS = 256, 1 << 15
NONE = np.int32(2**31 - 1)


class Merges:
    """Ranks of mergeable pairs of ids in a hash table, and the id that each rank's merge gives."""

    def __init__(self, pairs: dict[tuple[int, int], int], result: np.ndarray, byte_ids: np.ndarray, last_ids: np.ndarray) -> None:
        """pairs: rank of a pair; byte_ids, last_ids: ids of a piece's bytes, and of its last byte."""
        self.pairs, self.result, self.byte_ids, self.last_ids = pairs, result.astype(np.int32), byte_ids, last_ids
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys, self.values = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            # Of the keys that want a free slot, the last written gets it; the others go on to the next.
            free = self.keys[slot[left]] == 2**64 - 1
            self.keys[slot[left[free]]] = keys[left[free]]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair doesn't merge or an id is padding (-1)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[slot] != 2**64 - 1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != 2**64 - 1)]
        return np.where((left < 0) | (right < 0), NONE, out)

    def merged_rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, padded with -1 at the right, merged to the end."""
        done = np.full_like(ids, -1)
        row = np.arange(len(ids))
        ranks = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            if not ranks.shape[1]:
                done[row, :1] = ids
                break
            at = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(row)), at]
            stop = rank == NONE
            if stop.any():
                done[row[stop], : ids.shape[1]] = ids[stop]
                row, ids, ranks, at, rank = row[~stop], ids[~stop], ranks[~stop], at[~stop], rank[~stop]
                if not len(row):
                    break
            # Everything right of the merge moves up by one.
            column = np.arange(ids.shape[1] - 1)
            ids_next = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            each = np.arange(len(row))
            ids_next[each, at] = self.result[rank]
            column = column[:-1]
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), ranks.shape[1] - 1), axis=1)
            before, after = at > 0, at < ids_next.shape[1] - 1
            i, j = each[before], at[before]
            ranks[i, j - 1] = self.lookup(ids_next[i, j - 1], ids_next[i, j])
            i, j = each[after], at[after]
            ranks[i, j] = self.lookup(ids_next[i, j], ids_next[i, j + 1])
            ids = ids_next
        return done

    def merged_long(self, piece: bytes) -> list[int]:
        """One long piece: the heap holds (rank, position) of pairs; stale entries are skipped."""
        raw = np.frombuffer(piece, np.uint8)
        ids = [*self.byte_ids[raw[:-1]].tolist(), int(self.last_ids[raw[-1]])]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(self.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] < 0 or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = int(self.result[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.pairs.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # rows of pieces, ids of each in turn
        # Widths: every length up to 16, then in steps of a quarter.
        width = np.where(lengths <= 16, lengths, 0)
        for w in (20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, LONGEST):
            width[(lengths > 16) & (width == 0) & (lengths <= w)] = w
        for w in np.unique(width[(width > 0)]).tolist():
            mine = np.flatnonzero(width == w)
            for k in range(0, len(mine), ROWS):
                part = mine[k : k + ROWS]
                raw = np.frombuffer(b"".join(pieces[i].ljust(w, b"\0") for i in part.tolist()), np.uint8).reshape(-1, w)
                ids = self.byte_ids[raw]
                end = np.arange(len(part)), lengths[part] - 1
                ids[end] = self.last_ids[raw[end]]
                ids[np.arange(w) >= lengths[part][:, None]] = -1
                out = self.merged_rows(ids)
                real = out >= 0
                size[part] = real.sum(axis=1)
                found.append((part, out[real]))
        for i in np.flatnonzero(lengths > LONGEST).tolist():
            ids = np.array(self.merged_long(pieces[i]), np.int32)
            size[i] = len(ids)
            found.append((np.array([i]), ids))
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        for part, ids in found:
            n = size[part]
            flat[np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, size


class Ranks(Merges):
    """The vocabulary of a rank file, whose ranks are ids, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_start, self.token_size = np.cumsum(lengths) - lengths, lengths
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        super().__init__(pairs, np.arange(len(tokens)), byte_ids, byte_ids)

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and how many each has."""
        size = self.token_size[ids]
        ends = np.cumsum(size)
        return self.token_bytes[np.repeat(self.token_start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class PieceIds(MemoIds):
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        super().__init__()
        self.ranks, self.split = Ranks(path), regex.compile(pattern).findall

    def pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        split = [self.split(t) for t in texts.to_pylist()]
        return pa.array(chain.from_iterable(split), pa.string()), np.fromiter(map(len, split), np.int64, len(split))

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.ranks.encoded([p.encode() for p in pieces])


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _encode_batches(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(.., text) -> (.., ids, n_ids, decoded)."""
        pieces = kept_memo(PieceIds, path, pattern)
        for whole in batches:
            for b in slices(whole, 2000):
                ids, at = pieces(b.column(b.num_columns - 1))
                back, size = pieces.ranks.decoded(ids)
                ends = np.r_[0, np.cumsum(size)][at]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], _binaries(ids.astype("<u4"), 4 * at), pa.array(np.diff(at)), _binaries(back, ends)], [*b.schema.names[:-1], "ids", "n_ids", "decoded"]
                )

    return encode


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without the text, with ids (binary, little-endian 32-bit), n_ids and decoded (binary, from the ids)."""
    others = [c for c in docs.columns if c not in (text, "ids", "n_ids", "decoded")]
    schema = docs.select(*others).schema.add("ids", T.BinaryType()).add("n_ids", T.LongType()).add("decoded", T.BinaryType())
    return docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(tidy(_encode_batches(path, pattern), keeps=True), schema)
