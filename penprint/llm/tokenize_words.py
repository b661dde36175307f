"""Ids of whole texts from the ids of their distinct pieces.

A tokenizer that treats the pieces of a text separately is asked once a distinct piece. Each Python worker keeps a memo
of at most MEMO pieces from task to task, which starts anew when full; a task holds one batch of texts besides.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from penprint.llm.common import memos

MEMO = 700_000
#: Bytes of text that are encoded together, besides a longer text by itself.
SLICE = 32 << 20


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about SLICE bytes of the last column, a string."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
    ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    at = 0
    while at < len(batch):
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def kept_memo(kind: type[MemoIds], *arguments: str) -> MemoIds:
    """The worker's memo of this kind; only the last kind asked for is kept."""
    if (kind, *arguments) not in memos:
        memos.clear()
        memos[kind, *arguments] = kind(*arguments)
    return memos[kind, *arguments]


class MemoIds:
    """pieces(texts) parts texts; encode(pieces) gives all their ids and how many each has."""

    def pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """All pieces, one text after the other, and how many each text has."""
        raise NotImplementedError

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        ids, size = self.encode(pieces)
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.flat = np.r_[self.flat, ids]

    def __call__(self, texts: pa.StringArray | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the offsets of the texts."""
        if len(self.number) > MEMO:
            MemoIds.__init__(self)
        parts, counts = self.pieces(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        # Python sees each distinct piece once a call.
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := [x for x in distinct if x not in self.number]:
            self._learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        word = numbers[np.asarray(coded.indices)] if len(coded) else numbers[:0]
        size = self.size[word]
        ends = np.cumsum(size)
        at = np.repeat(self.start[word] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], np.r_[0, np.r_[0, ends][np.cumsum(counts)]]


class WordIds(MemoIds):
    """Ids by a tokenizers file whose tokenizer parts text at white space and drops it (word_bpe_49k.json does).

    Words of Latin letters, digits and ASCII signs, for which lower-casing and normal form are plain, are parted by the
    tokenizer's pattern and merged in matrices by its merge table; the tokenizer itself encodes all others, and whole texts
    that hold the string of an added token, since it looks for these first.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        from penprint.llm.byte_bpe import Merges

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.begin = {t["content"][:2] for t in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(added), regex.IGNORECASE).search
        self.parts = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # Printable Latin up to U+024F, without the letters that change length in lower case or normal form.
        self.plain = regex.compile("[!-~\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u012f\u0131-\u024f]*").fullmatch
        vocabulary, model = spec["model"]["vocab"], spec["model"]
        end = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            pairs.setdefault((vocabulary[a], vocabulary[b]), rank)
        letters = _byte_letters()
        self.merges = Merges(
            pairs,
            np.array([vocabulary[a + b] for a, b in merges]),
            np.array([vocabulary[x] for x in letters], np.int32),
            np.array([vocabulary[x + end] for x in letters], np.int32),
        )

    def __call__(self, texts: pa.StringArray | list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = [i for i in self.suspects(texts) if self.special(texts[i].as_py())]
        if not whole:
            return super().__call__(texts)
        encoded = self.tokenizer.encode_batch([texts[i].as_py() for i in whole], add_special_tokens=False)
        own = np.zeros(len(texts), bool)
        own[whole] = True
        flat, at = super().__call__(pc.if_else(pa.array(own), "", texts))
        rows = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        for i, e in zip(whole, encoded, strict=True):
            rows[i] = np.array(e.ids, np.uint32)
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def suspects(self, texts: pa.StringArray) -> list[int]:
        """Texts that may hold an added token: most lack even the first two signs of one, whose letters may be of either case."""
        if any(x.lower() != x.upper() for x in self.begin):
            return [*range(len(texts))]
        found = np.zeros(len(texts), bool)
        for x in self.begin:
            found |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found).tolist()

    def pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        parts = pc.split_pattern(texts, " ")
        return parts.flatten(), pc.list_value_length(parts).to_numpy()

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A word for the tokenizer itself is one part, marked by a character that no plain word has.
        parts = [self.parts(p.lower()) if self.plain(p) else [f"\0{p}"] for p in pieces]
        distinct = set(chain.from_iterable(parts))
        others = [x for x in distinct if x[0] == "\0"]
        distinct = [*distinct.difference(others), *others]
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        ids, size = self.merges.encoded([x.encode() for x in distinct[: len(distinct) - len(others)]])
        encoded = [e.ids for i in range(0, len(others), 20_000) for e in self.tokenizer.encode_batch([x[1:] for x in others[i : i + 20_000]], add_special_tokens=False)]
        size = np.r_[size, np.fromiter(map(len, encoded), np.int64, len(encoded))]
        ids = np.r_[ids, np.fromiter(chain.from_iterable(encoded), np.uint32)]
        start = np.cumsum(size) - size
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64)
        n = size[flat]
        ends = np.cumsum(n)
        out = ids[np.repeat(start[flat] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        counts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        return out, np.diff(np.r_[0, np.r_[0, ends][counts]])


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(other)) for b in range(256)]
