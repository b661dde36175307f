"""Helpers shared by the operators: let-bindings and words, and the library's tables and scratch files."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.storage import collected, dropped, release, scratch_path, table, written

__all__ = ["BLANKS", "BLANK_RUN", "ascii_lower", "blank_words", "boxed", "collected", "dropped", "let", "memos", "release", "scratch_path", "table", "tidy", "written"]

#: Code points that part words: tab, line feed, vertical tab, form feed, carriage return, space.
BLANKS = "\t\n\x0b\x0c\r "
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What a Python worker keeps from task to task.
memos: dict = {}


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow, in a worker that gives memory back at the end: workers live on between tasks, beside those of
    other operators. Unless f ``keeps`` memos, those of other operators go first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            memos.clear()
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not the GNU library
            pass

    return run


def boxed(df: DataFrame, *beside: str) -> DataFrame:
    """df as one column, _box, in which its names can't clash with any; ``select("_box.*")`` opens it. Columns ``beside`` it stay outside."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in beside]).alias("_box"), *beside)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """The maximal runs of code points outside BLANKS; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
