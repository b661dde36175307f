"""Language-model scores by prediction by partial matching (PPM) over bytes, and unigram scores over words.

Training texts are read as bytes between a start mark (0xFE, as context only) and an end mark (0xFF), which no
UTF-8 text holds. A trie of contexts up to three bytes counts what follows. A symbol is coded in the longest known context; an
escape (method C: as many escapes as different symbols were seen) leads to the next shorter one, where symbols
seen in the longer context are excluded from the counts; what no context has seen is uniform over the bytes left.
The score is the log10 probability of the text and its end.

All training text is counted, and every context counts, at any corpus size: the trie is a table of codes (three bytes of
context and a symbol) partitioned by context. What a code costs follows from the counts of its context and of the shorter
ones, depth by depth, in joins and windows of at most 256 symbols a context. Neighbouring documents of like size are a block: 2^BLOCK_BITS
of up to SMALL bytes, a sixteenth as many of up to sixteen times the size, so that a block is 2^BLOCK_BITS * SMALL bytes at most,
or one longer text. A block's distinct codes are joined to their costs and go back to their block. Nothing is gathered, and Spark
broadcasts only what it finds small.

Words go the same way: a block's distinct words, not its documents' words, are joined to the corpus counts, and go back
to their block. Counts are summed before the join, which ends in a table, so that Spark splits a word of every block among
tasks. NODE_BITS, if set, makes a smaller model: nodes below 2^-NODE_BITS of all training symbols are left out.

Defined results: null and empty texts score as their end alone; without training texts, words count zero
and bytes are uniform; rows with a null key train; repeated rows count each time; a very long text is a block of its own;
empty tables give empty results; other columns aren't passed on, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from penprint.llm.common import ascii_lower, blank_words, dropped, tidy, written

ORDER = 3
NODE_BITS: int | None = None
START, END = 0xFE, 0xFF
BLOCK_BITS, SMALL, CHUNK = 12, 1 << 15, 1 << 20
_TOKEN, _GRAM = 0, 1
_CLASS_MASK = 15


def chunks(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, codes, starts, ends) of about CHUNK bytes. A code is a symbol under its three bytes of
    context; codes[starts[i]:ends[i]] are those of a row's symbols, its end included. Row i is data[at[i]:at[i] + size[i]]."""
    lo, n, upto = 0, len(at), np.r_[0, np.cumsum(size)]
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CHUNK, side="right")) - 1)
        sizes = size[lo:hi]
        begins = np.cumsum(sizes + ORDER + 1) - (sizes + ORDER + 1)
        text = np.full(int((sizes + ORDER + 1).sum()), START, np.uint8)
        for to, a, k in zip((begins + ORDER).tolist(), at[lo:hi].tolist(), sizes.tolist(), strict=True):
            text[to : to + k] = data[a : a + k]
            text[to + k] = END
        codes = text.astype(np.uint32)
        for back in range(1, ORDER + 1):
            codes[back:] |= text[:-back].astype(np.uint32) << np.uint32(8 * back)
        yield lo, hi, codes, begins + ORDER, begins + ORDER + sizes + 1
        lo = hi


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(c, first)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where each row begins and how long it is."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets[:-1], np.diff(offsets)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, held_out, body, words) -> (kind, block, code, n): training counts of each block's codes and words."""
    # Blocks of each size class are filled one after the other: the last of each is open.
    open_: dict[int, tuple[int, list[np.ndarray], list[np.ndarray]]] = {}

    def rows(kind: int, block: int, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(np.full(len(code), block, np.int64)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "block", "code", "n"])

    for b in batches:
        block, held = np.asarray(b.column(0)), np.asarray(b.column(1).cast(pa.int8())).astype(bool)
        data, begins, sizes = _binary(b.column(2))
        for one in np.unique(block).tolist():
            kind = one & _CLASS_MASK
            if kind in open_ and open_[kind][0] != one:
                was, keys, counts = open_.pop(kind)
                yield rows(_GRAM, was, *_summed(keys, counts))
            _, keys, counts = open_.setdefault(kind, (one, [], []))
            for train in (True, False):
                mine = np.flatnonzero((block == one) & (held != train))
                for _, _, codes, starts, ends in chunks(data, begins[mine], sizes[mine]):
                    inside = np.zeros(len(codes) + 1, np.int8)
                    inside[starts] += 1
                    inside[ends] -= 1
                    found, n = np.unique(codes[np.cumsum(inside[:-1], dtype=np.int8) > 0], return_counts=True)
                    keys.append(found)
                    counts.append(n if train else np.zeros_like(n))
            if len(keys) > 64:
                keys[:], counts[:] = ([x] for x in _summed(keys, counts))
        words = b.column(3)
        at = np.asarray(words.offsets, np.int64)
        hashed = np.asarray(words.values, np.int64)[at[0] : at[-1]]
        of, train = np.repeat(block, np.diff(at)), np.repeat(~held, np.diff(at))
        for one in np.unique(block):
            mine = of == one
            code, back = np.unique(hashed[mine], return_inverse=True)
            yield rows(_TOKEN, one, code, np.bincount(back, train[mine], len(code)))
    for one, keys, counts in open_.values():
        yield rows(_GRAM, one, *_summed(keys, counts))


def held_out(key: Column) -> Column:
    """Every row whose key's text has CRC-32 of remainder 2 by 7."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def code_costs(counts: DataFrame) -> DataFrame:
    """code, cost: log10 probability of each code's symbol after its context. counts: a table of distinct codes and their training counts n."""
    of_depth = [counts]
    for j in reversed(range(ORDER)):
        shorter = of_depth[0].groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("code")).agg(F.sum("n").alias("n"))
        of_depth.insert(0, written(shorter, f"lm-depth{j}"))
    if NODE_BITS is not None:
        total = counts.agg(F.sum("n")).first()[0] or 0
        of_depth = [t.withColumn("n", F.when(F.col("n").cast("double") * 2**NODE_BITS >= total, F.col("n")).otherwise(0)) for t in of_depth]
    log = F.log10
    out = None
    for j, level in enumerate(of_depth):
        context = Window.partitionBy(F.shiftright("code", 8))
        level = level.withColumn("total", F.sum("n").over(context)).withColumn("seen", F.sum((F.col("n") > 0).cast("bigint")).over(context))
        n, whole, escapes = F.col("n"), F.col("total") + F.col("seen"), F.col("seen")
        if out is None:
            # After depth 0, the bytes that no context has seen are alike; down is the cost once the context is left.
            level = level.withColumn("down", -log(256 - F.col("seen"))).withColumn("plain_", F.col("down"))
        else:
            before = out.select(*[F.col(c).alias(f"{c}_") for c in ("code", "n", "total", "seen", "down", "plain")])
            level = level.join(before, F.col("code").bitwiseAND(F.lit((1 << 8 * j) - 1)) == F.col("code_"))
            excluded = F.sum(F.when(n > 0, F.col("n_")).otherwise(0)).over(context)
            level = level.withColumn("left_seen", F.col("seen_") - F.col("seen")).withColumn("left", F.col("total_") - excluded + F.col("left_seen"))
            left, left_seen = F.col("left"), F.col("left_seen")
            down = F.when(F.col("n_") > 0, log("n_") - log(left)).when(left_seen > 0, log(left_seen) - log(left) + F.col("down_")).otherwise(F.col("down_"))
            level = level.withColumn("down", down)
        plain = F.when(n > 0, log(n) - log(whole)).when(escapes > 0, log(escapes) - log(whole) + F.col("down")).otherwise(F.col("plain_"))
        out = level.withColumn("plain", plain).select("code", "n", "total", "seen", "down", "plain")
    return out.select("code", F.col("plain").alias("cost"))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    # Neighbouring rows of the input make a block, so blocks form without a shuffle; the table fixes who is in which.
    numbered = docs.select(F.col(key).alias("_key"), held_out(F.col(key)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_id"))
    size = F.octet_length("_text")
    large = F.when(size <= SMALL, 0).when(size <= SMALL << 4, 4).otherwise(BLOCK_BITS)
    block = F.shiftleft(F.call_function("shiftright", F.col("_id"), F.lit(BLOCK_BITS) - large), 4).bitwiseOR(large.cast("bigint"))
    dealt = written(numbered.select("_key", "held_out", "_text", block.alias("block")), "lm-blocks")
    hashed = F.transform(blank_words(ascii_lower(F.col("_text"))), lambda w: F.xxhash64(w))
    body = F.col("_text").cast("binary")

    counted = written(dealt.select("block", "held_out", body.alias("body"), hashed.alias("words")).mapInArrow(tidy(_count_batches), "kind int, block bigint, code bigint, n bigint"), "lm-counts")
    grams = counted.filter(F.col("kind") == _GRAM)
    whole = written(grams.groupBy("code").agg(F.sum("n").alias("n")), "lm-codes")
    costs = code_costs(whole).withColumnRenamed("code", "_code")
    priced = written(grams.join(costs, F.col("code") == F.col("_code")).select("block", "code", "cost"), "lm-costs")
    tokens = counted.filter(F.col("kind") == _TOKEN)
    totals = written(tokens.groupBy("code").agg(F.sum("n").alias("count")).withColumnRenamed("code", "_code"), "lm-words")
    glossary = written(tokens.join(totals, F.col("code") == F.col("_code")).select("block", "code", "count"), "lm-glossary")
    word_total, word_kinds = totals.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    ends = dealt.filter(~F.col("held_out")).count()
    dropped(counted)
    total, kinds = word_total + ends, word_kinds + (ends > 0)

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, code, value = (right.column(c).to_numpy() for c in ("kind", "code", "value"))
        order = np.argsort(code)
        order = order[kind[order] == _TOKEN], order[kind[order] == _GRAM]
        known, count = (x[order[0]] for x in (code, value))
        nodes, cost = code[order[1]].astype(np.uint32), value[order[1]]
        floor = np.log10(float(total + kinds + 1))
        out = []
        for b in left.combine_chunks().to_batches():
            score = np.empty(len(b))
            for lo, hi, codes, starts, stops in chunks(*_binary(b.column("body"))):
                # Codes between two rows are in no block's table, and in no row's sum.
                sums = np.r_[0.0, np.cumsum(cost[np.minimum(np.searchsorted(nodes, codes), len(nodes) - 1)])]
                score[lo:hi] = sums[stops] - sums[starts]
            lists = b.column("words")
            at = np.asarray(lists.offsets, np.int64)
            at, mine = at - at[0], np.asarray(lists.values, np.int64)[at[0] : at[-1]]
            c = count[np.searchsorted(known, mine)] if len(mine) else np.empty(0)
            each = np.r_[0.0, np.cumsum(np.log10(c + 1.0) - floor)]
            seen = np.r_[0, np.cumsum(c > 0)]
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        b.column("_key"),
                        b.column("held_out"),
                        pa.array(np.diff(at) + 1),
                        pa.array(seen[at[1:]] - seen[at[:-1]] + int(ends > 0)),
                        pa.array(np.full(len(b), total, np.int64)),
                        pa.array(each[at[1:]] - each[at[:-1]] + np.log10(ends + 1.0) - floor),
                        pa.array(score),
                    ],
                    schema=arrow,
                )
            )
        return pa.Table.from_batches(out, arrow)

    schema = docs.select(key).schema.add("held_out", "boolean")
    for name in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(name, "long")
    schema = schema.add("base_score", T.DoubleType()).add("score", T.DoubleType())
    arrow = to_arrow_schema(schema)
    # Words are hashed after the shuffle, since the hashes take more room than the text.
    left = dealt.repartition("block").select("block", "_key", "held_out", body.alias("body"), hashed.alias("words"))
    values = glossary.select("block", F.lit(_TOKEN).alias("kind"), "code", F.col("count").cast("double").alias("value")).unionByName(
        priced.select("block", F.lit(_GRAM).alias("kind"), "code", F.col("cost").alias("value"))
    )
    return left.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(scores, schema)
