"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: XXH64 of word shingles in the JVM, then per bit a count over the shingles (byte lanes of 64-bit
words, eight bits an addition). Equal fingerprints are one node from here on, so copies cost nothing more.

Links at ``radius`` or fewer differing bits: the 64 bits are cut into radius + 2 blocks, of which two must be
untouched, so two linked fingerprints share the bits of some pair of blocks. Buckets of such a key are compared whole. In a
task, bit planes are stored vertically (one bit of 64 fingerprints a machine word), distances of a tile of queries to all
members are updated plane by plane in carry-save counters, and a tile is abandoned once all its distances exceed the
radius. Tasks give spanning edges of what they find, never all pairs; components.roots joins them up.

Only connectivity is asked for, and connected() makes use of that where a bucket is too large for a task: it is dealt into
chunks at random, ROUNDS times over, which connects nearly all of a group of copies at a cost in proportion to its
size. Then whatever isn't in the bucket's largest component meets all of the bucket, chunk by chunk. Two nodes of one
component need not meet, all others do: nothing is capped, and no link between components is lost.

With ``total``, a second fingerprint (the same hashes, mixed anew) must agree as well.

deduplicated() goes by the Jaccard similarity of shingle sets. A radius that holds the tail of the pairs wanted is too
wide for blocks of untouched bits, so its buckets are of BANDS keys of BAND_ROWS minima of the set each: of pairs at
0.8, one in 500 shares no key. In a bucket, texts within ``total`` of 128 bits are candidates: pairs at 0.8 differ in
19.4 bits on average, 24 if the sets are small, with a deviation of 4.4. The first FIRST_BANDS keys connect most candidates; of
the others, only buckets that hold more than one component are compared. Connected candidates are a group; only pairs of
a group whose sets have the similarity are linked, and groups go through connected() as buckets do.

Defined results: null, empty and wordless texts have fingerprint zero and are one class; a text of fewer words
than a shingle is one shingle; repeated rows are in one class; of a class, ties go by the order that deduplicated() states; null
keys are larger than others and only name a class of null keys alone; very long texts are read whole; empty tables give empty
results; other columns pass through, but ``fingerprint``, ``second`` and ``component_id`` of the input are replaced
(``_hashes`` and ``_node`` are reserved).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.llm.common import ascii_lower, blank_words, dropped, let, tidy, written
from penprint.llm.components import roots

CHUNK, VERIFIED, ROUNDS = 4096, 1024, 2
BANDS, BAND_ROWS, FIRST_BANDS = 12, 4, 4
#: Shingles that count as one set, of which a task gets VERIFIED twice.
WEIGHT = 1024
_CLASSES, _ROWS = [(1, 8), (8, 32), (32, 128)], 1 << 15
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: Column, n: int) -> Column:
    """Signed XXH64 (seed 42) of the n-word shingles, repeats included."""

    def of(w: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)])))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < n, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(rolled)

    return let(blank_words(ascii_lower(F.coalesce(text, F.lit("")))), of)


def shingle_set(text: Column, n: int) -> Column:
    """The distinct shingle hashes, ascending."""
    return F.sort_array(F.array_distinct(shingle_hashes(text, n)))


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint64 fingerprints: bit b is 1 if set in over half of hashes[offsets[i]:offsets[i + 1]]."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    if not len(hashes):
        return out
    full = np.flatnonzero(n)
    chunks = -(-n[full] // 255)  # a byte lane counts to 255
    first = np.cumsum(chunks) - chunks
    starts = np.repeat(offsets[:-1][full] - first * 255, chunks) + 255 * np.arange(chunks.sum())
    counts = np.empty((len(full), 64), np.int64)
    for low in range(8):
        lanes = (hashes >> np.uint64(low)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
        counts[:, low::8] = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    set_bits = (2 * counts > n[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes that are independent of those given, for a second fingerprint."""
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(b.num_columns - 1)
        offsets = np.asarray(lists.offsets, np.int64)
        hashes = np.asarray(lists.values, np.int64).view(np.uint64)[offsets[0] : offsets[-1]]
        made = [pa.array(majority_bits(h, offsets - offsets[0]).view(np.int64)) for h in (hashes, remixed(hashes))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "fingerprint", "second"])


def fingerprinted(docs: DataFrame, text: str = "text", n: int = 4) -> DataFrame:
    """docs without the text, with fingerprint and second (bigint)."""
    kept = [c for c in docs.columns if c not in (text, "fingerprint", "second")]
    hashed = docs.select(*kept, shingle_hashes(F.col(text), n).alias("_hashes"))
    schema = docs.select(*kept).schema.add("fingerprint", "long").add("second", "long")
    return hashed.mapInArrow(tidy(_fingerprint_batches), schema)


def band_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of the non-empty sets hashes[offsets[i]:offsets[i + 1]]: each mixes BAND_ROWS minima under permutations of its own."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    salts = np.random.default_rng(7).integers(0, 1 << 64, (BANDS, BAND_ROWS, 2), np.uint64)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band, rows in enumerate(salts if len(starts) else ()):
        key = np.full(len(starts), band, np.uint64)
        for salt, factor in rows:
            key = remixed(key ^ np.minimum.reduceat((hashes ^ salt) * (factor | np.uint64(1)), starts))
        keys[:, band] = key
    return keys


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fingerprint, second and bands in place of the last column, the set of shingle hashes; an empty set has no bands."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        offsets = np.asarray(lists.offsets, np.int64)
        hashes = np.asarray(lists.values, np.int64).view(np.uint64)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        made = [pa.array(majority_bits(h, offsets).view(np.int64)) for h in (hashes, remixed(hashes))]
        ends = np.cumsum(np.r_[0, np.where(np.diff(offsets) > 0, BANDS, 0)]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(hashes, offsets).ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made, bands], [*b.schema.names[:-1], "fingerprint", "second", "bands"])


def bit_planes(fingerprints: np.ndarray) -> np.ndarray:
    """(64, words): row b holds bit b of the fingerprints, 64 to a word; the last word is filled up with zeros."""
    bits = np.unpackbits(fingerprints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(bits) // 64) * 64), np.uint8)
    padded[:, : len(bits)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(planes: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """Bits of the positions whose planes hold at most radius ones; None once no position is left."""
    digits = radius.bit_length()
    counter: list[np.ndarray] = []
    over = None
    for b, carry in enumerate(planes):
        if over is None:
            over = np.zeros_like(carry)
            counter = [np.zeros_like(carry) for _ in range(digits)]
        for k in range(digits):
            both = counter[k] & carry
            counter[k] ^= carry
            carry = both
        over |= carry
        if b % 8 == 7:
            # Bitwise comparison of the counter with the radius, from the highest digit.
            above, equal = np.zeros_like(over), np.full_like(over, _ONES)
            for k in reversed(range(digits)):
                if radius >> k & 1:
                    equal &= counter[k]
                else:
                    above |= equal & counter[k]
                    equal &= ~counter[k]
            if (done := over | above).all() and (done == _ONES).all():
                return None
    return ~done


def _near(first: Iterator[np.ndarray], second: Iterator[np.ndarray], radius: int, total: int | None) -> np.ndarray | None:
    """Bits of the positions within the radius, and within ``total`` over both fingerprints."""
    kept: list[np.ndarray] = []

    def passed() -> Iterator[np.ndarray]:
        for x in first:
            if total is not None:
                kept.append(x.copy())
            yield x

    found = within(passed(), radius)
    if found is None or total is None:
        return found
    both = within(chain(kept, second), total)
    return None if both is None else found & both


def _differences(queries: np.ndarray, planes: np.ndarray) -> Iterator[np.ndarray]:
    """Plane by plane, the bits in which each query differs from all members."""
    for b in range(64):
        yield planes[b][None, :] ^ np.where(queries >> np.uint64(b) & np.uint64(1), _ONES, np.uint64(0))[:, None]


def clusters(fingerprints: np.ndarray, radius: int, second: np.ndarray | None = None, total: int | None = None, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (member, root), as positions, of the links between fingerprints."""
    n = len(fingerprints)
    words = [fingerprints, fingerprints if second is None else second]
    planes = [bit_planes(w) for w in words]
    tail = np.zeros(planes[0].shape[1] * 64, np.uint8)
    tail[:n] = 1
    real = np.packbits(tail, bitorder="little").view(np.uint64)
    near = np.zeros((n, planes[0].shape[1]), np.uint64)
    for at in range(0, n, tile):
        found = _near(*(_differences(w[at : at + tile], p) for w, p in zip(words, planes, strict=True)), radius, total)
        if found is not None:
            near[at : at + tile] = found & real
    seen = np.zeros(n, bool)
    members, root_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    linked = np.bitwise_count(near).sum(axis=1) > 1  # besides itself
    for root in np.flatnonzero(linked):
        if seen[root]:
            continue
        seen[root] = True
        frontier = np.array([root])
        while len(frontier):
            reached = np.unpackbits(np.bitwise_or.reduce(near[frontier], axis=0).view(np.uint8), bitorder="little")[:n].astype(bool)
            frontier = np.flatnonzero(reached & ~seen)
            seen[frontier] = True
            members.append(frontier)
            root_of.append(np.full(len(frontier), root))
    return np.concatenate(members), np.concatenate(root_of)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (member, least member of its component) of the graph on positions below n."""
    label = np.arange(n)
    while True:
        low, before = np.minimum(label[left], label[right]), label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            members = np.flatnonzero(label != np.arange(n))
            return members, label[members]


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes in which position i holds what position i + d held; zeros come in at the end."""
    whole, rest = divmod(d, 64)
    out = np.zeros_like(planes)
    n = planes.shape[-1] - whole
    out[..., :n] = planes[..., whole:]
    if rest:
        out[..., :n] >>= np.uint64(rest)
        out[..., : n - 1] |= planes[..., whole + 1 :] << np.uint64(64 - rest)
    return out


def _moved(planes: np.ndarray, d: int) -> Iterator[np.ndarray]:
    """Plane by plane, the bits in which each position differs from the one d further on."""
    for p in planes:
        yield p ^ _shifted(p, d)


def small_groups(groups: np.ndarray, fingerprints: np.ndarray, radius: int, second: np.ndarray | None = None, total: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges, as positions, of the links in groups of few members: the planes of all groups are compared with
    themselves moved by one position, two, and so on, as far as the largest group goes."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    words = [fingerprints, fingerprints if second is None else second]
    planes = [bit_planes(w) for w in words]
    for d in range(1, len(groups)):
        same = groups[d:] == groups[:-d]
        if not same.any():
            break
        here = np.zeros(planes[0].shape[1] * 64, np.uint8)
        here[: len(same)] = same
        if (found := _near(*(_moved(p, d) for p in planes), radius, total)) is not None:
            hit = np.unpackbits((found & np.packbits(here, bitorder="little").view(np.uint64)).view(np.uint8), bitorder="little")
            at = np.flatnonzero(hit)
            left.append(at)
            right.append(at + d)
    return forest(len(groups), np.concatenate(left), np.concatenate(right))


def _linked_batches(radius: int, total: int | None):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (group, node, fingerprint, second), sorted by group."""

        def edges(g: np.ndarray, node: np.ndarray, f: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            sizes = np.diff(np.r_[starts, len(g)])
            size = np.repeat(sizes, sizes)
            found = [(node[:0], node[:0])]
            for least, most in _CLASSES:  # groups of like size, so that few of the compared positions are of two groups
                mine = np.flatnonzero((size > least) & (size <= most))
                for i in range(0, len(mine), _ROWS):
                    part = mine[i : i + _ROWS + most]  # a group at the edge is seen whole by one of two parts
                    u, v = small_groups(g[part], f[part], radius, s[part], total)
                    found.append((node[part[u]], node[part[v]]))
            large = sizes > _CLASSES[-1][1]
            for at, k in zip(starts[large], sizes[large], strict=True):
                mine = slice(at, at + k)
                u, v = clusters(f[mine], radius, s[mine], total)
                found.append((node[mine][u], node[mine][v]))
            # Keys share most of their links: a forest over all of them has each only once.
            named, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*found, strict=True)]), return_inverse=True)
            u, v = forest(len(named), *np.split(at, 2))
            return pa.RecordBatch.from_arrays([pa.array(named[u]), pa.array(named[v])], ["u", "v"])

        held: list[np.ndarray] | None = None
        for b in batches:
            new = [np.asarray(c, np.int64) for c in b.columns]
            new[2:] = [x.view(np.uint64) for x in new[2:]]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last group may go on
            if cut:
                yield edges(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield edges(*held)

    return linked


def block_masks(radius: int) -> list[int]:
    """Masks of all pairs of radius + 2 blocks of the 64 bits."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def connected(members: Callable[[DataFrame | None], DataFrame], most: int, meet: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """Components, as of components.roots, of the links between nodes of one place. A task sees nodes of a weight of some twice ``most`` at once.

    members(stars): place, node, weight, root (the node's root in stars, else the node) and what meet needs. meet: rows with
    ``group`` to edges u, v, where the nodes of each group are compared. known: components found before; places within one are left out.
    """
    weight = F.ceil(F.sum("weight"))
    if known is None:
        rows = members(None)
        crowds = written(rows.groupBy("place").agg(weight.alias("_n")).filter(F.col("_n") > most).select(F.col("place").alias("_crowd"), "_n"), "crowds")
        salts = F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(ROUNDS - 1)))
        salted = rows.join(crowds, F.col("place") == F.col("_crowd"), "left").withColumn("_salt", F.explode(salts))
        chunk = F.pmod(F.xxhash64("node", "_salt"), F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)))
        stars = roots(meet(salted.withColumn("group", F.xxhash64("place", "_salt", chunk))))
        if crowds.isEmpty():
            return stars
        rows = members(stars).join(crowds.select("_crowd"), F.col("place") == F.col("_crowd"), "left_semi")
    else:
        stars, rows = known, members(known)
    spread = rows.groupBy("place").agg(weight.alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high")
    mixed = written(spread.select(F.col("place").alias("_place"), "_n"), "mixed")
    if mixed.isEmpty():
        return stars
    sizes = rows.join(mixed.filter(F.col("_n") > most).select("_place"), F.col("place") == F.col("_place"), "left_semi").groupBy("place", "root").agg(weight.alias("n"))
    largest = sizes.groupBy("place").agg(F.max(F.struct("n", "root")).alias("_most")).select(F.col("place").alias("_large"), "_most.n", F.col("_most.root").alias("_root"))
    parted = written(mixed.join(largest, F.col("_place") == F.col("_large"), "left").select("_place", F.col("_n"), F.col("n").alias("_big"), "_root"), "parted")
    # Chunks of the largest component, and of the rest: each of the rest meets all chunks of both.
    big, rest = (F.greatest(F.ceil(c / most), F.lit(1)).cast("int") for c in (F.col("_big"), F.col("_n") - F.col("_big")))
    own = lambda salt, chunks: F.pmod(F.xxhash64("node", F.lit(salt)), chunks).cast("int")
    group = lambda kind, i, j: F.xxhash64("place", F.lit(kind), i, j)
    each = lambda chunks, f: F.transform(F.sequence(F.lit(0), chunks - 1), f)
    mine = own(2, rest)
    of_rest = F.concat(each(big, lambda j: group(0, mine, j)), each(rest, lambda i: group(1, F.least(mine, i), F.greatest(mine, i))))
    groups = F.when(F.col("_big").isNull(), F.array(group(2, F.lit(0), F.lit(0)))).when(F.col("root") == F.col("_root"), each(rest, lambda i: group(0, i, own(3, big)))).otherwise(of_rest)
    more = meet(rows.join(parted, F.col("place") == F.col("_place")).withColumn("group", F.explode(groups)))
    out = roots(stars.select("u", "v").unionByName(more))
    for t in (mixed, parted, stars):
        dropped(t)
    return out


def _rooted(nodes: DataFrame, stars: DataFrame | None) -> DataFrame:
    """nodes with root."""
    if stars is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(stars.select(F.col("u").alias("_u"), F.col("v").alias("_v")), F.col("node") == F.col("_u"), "left").withColumn("root", F.coalesce("_v", "node")).drop("_u", "_v")


def links(nodes: DataFrame, radius: int = 4, total: int | None = None, keys: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """Components (as of components.roots) of all links. nodes: node, fingerprint, second; fingerprints distinct without total.
    Only nodes that share one of ``keys`` meet; without them, all nodes within the radius do."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    if keys is None:
        keys = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(block_masks(radius))])
    members = lambda stars: _rooted(nodes, stars).select("node", "root", "fingerprint", "second", F.lit(1).alias("weight"), F.explode(keys).alias("place"))

    def meet(dealt: DataFrame) -> DataFrame:
        rows = dealt.select("group", "node", "fingerprint", "second").repartition("group").sortWithinPartitions("group")
        return rows.mapInArrow(tidy(_linked_batches(radius, total)), "u bigint, v bigint")

    return connected(members, CHUNK, meet, known)


def classes(marked: DataFrame, key: str = "doc_id", radius: int = 4, total: int | None = None) -> DataFrame:
    """marked with component_id, the least key reachable. marked: a table with key, fingerprint and, for total, second."""
    node = F.col("fingerprint") if total is None else F.xxhash64("fingerprint", "second")
    second = F.lit(0).cast("bigint") if total is None else F.first("second")
    nodes = written(marked.groupBy(node.alias("node")).agg(F.min(key).alias("least"), F.first("fingerprint").alias("fingerprint"), second.alias("second")), "nodes")
    stars = links(nodes.drop("least"), radius, total)
    rooted = written(nodes.join(stars, F.col("node") == F.col("u"), "left").select("node", "least", F.coalesce("v", "node").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root"), "least")
    labels = written(rooted.join(least, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component_id"), "labels")
    for t in (nodes, stars, rooted, least):
        dropped(t)
    return marked.drop("component_id").join(labels, node == F.col("_node")).drop("_node")


def alike(hashes: np.ndarray, offsets: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges, as positions, of the pairs of sets whose Jaccard similarity is the given one or more."""
    sizes, n = np.diff(offsets), len(offsets) - 1
    if n == 2:
        shared = len(np.intersect1d(hashes[: offsets[1]], hashes[offsets[1] :], assume_unique=True))
        near = shared * similarity.denominator >= (len(hashes) - shared) * similarity.numerator
        return np.array([1][:near], np.int64), np.array([0][:near], np.int64)
    _, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
    owner, common = np.repeat(np.arange(n), sizes), count > 1  # what only one set has is in no intersection
    column, owner = (np.cumsum(common) - 1)[column[common[column]]], owner[common[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n, n), np.float32)
    for low in range(0, int(common.sum()), 1024):
        a, b = np.searchsorted(column, [low, low + 1024])
        held = np.zeros((n, min(1024, int(common.sum()) - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        shared += held @ held.T
    shared = shared.astype(np.int64)
    near = shared * similarity.denominator >= (sizes[:, None] + sizes[None, :] - shared) * similarity.numerator
    seen = np.zeros(n, bool)
    members, root_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        frontier = np.array([root])
        while len(frontier):
            frontier = np.flatnonzero(near[frontier].any(axis=0) & ~seen)
            seen[frontier] = True
            members.append(frontier)
            root_of.append(np.full(len(frontier), root))
    return np.concatenate(members), np.concatenate(root_of)


def _alike_batches(similarity: Fraction):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (group, node, shingles), sorted by group."""

        def edges(t: pa.Table) -> pa.RecordBatch:
            g, node = (t.column(k).to_numpy() for k in (0, 1))
            lists = t.column(2).combine_chunks()
            offsets = np.asarray(lists.offsets, np.int64)
            hashes = np.asarray(lists.values, np.int64)
            cuts = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            found = [(node[:0], node[:0])]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    u, v = alike(hashes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], similarity)
                    found.append((node[a + u], node[a + v]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])

        held: pa.Table | None = None
        for b in batches:
            if not len(b):
                continue
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            g = held.column(0).to_numpy()
            cut = len(g) - int((g[::-1] != g[-1]).argmax()) if (g != g[-1]).any() else 0  # the last group may go on
            if cut:
                yield edges(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None:
            yield edges(held.combine_chunks())

    return verified


def verified_links(groups: DataFrame, rows: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Components of the nodes of each group whose sets have the similarity. groups: a table of u, v as of
    components.roots; rows: node, row; texts: _row, _text. Sets are made once, for the rows of groups only."""
    placed = groups.select(F.col("u").alias("node"), F.col("v").alias("place")).unionByName(groups.select(F.col("v").alias("node"), F.col("v").alias("place")).distinct())
    wanted = rows.join(placed.select(F.col("node").alias("_node"), "place"), F.col("node") == F.col("_node")).drop("_node")
    made = texts.join(wanted, F.col("_row") == F.col("row")).select("place", "node", shingle_set(F.col("_text"), n).alias("shingles"))
    # A long set weighs as much as several, so that a task holds no more of long texts than of others.
    sets = written(made.withColumn("weight", F.greatest(F.lit(1), F.ceil(F.size("shingles") / WEIGHT))), "sets")

    def meet(dealt: DataFrame) -> DataFrame:
        grouped = dealt.select("group", "node", "shingles").repartition("group").sortWithinPartitions("group")
        return grouped.mapInArrow(tidy(_alike_batches(Fraction(str(similarity)))), "u bigint, v bigint")

    out = connected(lambda stars: _rooted(sets, stars), VERIFIED, meet)
    dropped(sets)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, which tells rows apart and stays from one read to the next: a file and a place in it. What wasn't read
    from files is first written to a table."""

    def placed(df: DataFrame) -> DataFrame:
        return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")).alias("_row"))

    try:
        return placed(docs)
    except AnalysisException:
        return placed(written(docs, "numbered"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, total: int = 40) -> DataFrame:
    """One row of each class stays: that of the least key, nulls last; then of the least hash of all columns; then the first in the files.

    Texts whose sets of n-word shingles have the Jaccard similarity are linked; a class is what links connect. So one of
    repeated rows stays, and one of a class of null keys only (``_row`` and ``_stays`` are reserved).
    """
    rows = numbered(docs)
    rank = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.xxhash64(*docs.columns).alias("hash"), F.col("_row").alias("row"))
    hashed = rows.select(rank.alias("rank"), shingle_set(F.col(text), n).alias("shingles"))
    hashed = hashed.select("rank", F.xxhash64("shingles").alias("node"), "shingles")
    schema = T.StructType([*hashed.schema][:-1]).add("fingerprint", "long").add("second", "long").add("bands", T.ArrayType(T.LongType()))
    marked = hashed.mapInArrow(tidy(_sketch_batches), schema)
    nodes = written(marked.groupBy("node").agg(F.min("rank").alias("least"), *[F.first(c).alias(c) for c in ("fingerprint", "second", "bands")]), "nodes")
    groups = None
    for keys in (F.slice("bands", 1, FIRST_BANDS), F.slice("bands", FIRST_BANDS + 1, BANDS)):
        groups = links(nodes, min(total, 64), total, keys, groups)
    texts = rows.select("_row", F.col(text).alias("_text"))
    stars = verified_links(groups, nodes.select("node", F.col("least.row").alias("row")), texts, n, similarity)
    rooted = nodes.join(stars, F.col("node") == F.col("u"), "left").select(F.coalesce("v", "node").alias("root"), "least")
    stays = written(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("_stays")), "stays")
    for t in (nodes, groups, stars):
        dropped(t)
    return rows.join(stays, F.col("_row") == F.col("_stays")).drop("_row", "_stays")
