"""Order MinHash fingerprints of whole texts.

k-mers are runs of ``k`` words. Each gets an occurrence number (first, second, ... time in the text), so
repeats count; the hash of k-mer and number deals it to one of ``m`` bins (one-permutation hashing: one
hash a k-mer instead of m). In each bin the ``l`` k-mers of least hash are kept, put back into text order,
and the tuple is hashed. With ``fill``, as in fingerprints(), a bin of fewer than l takes what it lacks from the bins that
follow, the first after the last: a tuple of one carries no order, and short texts fill few bins. Moving a passage changes the order within tuples, so the share of equal tuples
follows the edit distance rather than the set overlap alone.

Everything is an array expression of one row: no row is exploded and nothing is shuffled.

Defined results: a null text counts as empty; a text without words has the empty fingerprint; a text of
fewer than k words is one k-mer of all its words; two empty fingerprints are alike (1.0), an empty and a
filled one are not (0.0); equal texts have equal fingerprints, repeated rows and null keys too; k-mers of equal hash go by
place; very long texts are read whole; empty tables give empty results; other columns pass through, but the result's own name
is replaced (in with_next(), names of the prefix too; ``_place``, ``_range`` and ``_guest`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import blank_words, let

POS_BITS, HASH_BITS = 30, 33
POS_MASK, HASH_MASK = (1 << POS_BITS) - 1, (1 << HASH_BITS) - 1


def kmer_hashes(text: Column, k: int) -> Column:
    """64-bit hashes of the k-mers in text order."""
    return let(
        F.transform(blank_words(text), lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < k, F.array(F.xxhash64(h)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))),
    )


def sketch(text: Column, k: int = 5, l: int = 2, m: int = 64, fill: bool = False) -> Column:  # noqa: E741
    """array<bigint>, one element a filled bin (with fill, all m are unless the text has no words): bin number above 32 bits of the tuple's hash, in bin order."""
    bin_bits = max(1, (m - 1).bit_length())
    rest_bits = 63 - POS_BITS - bin_bits
    bin_shift = POS_BITS + rest_bits

    def numbered(kmer: Column, occurrence: Column, pos: Column) -> Column:
        return let(
            F.xxhash64(kmer, occurrence),
            lambda g: F.shiftleft(F.pmod(g, F.lit(m).cast("bigint")), bin_shift)
            .bitwiseOR(F.shiftleft(F.shiftrightunsigned(g, 64 - rest_bits), POS_BITS))
            .bitwiseOR(pos),
        )

    def unrepeated(kmers: Column) -> Column:
        return F.transform(kmers, lambda x, i: numbered(x.bitwiseAND(F.lit(HASH_MASK)), F.lit(0), i.cast("bigint")))

    def repeated(kmers: Column) -> Column:
        # Sorted by (k-mer, position), equal k-mers are a run, and the index in the run is the occurrence number.
        by_kmer = F.sort_array(F.transform(kmers, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(HASH_MASK)), POS_BITS).bitwiseOR(i.cast("bigint"))))
        key = lambda s: F.shiftright(s, POS_BITS)

        def runs(s: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (key(F.get(s, i - 1)) != key(F.get(s, i))))
            return let(
                starts,
                lambda r: F.flatten(
                    F.transform(
                        r,
                        lambda at, j: F.transform(
                            F.slice(s, at + 1, F.coalesce(F.get(r, j + 1), F.size(s)) - at),
                            lambda x, o: numbered(key(x), o, x.bitwiseAND(F.lit(POS_MASK))),
                        ),
                    )
                ),
            )

        return let(by_kmer, runs)

    def tuples(kmers: Column, least: Column) -> Column:
        """least: the l least of each bin, sorted by (bin, hash)."""
        bin_of = lambda t: F.shiftright(t, bin_shift)
        pos_of = lambda t: t.bitwiseAND(F.lit(POS_MASK)).cast("int")
        starts = F.filter(F.sequence(F.lit(0), F.size(least) - 1), lambda i: (i == 0) | (bin_of(F.get(least, i - 1)) != bin_of(F.get(least, i))))

        def filled(r: Column, twice: Column) -> Column:
            """The l members from a bin's start on are its tuple, and that of the empty bins before it."""
            every = F.least(F.size(least), F.lit(l))

            def run(at: Column, j: Column) -> Column:
                in_order = F.sort_array(F.transform(F.slice(twice, at + 1, every), pos_of))
                value = F.xxhash64(F.transform(in_order, lambda p: F.get(kmers, p))).bitwiseAND(F.lit(0xFFFFFFFF))
                mine = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
                after = F.when(j == 0, F.lit(-1).cast("bigint")).otherwise(bin_of(F.get(least, F.get(r, j - 1)))) + 1
                last = F.when(j == 0, bin_of(F.element_at(least, -1)) + 1).otherwise(F.lit(m).cast("bigint"))
                bins = F.concat(mine(after, bin_of(F.get(least, at))), mine(last, F.lit(m - 1).cast("bigint")))
                return let(value, lambda v: F.transform(bins, lambda b: F.shiftleft(b, 32).bitwiseOR(v)))

            return F.sort_array(F.flatten(F.transform(r, run)))

        def one(r: Column, at: Column, j: Column) -> Column:
            members = F.slice(least, at + 1, F.coalesce(F.get(r, j + 1), F.size(least)) - at)
            in_order = F.sort_array(F.transform(members, pos_of))
            value = F.xxhash64(F.transform(in_order, lambda p: F.get(kmers, p)))
            return F.shiftleft(bin_of(F.get(least, at)), 32).bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF)))

        if fill:
            return let(starts, lambda r: let(F.concat(least, F.slice(least, 1, l)), lambda twice: filled(r, twice)))
        return let(starts, lambda r: F.transform(r, lambda at, j: one(r, at, j)))

    def from_kmers(kmers: Column) -> Column:
        ordered = F.sort_array(F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), unrepeated(kmers)).otherwise(repeated(kmers)))
        least = let(
            ordered,
            lambda t: F.filter(t, lambda x, i: (i < l) | (F.shiftright(F.get(t, i - l), bin_shift) != F.shiftright(x, bin_shift))),
        )
        return F.when(F.size(kmers) == 0, F.array().cast("array<bigint>")).otherwise(let(least, lambda s: tuples(kmers, s)))

    return let(kmer_hashes(text, k), from_kmers)


def as_text(sketched: Column) -> Column:
    """Lower-case hexadecimal, ten digits a filled bin."""
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal bins over bins filled in either."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled).cast("double")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "sketch", **parameters: int) -> DataFrame:
    """docs with the sketch of a text column."""
    return docs.withColumn(out, sketch(F.col(text), fill=True, **parameters))


#: Neighbour search deals documents out by ranges of their ids; this many ranges at most are found on the driver.
MOST_RANGES, DOCS_A_RANGE = 65536, 256
_COARSE = 256


def id_bounds(docs: DataFrame, key: str) -> list[int]:
    """Ids that end ranges of about equal row counts, ascending; the largest id ends the last. At most MOST_RANGES."""
    n = docs.agg(F.count(key)).first()[0]
    if not n:
        return []
    ranges = max(1, min(MOST_RANGES, n // DOCS_A_RANGE))
    shares = [(i + 1) / ranges for i in range(ranges)]
    found = docs.agg(F.percentile_approx(key, shares, max(10000, 16 * ranges)).alias("b"), F.max(key).alias("top")).first()
    return sorted({*found["b"], found["top"]})


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", prefix: str = "next_", then=None) -> DataFrame:
    """docs with the values of the next row by descending key; after the last comes the first.

    One shuffle by ranges of the key. The row that ends a range is also sent to the range above it, where it is
    the last row's next. Equal keys go by the remaining columns' hash; null keys come last. ``then`` is applied
    to rows that already have the first column's next value, and may add columns; it returns the frame and more
    columns whose next values are wanted.
    """
    bounds = id_bounds(docs, key)
    c = F.col(key).cast("bigint")
    longs = lambda found: F.lit(found).cast("array<bigint>") if found else F.array().cast("array<bigint>")
    every, coarse = longs(bounds), longs(bounds[_COARSE - 1 :: _COARSE])
    place = lambda at, guest: F.struct(at.cast("int").alias("range"), F.lit(guest).alias("guest"))
    last = F.lit(bounds[-1] if bounds else None).cast("bigint")

    def places(at: Column) -> Column:
        return F.when(F.get(every, at) == c, F.array(place(at, False), place(F.when(c == last, F.lit(0)).otherwise(at + 1), True))).otherwise(F.array(place(at, False)))

    at = let(F.size(F.filter(coarse, lambda b: b < c)), lambda k: k * _COARSE + F.size(F.filter(F.slice(every, k * _COARSE + 1, _COARSE), lambda b: b < c)))
    places = let(at, places)
    dealt = docs.withColumn("_place", F.explode(places)).withColumn("_range", F.col("_place.range")).withColumn("_guest", F.col("_place.guest")).drop("_place")
    order = Window.partitionBy("_range").orderBy(F.col("_guest"), F.col(key).desc_nulls_last(), *[F.col(x).asc_nulls_first() for x in columns])
    out = dealt.withColumns({prefix + x: F.lead(x).over(order) for x in columns})
    if then is not None:
        out, more = then(out)
        out = out.withColumns({prefix + x: F.lead(x).over(order) for x in more})
    return out.filter(~F.col("_guest")).drop("_range", "_guest")
