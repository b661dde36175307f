"""Suffix sorting of one shard by external induced sorting, with common-prefix values.

Left-most S-type suffixes are sorted first: their substrings get names in sorted order, and the string of names is sorted
by the same induction in turn, until all names differ. All other suffixes are induced from them in two scans.

At the first level the scans run over priority queues keyed by first byte: draining a bucket in order appends each suffix's
predecessor to the bucket of its own first byte, and the least common-prefix value passed since the last
predecessor sent there, plus one, is the value between the two. Buckets are drained and filled in bulk with
numpy, and each queue keeps its tuples (position, common prefix) on disk beyond ``memory`` entries.

The levels below have as many buckets as names, of one or two entries each. There, neighbouring buckets are drained
together as far as none of them sends to another of them, some square root of all at a time. The arrays of these levels are
mapped from files beyond ``memory`` entries, as a text may be that is given so. All files are unnamed temporary ones
that vanish with the task; a retried task starts again from its input.

Order is exact; common-prefix values are so up to ``depth`` bytes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_FAR = np.iinfo(np.uint16).max
BLOCK = 1 << 18


class Queue:
    """First in, first out: blocks of (position, common prefix with the one before), on disk beyond ``memory`` entries."""

    def __init__(self, memory: int) -> None:
        self.memory, self.held, self.blocks, self.file, self.on_disk = memory, 0, [], None, []

    def append(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.blocks.append((positions, prefixes))
        self.held += len(positions)
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            for p, q in self.blocks:
                self.file.seek(0, 2)
                self.on_disk.append((self.file.tell(), len(p), p.dtype))
                p.tofile(self.file)
                q.tofile(self.file)
            self.blocks, self.held = [], 0

    def _stored(self, at: int, n: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        self.file.flush()
        self.file.seek(at)
        return np.fromfile(self.file, kind, n), np.fromfile(self.file, np.uint16, n)

    def drained(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in order, those appended meanwhile too; they stay readable."""
        i = 0
        while i < len(self.on_disk) + len(self.blocks):
            self._merge(max(0, i - len(self.on_disk)))
            yield self.block(i)
            i += 1

    def _merge(self, i: int) -> None:
        """Small blocks from the i-th in memory on become blocks of up to BLOCK entries."""
        waiting, self.blocks = self.blocks[i:], self.blocks[:i]
        while waiting:
            size = np.cumsum([len(p) for p, _ in waiting])
            k = max(1, int(np.searchsorted(size, BLOCK, side="right")))
            self.blocks.append(waiting[0] if k == 1 else tuple(np.concatenate(x) for x in zip(*waiting[:k], strict=True)))
            waiting = waiting[k:]

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.on_disk)
        return self._stored(*self.on_disk[i]) if i < k else self.blocks[i - k]

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Last to first; each with the common prefix with the one that follows it in the queue (that of the last: unset)."""
        after = _FAR
        for i in reversed(range(len(self.on_disk) + len(self.blocks))):
            p, q = self.block(i)
            yield p[::-1], np.r_[q[1:], np.uint16(after)][::-1]
            after = q[0]

    def close(self) -> None:
        if self.file:
            self.file.close()


def runs_and_types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the run of equal bytes that starts at each position, and whether the suffix there is S-type."""
    n = len(text)
    ends = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]
    lengths = np.diff(np.r_[-1, ends])
    rising = np.r_[text[ends[:-1] + 1] > text[ends[:-1]], False]
    return np.repeat(ends, lengths) - np.arange(n) + 1, np.repeat(rising, lengths)


def _names(text: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of the substrings, each with its closing byte. A substring that begins a longer one is larger: its
    last suffix is S-type where the other's is L-type."""
    key = np.zeros(len(at), np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.where(k < lengths, text[np.minimum(at + k, len(text) - 1)], np.uint8(255)).astype(np.uint64)
    rest = np.full(len(at), 0xFFFFFFFF, np.uint64)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        raw = text.tobytes()
        strings = [raw[a : a + n] for a, n in zip(at[long].tolist(), lengths[long].tolist(), strict=True)]
        rank = {s: i for i, (s, _) in enumerate(sorted(((s, s + b"\xff") for s in set(strings)), key=lambda x: x[1]))}
        rest[long] = np.fromiter((rank[s] for s in strings), np.uint64, len(strings))
    _, first = np.unique(key, return_inverse=True)
    return np.unique(first.astype(np.uint64) << np.uint64(32) | rest, return_inverse=True)[1]


def room(n: int, kind: type, memory: int) -> np.ndarray:
    """An array to fill, in an unnamed file beyond ``memory`` entries."""
    if n <= memory:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+", shape=(n,))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges of counts[i] numbers from starts[i] on, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def substring_names(names: np.ndarray, at: np.ndarray, kinds: int, memory: int) -> np.ndarray:
    """Dense ranks of the substrings from each position of ``at`` to the next, its element included, element by element among
    those still tied. One that begins a longer one is larger (its last suffix is S-type where the other's is L-type), but
    the end of the string is less than any element."""
    m, n = len(at), len(names)
    length = np.r_[at[1:] - at[:-1] + 1, n - at[-1:]]
    rank = room(m, np.int64, memory)
    rank[:] = 0
    active, k = np.arange(m), 0
    while len(active):
        inside = k < length[active]
        value = np.where(active == m - 1, 0, kinds + 1)
        value[inside] = names[at[active[inside]] + k] + 1
        own = rank[active]
        order = np.lexsort((value, own))
        active, own, value, inside = active[order], own[order], value[order], inside[order]
        group = np.r_[True, own[1:] != own[:-1]]
        part = group.copy()
        part[1:] |= value[1:] != value[:-1]
        here = np.arange(len(active))
        first = np.maximum.accumulate(np.where(part, here, 0))
        rank[active] = own + first - np.maximum.accumulate(np.where(group, here, 0))
        tied = np.bincount(first, minlength=len(active))[first] > 1
        active, k = np.sort(active[tied & inside]), k + 1
    return (np.cumsum(np.bincount(rank, minlength=m) > 0) - 1)[rank]


def _scanned(names: np.ndarray, kinds: int, wanted: np.ndarray, seeds: np.ndarray, first: int | None, memory: int) -> np.ndarray:
    """All wanted positions in suffix order, induced by ascending buckets: those of a bucket are before its seeds.

    names: elements, or their mirror images for a descending scan. seeds: positions in order that aren't wanted.
    """
    wanted_in = np.bincount(names[wanted], minlength=kinds)
    start = np.cumsum(wanted_in) - wanted_in
    head = start.copy()
    edges = np.searchsorted(names[seeds], np.arange(kinds + 1))
    out = room(int(wanted_in.sum()), np.int64, memory)

    def targets(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = entries - 1
        ok = entries > 0
        ok[ok] = wanted[before[ok]]
        return before, np.where(ok, names[before], kinds)

    def send(before: np.ndarray, target: np.ndarray) -> None:
        ok = target < kinds
        before, target = before[ok], target[ok]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        before, target = before[order], target[order]
        new = np.flatnonzero(target[1:] != target[:-1]) + 1
        new = np.concatenate(([0], new))
        count = np.diff(new, append=len(target))
        to = target[new]
        out[np.repeat(head[to] - new, count) + np.arange(len(target))] = before
        head[to] += count

    if first is not None:
        out[head[names[first]]] = first
        head[names[first]] += 1
    c, width = 0, 64
    while c < kinds:
        to = min(c + width, kinds)
        known, given = head[c:to] - start[c:to], edges[c + 1 : to + 1] - edges[c:to]
        ends = np.cumsum(known + given)
        entries = np.empty(ends[-1], np.int64)
        entries[_spread(ends - known - given, known)] = out[_spread(start[c:to], known)]
        entries[_spread(ends - given, given)] = seeds[edges[c] : edges[to]]
        before, target = targets(entries)
        # As far as no bucket sends to one that is drained with it.
        least = np.full(to - c, kinds)
        least[ends > 0] = np.minimum.accumulate(target)[ends[ends > 0] - 1]
        done = int(np.count_nonzero(least > np.arange(c, to)))
        if done:
            send(before[: ends[done - 1]], target[: ends[done - 1]])
            c += done
        else:  # a bucket that sends to itself: in turns, then its seeds
            at = start[c]
            while at < head[c]:
                block = np.array(out[at : head[c]])
                at = head[c]
                send(*targets(block))
            send(*targets(np.array(seeds[edges[c] : edges[c + 1]])))
            c += 1
        width = min(1 << 16, 2 * width if done == width else max(64, 2 * done))
    return out


def induced_order(names: np.ndarray, memory: int) -> np.ndarray:
    """Positions of a string of names in suffix order; its end is less than any name."""
    n, kinds = len(names), int(names.max(initial=-1)) + 1
    if kinds == n:
        order = room(n, np.int64, memory)
        order[names] = np.arange(n)
        return order
    _, s_type = runs_and_types(names)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms):
        lms = lms[induced_order(substring_names(names, lms, kinds, memory), memory)]
    large = _scanned(names, kinds, ~s_type, lms, n - 1, memory)
    small = _scanned(kinds - 1 - names, kinds, s_type, large[::-1], None, memory)[::-1]
    order = room(n, np.int64, memory)
    in_large, in_small = np.bincount(names[large], minlength=kinds), np.bincount(names[small], minlength=kinds)
    start = np.cumsum(in_large + in_small) - in_large - in_small
    order[_spread(start, in_large)] = large
    order[_spread(start + in_large, in_small)] = small
    return order


def common_prefixes(eights: np.ndarray, p: np.ndarray, q: np.ndarray, depth: int, least: np.ndarray | int = 0) -> np.ndarray:
    """Bytes, up to depth, that the suffixes at p[i] and q[i] begin alike, at least ``least``. eights: the eight bytes from each position on."""
    most = np.minimum(len(eights) - np.maximum(p, q), depth)
    out = np.zeros(len(p), np.int64) + least
    active = np.flatnonzero(out < most)
    while len(active):
        x, y = p[active] + out[active], q[active] + out[active]
        differ = eights[x] ^ eights[y]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3).astype(np.int64)
        out[active] += same
        active = active[(same == 8) & (out[active] < most[active])]
    return np.minimum(out, most)


#: Of so many neighbours in the text, one has its common prefix counted from nothing.
SAMPLE = 8


def sorted_lms(text: np.ndarray, run: np.ndarray, lms: np.ndarray, depth: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Left-most S-type positions in suffix order, and common prefixes with the one before."""
    m = len(lms)
    if not m:
        return lms, np.empty(0, np.uint16)
    ends = np.r_[lms[1:], len(text)]
    order = induced_order(_names(text, lms, np.minimum(ends + 1, len(text)) - lms), memory)
    eights = np.ndarray((len(text),), "<u8", np.r_[text, np.zeros(8, np.uint8)].tobytes(), 0, (1,))
    before = np.empty(m, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    prefix = np.zeros(m, np.int64)
    some = np.arange(0, m, SAMPLE)
    some = some[before[some] >= 0]
    prefix[some] = common_prefixes(eights, lms[some], lms[before[some]], depth)
    # d bytes on, a suffix has d bytes less in common with one before it, if what they share tells the types of both.
    rest = np.flatnonzero((np.arange(m) % SAMPLE > 0) & (before >= 0))
    near = rest - rest % SAMPLE
    least = prefix[near] - (lms[rest] - lms[near])
    least[least <= run[lms[rest]]] = 0
    prefix[rest] = common_prefixes(eights, lms[rest], lms[before[rest]], depth, least)
    return lms[order], prefix[order].astype(np.uint16)


class _Sender:
    """Sends predecessors of one type to their buckets."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: list[Queue], depth: int) -> None:
        self.text, self.wanted, self.queues, self.depth = text, wanted, queues, depth
        self.least = np.full(256, _FAR, np.uint16)

    def bucket(self) -> None:
        self.least[:] = _FAR

    def send(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        at = np.flatnonzero(positions > 0)
        at = at[self.wanted[positions[at] - 1]]
        target = self.text[positions[at] - 1]
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(at) else [0]
        sent = np.zeros(256, bool)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            x, own = int(target[lo]), at[lo:hi]
            sent[x] = True
            first = min(self.least[x], prefixes[: own[0] + 1].min())
            rest = np.minimum.reduceat(prefixes[: own[-1] + 1], own[:-1] + 1) if len(own) > 1 else prefixes[:0]
            prefix = np.minimum(np.r_[first, rest].astype(np.int32) + 1, self.depth).astype(np.uint16)
            queue = self.queues[x]
            if not queue.held and not queue.on_disk:
                prefix[0] = 0
            self.least[x] = prefixes[own[-1] + 1 :].min(initial=_FAR)
            queue.append(positions[own] - 1, prefix)
        if len(prefixes):
            self.least[~sent] = np.minimum(self.least[~sent], prefixes.min())


def sorted_blocks(text: np.ndarray, depth: int, memory: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all positions: within a block's list neighbours are neighbours in (reversed) suffix order.

    Yields (positions, common prefixes with the one before it in this direction), in descending suffix order. Bytes
    of the text must be below 255.
    """
    n = len(text)
    run, s_type = runs_and_types(text)
    kind = np.int32 if n < 2**31 else np.int64
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    lms, lms_prefix = sorted_lms(text, run, lms, depth, memory)
    lms = lms.astype(kind)
    per_queue = max(1 << 12, memory // 64)
    large = [Queue(per_queue) for _ in range(256)]
    small = [Queue(per_queue) for _ in range(256)]
    edges = np.searchsorted(text[lms], np.arange(257)) if len(lms) else np.zeros(257, int)

    sender = _Sender(text, ~s_type, large, depth)
    large[text[n - 1]].append(np.array([n - 1], kind), np.zeros(1, np.uint16))
    for c in range(256):
        sender.bucket()
        last = None
        for positions, prefixes in large[c].drained():
            sender.send(positions, prefixes)
            last = positions[-1]
        own, prefixes = lms[edges[c] : edges[c + 1]], lms_prefix[edges[c] : edges[c + 1]].copy()
        if len(own):
            prefixes[0] = 0 if last is None else min(run[last], run[own[0]], depth)
            for i in range(0, len(own), BLOCK):
                sender.send(own[i : i + BLOCK], prefixes[i : i + BLOCK])

    sender = _Sender(text, s_type, small, depth)
    for c in reversed(range(256)):
        sender.bucket()
        last = None
        for positions, prefixes in small[c].drained():
            sender.send(positions, prefixes)
            last = positions[-1]
            yield positions, prefixes
        for positions, prefixes in large[c].backwards():
            prefixes = prefixes.copy()
            if prefixes[0] == _FAR:
                prefixes[0] = 0 if last is None else min(run[last], run[positions[0]], depth)
            sender.send(positions, prefixes)
            last = positions[-1]
            yield positions, prefixes
        small[c].close()
        large[c].close()


def repeated_starts(text: np.ndarray, length: int, memory: int = 1 << 22) -> np.ndarray:
    """Whether the string of ``length`` bytes at each position also starts at another."""
    flags = np.zeros(len(text), bool)
    if not len(text):
        return flags
    before = None
    for positions, prefixes in sorted_blocks(text, length, memory):
        hit = prefixes >= length
        flags[positions[hit]] = True
        if before is not None and len(hit) and hit[0]:
            flags[before] = True
        flags[positions[:-1][hit[1:]]] = True
        before = positions[-1]
    return flags
