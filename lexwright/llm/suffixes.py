"""Suffix-array dedup of byte strings: hash-compared suffix sort.

The rule: a byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller doc_id.  Sorting all suffixes of a corpus would shuffle it many
times over, so the work is dealt out by minimizers, without loss:

* Every string of ``length`` bytes has one anchor: of the ``gram``-byte grams in it, the
  leftmost with the least hash.  Equal strings have equal anchors at the same offset.
* Documents are gathered into blocks of bounded size.  A block tells each of its anchor
  hashes once, so one value costs at most one entry a block however common it is.
* Anchors of one document only are dropped.  For the others, each run of starts with the
  same anchor (at most ``length - gram + 1`` of them, a string of under 2 * length bytes)
  goes to the anchor's bucket; copies within a block go once, for their smallest document.
* In a bucket the suffixes are sorted by a mergesort that compares two of them by binary
  search on prefix polynomial hashes (their common extension) and the byte after it.
  Neighbours in a class are compared byte by byte.  The smallest document of a class
  answers all others.
* Blocks get their answers and are written out with sizes, spans and digests.

Anchors that stand in very many blocks are dealt out by longer strings around them, in three
parts, so that a common word group with ever new neighbours isn't gathered in one bucket.
What is left is strings of 42 bytes that stand in very many blocks: one entry a block, however common.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwright.llm.common import _BYTE_KEY, forget, lists, mix, powers, written


@dataclass(frozen=True)
class Settings:
    length: int = 50
    gram: int = 24
    block_bytes: int = 8 << 20  # text in a block: what a task holds at a time
    slice_bytes: int = 1 << 20
    piece_bytes: int = 2 << 20  # text whose suffixes are hashed and sorted at a time
    hot_blocks: int = 256  # from so many blocks on, an anchor is dealt out by more than its own bytes


#: Parts of a very common anchor's runs.
PARTS = 3


# --- hashing and sorting -------------------------------------------------------------------------


class Hashed:
    """Prefix polynomial hashes of a byte string: the hash of any substring in constant time."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_KEY[raw] * up[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, size) -> np.ndarray:
        return (self.sums[a + size] - self.sums[a]) * self.down[a]

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes a and b, at most limit, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), limit.copy()
        whole = self.of(a, limit) == self.of(b, limit)
        if whole.any():  # alike to the end: nothing to search
            lo[whole] = limit[whole]
            rest = np.flatnonzero(~whole)
            lo[rest] = self.extension(a[rest], b[rest], limit[rest]) if len(rest) else 0
            return lo
        for _ in range(int(limit.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, depth: int, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b, both cut at depth; equal ones where or_equal says so."""
        n = self.extension(a, b, np.full(len(a), depth))
        last = len(self.raw) - 1
        x, y = self.raw[np.minimum(a + n, last)], self.raw[np.minimum(b + n, last)]
        return np.where(n >= depth, or_equal, x < y)


def suffix_sort(text: Hashed, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes within each group (ascending), by mergesort over all groups at once.

    Every suffix has at least ``depth`` bytes.  At each level every element finds its rank in
    the run that its own is merged with, by binary search with hash-compared suffixes.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    n = len(order)
    heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((heads, [n])))
    head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    place = np.arange(n) - head
    run = 1
    most = int(sizes.max(initial=1))
    while run < most:
        todo = np.flatnonzero(size > run)  # groups of more than one run
        k = place[todo] // run
        left = k % 2 == 0
        other = (k ^ 1) * run
        end = np.minimum(other + run, size[todo])
        own = starts[order[todo]]
        lo, hi = np.minimum(other, end), end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            there = starts[order[head[todo[open_]] + mid]]
            # an element of the right run goes after equal ones of the left run
            before = text.less(there, own[open_], depth, ~left[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        at = head[todo] + np.minimum(k, k ^ 1) * run + (place[todo] - k * run) + (lo - np.minimum(other, end))
        moved = order[todo]
        order[at] = moved
        run *= 2
    return order


def equal_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    same = np.ones(len(a), bool)
    for k in range(size):
        same &= raw[a + k] == raw[b + k]
    return same


def first_owner(text: Hashed, starts: np.ndarray, group: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the smallest owner among the suffixes of its group with the same first ``depth`` bytes."""
    if not len(starts):
        return owner.copy()
    order = suffix_sort(text, starts, group, depth)
    s, g = starts[order], group[order]
    new = np.ones(len(s), bool)
    # verified on the bytes: what only hashes alike would stand next to each other, but opens a class of its own
    new[1:] = (g[1:] != g[:-1]) | ~equal_bytes(text.raw, s[1:], s[:-1], depth)
    heads = np.flatnonzero(new)
    low = np.minimum.reduceat(owner[order], heads)
    out = np.empty_like(owner)
    out[order] = np.repeat(low, np.diff(np.concatenate((heads, [len(s)]))))
    return out


# --- blocks --------------------------------------------------------------------------------------


def pack_block(ids: list, parts: list[bytes]) -> bytes:
    known = bytes(d is not None for d in ids)
    named = np.array([0 if d is None else d for d in ids], "<i8").tobytes()
    sizes = np.array([len(p) for p in parts], "<i8").tobytes()
    return zstandard.compress(struct.pack("<q", len(ids)) + known + named + sizes + b"".join(parts), 2)


def open_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """known, doc ids, where each text stops (from 0), bytes."""
    data = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<q", data)
    known = np.frombuffer(data, np.uint8, n, 8).astype(bool)
    named = np.frombuffer(data, "<i8", n, 8 + n)
    sizes = np.frombuffer(data, "<i8", n, 8 + 9 * n)
    return known, named, np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(data, np.uint8, -1, 8 + 17 * n)


def blocks_of(docs: DataFrame, s: Settings, text: str, doc_id: str) -> DataFrame:
    """(block, payload): consecutive rows of a task, about block_bytes of text each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for named, texts in lists(batches):
            for d, t in zip(named, texts):
                p = b"" if t is None else t.encode("utf-8", "surrogatepass")
                if size and size + len(p) > s.block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack_block(ids, parts)], pa.binary())], names=["block", "payload"])
                    name, ids, parts, size = name + 1, [], [], 0
                ids.append(d)
                parts.append(p)
                size += len(p) + 64
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack_block(ids, parts)], pa.binary())], names=["block", "payload"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return written(slim.mapInArrow(gather, "block long, payload binary"), "blocks")


def anchored(raw: np.ndarray, stops: np.ndarray, s: Settings) -> tuple[Hashed, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of starts that share an anchor: text, first start, number of starts, anchor; in order."""
    text = Hashed(raw)
    w = s.length - s.gram + 1
    none = np.zeros(0, np.int64)
    if len(raw) < s.length:
        return text, none, none, none
    every = np.arange(len(raw) - s.gram + 1)
    v = mix(text.of(every, s.gram))
    at, size = every.astype(np.int32), 1
    while size < w:  # leftmost least gram of growing windows
        step = min(size, w - size)
        right = v[step:] < v[:-step]
        at = np.where(right, at[step:], at[:-step])
        v = np.minimum(v[step:], v[:-step])
        size += step
    first, last = stops[:-1], stops[1:] - s.length
    ok = last >= first
    count = (last - first + 1)[ok]
    if not len(count):
        return text, none, none, none
    p = np.arange(count.sum()) + np.repeat(first[ok] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    a = at[p]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)))
    heads = np.flatnonzero(new)
    return text, p[heads], np.diff(np.concatenate((heads, [len(p)]))), a[heads].astype(np.int64)


def runs_of(payload: bytes, s: Settings) -> Iterator[tuple]:
    """Slices of a block: (first slot, doc ids by slot, offsets by slot, text, start, n, anchor, key, slot of each run)."""
    known, named, stops, raw = open_block(payload)
    a = 0
    while a < len(named):
        b = int(np.searchsorted(stops, stops[a] + s.slice_bytes, "left"))
        b = min(max(b, a + 1), len(named))
        here = raw[stops[a] : stops[b]]
        local = stops[a : b + 1] - stops[a]
        text, start, n, anchor = anchored(here, local, s)
        slot = np.searchsorted(local, start, "right") - 1
        ok = known[a + slot]
        start, n, anchor, slot = start[ok], n[ok], anchor[ok], slot[ok]
        key = mix(mix(text.of(anchor, s.gram))) >> np.uint64(16)
        yield a, named[a:b], local, text, start, n, anchor, key, slot
        a = b


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.concatenate((np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))), [len(b)])) if len(b) else [0]
    for i, j in zip(cut, cut[1:]):
        yield int(b[i]), order[i:j]


# --- the passes ----------------------------------------------------------------------------------


def _told(buckets: int, s: Settings):
    """Pass 1: each block's anchor hashes, once each, those of several documents first."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in lists(batches, 1):
            for block, payload in zip(*columns):
                keys, docs = [], []
                for _, named, _, _, _, _, _, key, slot in runs_of(payload, s):
                    keys.append(key)
                    docs.append(named[slot])
                if not keys:
                    continue
                keys, docs = np.concatenate(keys), np.concatenate(docs)
                order = np.argsort(keys, kind="stable")
                keys, docs = keys[order], docs[order]
                heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                if not len(heads):
                    continue
                several = np.minimum.reduceat(docs, heads) < np.maximum.reduceat(docs, heads)
                keys = keys[heads]
                rows = []
                for bucket, at in _by_bucket((mix(keys) % np.uint64(buckets)).astype(np.int64)):
                    two = several[at]
                    rows.append((bucket, block, struct.pack("<i", int(two.sum())) + _six(np.concatenate((keys[at][two], keys[at][~two])))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "block", "data"])

    return tell


def _shared(s: Settings):
    """Which anchors stand in several documents: an answer to each block that told of them, very common ones first."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blocks, sure = [], [], []
        for _, named, entries in lists(batches):
            for block, data in zip(named, entries):
                (n,) = struct.unpack_from("<i", data)
                h = _unsix(data[4:])
                keys.append(h)
                blocks.append(np.full(len(h), block))
                sure.append(np.arange(len(h)) < n)
        if not keys:
            return
        keys, blocks, sure = np.concatenate(keys), np.concatenate(blocks), np.concatenate(sure)
        order = np.argsort(keys)
        keys, blocks, sure = keys[order], blocks[order], sure[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.concatenate((heads, [len(keys)])))
        wanted = np.repeat((n > 1) | np.maximum.reduceat(sure, heads), n)
        hot = np.repeat(n >= s.hot_blocks, n)[wanted]
        keys, blocks = keys[wanted], blocks[wanted]
        rows = []
        for block, at in _by_bucket(blocks):
            rows.append((block, struct.pack("<i", int(hot[at].sum())) + _six(np.concatenate((keys[at][hot[at]], keys[at][~hot[at]])))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["block", "data"])

    return share


def _sent(buckets: int, s: Settings):
    """Pass 2: the runs of shared anchors with their bytes, one for each string in the block; notices for the copies."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in lists(batches, 1):
            for block, payload, answers in zip(*columns):
                parts = [struct.unpack_from("<i", x)[0] for x in answers]
                hot = np.sort(np.concatenate([_unsix(x[4 : 4 + 6 * n]) for x, n in zip(answers, parts)]))
                known = np.sort(np.concatenate([_unsix(x[4:]) for x in answers]))
                runs, texts = [], []
                for first, named, local, text, start, n, anchor, key, slot in runs_of(payload, s):
                    on = _has(known, key)
                    start, n, anchor, key, slot = start[on], n[on], anchor[on], key[on], slot[on]
                    lead = anchor - start
                    if len(hot):
                        start, n, lead, key, slot = _split(text, start, n, lead, key, slot, _has(hot, key), s)
                    size = n + s.length - 1
                    mark = mix(text.of(start, size) + lead.astype(np.uint64) + (n.astype(np.uint64) << np.uint64(8)))
                    ends = np.cumsum(size)
                    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - np.concatenate(([0], ends[:-1])), size)
                    texts.append(text.raw[at])
                    runs.append(np.stack((key.view(np.int64), mark.view(np.int64), named[slot], first + slot, start - local[slot], n, lead, size)))
                if not runs:
                    continue
                key, mark, doc, slot, start, n, lead, size = np.concatenate(runs, axis=1)
                raw = np.concatenate(texts)
                begin = np.cumsum(size) - size
                order = np.lexsort((doc, mark, key))
                same = (key[order][1:] == key[order][:-1]) & (mark[order][1:] == mark[order][:-1]) & (size[order][1:] == size[order][:-1])
                heads = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)
                chief = np.empty(len(order), np.int64)
                chief[order] = np.repeat(order[heads], np.diff(np.concatenate((heads, [len(order)]))))
                copy = doc > doc[chief]
                copy[copy] = _same_runs(raw, begin[copy], begin[chief[copy]], size[copy])
                bucket = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                rows = []
                for b, at in _by_bucket(bucket):
                    c, t = at[copy[at]], at[~copy[at]]
                    span = np.arange(size[t].sum()) + np.repeat(begin[t] - (np.cumsum(size[t]) - size[t]), size[t])
                    data = b"".join(
                        [struct.pack("<ii", len(c), len(t)), slot[c].astype("<i4").tobytes(), start[c].astype("<i4").tobytes(), n[c].astype("<i4").tobytes(), key[t].tobytes(), doc[t].tobytes()]
                        + [x[t].astype("<i4").tobytes() for x in (slot, start, n, lead)] + [raw[span].tobytes()]
                    )
                    rows.append((b, block, zstandard.compress(data, 1)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "block", "data"])

    return send


def _has(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _split(text: Hashed, start, n, lead, key, slot, hot, s: Settings):
    """Runs of very common anchors in parts, each under the hash of the bytes that all its strings have in common.

    A part is the strings whose anchor stands ``fold`` consecutive ways; they share all but
    fold - 1 bytes with each other, so equal strings get equal keys and different ones hardly ever.
    """
    fold = -(-(s.length - s.gram + 1) // PARTS)
    part = np.tile(np.arange(PARTS), int(hot.sum()))
    begin, high, m, home = (np.repeat(x[hot], PARTS) for x in (start, lead, n, slot))
    anchor, low = begin + high, high - m + 1
    high, low = np.minimum(high, (part + 1) * fold - 1), np.maximum(low, part * fold)
    ok = high >= low
    part, anchor, high, low, home = part[ok], anchor[ok], high[ok], low[ok], home[ok]
    # apart from the anchors' keys, which have 48 bits
    own = mix(text.of(anchor - part * fold, s.length - fold + 1) + part.astype(np.uint64)) | np.uint64(1 << 63)
    join = lambda a, b: np.concatenate((a[~hot], b))
    return join(start, anchor - high), join(n, (high - low + 1).astype(n.dtype)), join(lead, high.astype(lead.dtype)), join(key, own), join(slot, home)


def _same_runs(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), bool)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = equal_bytes(raw, a[at], b[at], int(n))
    return out


def _answers(raw, size, key, doc, n, lead, s: Settings) -> np.ndarray:
    """For each run (their bytes one after another in raw) the bits of the starts whose string has a smaller document."""
    begin = np.cumsum(size) - size
    text = Hashed(raw)
    # equal runs are one class, answered by its smallest document; only one of a class is sorted
    mark = mix(text.of(begin, size) + lead.astype(np.uint64) + (n.astype(np.uint64) << np.uint64(8)))
    mask = np.zeros(len(key), np.int64)
    if len(key):
        order = np.lexsort((doc, mark, key))
        prev, here = order[:-1], order[1:]
        close = (key[here] == key[prev]) & (mark[here] == mark[prev]) & (lead[here] == lead[prev]) & (n[here] == n[prev])
        close[close] = _same_runs(raw, begin[here[close]], begin[prev[close]], size[here[close]])
        heads = np.flatnonzero(np.concatenate(([True], ~close)))
        chief = np.empty(len(key), np.int64)
        chief[order] = np.repeat(order[heads], np.diff(np.concatenate((heads, [len(key)]))))
        later = doc > doc[chief]
        mask[later] = (np.int64(1) << n[later]) - 1
        # a class that is alone with its anchor has no other string to be equal to
        chiefs = order[heads]
        k = key[chiefs]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        open_, number = chiefs[several], number[several]
        m = n[open_]
        run = np.repeat(np.arange(len(open_)), m)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(m) - m, m)
        # strings can be equal only at the same distance from the same anchor
        group = number[run] * np.int64(s.length + 1) + (lead[open_][run] - inner)
        owner = doc[open_][run]
        first = first_owner(text, begin[open_][run] + inner, group, owner, s.length)
        own = np.zeros(len(key), np.int64)
        np.bitwise_or.at(own, open_[run], np.where(first < owner, np.int64(1) << inner, 0))
        mask = np.where(later, mask, own[chief])
    return mask


def _decided(s: Settings):
    """Sort the suffixes of a bucket; answer each block with the starts whose string has a smaller document."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)  # still compressed; one bucket at a time is opened
        for columns in lists(batches):
            for bucket, block, data in zip(*columns):
                held[bucket].append((block, data))
        for bucket in sorted(held):
            yield from one(held.pop(bucket))

    def one(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        notes, runs, texts, homes = [], [], [], []
        for block, data in rows:
            data = zstandard.ZstdDecompressor().decompress(data)
            c, t = struct.unpack_from("<ii", data)
            at = 8
            three = np.frombuffer(data, "<i4", 3 * c, at).reshape(3, c).astype(np.int64)
            at += 12 * c
            two = np.frombuffer(data, "<i8", 2 * t, at).reshape(2, t)
            at += 16 * t
            four = np.frombuffer(data, "<i4", 4 * t, at).reshape(4, t).astype(np.int64)
            at += 16 * t
            notes.append(np.concatenate((np.full((1, c), block), three)))
            runs.append(np.concatenate((two, four)))
            homes.append(np.full(t, block))
            texts.append(np.frombuffer(data, np.uint8, -1, at))
        note_block, note_slot, note_start, note_n = np.concatenate(notes, axis=1)
        note_mask = (np.int64(1) << note_n) - 1
        key, doc, slot, start, n, lead = np.concatenate(runs, axis=1)
        home, raw = np.concatenate(homes), np.concatenate(texts)
        size = n + s.length - 1
        begin = np.cumsum(size) - size
        mask = np.zeros(len(key), np.int64)
        # hashing takes some 40 bytes a byte, so a large bucket is answered in pieces; a key is in one piece
        piece = (mix(mix(key.view(np.uint64)) + np.uint64(7)) % np.uint64(1 + len(raw) // s.piece_bytes)).astype(np.int64)
        for _, at in _by_bucket(piece):
            span = np.arange(size[at].sum()) + np.repeat(begin[at] - (np.cumsum(size[at]) - size[at]), size[at])
            mask[at] = _answers(raw[span], size[at], key[at], doc[at], n[at], lead[at], s)
        hit = mask != 0
        block, slot, start, mask = (np.concatenate((a, b)) for a, b in ((note_block, home[hit]), (note_slot, slot[hit]), (note_start, start[hit]), (note_mask, mask[hit])))
        rows = [(b, zstandard.compress(struct.pack("<i", len(at)) + slot[at].astype("<i4").tobytes() + start[at].astype("<i4").tobytes() + mask[at].astype("<u4").tobytes(), 1)) for b, at in _by_bucket(block)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["block", "data"])

    return decide


def _finished(s: Settings, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads, sets in lists(batches, 1):
            for payload, answers in zip(payloads, sets):
                known, named, stops, raw = open_block(payload)
                cover = np.zeros(len(raw) + 1, np.int32)
                for data in answers or []:
                    data = zstandard.ZstdDecompressor().decompress(data)
                    (n,) = struct.unpack_from("<i", data)
                    slot, start = np.frombuffer(data, "<i4", n, 4), np.frombuffer(data, "<i4", n, 4 + 4 * n)
                    mask = np.frombuffer(data, "<u4", n, 4 + 8 * n)
                    for k in range(s.length - s.gram + 1):
                        p = (stops[slot] + start)[(mask >> np.uint32(k)) & np.uint32(1) == 1] + k
                        np.add.at(cover, p, 1)
                        np.add.at(cover, p + s.length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                edge[stops[:-1][stops[:-1] < len(raw)]] |= gone[stops[:-1][stops[:-1] < len(raw)]]
                removed = np.concatenate(([0], np.cumsum(gone)))
                spans = np.concatenate(([0], np.cumsum(edge)))
                rows = []
                for i in range(len(named)):
                    a, b = stops[i], stops[i + 1]
                    r = int(removed[b] - removed[a])
                    rest = raw[a:b] if not r else raw[a:b][~gone[a:b]]
                    rows.append((int(named[i]) if known[i] else None, int(b - a), r, int(spans[b] - spans[a]), hashlib.sha256(rest.tobytes()).hexdigest(), *([rest.tobytes()] if with_text else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return finish


def dedup_bytes(docs: DataFrame, s: Settings = Settings(), text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes, kept_text); one row per row of docs.

    Null texts count as empty.  Rows with the same doc_id are not smaller than each other, so
    they lose nothing to each other.  A row with a null doc_id loses nothing and takes nothing
    from others.  Texts shorter than ``length`` bytes stay whole.
    """
    spark = docs.sparkSession
    if not 1 <= s.length - s.gram + 1 <= 32:
        raise ValueError("length - gram must be at most 31")
    blocks = blocks_of(docs, s, text, doc_id)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() // 4)
    buckets = 8 * parts
    # blocks and what is said about them are dealt out alike, into as many parts: a task's share doesn't grow with the input
    dealt = lambda: blocks.repartition(parts, "block")
    told = blocks.mapInArrow(_told(buckets, s), "bucket long, block long, data binary").repartition(parts, "bucket")
    answers = told.mapInArrow(_shared(s), "block long, data binary").repartition(parts, "block")
    answers = written(answers.groupBy("block").agg(F.collect_list("data").alias("answers")), "answers", spent=True)
    sent = dealt().join(answers.repartition(parts, "block"), "block").mapInArrow(_sent(buckets, s), "bucket long, block long, data binary").repartition(parts, "bucket")
    flags = sent.mapInArrow(_decided(s), "block long, data binary").repartition(parts, "block")
    flags = written(flags.groupBy("block").agg(F.collect_list("data").alias("answers")), "flags", spent=True)
    forget(answers)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text
    return dealt().join(flags.repartition(parts, "block"), "block", "left").mapInArrow(_finished(s, with_text), schema)
