"""Tokenizing with a public byte-level BPE vocabulary, and a bit-packed format for the ids.

Encoding: a text is cut where the vocabulary's own pre-tokenizer must cut as well
(before the last white-space character of a run), so pieces can be encoded apart and
remembered; the vocabulary's library encodes each piece once per worker.

Format: rows of a Parquet table, each a block of whole documents.  A block holds ids at
the fewest bits that the vocabulary needs; 64 ids fill exactly ``bits`` 64-bit words, so
any document's ids are found by its token offset and unpacked by whole columns.  Files
are written by Spark's committer: a lost executor's half-written block never shows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwright.llm.common import lists, written

#: White space as the pre-tokenizer's pattern has it.
_W = "\t\n\x0b\x0c\r \xa0  -     　"
_UNIT = re.compile(f"[{_W}]?[^{_W}]+|[{_W}]+(?=[{_W}][^{_W}])|[{_W}]+")
#: Characters on which libraries differ, and the special token's own string: such texts are encoded whole.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u180e", "\u200b", "<|")
_RARE = [chr(c) for c in range(0x3001) if re.match(f"[{_W}]", chr(c)) and chr(c) not in " \n"]
_LONG_RUN = re.compile("[ \n]{3}|[ \n]{2}\\Z")
_STEM = re.compile(f"([{_W}]?)(\\w+)([^\\w{_W}]*)")
#: Units (a word with what sticks to it) and parts that a worker remembers; a part costs more to encode. The last full
#: generation stays at hand, so that frequent ones are never lost.
UNITS, PARTS = 700_000, 400_000
#: Longer pieces are encoded each time, so that what is remembered stays small.
LONG = 200


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Units(dict):
    """Ids of the units seen so far; one that is missing comes from the generation before or is encoded."""

    def __init__(self, encode, old: dict):
        self.encode, self.old = encode, old

    def next(self) -> _Units:
        self.old = {}
        return _Units(self.encode, self)

    def __missing__(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            found = self.encode(unit)
        if len(unit) <= LONG:
            self[unit] = found
        return found


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remember: tuple[int, int] = (UNITS, PARTS)):
        from tokenizers import Tokenizer

        self.remember = remember
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.letters = _byte_letters()
        self.units = _Units(lambda u: self._unit(u if u[:1] == "\n" else " " + u), {})  # by their text without the blank before it
        self.parts = _Units(self._part, {})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, text: str) -> bytes:
        """A text that the pre-tokenizer leaves in one piece."""
        if text.isascii() and text.isprintable():  # letters stand for themselves
            as_letters = text.replace(" ", "\u0120")
        else:
            as_letters = "".join(map(self.letters.__getitem__, text.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(as_letters)]).tobytes()

    def _unit(self, text: str) -> bytes:
        if len(text) <= LONG and (text[1:] if text[0] == " " else text).isalpha():
            return self.parts[text]
        m = _STEM.fullmatch(text) if len(text) <= LONG else None
        if not m or not m[2].isalpha():
            return self.whole(text)
        head, stem, tail = m.groups()
        parts = self.parts
        if head not in ("", " "):
            return parts[head] + parts[stem] + (parts[tail] if tail else b"")
        return parts[head + stem] + (parts[tail] if tail else b"")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in _ODD):
            return self.whole(text)
        if len(self.units) >= self.remember[0]:
            self.units = self.units.next()
        if len(self.parts) >= self.remember[1]:
            self.parts = self.parts.next()
        if _plain(text):
            rest = iter(text.replace("\n", " \n").split(" "))
            first = next(rest)
            return (self._unit(first) if first else b"") + b"".join(map(self.units.__getitem__, rest))
        return b"".join([self.units[u[1:]] if u[0] == " " and u[1:2] != "\n" else self._unit(u) for u in _UNIT.findall(text)])


def _plain(text: str) -> bool:
    """Whether all white space is blanks and line feeds, at most two in a row and one at the end.

    The pre-tokenizer leaves the last character of a run to the word and takes the others as one piece, so
    in such a text every blank and line feed opens a unit.
    """
    if any(w in text for w in _RARE):
        return False
    return not any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or not _LONG_RUN.search(text)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, remember: tuple[int, int] = (UNITS, PARTS)) -> Encoder:
    """One per Python worker, kept from task to task."""
    if (path, remember) not in _ENCODERS:
        _ENCODERS[path, remember] = Encoder(path, remember)
    return _ENCODERS[path, remember]


# --- packing ------------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    return max(1, (max(vocabulary, 1) - 1).bit_length())


_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64 ids into ``bits`` 64-bit words, little-endian, first id in the lowest bits."""
    groups = -(-len(ids) // 64)
    if bits in _WHOLE:  # ids lie side by side in the words
        v = np.zeros(groups * 64, _WHOLE[bits])
        v[: len(ids)] = ids
        return v.view("<u8")
    v = np.zeros((groups, 64), np.uint64)
    v.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits + 1), np.uint64)
    for j in range(64):
        k, shift = divmod(j * bits, 64)
        out[:, k] |= v[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, k + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out[:, :bits].reshape(-1)


def unpack(words: np.ndarray, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a packed block; only the groups that hold them are read."""
    if bits in _WHOLE:
        return np.ascontiguousarray(words).view(_WHOLE[bits])[start:stop].astype(np.uint32)
    a, b = start // 64, -(-stop // 64)
    w = words[a * bits : b * bits].reshape(b - a, bits)
    out = np.empty((b - a, 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        k, shift = divmod(j * bits, 64)
        x = w[:, k] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (w[:, k + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[start - 64 * a : stop - 64 * a]


MAGIC = b"LXT1"


def block(doc_ids: list, counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    """Magic, bits, number of documents, whether each has an id, their ids, token offsets, packed ids."""
    n = len(doc_ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    offsets = np.concatenate(([0], np.cumsum(counts))).astype("<i8")
    return b"".join([MAGIC, bytes([bits]), n.to_bytes(8, "little"), known.tobytes(), named.tobytes(), offsets.tobytes(), pack(ids, bits).astype("<u8").tobytes()])


def open_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """(doc ids, token offsets, packed words, bits) of a block."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    bits, n = data[4], int.from_bytes(data[5:13], "little")
    known = np.frombuffer(data, np.uint8, n, 13)
    named = np.frombuffer(data, "<i8", n, 13 + n)
    offsets = np.frombuffer(data, "<i8", n + 1, 13 + 9 * n)
    words = np.frombuffer(data, "<u8", -1, 13 + 17 * n + 8)
    return [int(d) if k else None for d, k in zip(named, known)], offsets, words, bits


BLOCKS = "shard int, block int, first_doc long, last_doc long, n_docs long, start_in_shard long, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", block_tokens: int = 1 << 18) -> DataFrame:
    """Encode every whole text, append end_id, and write blocks in ascending doc_id order.

    Returns the written table (one row per block).  Null texts count as empty; rows with
    the same doc_id follow each other in order of their texts; null doc_ids come first.
    A text that is longer than a block gets a block of its own.  An empty table gives no blocks.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, shard = encoder(vocabulary), TaskContext.get().partitionId()
        bits = bits_for(max(e.size, end_id + 1))
        end = np.asarray([end_id], "<u4").tobytes()
        names, counts, parts, size, number, before = [], [], [], 0, 0, 0

        def close():
            nonlocal names, counts, parts, size, number, before
            ids = np.frombuffer(b"".join(parts), "<u4")
            known = [d for d in names if d is not None]
            row = (shard, number, min(known, default=None), max(known, default=None), len(names), before, size, block(names, counts, ids, bits))
            number, before = number + 1, before + size
            names, counts, parts, size = [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["shard", "block", "first_doc", "last_doc", "n_docs", "start_in_shard", "n_tokens", "payload"],
            )

        for named, texts in lists(batches):
            for d, t in zip(named, texts):
                ids = e.encode(t) + end
                names.append(d)
                counts.append(len(ids) // 4)
                parts.append(ids)
                size += len(ids) // 4
                if size >= block_tokens:
                    yield close()
        if names:
            yield close()

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dealt = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(encode, BLOCKS), "tokens")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Read every document back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Shards are ranges of doc_id in ascending order and few (one per writing task), so their
    totals are summed on the driver; blocks know their place in their shard.
    """
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())
    base, at = {}, 0
    for shard, n in totals:
        base[shard] = at
        at += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in lists(batches, 16):
            for shard, first, data in zip(*columns):
                names, offsets, words, bits = open_block(data)
                starts, sums = offsets[:-1] + (base[shard] + first), []
                step = 4096  # documents at a time, so that a block's ids are never held whole as text
                for a in range(0, len(names), step):
                    b = min(len(names), a + step)
                    ids = unpack(words, bits, int(offsets[a]), int(offsets[b])).astype("<u4").tobytes()
                    o = (offsets[a : b + 1] - offsets[a]) * 4
                    sums += [zlib.crc32(memoryview(ids)[o[k] : o[k + 1]]) for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # written at once, and so in small batches: blocks are large, and the JVM keeps what its largest batch took
    return written(blocks.select("shard", "start_in_shard", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"), "decoded")
