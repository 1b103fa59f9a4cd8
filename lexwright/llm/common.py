"""Shared helpers: tables, scratch space that survives lost executors, and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwright.operators.scratch import forget, scratch, written

__all__ = ["forget", "scratch", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """wanted, or what stands nearest to it that no column is called."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def lists(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[list[list]]:
    """The columns of the batches as Python lists, so many rows at a time.

    Spark bounds a batch in bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set); this bounds what
    of it stands in Python objects as well.  The session's settings are left alone.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield [c.to_pylist() for c in batch.slice(a, rows).columns]
    release()


def release() -> None:
    """Give freed memory back to the system: a worker waits for its next task next to the others on its machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such function
        ctypes.CDLL(None).malloc_trim(0)


# --- word hashing over whole Arrow batches -------------------------------------------------------

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_KEY = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word in raw, the texts one after another; ends has where each text stops."""
    space = np.ones(len(raw) + 1, bool)
    space[:-1] = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[0] = True
    first[ends] = True
    opens = ~space[:-1] & (np.concatenate(([True], space[:-2])) | first[:-1])
    closes = ~space[:-1] & (space[1:] | first[1:])
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(ends, start, "right")


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_KEY[raw] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """ASCII-folded bytes of the texts one after another, and where each stops. Null counts as empty."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    return _FOLD[raw], np.cumsum([len(p) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)


def shingles(texts: list, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles in text order, and the document of each.

    A text with fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    raw, ends = joined(texts)
    start, end, doc = word_spans(raw, ends)
    words = word_hashes(raw, start, end)
    if not len(words):
        return words, doc
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    position = np.arange(len(words)) - first[doc]
    head = (position + width <= count[doc]) | (position == 0)
    at = np.flatnonzero(head)
    length = np.minimum(width, count[doc[at]])
    out = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(width):
        more = length > k
        out[more] = mix(out[more] * _BASE + words[at[more] + k])
    return out, doc[at]


def slices(texts: list, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts with about ``limit`` characters each, so that working arrays stay small."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)
