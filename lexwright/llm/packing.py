"""Best-fit packing with vector capacities.

A piece's demand is a vector (tokens, documents, attention cost = length squared) that
its length alone decides.  So the driver packs the histogram of lengths, which has at
most ``capacity`` rows whatever the corpus: pieces of equal length go in bulk to the
open bins that fit best.  The result, a few thousand rules "ranks a to b of length L go
to bins from x on", is then applied to the pieces by a join.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexwright.llm.common import lists, written
from lexwright.llm.tokens import PARTS, UNITS, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, text: str = "text", doc_id: str = "doc_id", remember: tuple[int, int] = (UNITS, PARTS)) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length that the same task made.

    Only documents longer than ``capacity`` are cut, from their end: every piece but the first is full.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, task = encoder(vocabulary, remember), TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for named, texts in lists(batches):
            rows = []
            for d, t in zip(named, texts):
                ids = memoryview(e.encode(t) + end)
                n = len(ids) // 4
                a, b, piece = 0, (n - 1) % capacity + 1, 0
                while a < n:
                    rows.append((d, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), task, seen[b - a]))
                    seen[b - a] += 1
                    a, b, piece = b, b + capacity, piece + 1
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(encode, PIECES)


def plan(counts: dict[int, int], capacity: int, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights=(1.0, 0.01, 0.01)) -> list[tuple[int, int, int, int, int, int]]:
    """Pack a histogram of lengths: rules (length, first rank, past-last rank, per bin, first bin, offset).

    Lengths go from long to short.  A group is a number of bins with the same contents; of
    the groups in which one more piece fits under all three capacities, ``norm`` takes the
    least weighted norm of what stays free, ``dot`` the largest weighted dot product of
    demand and free space (each as a share of capacity).  Only if none fits are bins opened.
    """
    caps = (capacity, max_docs or max(1, capacity), max_cost or capacity * capacity)
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # free vector -> ranges of bins
    rules, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if length * length > caps[2] or length > capacity:
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        need = (length, 1, length * length)
        while left:
            fits = [g for g in groups if all(f >= n for f, n in zip(g, need))]
            if fits:
                free = min(fits, key=lambda g: _order(g, need, caps, rule, weights))
                lo, hi = groups[free].pop()
                if not groups[free]:
                    del groups[free]
            else:
                free, lo, hi = caps, opened, None
            each = min(f // n for f, n in zip(free, need))
            bins = left // each
            if hi is not None:
                bins = min(bins, hi - lo)
            if not bins:  # one bin takes what is left
                each, bins = left, 1
            rules.append((length, rank, rank + bins * each, each, lo, capacity - free[0]))
            rank, left = rank + bins * each, left - bins * each
            rest = tuple(f - each * n for f, n in zip(free, need))
            if rest[0]:
                groups.setdefault(rest, []).append((lo, lo + bins))
            if hi is None:
                opened += bins
            elif lo + bins < hi:
                groups.setdefault(free, []).append((lo + bins, hi))
    return rules


def _order(free, need, caps, rule, weights):
    if rule == "dot":
        return (-sum(w * n * f / c / c for w, n, f, c in zip(weights, need, free, caps)), free)
    return (sum(w * ((f - n) / c) ** 2 for w, n, f, c in zip(weights, need, free, caps)), free)


def best_fit(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", text: str = "text", doc_id: str = "doc_id",
    remember: tuple[int, int] = (UNITS, PARTS),
) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    Null texts count as empty (a piece with the end id alone); repeated rows are packed each
    by itself; an empty table gives no rows.  A sequence holds at most ``capacity`` tokens, ``max_docs`` pieces and
    ``max_cost`` of attention (the squares of the lengths); without the latter two the first alone binds.  Where
    ``max_cost`` is below the square of ``capacity``, pieces are cut so that each fits by itself.  ``remember``: how many
    words, and parts of words, a worker keeps encoded.
    """
    spark = docs.sparkSession
    longest = capacity if max_cost is None else min(capacity, math.isqrt(max_cost))
    pieces = written(cut(docs, vocabulary, longest, end_id, text, doc_id, remember), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rules = plan(counts, capacity, max_docs, max_cost, rule)
    listed = spark.createDataFrame(rules, "length long, lo long, hi long, each long, bin long, at long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("r", F.col("rank") + F.col("before"))
    # the rules' number depends on the capacity and not on the data: a proven bound
    placed = ranked.join(F.broadcast(listed), "length").where("r >= lo AND r < hi").withColumn("k", F.col("r") - F.col("lo"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(F.col("k") / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + F.col("k") % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
