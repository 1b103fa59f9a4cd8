"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with n shingles of which at least a share t stands in a document misses at most
n - ceil(t n) of them.  So its bottom-k MinHash sketch with k = n - ceil(t n) + 1 has at
least one minimum in common with that document: candidate search loses nothing.  Items
are partitioned by size, and each partition's k comes from its largest size.  Candidates
are verified by exact shingle containment.

The documents are read once, however many items there are.  Items whose shingles take at
most ``BLOCK`` bytes go to every task whole, and documents aren't shuffled.  Beyond that only
a Bloom filter of the sketches does (of bounded size): documents that it lets pass are joined
with the sketches on the minimum and with the items' sets, both shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwright.llm.common import forget, free_name, lists, mix, release, shingles, slices, written

#: Bytes of the items' shingle hashes up to which they are sent to every task whole.
BLOCK = 8 << 20
#: Bits of the Bloom filter: a power of two, 16 or more for each minimum up to this many (64 MB).
BLOOM_BITS = 1 << 29


def sketch_size(n: int, share: float) -> int:
    """Minima that an item of n shingles needs, taken for the largest n of its size partition (powers of two)."""
    top = (1 << n.bit_length()) - 1
    return min(n, top - math.ceil(share * top - 1e-9) + 1)


def item_sets(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """item_id, hashes (sorted distinct shingles), words (of a shingle) for each item with a word."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in lists(batches):
            for a, b in slices(texts):
                h, doc = shingles(texts[a:b], width)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                words = np.bincount(shingles(texts[a:b], 1)[1], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([np.unique(h[i:j]).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array(np.minimum(words, width), pa.int32())],
                    names=["item_id", "hashes", "words"],
                )

    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(sets, "item_id long, hashes binary, words int").where(F.length("hashes") > 0)


def sketch(own: np.ndarray, share: float) -> np.ndarray:
    """The shingles of a sorted set with the smallest keyed hashes."""
    return own[np.argsort(mix(own))[: sketch_size(len(own), share)]]


def _block(ids: list, sets: list[np.ndarray], share: float) -> dict:
    minima = [sketch(s, share) for s in sets]
    of = np.repeat(np.arange(len(sets)), [len(m) for m in minima])
    minima = np.concatenate(minima)
    order = np.argsort(minima, kind="stable")
    return {"ids": ids, "sets": sets, "minima": minima[order], "of": of[order]}


def _has(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _shingled(texts: list, width: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of width words, and of each width in short: a shingle of n words hashes as an item of just these."""
    parts = [shingles(texts, width), *[shingles(texts, n) for n in short]]
    h, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(doc, kind="stable")
    return h[order], doc[order]


def _found(block: dict, texts: list, width: int, share: float) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) for each text of the list that contains an item of the block."""
    minima, of, sets, out = block["minima"], block["of"], block["sets"], []
    for a, b in slices(texts):
        h, doc = _shingled(texts[a:b], width, block["widths"])
        lo = np.searchsorted(minima, h)
        hit = np.flatnonzero(minima[np.minimum(lo, len(minima) - 1)] == h)
        if not len(hit):
            continue
        n = np.searchsorted(minima, h[hit], "right") - lo[hit]
        which = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = np.unique(np.repeat(doc[hit], n) * np.int64(len(sets)) + of[which])
        for d in np.unique(found // len(sets)):
            i, j = np.searchsorted(doc, [d, d + 1])
            own = np.unique(h[i:j])
            for k in found[found // len(sets) == d] % len(sets):
                shared = int(np.sum(_has(own, sets[k])))
                if shared >= share * len(sets[k]) - 1e-9:
                    out.append((a + int(d), int(k), shared))
    return out


PAIRS = "doc_id long, item_id long, n_item long, n_shared long, containment double"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())


def _items(items: DataFrame, item_id: str, text: str, width: int, share: float, short: bool, limit: int):
    """(a block of all items, or None without any; the items' table where they take more than limit bytes)."""
    table = written(item_sets(items, item_id, text, width), "items")
    n, size = table.agg(F.count("*"), F.sum(F.length("hashes"))).first()
    if not n:
        return None, None
    if size > limit:
        return None, table
    rows = table.collect()  # at most limit bytes of hashes
    forget(table)
    block = _block([r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows], share)
    return block | {"widths": sorted({r[2] for r in rows} - {width}) if short else []}, None


def contained(
    docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", short: bool = False, limit: int = BLOCK
) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with at least ``share`` of the item's distinct shingles in the document.

    Words are runs of other characters than ASCII white space, A-Z lower-cased.  An item with
    fewer than ``width`` words is one shingle, which only a document of just these words has; with
    ``short`` every document has it in which these words follow each other.
    Null and wordless texts are in no pair.  Repeated rows give their pairs each.  Without
    items or documents there are no pairs.  Items of more than ``limit`` bytes of shingles are joined.
    """
    block, table = _items(items, item_id, text, width, share, short, limit)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if table is not None:
        return _joined(base, table, share, width, short).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    if block is None:
        return docs.sparkSession.createDataFrame([], PAIRS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in lists(batches):
            rows = [(ids[d], block["ids"][k], len(block["sets"][k]), n, n / len(block["sets"][k])) for d, k, n in _found(block, texts, width, share)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return base.mapInArrow(search, PAIRS)


def _bloom_places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in (1, 2, 3):
        yield mix(h + np.uint64(k)) & np.uint64(bits - 1)


def _bloom(minima: DataFrame, most: int = BLOOM_BITS) -> np.ndarray:
    """Bits (one byte each eight) of a Bloom filter over the minima, which pass the driver a piece at a time."""
    bits = min(most, 1 << max(10, (16 * minima.count()).bit_length()))
    out = np.zeros(bits, bool)
    packed = minima.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary())], names=["data"]) for b in batches), "data binary")
    for (data,) in packed.toLocalIterator():
        for at in _bloom_places(np.frombuffer(data, np.uint64), bits):
            out[at] = True
    return np.packbits(out)


def _joined(base: DataFrame, table: DataFrame, share: float, width: int, short: bool) -> DataFrame:
    """contained() for items too many to send whole; with the digest of each row's text besides."""
    spark = base.sparkSession
    widths = [r[0] for r in table.where(F.col("words") < width).select("words").distinct().collect()] if short else []  # at most width - 1

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets, numbers in lists(batches):
            low = [sketch(np.frombuffer(x, np.uint64), share) for x in sets]
            n = [len(x) for x in low]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, n)), pa.array(np.concatenate(low).view(np.int64))], names=["item", "minimum"])

    numbered = written(table.select("item_id", "hashes", F.expr("uuid()").alias("item")), "items")
    minima = written(numbered.select("item_id", "hashes", "item").mapInArrow(sketches, "item string, minimum long"), "sketches")
    bloom = spark.sparkContext.broadcast(_bloom(minima.select("minimum").distinct()))

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bloom.value
        bits = len(filled) * 8
        for ids, texts, digests in lists(batches):
            rows = []
            for a, b in slices(texts):
                h, doc = _shingled(texts[a:b], width, widths)
                ok = np.ones(len(h), bool)
                for at in _bloom_places(h, bits):
                    ok &= (filled[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
                for d in np.unique(doc[ok]):
                    i, j = np.searchsorted(doc, [d, d + 1])
                    rows.append((uuid.uuid4().bytes, ids[a + d], digests[a + d], np.unique(h[i:j]).tobytes(), np.unique(h[i:j][ok[i:j]]).view(np.int64)))
            if rows:
                types = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["row", "doc_id", "digest", "own", "minima"])

    schema = "row binary, doc_id long, digest binary, own binary, minima array<long>"
    hits = written(base.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest")).mapInArrow(pass_on, schema), "hits")
    pairs = written(hits.select("row", F.explode("minima").alias("minimum")).join(minima, "minimum").select("row", "item").distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, own, names, sets in lists(batches, 100):
            rows = []
            for d, g, x, k, y in zip(ids, digests, own, names, sets):
                item = np.frombuffer(y, np.uint64)
                n = int(np.sum(_has(np.frombuffer(x, np.uint64), item)))
                if n >= share * len(item) - 1e-9:
                    rows.append((d, g, k, len(item), n))
            if rows:
                types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "digest", "item_id", "n_item", "n_shared"])

    both = pairs.join(numbered, "item").join(hits.drop("minima"), "row").select("doc_id", "digest", "own", "item_id", "hashes")
    return both.mapInArrow(verify, "doc_id long, digest binary, item_id long, n_item long, n_shared long")


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, short: bool = False, text: str = "text", item_id: str = "item_id", limit: int = BLOCK) -> DataFrame:
    """docs without the rows in which an item is contained, each judged by its own text whatever its doc_id.

    All columns of docs are returned, whatever they are called; without items all rows stay.
    """
    block, table = _items(items, item_id, "text", width, share, short, limit)
    if table is not None:
        own, digest = F.col(f"`{text}`"), free_name("digest", docs.columns)
        bad = _joined(docs.select(F.lit(None).cast("long").alias("doc_id"), own.alias("text")), table, share, width, short).select(F.col("digest").alias(digest)).distinct()
        return docs.withColumn(digest, F.unhex(F.sha2(own, 256))).join(bad, digest, "left_anti").drop(digest)
    if block is None:
        return docs
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = np.zeros(batch.num_rows, bool)
            for a in range(0, batch.num_rows, 500):
                for d, _, _ in _found(block, batch.column(at).slice(a, 500).to_pylist(), width, share):
                    bad[a + d] = True
            yield batch.filter(pa.array(~bad))
        release()

    return docs.mapInArrow(clean, docs.schema)
