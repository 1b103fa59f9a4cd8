"""Pack files: content-addressed bodies, gzipped, in files of bounded size.

Entry: the content's 8-byte hash, then its gzip form.  A pack is closed before an entry
would take it past the limit; an entry is never split, so one larger than the limit has a
pack of its own.  Writers are shards of a source of bounded length, so a source that holds
most of the rows is packed by many tasks.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 25 * 1000 * 1000
INDEX = "source_id string, shard long, pack int, packfile_key string, hash string, offset long, size long, payload binary"


def hash_hex(data: bytes) -> str:
    return f"{xxhash.xxh64(data, seed=0).intdigest():016x}"


@F.pandas_udf(T.StringType())
def content_hash(text: pd.Series) -> pd.Series:
    """16 hex digits of the seed-0 xxHash64 of the UTF-8 bytes; null for null."""
    return text.map(lambda t: None if t is None else hash_hex(t.encode()))


def entry(text: str) -> bytes:
    data = text.encode()
    return bytes.fromhex(hash_hex(data)) + gzip.compress(data, mtime=0)


def write_packs(blobs: DataFrame, limit: int = LIMIT, shard_rows: int = 20_000, shard_bytes: int = 64_000_000) -> DataFrame:
    """(source_id, position, hash, content), distinct hashes, to index rows; each pack's bytes stand in its first row.

    A shard holds at most ``shard_rows`` positions, and of them runs of about ``shard_bytes``, so
    that a task never gathers more than that and one row. Rows with null content are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, parts, size, number = [], [], 0, 0
        source, shard = pdf["source_id"].iloc[0], int(pdf["shard"].iloc[0])
        done = []

        def close():
            nonlocal rows, parts, size, number
            data = b"".join(parts)
            key = f"packs/{source}/{hash_hex(data)}"
            done.extend((source, shard, number, key, h, o, n, data if k == 0 else None) for k, (h, o, n) in enumerate(rows))
            rows, parts, size, number = [], [], 0, number + 1

        for h, text in zip(*(pdf.sort_values("position")[c] for c in ("hash", "content"))):
            e = entry(text)
            if rows and size + len(e) > limit:
                close()
            rows.append((h, size, len(e)))
            parts.append(e)
            size += len(e)
        if rows:
            close()
        return pd.DataFrame(done, columns=[c.strip().split()[0] for c in INDEX.split(",")])

    rows = blobs.where("content IS NOT NULL").withColumn("__rows", F.floor(F.col("position") / shard_rows).cast("long"))
    before = Window.partitionBy("source_id", "__rows").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.octet_length("content").cast("long")).over(before), F.lit(0))
    sharded = rows.withColumn("shard", F.col("__rows") * 1_000_000 + F.floor(size / shard_bytes).cast("long"))
    return sharded.select("source_id", "shard", "position", "hash", "content").groupBy("source_id", "shard").applyInPandas(run, INDEX)


def read_blobs(index: DataFrame, packs: DataFrame) -> DataFrame:
    """index rows with ``content``; null where the stored hash (all 8 bytes) is another one. packs: (packfile_key, payload)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for entries, data in zip(b["entries"], b["payload"]):
                for a in range(0, len(entries), 1000):
                    rows = []
                    for x in entries[a : a + 1000]:
                        e = bytes(data[x["offset"] : x["offset"] + x["size"]]) if data is not None else b""
                        rows.append((x["source_id"], x["hash"], gzip.decompress(e[8:]).decode() if e[:8].hex() == x["hash"] else None))
                    yield pd.DataFrame(rows, columns=["source_id", "hash", "content"])

    # a pack's bytes come once, with all entries wanted of it; their number is bounded by the pack's size
    entries = index.groupBy("packfile_key").agg(F.collect_list(F.struct("source_id", "hash", "offset", "size")).alias("entries"))
    return entries.join(packs, "packfile_key", "left").select("entries", "payload").mapInPandas(run, "source_id string, hash string, content string")


def blob_json(blobs: DataFrame, schema: str) -> DataFrame:
    """blobs with ``value``: the content read as JSON; null where it isn't."""
    return blobs.withColumn("value", F.from_json("content", schema))


def list_objects(objects: DataFrame, prefix: str = "", after: str | None = None, limit: int = 1000) -> DataFrame:
    """A page of a listing (key, size) in order of key: those with the prefix, beyond the cursor."""
    page = objects.where(F.col("key").startswith(prefix))
    if after is not None:
        page = page.where(F.col("key") > after)
    return page.orderBy("key").limit(limit)
