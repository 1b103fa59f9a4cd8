"""Near-duplicate detection: b-bit MinHash.

1. One pass over the texts makes, for each document, the digest of its shingle set, the
   band keys of its MinHash minima, and the lowest two bits of every minimum, packed.
2. Documents with equal sets are one class, stood for by its smallest doc_id.
3. Each class is compared with the smallest class in each of its band buckets: first by
   counting equal low bits (corrected for chance), then exactly.  Hot buckets cost one
   comparison a member, and no task gathers a bucket.
4. Links give components.  Only buckets that still hold several components go on: a pair of
   at least the threshold must share one of its rarest shingles, early enough in both
   (prefix and position filter), so classes of different components are joined on these
   and verified in the same way.

After step 4 every pair of texts that share a band bucket is either in one component or
known not to be a link.  Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwright.llm.common import forget, lists, mix, shingles, slices, written
from lexwright.llm.graph import components


@dataclass(frozen=True)
class Settings:
    """A pair of similarity s is missed by all bands with probability (1 - s**rows)**bands: 7e-11 at 0.85, 1e-7 at 0.8."""

    percent: int = 80  # similarity from which documents are linked, in hundredths
    width: int = 5
    rows: int = 5
    bands: int = 40
    margin: float = 0.2  # an estimate below the threshold by more (6 standard deviations) rules a pair out
    chunk: int = 64  # members compared with one copy of a centre


_KEYS = mix(np.arange(1, 4097, dtype=np.uint64))


def minima(own: np.ndarray, k: int) -> np.ndarray:
    """The smallest of each of k keyed permutations of a set of hashes."""
    out = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), 4096):
        x = own[a : a + 4096]
        x = (x[None, :] ^ _KEYS[:k, None]) * (_KEYS[k : 2 * k, None] | np.uint64(1))
        np.minimum(out, (x ^ (x >> np.uint64(29))).min(1), out=out)
    return out


def _planes(low: np.ndarray) -> list[int]:
    """Lowest and second bit of each minimum, each as four 64-bit words."""
    out = []
    for b in (0, 1):
        bits = np.zeros(256, np.uint8)
        bits[: len(low)] = (low >> np.uint64(b)) & np.uint64(1)
        out += np.packbits(bits).view("<i8").tolist()
    return out


PLANES = [f"p{k}" for k in range(8)]


def signatures(docs: DataFrame, s: Settings, text: str, doc_id: str) -> DataFrame:
    """doc_id, n_shingles, digest, bands, p0..p7; digest and the rest are null for empty sets."""
    k = s.rows * s.bands
    if k > 256:
        raise ValueError("at most 256 minima")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in lists(batches):
            for a, b in slices(texts):
                h, doc = shingles(texts[a:b], s.width)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                rows = []
                for i in range(b - a):
                    own = np.unique(h[cut[i] : cut[i + 1]])
                    if not len(own):
                        rows.append((ids[a + i], 0, None, None, *[None] * 8))
                        continue
                    low = minima(own, k)
                    keys = np.zeros(s.bands, np.uint64)
                    for r in range(s.rows):
                        keys = mix(keys + low[r :: s.rows])
                    keys = mix(keys + np.arange(s.bands, dtype=np.uint64)).view(np.int64)
                    rows.append((ids[a + i], len(own), hashlib.sha256(own.tobytes()).digest()[:16], keys, *_planes(low)))
                types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 8]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_shingles", "digest", "bands", *PLANES])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{p} long" for p in PLANES))


def _likely(pairs: DataFrame, planes: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose similarity, estimated from the packed bits and corrected for chance agreement (a quarter), may reach the threshold."""
    k = s.rows * s.bands
    left = planes.select(F.col("doc_id").alias("a"), *[F.col(p).alias(f"a{p}") for p in PLANES])
    right = planes.select(F.col("doc_id").alias("b"), *[F.col(p).alias(f"b{p}") for p in PLANES])
    differ = F.lit(0)
    for w in range(4):
        differ = differ + F.bit_count(F.col(f"ap{w}").bitwiseXOR(F.col(f"bp{w}")).bitwiseOR(F.col(f"ap{w + 4}").bitwiseXOR(F.col(f"bp{w + 4}"))))
    estimate = ((1 - differ / F.lit(float(k))) - 0.25) / 0.75
    return pairs.join(left, "a").join(right, "b").where(estimate >= s.percent / 100 - s.margin).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of which the whole shingle sets reach the threshold. b may be in very many pairs: it is dealt out in chunks."""
    # both sides of the join are read from tables, so that Spark can split a centre's rows over tasks
    parts = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / s.chunk).alias("parts")).where("parts > 1"), "centres")
    dealt = pairs.join(parts, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))).select("a", "b", "part")
    members = dealt.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    centres = dealt.select("b", "part").distinct().join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    percent, width = s.percent, s.width

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for a, b, ta, tb in lists(batches, 200):
            good = []
            for i, j in slices(ta, 1 << 18):
                h, doc = shingles(ta[i:j], width)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(i, j):
                    if b[k] != last:
                        last, centre = b[k], np.unique(shingles([tb[k]], width)[0])
                    own = np.unique(h[cut[k - i] : cut[k - i + 1]])
                    both = int(np.sum(centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own))
                    if 100 * both >= percent * (len(own) + len(centre) - both):
                        good.append((a[k], b[k]))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good)], names=["a", "b"])

    side = members.join(centres, ["b", "part"]).sortWithinPartitions("b").select("a", "b", "text_a", "text_b")
    return side.mapInArrow(verify, "a long, b long")


def _prefixes(texts: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, token, pos): the n - ceil(t n) + 1 rarest of a text's n shingles, by their counts over the given texts."""
    width, percent = s.width, s.percent

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ts in lists(batches):
            for a, b in slices(ts):
                h, doc = shingles(ts[a:b], width)
                key = np.unique(np.stack((doc.astype(np.uint64), h)), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                named = np.asarray(ids[a:b], np.int64)[key[0].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(key[1].view(np.int64))], names=["doc_id", "token"])

    tokens = written(texts.select("doc_id", "text").mapInArrow(explode, "doc_id long, token long"), "tokens")
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(df, "token", "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("t"))
    n = F.size("t")
    need = n - F.ceil(n * percent / 100.0 - 1e-9).cast("int") + 1
    # a token of one text only takes its place in the prefix, but can't make a pair
    placed = F.transform(F.slice("t", 1, need), lambda x, i: F.struct(x["df"].alias("df"), x["token"].alias("token"), i.alias("pos")))
    return ranked.select("doc_id", n.alias("n"), F.explode(F.filter(placed, lambda x: x["df"] > 1)).alias("x")).select("doc_id", "n", "x.token", "x.pos")


def classify(docs: DataFrame, s: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a text with
    fewer than ``width`` words is one shingle.  Null, empty and wordless texts have no
    shingles and are linked with nothing.  Rows with the same doc_id are one document.  Rows
    with a null doc_id stay by themselves, with a null component.  kept: doc_id is the
    smallest of its component (true for a null doc_id).
    """
    sig = written(signatures(docs, s, text, doc_id), "signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = written(full.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    classes = full.join(copies, "digest", "left").withColumn("class", F.coalesce("class", "doc_id"))
    heads = classes.where("doc_id = class").dropDuplicates(["doc_id", "digest"])
    banded = written(heads.select("doc_id", F.explode("bands").alias("key")), "bands")
    shared = written(banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "low"), "shared")
    members = written(banded.join(shared, "key"), "members")
    planes = heads.select("doc_id", *PLANES)
    stars = written(_likely(members.where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct(), planes, s), "stars")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    texts = written(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "candidates")
    # a doc_id may stand for several texts; all of them carry its links
    copy_links = classes.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    links = written(_verified(stars, texts, s), "links")
    labels = written(components(links), "labels")

    # both tables are written, so that Spark can split the members of a common key over tasks
    at = written(members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    mixed = written(at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key"), "mixed")
    open_ids = written(at.join(mixed, "key", "left_semi").select("doc_id", "component").distinct(), "open")
    raw_prefix = written(_prefixes(texts.join(open_ids.select("doc_id"), "doc_id", "left_semi"), s).join(open_ids, "doc_id"), "prefixes")
    # written, so that the joins read tables on both sides and Spark can split a common token over tasks
    spread = written(raw_prefix.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token"), "spread")
    prefix = written(raw_prefix.join(spread, "token", "left_semi"), "prefixes")
    left = prefix.select("token", F.col("doc_id").alias("a"), F.col("component").alias("x"), (F.col("n") - F.col("pos")).alias("rest_a"), F.col("n").alias("n_a"))
    right = prefix.select("token", F.col("doc_id").alias("b"), F.col("component").alias("y"), (F.col("n") - F.col("pos")).alias("rest_b"), F.col("n").alias("n_b"))
    # from a pair's first common shingle on, at most the shorter rest can be common; later ones have shorter rests
    enough = F.least("rest_a", "rest_b") * (100 + s.percent) >= s.percent * (F.col("n_a") + F.col("n_b"))
    across = left.join(right, "token").where((F.col("x") < F.col("y")) & enough).select(F.col("b").alias("a"), F.col("a").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = written(_verified(written(_likely(across, planes, s), "across"), texts, s), "more")

    edges = links.unionAll(more).unionAll(copy_links)
    final = written(components(edges), "components")
    forget(at, mixed, copies, banded, shared, members, stars, texts, links, labels, open_ids, raw_prefix, spread, prefix, more)
    out = sig.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
