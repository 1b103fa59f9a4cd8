"""Suffix sort and byte dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lexwright.llm import suffixes
from lexwright.llm.suffixes import Hashed, Settings, first_owner, suffix_sort


def test_suffix_sort():
    rng = random.Random(3)
    for alphabet in ("ab", "abcdefgh", "a"):
        raw = "".join(rng.choice(alphabet) for _ in range(700)).encode()
        raw = raw[:300] + raw[100:250] + raw[300:]
        starts = np.array(sorted(rng.sample(range(len(raw) - 50), 400)))
        group = np.array([rng.randrange(5) for _ in starts])
        text = Hashed(np.frombuffer(raw, np.uint8))
        order = suffix_sort(text, starts, group, 50)
        assert sorted(order) == list(range(len(starts)))
        keys = [(group[i], raw[starts[i] : starts[i] + 50]) for i in order]
        assert keys == sorted(keys)
        owner = np.array([rng.randrange(100) for _ in starts])
        low = {}
        for g, p, o in zip(group, starts, owner):
            low[g, raw[p : p + 50]] = min(o, low.get((g, raw[p : p + 50]), 999))
        got = first_owner(text, starts, group, owner, 50)
        assert got.tolist() == [low[g, raw[p : p + 50]] for g, p in zip(group, starts)]


def test_extension():
    raw = b"abcabcabcabd" + b"x" * 100
    t = Hashed(np.frombuffer(raw, np.uint8))
    assert t.extension(np.array([0, 0, 12]), np.array([3, 1, 20]), np.array([20, 20, 50])).tolist() == [8, 0, 50]


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for p in range(len(b) - length + 1):
                k = b[p : p + length]
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < d:
                    gone[p : p + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(8, 30)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 52))
            parts += [p[a : a + rng.choice([49, 50, 51, 60, 500])], text(rng.randint(0, 20))]
        rows.append((i, "".join(parts)))
    base = text(120)
    for i in range(20):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "#"
        rows.append((1000 - i, "".join(w)))
    rows += [(2000, "a" * 300), (2001, "a" * 49), (2002, "a" * 50), (2003, "ab" * 200), (1999, "ab" * 100 + "a" * 80), (2004, None), (2005, ""), (7, rows[7][1]), (None, rows[3][1]), (None, None), (5000, passages[0] * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("s", [Settings(), Settings(block_bytes=4000, slice_bytes=1000), Settings(block_bytes=2000, slice_bytes=500, hot_blocks=2, piece_bytes=700)])
def test_dedup(spark, s):
    rows = corpus()
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(4)
    got = sorted((tuple(r)[:5] + (bytes(r.kept_text),) for r in suffixes.dedup_bytes(d, s, with_text=True).collect()), key=str)
    assert got == brute(rows)


def test_tables(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [x[:5] for x in brute([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])]
    assert sorted(map(tuple, suffixes.dedup_bytes(d).collect()), key=str) == sorted(want, key=str)
    assert suffixes.dedup_bytes(d.limit(0)).count() == 0


def test_spent_shuffles_go(spark):
    """What was shuffled for the tables of the first passes is gone when they are written; it counts as disk."""
    import time

    from lexwright.llm.suffixes import dedup_bytes

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size())}

    docs = spark.createDataFrame([(k, f"{k} starts here. " + "the same words stand in each of these texts, at some length. " * 3) for k in range(40)], "doc_id long, text string").repartition(4)
    before = files()
    out = dedup_bytes(docs)
    left = True
    for _ in range(20):
        left = {f for f in files() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.25)
    assert not left
    assert {r.doc_id: r.n_removed > 100 for r in out.collect()} == {k: k > 0 for k in range(40)}
