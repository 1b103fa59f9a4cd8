"""Encoding against the library itself, packing round trips, and the whole path against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexwright.llm import packing, tokens
from lexwright.llm.queries import vocabulary

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b\n\n c", "x\n y", "x \n \t y  ", "it's we'll 'tis I'd''s", "12 ab12 1.5%", "é́e ñ½ ²x", "a\x1cb", "a\x85b\xa0c \xa0d", "x<|endoftext|>y", "<|endof",
    "日本語 テキスト", "🙂🙂 ok", "snake_case __x__", "　wide　　space", "don't  stop", "a" * 5000, "the end.\nThe start, (of) \"it\"", "\r\n\r\nx\r\n", "tab\tword\t\tend\t", "x​y", "ǅ ª º ʰ", "٣ ४ x٣",
]


def test_encoder_equals_library():
    e = tokens.Encoder(vocabulary())
    rng = random.Random(5)
    alphabet = list("ab eé.,'\n\t \xa01_-²　日") + ["  ", " the", "'s", "!?", "\r\n"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for t in TEXTS + made:
        want = [] if t is None else e.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want, repr(t)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_pack_round_trip(bits):
    for n in (0, 1, 63, 64, 65, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n)
        words = tokens.pack(ids, bits)
        assert len(words) == -(-n // 64) * bits
        assert tokens.unpack(words, bits, 0, n).tolist() == ids.tolist()
        assert tokens.unpack(words, bits, n // 3, n // 2).tolist() == ids[n // 3 : n // 2].tolist()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 - i, t, 1) for i, t in enumerate(TEXTS)] + [(100, "zz", 2), (100, "zz", 2), (7, "word " * 3000, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)


def ids_of(tokenizer, text, end):
    return [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files(spark, docs):
    e = tokens.Encoder(vocabulary())
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = ids_of(e.tokenizer, r.text, 0)
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    for size in (50, 1 << 18):
        got = tokens.read_tokens(tokens.write_tokens(docs, vocabulary(), block_tokens=size)).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert tokens.read_tokens(tokens.write_tokens(docs.limit(0), vocabulary())).count() == 0


def packed_well(rows, want, capacity):
    """Every piece once, gapless sequences, no sequence over the capacity."""
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def pieces(tokenizer, rows, capacity, end):
    out = []
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text, end)
        a, b, k = 0, (len(ids) - 1) % capacity + 1, 0
        while a < len(ids):
            out.append((doc_id, k, a, b - a, crc(ids[a:b])))
            a, b, k = b, b + capacity, k + 1
    return out


def test_best_fit(spark, docs, sf_dir):
    e = tokens.Encoder(vocabulary())
    own = [(r.doc_id, r.text) for r in docs.collect()]
    packed_well(packing.best_fit(docs, vocabulary()).collect(), pieces(e.tokenizer, own, 1024, 2), 1024)
    packed_well(packing.best_fit(docs, vocabulary(), capacity=16).collect(), pieces(e.tokenizer, own, 16, 2), 16)
    assert packing.best_fit(docs.limit(0), vocabulary()).count() == 0
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = pieces(e.tokenizer, [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], 1024, 2)
    n = packed_well(packing.best_fit(d, vocabulary()).collect(), want, 1024)
    least = -(-sum(p[3] for p in want) // 1024)
    assert least <= n <= least * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_all_capacities(rule):
    rng = random.Random(3)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 101), 60)}
    rules = packing.plan(counts, 100, max_docs=4, max_cost=11000, rule=rule)
    bins = defaultdict(list)
    for length, lo, hi, each, first, at in rules:
        for k in range(hi - lo):
            bins[first + k // each].append((at + k % each * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for parts in bins.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert sum(n for _, n in parts) <= 100 and len(parts) <= 4 and sum(n * n for _, n in parts) <= 11000


def test_all_three_capacities_bind(spark, docs):
    """Sequences limited in pieces and in attention cost, and bins that the rule decides."""
    got = {}
    for name, limits in {"tokens": {}, "docs": {"max_docs": 2}, "cost": {"max_cost": 20_000}, "dot": {"max_docs": 6, "max_cost": 60_000, "rule": "dot"}, "norm": {"max_docs": 6, "max_cost": 60_000, "rule": "norm"}}.items():
        by = defaultdict(list)
        for r in packing.best_fit(docs, vocabulary(), capacity=256, **limits).collect():
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert sum(n for _, n in parts) <= 256 and len(parts) <= limits.get("max_docs", 10**9) and sum(n * n for _, n in parts) <= limits.get("max_cost", 10**9)
        got[name] = sorted(sorted(n for _, n in parts) for parts in by.values())
    assert max(map(len, got["tokens"])) > 2 and len(got["docs"]) > len(got["tokens"])
    assert max(max(x) for x in got["cost"]) == 141 < max(max(x) for x in got["tokens"])


def test_rules_choose_different_bins():
    """A short piece goes to the bin that it leaves least free, or to the one whose free space it is most alike."""
    rng = random.Random(8)
    counts = {n: rng.randint(1, 9) for n in rng.sample(range(5, 100), 40)}
    plans = {rule: packing.plan(counts, 100, max_docs=5, max_cost=10_000, rule=rule, weights=(1.0, 0.5, 0.5)) for rule in ("norm", "dot")}
    assert plans["norm"] != plans["dot"]
    bins = {rule: max(first + (hi - lo - 1) // each for _, lo, hi, each, first, _ in p) + 1 for rule, p in plans.items()}
    least = -(-sum(n * c for n, c in counts.items()) // 100)
    assert all(least <= b <= least * 1.25 for b in bins.values()), (bins, least)
