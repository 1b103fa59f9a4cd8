"""Decontamination against brute force; the classifier on held-out and planted rows."""

import random

import numpy as np
import pytest

from lexwright.llm import classifier, decontam
from lexwright.llm.common import shingles

W = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi omega".split()


def words(rng, n):
    return [rng.choice(W) + str(rng.randint(0, 50)) for _ in range(n)]


def brute_set(t, width=5):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_shingles_equal_brute_force():
    texts = [None, "", " ", "a", "a b", "a b c d e", "A b C d e f", "a\tb\nc\x0bd\x0ce\rf", "x\x1cy \xa0z é Ä", "a b c d e " * 30, "end"]
    h, doc = shingles(texts)
    known = {}
    for i, t in enumerate(texts):
        assert len(set(h[doc == i])) == len(brute_set(t))
        for x in h[doc == i]:
            known.setdefault(int(x), set()).add(i)
    same = {i for i, t in enumerate(texts) if t and brute_set(t) == brute_set("a b c d e")}
    assert same == {5}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, rng.randint(1, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "just four words here"), (3, "again " * 9)]
    docs = []
    for i in range(120):
        body = words(rng, rng.randint(0, 300))
        if i % 2:
            item = (items[rng.randrange(40)][1] or "").split()
            for k in range(rng.randint(0, 3)):  # near the threshold as well
                if item:
                    item[rng.randrange(len(item))] = "x"
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " ".join(body).upper() if i % 3 == 0 else "\n".join(body)))
    docs += [(200, None), (201, ""), (202, "Just  four words\nHERE"), (1, docs[1][1]), (203, " ".join(words(rng, 60000)) + " " + items[7][1])]
    return docs, items, spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_item long").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_containment(corpus, spark):
    docs, items, d, b = corpus
    sets = [(i, brute_set(t)) for i, t in items]
    want = sorted((k, i, len(s), len(s & own)) for k, t in docs for own in [brute_set(t)] for i, s in sets if s and 100 * len(s & own) >= 80 * len(s))
    assert any(n != m for _, _, n, m in want) and len(want) > 15
    assert sorted(tuple(r)[:4] for r in decontam.contained(d, b).collect()) == want
    # too many items to send whole: joined, with the same pairs
    assert sorted(tuple(r)[:4] for r in decontam.contained(d, b, limit=1000).collect()) == want
    assert decontam.contained(d.limit(0), b).count() == 0 and decontam.contained(d, b.limit(0)).count() == 0
    left = {r.doc_id for r in decontam.decontaminate(d, b).collect()}
    assert left == {k for k, _ in docs} - {k for k, *_ in want}
    assert {r.doc_id for r in decontam.decontaminate(d, b, limit=1000).collect()} == left


@pytest.mark.parametrize("limit", [decontam.BLOCK, 100])
def test_rows_are_judged_one_by_one(spark, limit):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"so {item} there", "a", b"1"), (1, "a clean text of the same number", "b", None), (None, item, "c", b"2"), (None, None, "d", b"3"), (2, "", None, b"4")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string, digest binary")
    items = spark.createDataFrame([(7, item), (8, " ".join(f"v{i}" for i in range(30)))], "item_id long, text string")
    out = decontam.decontaminate(d, items, limit=limit)
    assert out.columns == d.columns and dict(out.dtypes) == dict(d.dtypes)
    assert sorted((r.item_id or "", r.digest and bytes(r.digest)) for r in out.collect()) == [("", b"4"), ("b", None), ("d", b"3")]
    short = spark.createDataFrame([(7, item), (8, "same number")], "item_id long, text string")
    assert sorted(r.item_id or "" for r in decontam.decontaminate(d, short, limit=limit, short=True).collect()) == ["", "d"]


def test_classifier_learns_order(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        w, y = words(rng, rng.randint(20, 200)), rng.choice([0, 1, 2, 2, 2])
        if y == 0:
            w = [x + "***" for x in w]
        if y == 1:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), "awful")
        rows.append((i, " ".join(w), y if rng.random() > 0.03 else 2))
    d = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a < 600] + [(None, 1), (5, None), (6, 9), (99999, 1)], "doc_id long, grade int")
    m = classifier.fit(d, labels, 3)
    assert list(m.thresholds) == sorted(m.thresholds)
    got = {r.doc_id: r for r in classifier.grade(d, m).collect()}
    assert len(got) == 900
    held = [(got[i], "awful" not in t and "***" not in t) for i, t, _ in rows if i >= 600]
    assert np.mean([r.accepted == good for r, good in held]) > 0.95
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r, _ in held)


def test_classifier_awkward_rows(spark):
    d = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, "word " * 100000, "k"), (4, "\n\n", "k"), (5, "é", "k")], "doc_id long, text string, tail string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    m = classifier.fit(d, none, 3)
    assert classifier.grade(d, m).count() == 6
    one = spark.createDataFrame([(3, 2)], "doc_id long, grade int")
    rows = classifier.grade(d, classifier.fit(d, one, 3)).collect()
    assert len(rows) == 6 and all(0 <= r.tail <= 1 for r in rows)
    assert classifier.grade(d.limit(0), m).count() == 0
    assert classifier.fit(d.limit(0), one, 3).score([]).tolist() == []


def test_classifier_equals_dense_form(spark):
    """Loss and probabilities of a fitted model against a plain dense implementation; its gradient is nil at the mode."""
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.randint(20, 60)) + (["awful"] if i % 3 == 1 else ["***"] * (i % 3 == 0) * 9)) for i in range(300)]
    grades = [i % 3 if rng.random() > 0.1 else rng.randrange(3) for i in range(300)]
    rows = []
    for t, y in zip(texts, grades):
        at, dim, value = classifier.features([t])
        rows.append((y, dim, value))
    model = classifier.fit_rows(rows, 3)
    kept = classifier.distinct(rows)
    used = classifier.screen(kept, 3)
    x = np.zeros((len(kept) + 3, classifier.DIM))
    y = np.array([r[0] for r in kept] + [0, 1, 2])
    for i, (_, dim, value) in enumerate(kept):
        for d, v in zip(dim, value):
            x[i, d] += v * used[d]
    dims = np.flatnonzero(x.any(0))
    x = x[:, dims]

    def loss(w, cuts):
        score = x @ w
        edges = np.concatenate((np.full((len(y), 1), -np.inf), np.tile(cuts, (len(y), 1)), np.full((len(y), 1), np.inf)), 1) - score[:, None]
        with np.errstate(over="ignore"):
            below = 1 / (1 + np.exp(-edges))
        return -np.log(below[np.arange(len(y)), y + 1] - below[np.arange(len(y)), y]).sum() + w @ w / 8

    w, cuts = model.weights[dims], model.thresholds
    assert not np.delete(model.weights, dims).any() and cuts[0] < cuts[1]
    for k in range(min(len(dims), 40)):  # no step in any direction lowers the loss
        step = np.zeros(len(dims))
        step[k] = 1e-4
        assert abs(loss(w + step, cuts) - loss(w - step, cuts)) / 2e-4 < 1e-2
    for k in range(2):
        step = np.eye(2)[k] * 1e-4
        assert abs(loss(w, cuts + step) - loss(w, cuts - step)) / 2e-4 < 1e-2

    dense = []
    for t in texts:
        at, dim, value = classifier.features([t])
        s = sum(model.weights[d] * v for d, v in zip(dim.tolist(), value.tolist()))
        tails = [1 / (1 + np.exp(c - s)) for c in cuts]
        dense.append((sum(tails), tails[-1], tails[-1] >= 0.5))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in classifier.grade(d, model).collect()}
    for i, (expected, tail, ok) in enumerate(dense):
        assert abs(got[i].expected_grade - expected) < 1e-4 and abs(got[i].tail - tail) < 1e-4
        assert got[i].accepted == ok or abs(tail - 0.5) < 1e-4
    left = {r.doc_id for r in classifier.accepted(d, model).collect()}
    assert left == {i for i in got if got[i].accepted}
