"""Components and near-duplicate classes against brute force."""

import random

import pytest

from lexwright.llm import near
from lexwright.llm.graph import components
from tests.llm.test_scan import brute_set, words


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5000, i) for i in range(5001, 5100)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    edges += [(b, a) for a, b in edges[::3]]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = "e" + str(rng.randrange(10**6))
    return w


def corpus():
    rng = random.Random(9)
    out = []
    for g in range(12):  # groups of drifting copies, around the threshold and far from it
        base = words(rng, rng.randint(40, 200))
        for _ in range(rng.randint(2, 25)):
            out.append(" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 25)))))
        drift = base
        for _ in range(6):
            drift = edited(rng, drift, max(1, len(base) // 80))
            out.append("\n".join(drift))
    out += [" ".join(words(rng, rng.randint(5, 100))) for _ in range(60)]
    out += [None, "", "  ", "few words here", "Few  words\nHERE", "few words", "a b c d e", "a b c d e", "A B C D E"]
    out += [out[0]] * 20
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("percent", [80, 85])
def test_classes(spark, percent):
    docs = corpus()
    sets = {i: brute_set(t) for i, t in docs}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union_find(ids, edges)
    d = spark.createDataFrame([(*x, "extra", 1) for x in docs], "doc_id long, text string, component_id string, kept int").repartition(5)
    got = near.classify(d, near.Settings(percent=percent)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(docs)


def test_awkward_rows(spark):
    long = " ".join(str(i) for i in range(50000))
    rows = [(1, long), (2, long + " tail"), (3, None), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "x y")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near.classify(d).collect()), key=str)
    assert (2, 49997, 1, False) in got and (None, 2, None, True) in got and got.count((4, 2, 4, True)) == 2 and len(got) == 7
    assert near.classify(d.limit(0)).count() == 0
