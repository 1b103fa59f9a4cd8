"""The classifier after a fit on a few hundred labels."""

import random

import numpy as np

from lexwright.llm import classifier

INSULTS = [f"insult{k}" for k in range(10)]


def texts(rng, n, toxic_share):
    out = []
    for _ in range(n):
        w = [f"word{min(int(rng.expovariate(0.01)), 2000)}" for _ in range(rng.randint(40, 200))]
        toxic = rng.random() < toxic_share
        if toxic:
            for x in rng.sample(INSULTS, 4):
                w.insert(rng.randrange(len(w)), x)
        out.append((" ".join(w), 1 if toxic else 2))
    return out


def rows(items, rng, noise):
    at, dim, value = classifier.features([t for t, _ in items])
    cut = np.searchsorted(at, np.arange(len(items) + 1))
    return [(rng.choice([1, 2]) if rng.random() < noise else y, dim[i:j], value[i:j]) for (_, y), i, j in zip(items, cut, cut[1:])]


def test_toxic_texts_are_rejected_after_few_labels():
    rng = random.Random(4)
    known, new = texts(rng, 380, 0.11), texts(rng, 1000, 0.2)
    m = classifier.fit_rows(rows(known, rng, 0.04), 3)
    kept = m.tails([t for t, _ in new])[:, 1] >= 0.5
    grade = np.array([y for _, y in new])
    assert kept[grade == 1].mean() < 0.15
    assert kept[grade == 2].mean() > 0.97


def test_noise_alone_passes_no_word():
    rng = random.Random(5)
    items = [(t, rng.choice([1, 2, 2, 2])) for t, _ in texts(rng, 400, 0.0)]
    assert classifier.screen(rows(items, rng, 0.0), 3)[: classifier.DIM - classifier.SHAPES].sum() <= 1


def test_slope_is_zero_at_the_fit(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(classifier, "distinct", lambda rows: rows)
    r = rows(texts(rng, 300, 0.3), rng, 0.1)
    m, spread = classifier.fit_rows(r, 3), 4.0
    keep = classifier.screen(r, 3)

    def loss(w, t):
        out, t = w @ w / (2 * spread), np.concatenate(([-np.inf], t, [np.inf]))
        for y, s in [(y, w[d[keep[d]]] @ v[keep[d]]) for y, d, v in r] + [(y, 0.0) for y in range(3)]:
            out -= np.log(1 / (1 + np.exp(s - t[y + 1])) - 1 / (1 + np.exp(s - t[y])))
        return out

    for k in [*np.flatnonzero(m.weights)[:12], *range(classifier.DIM - 3, classifier.DIM)]:
        e = np.zeros(classifier.DIM)
        e[k] = 1e-4
        assert abs(loss(m.weights + e, m.thresholds) - loss(m.weights - e, m.thresholds)) / 2e-4 < 1e-2
    for k in range(2):
        e = np.eye(2)[k] * 1e-4
        assert abs(loss(m.weights, m.thresholds + e) - loss(m.weights, m.thresholds - e)) / 2e-4 < 1e-2
