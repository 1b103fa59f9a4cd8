"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered; one weight vector over hashed features serves all of them and
ordered thresholds cut its score: P(grade <= k) = sigmoid(threshold[k] - w.x).
Fitting takes a bounded sample of labelled rows to the driver (features only);
scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwright.llm.common import lists, mix, release, slices, word_hashes

#: Hashed dimensions.  The last SHAPES ones are kept for measures of form.
DIM, SHAPES = 1 << 16, 8
#: At most so many labelled rows are used to fit.
SAMPLE = 8000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARKS = np.zeros(256, np.int64)
_MARKS[list(b"#*$%&|<>")] = 1
_SHOUT = np.zeros(256, np.int64)
_SHOUT[ord("!")] = 1
_SCALE = np.array([4, 4, 4, 1, 1, 1, 1, 1])


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, dimension, value) of the non-zero features, documents ascending.

    A word counts the square root of 100 times its share of the words, 1 at most: one in a
    hundred is seen in full, and one in ten thousand still by a tenth.  Measures of form (capitals, marks,
    exclamation) count four times their share, 1 at most; repetitions (words like the one
    before, word triples, lines) count their share.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    n_docs = len(texts)
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
    gap = np.ones(len(raw) + 1, bool)
    gap[:-1] = _GAP[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[0] = True
    first[ends] = True
    start = np.flatnonzero(~gap[:-1] & (np.concatenate(([True], gap[:-2])) | first[:-1]))
    end = np.flatnonzero(~gap[:-1] & (gap[1:] | first[1:])) + 1
    doc = np.searchsorted(ends, start, "right")
    n = np.bincount(doc, minlength=n_docs)
    some = np.maximum(n, 1)
    h = word_hashes(_FOLD[raw], start, end)
    key, count = np.unique(doc.astype(np.uint64) << np.uint64(16) | h % np.uint64(DIM - SHAPES), return_counts=True)
    at, dim = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64)
    value = np.minimum(1.0, np.sqrt(100.0 * count / some[at]))

    def inside(table):  # how many such bytes a span has
        sums = np.concatenate(([0], np.cumsum(table[raw])))
        return lambda a, b: sums[b] - sums[a]

    opens = np.concatenate(([0], ends[:-1]))
    upper = inside(_UPPER)(start, end)
    shapes = np.zeros((n_docs, SHAPES))
    shapes[:, 0] = np.bincount(doc, (upper == end - start) & (end - start > 1), n_docs) / some
    shapes[:, 1] = inside(_MARKS)(opens, ends) / some
    shapes[:, 2] = inside(_SHOUT)(opens, ends) / some
    if len(h):
        near = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        shapes[:, 3] = np.bincount(doc[1:], near, n_docs) / some
        if len(h) > 2:
            triple = mix(h[:-2]) + mix(h[1:-1] * np.uint64(3)) + mix(h[2:] * np.uint64(5))
            inner = doc[2:] == doc[:-2]
            shapes[:, 4] = _repeats(triple[inner], doc[:-2][inner], n_docs) / some
    cuts = np.union1d(np.flatnonzero(raw == 10), ends - 1) + 1 if len(raw) else np.zeros(0, np.int64)
    a = np.concatenate(([0], cuts[:-1])) if len(cuts) else cuts
    if len(cuts):
        lines = word_hashes(raw, a, cuts)
        of = np.searchsorted(ends, a, "right")
        long = cuts - a > 12
        shapes[:, 5] = _repeats(lines[long], of[long], n_docs) / np.maximum(np.bincount(of[long], minlength=n_docs), 1)
    shapes[:, 6] = n < 20
    shapes[:, 7] = 0.25
    d, k = np.nonzero(shapes)
    at = np.concatenate((at, d))
    order = np.argsort(at, kind="stable")
    return at[order], np.concatenate((dim, k + DIM - SHAPES))[order], np.concatenate((value, np.minimum(1.0, _SCALE[k] * shapes[d, k])))[order]


def _repeats(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """How many of a document's values have come before in it."""
    if not len(h):
        return np.zeros(n_docs)
    key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    return np.bincount(doc[order[1:]], key[1:] == key[:-1], n_docs)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades

    def score(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices(texts):
            at, dim, value = features(texts[a:b])
            out[a:b] = np.bincount(at, self.weights[dim] * value, b - a)
        return out

    def tails(self, texts: list) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - self.score(texts)[:, None], -500, 500)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def distinct(rows: list[tuple[int, np.ndarray, np.ndarray]], keys: int = 6) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """rows without copies and near copies of an earlier row.

    A copied text brings its label's chance error and all its rare words many times over.  Rows
    count as copies if two MinHash minima over their rare dimensions agree in one of the keys.
    """
    df = np.bincount(np.concatenate([dim for _, dim, _ in rows]), minlength=DIM) if rows else np.zeros(DIM)
    salts = mix(np.arange(1, 2 * keys + 1, dtype=np.uint64))
    seen, out = set(), []
    for y, dim, value in rows:
        rare = dim[(df[dim] <= max(2, len(rows) // 50)) & (dim < DIM - SHAPES)].astype(np.uint64)
        low = mix(rare[:, None] * salts[None, :] + salts[None, :]).min(0) if len(rare) else mix(np.resize(dim.astype(np.uint64), 2 * keys) + salts)
        own = {(k, int(low[2 * k]), int(low[2 * k + 1])) for k in range(keys)}
        if not own & seen:
            out.append((y, dim, value))
        seen |= own
    return out


def _tail(a: int, na: int, nb: int, c: int, logs: np.ndarray) -> float:
    """Two-sided Fisher test: of c rows drawn from na + nb without replacement, a come from the na; logs of the factorials."""
    x = np.arange(max(0, c - nb), min(c, na) + 1)
    ways = logs[na] - logs[x] - logs[na - x] + logs[nb] - logs[c - x] - logs[nb - c + x]
    p = np.exp(ways - ways.max())
    p /= p.sum()
    return min(1.0, 2 * min(p[x <= a].sum(), p[x >= a].sum()))


def screen(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, rate: float = 0.01, least: int = 5) -> np.ndarray:
    """Dimensions that tell some grades from the better ones, at a false discovery rate.

    Most words stand in a few documents only; what they seem to say is noise of the labels.  The test is
    exact and the bound (Benjamini and Hochberg) follows from the number of words tested, so
    it suits a few hundred rows as well as the whole sample.
    """
    df = np.zeros((grades, DIM), np.int64)
    for y, dim, _ in rows:
        df[y, dim] += 1
    n = np.bincount([y for y, _, _ in rows], minlength=grades)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n.sum() + 1)))))
    some = np.flatnonzero(df[:, : DIM - SHAPES].sum(0) >= least)
    keep = np.zeros(DIM, bool)
    for k in range(1, grades):
        a, c, na, nb = df[:k].sum(0), df.sum(0), int(n[:k].sum()), int(n[k:].sum())
        if na and nb and len(some):
            known = {}
            p = np.empty(len(some))
            for i, (x, y) in enumerate(zip(a[some].tolist(), c[some].tolist())):
                if (x, y) not in known:
                    known[x, y] = _tail(x, na, nb, y, logs)
                p[i] = known[x, y]
            order = np.argsort(p)
            under = np.flatnonzero(p[order] <= rate * np.arange(1, len(some) + 1) / len(some))
            if len(under):
                keep[some[order[: under[-1] + 1]]] = True
    keep[DIM - SHAPES :] = True
    return keep


def fit_rows(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, spread: float = 4.0, most: int = 100) -> Model:
    """Mode of the posterior by Newton steps with conjugate gradients. rows: (grade, dimensions, values).

    Weights have a normal prior of variance ``spread``, so few rows give small weights.  One empty row is
    added for each grade; it holds thresholds apart where a grade is rare or absent.
    """
    rows = distinct(rows)
    telling = screen(rows, grades)
    y = np.concatenate(([r[0] for r in rows], np.arange(grades))).astype(np.int64)
    kept = [telling[dim] for _, dim, _ in rows]
    at = np.repeat(np.arange(len(rows)), [k.sum() for k in kept])
    dims = np.concatenate([dim[k] for (_, dim, _), k in zip(rows, kept)]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([v[k] for (_, _, v), k in zip(rows, kept)]) if rows else np.zeros(0)
    places, col = np.unique(dims, return_inverse=True)
    n, m, g = len(y), len(places), grades - 1
    above, below = y < g, y > 0

    def to_rows(w):
        return np.bincount(at, w[col] * value, n)

    def to_dims(s):
        return np.bincount(col, s[at] * value, m)

    def to_thresholds(u, v):
        return np.bincount(y[above], u[above], g) + np.bincount(y[below] - 1, v[below], g)

    def from_thresholds(t):
        u, v = np.zeros(n), np.zeros(n)
        u[above], v[below] = t[y[above]], t[y[below] - 1]
        return u, v

    def look(x):
        s = to_rows(x[:m])
        u, v = from_thresholds(x[m:])
        up, lo = np.where(above, _sigmoid(u - s), 1.0), np.where(below, _sigmoid(v - s), 0.0)
        p = np.maximum(up - lo, 1e-12)
        return up, lo, p, x[:m] @ x[:m] / (2 * spread) - np.log(p).sum()

    share = np.bincount(y, minlength=grades)
    below_each = np.cumsum(share / share.sum())[:-1]
    x = np.concatenate((np.zeros(m), np.log(below_each / (1 - below_each))))
    up, lo, p, loss = look(x)
    for _ in range(most):
        du, dl = up * (1 - up), lo * (1 - lo)
        slope = np.concatenate((to_dims(1 - up - lo) + x[:m] / spread, to_thresholds(-du / p, dl / p)))
        # curvature in the two thresholds of a row; its score enters both with the opposite sign
        uu, vv, uv = (du / p) ** 2 - du * (1 - 2 * up) / p, (dl / p) ** 2 + dl * (1 - 2 * lo) / p, -du * dl / p**2

        def bend(d, uu=uu, vv=vv, uv=uv):
            s = to_rows(d[:m])
            a, b = from_thresholds(d[m:])
            a, b = a - s, b - s
            ca, cb = np.where(above, uu * a + uv * b * below, 0.0), np.where(below, vv * b + uv * a * above, 0.0)
            return np.concatenate((d[:m] / spread - to_dims(ca + cb), to_thresholds(ca, cb)))

        step, rest = np.zeros_like(x), -slope
        d, size = rest, rest @ rest
        aim = 1e-8 * size
        for _ in range(500):
            if size <= aim or size < 1e-20:
                break
            bent = bend(d)
            alpha = size / (d @ bent)
            step, rest = step + alpha * d, rest - alpha * bent
            size, old = rest @ rest, size
            d = rest + size / old * d
        length, gain = 1.0, 0.0
        while length > 1e-8:
            new = x + length * step
            if (np.diff(new[m:]) > 0).all():
                seen = look(new)
                if seen[3] <= loss + 1e-4 * length * (slope @ step):
                    gain = loss - seen[3]
                    x, (up, lo, p, loss) = new, seen
                    break
            length /= 2
        if gain <= 1e-9 * abs(loss):
            break
    w = np.zeros(DIM)
    w[places] = x[:m]
    return Model(w, x[m:])


def fit(docs: DataFrame, graded: DataFrame, grades: int, sample: int = SAMPLE, text: str = "text") -> Model:
    """Fit on at most ``sample`` rows of graded (doc_id, grade), chosen by a hash of doc_id.

    The sample of labels is bounded, so it is broadcast and the texts are not shuffled.  Rows
    with a null or out-of-range grade are left out; with no rows left every text gets the
    same prior.
    """
    g = graded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull())
    some = g.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "grade", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ys, texts in lists(batches):
            for a, b in slices(texts):
                at, dim, value = features(texts[a:b])
                cut = np.searchsorted(at, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b], pa.int64()), pa.array(ys[a:b], pa.int32()),
                        pa.array([dim[i:j].astype("<u2").tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([value[i:j].astype("<f4").tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                    ],
                    names=["doc_id", "grade", "dims", "vals"],
                )

    # a doc_id may stand in several rows, so the rows are cut to the bound as well before they go to the driver
    got = rows.mapInArrow(extract, "doc_id long, grade int, dims binary, vals binary").orderBy("doc_id", "grade", "dims", "vals").limit(sample).collect()
    return fit_rows([(y, np.frombuffer(d, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for _, y, d, v in got], grades)


def _tails(model: Model, texts: pa.Array) -> np.ndarray:
    parts = [model.tails(texts.slice(a, 500).to_pylist()) for a in range(0, len(texts), 500)]
    return np.concatenate(parts) if parts else np.zeros((0, len(model.thresholds)))


def accepted(docs: DataFrame, model: Model, text: str = "text", least: int | None = None, keep: float = 0.5) -> DataFrame:
    """The rows of docs that ``grade`` accepts, with the columns of docs whatever they are called."""
    k = len(model.thresholds) - 1 if least is None else least - 1
    at = docs.columns.index(text)
    slim = Model(model.weights.astype(np.float32), model.thresholds)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_tails(slim, batch.column(at))[:, k] >= keep))
        release()

    return docs.mapInArrow(choose, docs.schema)


def grade(docs: DataFrame, model: Model, text: str = "text", least: int | None = None, keep: float = 0.5) -> DataFrame:
    """Add expected_grade, tail (probability of grade ``least``, by default the highest, or better) and accepted to every row.

    Null and empty texts are scored like any other, on their missing words.  Columns of these
    names are replaced; an empty table gives no rows.
    """
    new = ("expected_grade", "tail", "accepted")
    base = docs.drop(*[c for c in new if c != text])
    k = len(model.thresholds) - 1 if least is None else least - 1
    columns = base.columns
    at = columns.index(text)
    slim = Model(model.weights.astype(np.float32), model.thresholds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = _tails(slim, batch.column(at))
            extra = [pa.array(tails.sum(1)), pa.array(tails[:, k]), pa.array(tails[:, k] >= keep)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*columns, *new])
        release()

    schema = T.StructType([*base.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return base.mapInArrow(score, schema)


#: Grades of the documents' labels: 0 low quality, 1 of quality but toxic, 2 of quality and clean.
GRADES = 3


def grades_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
