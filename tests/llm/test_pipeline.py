"""The pipeline's stages, each on its own input, against plain Python."""

import pytest

import corpus_pipeline as cp
from lexwright.llm.tokens import Encoder
from lexwright.llm.queries import vocabulary
from tests.llm.test_near import union_find
from tests.llm.test_scan import brute_set
from tests.llm.test_tokens import packed_well, pieces


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Every stage's input and output, written and reread as run() does."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        at = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, docs, sf_dir).write.parquet(at)
        after = spark.read.parquet(at)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert [name for name, _ in cp.STAGES] == ["quality", "near_duplicates", "benchmark_passages", "personal_data", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)


def test_quality(stages):
    before, after = map(rows, stages[0])
    assert after.items() <= before.items()
    junk = {i for i, t in before.items() if sum(c in "#*$%&|" for c in t) > len(t.split())}
    assert junk and not junk & after.keys()
    assert len(after) > 0.75 * len(before)


def test_near_duplicates(stages):
    before, after = map(rows, stages[1])
    sets = {i: brute_set(t) for i, t in before.items()}
    ids = sorted(sets)
    holders = {}
    for i in ids:
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    edges = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(after) == {i for i, c in union_find(ids, edges).items() if i == c}


def test_benchmark_passages(spark, stages, sf_dir):
    before, after = map(rows, stages[2])
    items = [brute_set(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, t in before.items() for own in [brute_set(t)] if any(s and 100 * len(s & own) >= 80 * len(s) for s in items)}
    assert set(after) == set(before) - bad


def test_personal_data(stages):
    import re

    before, after = map(rows, stages[3])
    assert before.keys() == after.keys()
    for i, t in before.items():
        for found in re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}", t):
            assert found not in after[i]
    sizes = {r.doc_id: r.n_chars for r in stages[3][1].collect()}
    assert all(sizes[i] == len(after[i]) for i in after if after[i] != before[i])


def test_packing(stages):
    docs = sorted(rows(stages[4][0]).items())
    want = pieces(Encoder(vocabulary()).tokenizer, docs, 1024, 2)
    n = packed_well(stages[4][1].collect(), want, 1024)
    assert n <= -(-sum(p[3] for p in want) // 1024) * 1.02 + 1


def test_empty_tables(spark, stages, sf_dir):
    none = stages[0][0].limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_awkward_rows(spark, stages, sf_dir):
    """Nulls in every column, empty and repeated rows, a very long text: what each stage keeps of them."""
    schema = stages[0][0].schema
    long = "word " * 50000
    odd = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", None, None, None), (2, "one two", "en", "b", 7), (2, "one two", "en", "b", 7), (3, long, "xx", None, None)]
    d = spark.createDataFrame(odd, schema)
    stage = dict(cp.STAGES)
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(stage["near_duplicates"](spark, d, sf_dir).collect()) == key(odd)  # of one doc_id no row is a copy
    assert key(stage["benchmark_passages"](spark, d, sf_dir).collect()) == key(odd)
    assert key(stage["personal_data"](spark, d, sf_dir).collect()) == key(odd)
    left = key(stage["quality"](spark, d, sf_dir).collect())
    assert set(left) <= set(key(odd)) and left.count(str(odd[3])) in (0, 2)  # equal rows fare alike
    packed = stage["packing"](spark, d, sf_dir).collect()
    per = {}
    for r in packed:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    assert per[None] == 1 and per[1] == 2 and per[2] == 2 * (per[2] // 2) and per[3] > 50000


def test_clashing_columns(spark, stages, sf_dir):
    """Columns of the operators' own names come through every stage as they were."""
    clash = ["tail", "accepted", "expected_grade", "digest", "kept", "component_id", "item_id", "n_email", "n_date", "before", "__m"]
    from pyspark.sql import functions as F

    d = stages[0][0].limit(40).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clash})
    d = spark.createDataFrame(d.collect(), d.schema)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, sf_dir)
        assert out.columns == d.columns and dict(out.dtypes) == dict(d.dtypes), name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in clash), name
    assert cp.STAGES[-1][1](spark, d, sf_dir).count() >= 40


def test_rows_of_one_doc_id(spark, sf_dir):
    """A clean row stays although another row with its doc_id holds a benchmark item."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    d = spark.createDataFrame([(1, f"so {item} there"), (1, "a clean text of the same number")], "doc_id long, text string")
    assert [r.text for r in cp.benchmark_passages(spark, d, sf_dir).collect()] == ["a clean text of the same number"]
