"""What the operators leave of the caller's session, and rows of very long texts."""

import pytest

import corpus_pipeline as cp
from lexwright.llm import common, queries


def settings(spark):
    return {r.key: r.value for r in spark.sql("SET").collect()}


def test_settings_stay(spark, sf_dir):
    before = settings(spark)
    for fn in queries.queries().values():
        fn(spark, sf_dir)
    for _, stage in cp.STAGES:
        stage(spark, common.table(spark, sf_dir, "documents"), sf_dir)
    assert settings(spark) == before


def test_scratch_must_be_shared():
    class Conf(dict):
        pass

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.scratch(Session)
    Session.sparkContext.master = "local[2]"
    assert common.scratch(Session) == common.scratch(Session)
    Session.conf = {"spark.checkpoint.dir": "file:/shared/"}
    assert common.scratch(Session) == "file:/shared"


def test_texts_of_many_megabytes(spark):
    """Six texts of 8 MB and near copies of one: each operator returns its rows."""
    import random

    from lexwright.llm import near, packing, pii, quality, suffixes, tokens

    rng = random.Random(4)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    body = " ".join(rng.choices(vocabulary, k=1_100_000))
    texts = [body, body + " end", "x" * 8_000_000, " ".join(rng.choices(vocabulary, k=1_100_000)), "\n" * 3_000_000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in near.classify(d).collect()}
    assert [got[i].component_id for i in range(5)] == [0, 0, 2, 3, 4] and got[4].n_shingles == 0
    assert sum(r.n_tokens for r in tokens.read_tokens(tokens.write_tokens(d, queries.vocabulary())).collect()) > 2_000_000
    out = {r.doc_id: r for r in suffixes.dedup_bytes(d).collect()}
    assert out[1].n_removed >= len(body) and out[0].n_removed == 0 and out[3].n_removed == 0
    assert packing.best_fit(d, queries.vocabulary()).agg({"length": "sum"}).first()[0] > 2_000_000
    assert pii.pseudonymise(d, "k").count() == 5 and quality.judge_quality(d).count() == 5
