"""The walk to the root on trees of any depth."""

import pytest

from lexwright.operators import store


def chain(spark, n, first=None):
    return spark.createDataFrame([(str(k), str(k - 1) if k else first) for k in range(n)], "id string, parent_id string")


def test_deeper_than_twelve_levels(spark):
    rows = store.ancestors(chain(spark, 20)).collect()
    assert sorted((int(r.id), int(r.ancestor_id), r.distance) for r in rows) == [(i, j, i - j) for i in range(20) for j in range(i + 1)]


def test_roots_orphans_and_empty(spark):
    assert [tuple(r) for r in store.ancestors(chain(spark, 1, "missing")).collect()] == [("0", "0", 0)]
    assert store.ancestors(chain(spark, 1).limit(0)).count() == 0


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        store.ancestors(chain(spark, 3, "2"))
