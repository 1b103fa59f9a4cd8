import pytest

from lexwright.operators import redline, vectors
from lexwright.sources import discovery

PAGE = '<a href="a/xml_usc10@119-73.zip">x</a><a href="a/xml_usc05A@119-73.zip">y</a><a href="a/xml_usc05@119-73.zip">z</a><a href="a/xml_usc05@119-73.zip">z</a>'


def test_units(spark):
    u = discovery.usc_units(spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string"))
    assert [r.title for r in u.collect()] == ["5", "5A", "10"] and discovery.one_release(u) == "119-73"
    with pytest.raises(ValueError):
        discovery.one_release(u.limit(0))
    laws = spark.createDataFrame([("a", 105, "2030-01-01T0"), ("b", 117, "2024-05-06T7"), ("c", 106, "2023-01-01T0")], "package_id string, congress int, last_modified string")
    assert [(r.package_id, r.version) for r in discovery.law_packages(laws).collect()] == [("c", "2024-05-06"), ("b", "2024-05-06")]
    v = discovery.mgl_version(spark.createDataFrame([("a", "Amended through May 1, 2024 &copy; 2020"), ("b", "Copyright 2023"), ("c", "")], "url string, html string"))
    assert {r.url: r.version for r in v.collect()} == {"a": "May 1, 2024", "b": "2023", "c": None}


def test_objects(spark):
    w = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    assert [r.url for r in discovery.missing_objects(w, spark.createDataFrame([("b",)], "url string")).collect()] == ["a"]
    o = spark.createDataFrame([("a", bytearray(b"<!DOCTYPE HTML><p>")), ("b", bytearray(b"PK\x03\xff"))], "path string, content binary")
    assert [r.path for r in discovery.archives_only(o).collect()] == ["b"]


def test_discover_and_known(spark):
    p = spark.createDataFrame([("b", 2, "Section 2 of title 5, United States Code, is amended by striking “x”."), ("b", 1, "Words."), ("b", 3, None)], "bill_id string, paragraph int, text string")
    assert [(r.position, r.first, r.last) for r in redline.discover_instructions(p).collect()] == [(0, 2, 2)]
    a = spark.createDataFrame([("1", "m")], "id string, text string")
    b = spark.createDataFrame([("1", "f"), ("2", "g")], "id string, text string")
    got = vectors.first_known(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), a, b).orderBy("id").collect()
    assert [r.text for r in got] == ["m", "g", None]
