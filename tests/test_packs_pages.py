from pyspark.sql import functions as F

from lexwright.functions import anchors
from lexwright.operators import packs, pages


def test_pack_round_trip(spark):
    rows = [("s" + str(i % 3), i, f"body {i} " * (i % 50)) for i in range(300)] + [("s0", 300, "big " * 5000), ("s1", 301, None)]
    d = spark.createDataFrame(rows, "source_id string, position long, content string").withColumn("hash", packs.content_hash("content")).dropDuplicates(["source_id", "hash"])
    index = packs.write_packs(d, limit=2000, shard_rows=100).cache()
    back = packs.read_blobs(index, index.where("payload IS NOT NULL").select("packfile_key", "payload")).collect()
    assert {(r.source_id, r.content) for r in back} == {(s, t) for s, _, t in rows if t is not None}
    assert all(packs.hash_hex(r.content.encode()) == r.hash for r in back)
    sizes = [len(r.payload) for r in index.where("payload IS NOT NULL").collect()]
    assert len(sizes) > 5 and all(n <= 2000 for n in sizes)
    broken = index.withColumn("hash", F.lit("0" * 16))
    assert {r.content for r in packs.read_blobs(broken, index.where("payload IS NOT NULL").select("packfile_key", "payload")).collect()} == {None}
    assert packs.hash_hex(b"abc") == "44bc2cf5ad770999"


def test_anchors():
    assert anchors.find("a-b c", "ab", ignore_in_haystack="-") == (0, "a-b") and anchors.find("x", "") is None
    assert anchors.find("The ACT", "act", any_case=True) == (4, "ACT") and anchors.find("abc", "z") is None
    assert anchors.occurrences("aaaa", "aa") == [0, 2] and anchors.slash_fractions("2 1/2 and 7/9, 11/22/33") == "2 ½ and 7⁄9, 11/22/33"
    words = frozenset({"amendment", "well", "known"})
    assert anchors.drops_hyphen("the amend-", "ment of", words) and not anchors.drops_hyphen("a well-", "known", words)


def item(page, x, y, text, bold=False):
    return ("d", page, float(x), float(y), 5.0 * len(text), 10.0, bold, text)


def test_lines_and_paragraphs(spark):
    rows, y = [], 700
    texts = [("SEC. 2. OF THINGS.", 171, True), ("(a) The first rule of this section is that it shall be the", 191, False), ("first rule and shall go on over the whole of the next li-", 171, False), ("nes as well.", 171, False), ("(b) Next:", 191, False), ("(1) one;", 211, False), ("(2) two.", 211, False)]
    for k, (t, x, bold) in enumerate(texts):
        rows.append(item(1, 140, y + 1, str(k + 1)))
        a, _, b = t.partition(" ")
        rows += [item(1, x, y, a, bold), item(1, x + 5 * len(a) + 5, y, b, bold)]
        y -= 20
    d = spark.createDataFrame(rows, "doc_id string, page int, x double, y double, width double, height double, bold boolean, text string")
    lines = pages.extract_lines(d).orderBy("line").collect()
    assert [r.text for r in lines] == [t for t, _, _ in texts] and lines[0].bold and not lines[1].bold
    paras = pages.extract_paragraphs(pages.extract_lines(d), frozenset({"lines"})).orderBy("paragraph").collect()
    assert [r.text for r in paras] == ["SEC. 2. OF THINGS.", "(a) The first rule of this section is that it shall be the first rule and shall go on over the whole of the next lines as well.", "(b) Next:", "(1) one;", "(2) two."]
    assert [r.level for r in paras] == [1, 2, 2, 3, 3]
