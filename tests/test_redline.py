import pytest

from lexwright.functions import amendments, outline
from lexwright.operators import redline

BODY = """**(a)** **In general** The Secretary shall pay 85 percent. The rate is fixed.

> **(1)** first, see [section 5](/statutes/section/7/5);

> **(2)** second:

> > **(A)** alpha; and

> > **(B)** beta.

**(b)** **Other** The Secretary may act, and the Secretary may rest."""
HEAD = "(a) IN GENERAL.—Section 3{} of the Food Act of 2008 (7 U.S.C. 2012{}) is amended "


def amended(text, body=BODY):
    got = amendments.parse(text)
    assert got and (got["title"], got["section"]) == ("7", "2012") and not got["unread"], got
    out = outline.plain(body)[0]
    for e in got["edits"]:
        out, why = redline.apply_edit(out, e)
        assert why is None, (why, e)
    return out


def test_outline():
    text, spans, depths = outline.plain(BODY)
    assert [n.id for n in outline.outline(text, depths)] == [
        "subsection:a", "subsection:a/paragraph:1", "subsection:a/paragraph:2", "subsection:a/paragraph:2/subparagraph:A", "subsection:a/paragraph:2/subparagraph:B", "subsection:b",
    ]
    assert "**" not in text and "> " not in text and ("link", "/statutes/section/7/5") in {s[2:] for s in spans}
    assert outline.leading_labels("(a)(1) Text (b)") == ["a", "1"]
    assert outline.kind_of("i", "subparagraph", 0) == "clause" and outline.kind_of("i", None, 0) == "subsection" and outline.kind_of("V", "clause", 0) == "subclause"


@pytest.mark.parametrize(
    "where, clause, expect, absent",
    [
        ("(a)", "by striking “85” and inserting “beginning in 2025, 88”.", "shall pay beginning in 2025, 88 percent", "85"),
        ("(b)", "by striking “the Secretary” each place it appears and inserting “the Agency”.", "and the Agency may rest", "the Secretary may rest"),
        ("", "in subsection (a)(1), by striking “first” and inserting “1st”.", "(1) 1st, see", "first"),
        ("(a)", "in the second sentence, by striking “rate” and inserting “fee”.", "The fee is fixed", "The rate"),
        ("(a)(2)", "by striking the period at the end and inserting “; or”.", "(B) beta; or", "beta."),
        ("(a)", "by striking paragraph (2) and inserting the following:\n“(2) new second.”.", "(2) new second.", "alpha"),
        ("(a)", "by inserting “always ” before “pay”.", "shall always pay 85", "shall pay"),
        ("", "by adding at the end the following new subsection:\n“(c) LAST.—The end.”.", "may rest.\n(c) LAST.—The end.", "zzz"),
        ("(a)(2)", "by inserting after subparagraph (A) the following:\n“(AA) between;”.", "(A) alpha; and\n\n(AA) between;", "zzz"),
        ("(b)", "to read as follows:\n“(b) NEW.—All new.”.", "(b) NEW.—All new.", "may act"),
        ("", "by redesignating subsections (a) and (b) as subsections (b) and (c), respectively.", "(c) Other", "(a) In general"),
        ("(a)", "by striking “The rate” and all that follows through “fixed” and inserting “It floats”.", "percent. It floats.", "rate"),
        ("", "—\n(1) in subsection (a)—\n(A) by striking “85” and inserting “90”; and\n(B) in paragraph (2), by striking “alpha” and inserting “ALPHA”; and\n(2) in subsection (b), by striking “rest” and inserting “wait”.", "(A) ALPHA; and", "rest"),
    ],
)
def test_edits(where, clause, expect, absent):
    text = HEAD.format(where, where)
    text = text.rstrip() + clause if clause.startswith("—") else text + clause
    out = amended(text)
    if "\n\n(AA)" in expect:
        out, expect = out.replace("\n\n", "\n"), expect.replace("\n\n", "\n")
    assert expect in out and absent not in out


def test_failures_are_told():
    for clause, reason in (("striking “nowhere”.", "text_not_found"), ("striking paragraph (9).", "target_unresolved")):
        e = amendments.parse(HEAD.format("(a)", "(a)") + "by " + clause)["edits"][0]
        assert redline.apply_edit(outline.plain(BODY)[0], e)[1] == reason
    e = amendments.parse(HEAD.format("(z)", "(z)") + "by striking “x”.")["edits"][0]
    assert redline.apply_edit(BODY, e)[1] == "scope_unresolved"
    assert amendments.parse("Section 9 of an act is amended by striking “x”.") is None and amendments.parse("No edit.") is None


def test_spans():
    bill = ["SEC. 1. TITLE.", "Section 101 of title 10, United States Code, is amended—", "(1) by striking “A”; and", "(2) by striking “B”.", "Section 102 of title 10, United States Code, is amended by striking “C”.", "Other words.", HEAD.format("", "") + "to read as follows:", "“(a) One.", "“(b) Two.”.", "Tail."]
    assert amendments.spans(bill) == [(1, 3), (4, 4), (6, 8)]


def test_on_spark(spark):
    rows = [(1, 2, HEAD.format("(a)", "(a)") + "by striking “90” and inserting “95”."), (1, 1, HEAD.format("(a)", "(a)") + "by striking “85” and inserting “90”."), (1, 3, "Section 9 of title 3, United States Code, is amended by striking “x”."), (2, 1, None), (2, 2, "nothing")]
    ins = spark.createDataFrame(rows, "bill_id int, position int, text string")
    sec = spark.createDataFrame([("/section/7/2012", BODY)], "path string, body string")
    got = {r.section_path: r for r in redline.amend_sections(redline.parse_instructions(ins), sec).collect()}
    assert "pay 95 percent" in got["/section/7/2012"].after and got["/section/7/2012"].n_applied == 2
    assert got["/section/3/9"].after is None and got["/section/3/9"].issues[0].reason == "section_not_found"
