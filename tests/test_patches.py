"""Patches: choice, moves, what is shown, and the searches."""

import random

from lexwright.functions import patches as P
from lexwright.operators import redline


def test_choice_and_move():
    assert P.choose([(0, 5, "a"), (3, 8, "b"), (5, 6, "c"), (5, 5, "d"), (5, 5, "e")]) == [(0, 5, "a"), (5, 6, "c"), (5, 5, "d"), (5, 5, "e")]
    assert P.move("abcdef", [(1, 3)], 5) == "adebcf" and P.move("abcdef", [(3, 5)], 1) == "adebcf" and P.move("abcdef", [(1, 3)], 2) is None
    assert P.move("abcdef", [(4, 5), (0, 1)], 3) == "bcaedf" and P.move("abc", [(0, 1)], 3) == "bca"


def test_shown_equals_plain_application():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 20)))
        shown, plain = P.Shown(text), text
        for _ in range(3):
            places = [(rng.randint(0, len(plain)), rng.randint(0, 4), rng.choice(["", "X", "YZ"])) for _ in range(3)]
            patches = sorted(P.choose([(a, min(len(plain), a + n), new) for a, n, new in places if n or new]))
            patches = [p for k, p in enumerate(patches) if p[0] < p[1] or p[2]]
            patches = [p for k, p in enumerate(patches) if not any(q[0] <= p[0] <= q[1] or p[0] <= q[0] <= p[1] for q in patches[:k])]
            shown.apply(patches)
            for a, b, new in reversed(patches):
                plain = plain[:a] + new + plain[b:]
            assert shown.text == plain
        assert "".join(t for k, t in shown.parts if k != "inserted") == text  # what was struck stays visible


def test_searches():
    assert P.mark_at_end("the end.” ", ".") == 7 and P.mark_at_end("the end;", ".") == -1 and P.mark_at_end("", ".") == -1
    assert P.find_loosely("under section 99(a) of it", "section 12 of it") == (6, 25) and P.find_loosely("a ReEntry b", "re-entry") == (2, 9)
    assert P.any_section("no reference") is None and P.find_loosely("x", "") is None
    codes = {"5": ("7", "2011")}.get
    assert P.translate("section 5(a), section 6 and section 5 of title 9", codes) == "section 2011(a) of title 7, section 6 and section 5 of title 9"
    assert P.inserted_ranges("ab ab c", ["ab", "ab", "ab", "b c", "c", ""]) == [(0, 2), (3, 5), None, None, (6, 7), None]


def test_edits():
    text = "(a) One.\n(1) first;\n(2) second;\n(3) third.\n(b) End."
    move = {"op": "move", "path": [("subsection", "a")], "nodes": [[("paragraph", "3")]], "side": "before", "node": [("paragraph", "1")]}
    assert redline.apply_edit(text, move) == ("(a) One.\n(3) third.\n(1) first;\n(2) second;\n(b) End.", None)
    assert redline.apply_edit(text, {**move, "node": [("paragraph", "3")]})[1] == "move_into_itself"
    pairs = redline.one_snapshot([{"op": "redesignate", "path": [("subsection", "a")], "pairs": [[("paragraph", "1"), ("paragraph", "2")]]}, {"op": "redesignate", "path": [("subsection", "a")], "pairs": [[("paragraph", "2"), ("paragraph", "3")]]}])
    shown = P.Shown(text)
    after, why = redline.apply_edit(text, pairs[0], shown)
    assert len(pairs) == 1 and why is None and "(2) first;\n(3) second;" in after and shown.text == after
    nested = {"op": "strike_nodes", "nodes": [[("subsection", "a")], [("subsection", "a"), ("paragraph", "2")]]}
    assert redline.apply_edit(text, nested) == ("(b) End.", None)  # the inner one is left to the outer


def test_late_verb(spark):
    lead = "so it was said " * 200
    d = spark.createDataFrame([("b", 1, f"Section 2 of title 5, United States Code, ({lead}) is amended by striking “x”.")], "bill_id string, position int, text string")
    assert redline.parse_instructions(d).count() == 1


def test_parsed_move():
    from lexwright.functions import amendments

    got = amendments.parse("Section 2(a) of title 5, United States Code, is amended by moving paragraph (3) to appear after paragraph (1).")
    assert [e["op"] for e in got["edits"]] == ["move"] and got["edits"][0]["side"] == "after"
