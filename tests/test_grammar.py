"""The grammar engine against plain recursion, and amendment sentences."""

import itertools

from lexwright.functions import grammar as G


def test_all_ends_equal_brute_force():
    rules = G.load("""
s = a { b | a } | "x" s ["y"]
a = "a" | "aa" | "ab"
b = "b" [a]
""")

    def brute(node, text, at):
        kind, v = node
        if kind == "word":
            return {at + len(v)} if text[at : at + len(v)] == v else set()
        if kind == "rule":
            return brute(rules[v], text, at)
        if kind == "alt":
            return set().union(*[brute(x, text, at) for x in v])
        if kind == "opt":
            return {at} | brute(v, text, at)
        if kind == "rep":
            out = {at}
            for e in brute(v, text, at):
                if e > at:
                    out |= brute(node, text, e)
            return out
        places = {at}
        for x in v:
            places = set().union(*[brute(x, text, p) for p in places]) if places else places
        return places

    for n in range(6):
        for letters in itertools.product("abxy", repeat=n):
            t = "".join(letters)
            want = sorted(brute(rules["s"], t, 0), reverse=True)
            p = G.Parser(rules, t)
            assert list(p.rule_ends("s", 0)) == want
            for e in want:
                tree = p.tree("s", 0, e)
                assert (tree.start, tree.end) == (0, e)
                for c in tree.children:
                    assert 0 <= c.start <= c.end <= e
    assert G.Parser(G.load('l = l "a" | "b"'), "baa").rule_ends("l", 0) == (1,)  # left recursion has no ends


def test_amendments():
    text = "Note. Section 5(a)(2) of title 7, United States Code, is amended by striking “x” each place it appears and inserting “y”, and by inserting “z” after “w”. More."
    t = G.longest(G.AMENDMENT, "instruction", text, G.starts_of(text))
    assert text[t.start : t.end].startswith("Section 5") and text[t.start : t.end].endswith("“w”.")
    assert [c.rule for e in t.all("edit") for c in e.children] == ["strike", "insert"]
    assert [text[x.start : x.end] for x in t.all("place")[0].all("id")] == ["(a)", "(2)"]
    moved = "Paragraph (2) of Section 9 is further amended by moving paragraph (3) to appear after paragraph (1)."
    assert [x.rule for x in G.longest(G.AMENDMENT, "instruction", moved, [0]).all("move")] == ["move"]
    assert G.longest(G.AMENDMENT, "instruction", "Nothing here.", [0]) is None
    for bad in ('a = b', 'a = ( "x"', 'a = "x" )'):
        try:
            G.load(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
