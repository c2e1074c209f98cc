"""Which variables inner functions take, from how many keeping scopes away."""

import pytest

from heaploom.functions.jsscope import scopes, tokenize


def taken(source, name):
    found = scopes(source)
    assert found is not None
    return [(c["name"], c["depth"]) for s in found if s["name"] == name for c in s["captures"]]


def slots(source, name):
    return next(s["slots"] for s in scopes(source) if s["name"] == name)


@pytest.mark.parametrize(
    ("source", "inner", "want"),
    [
        ("function f(){ let a = 1; function g(){ return a; } return g; }", "g", [("a", 0)]),
        ("function f(a){ let b; function g(){ let c; function h(){ return a + b + c; } } }", "h", [("c", 0), ("a", 1), ("b", 1)]),
        ("function f(){ var a; function g(){ function h(){ return a; } } }", "h", [("a", 0)]),
        ("function f(){ let {a, b: [c = d], ...e} = x; var d; function g(){ c; e; b; } }", "g", [("c", 0), ("e", 0)]),
        ("function f(){ try { x() } catch (err) { function g(){ return err; } } }", "g", [("err", 0)]),
        ("function f(){ for (let i of xs) { function g(){ return i; } } }", "g", [("i", 0)]),
        ("function f(){ let a; { let a; function g(){ a; } } }", "g", [("a", 0)]),
        ("function f(){ let a; function g(a){ return a; } }", "g", []),
        ("let top = 1; function g(){ return top; }", "g", [("top", 0)]),
        ("let top = 1; function f(){ let a; function g(){ return top + a + f; } }", "g", [("a", 0), ("f", 1), ("top", 1)]),
        ("let top = 1; top; function g(){ return other; }", "g", []),
        ("function f(){ let a; class C { m(){ return a + this.a; } } }", "m", [("a", 0)]),
        ("function f(){ let a, r = /a\\/[/]g/; let o = { a, k: 1, m(){ return a; } } }", "m", [("a", 0)]),
        ("function f(){ let a; function g(){ return `x${ a }y${ `z${a}` }`; } }", "g", [("a", 0)]),
        ("function f(){ let a, b = 4; function g(){ return o.a / b / 2; } }", "g", [("b", 0)]),
        ("function f(){\n let a = 1\n let b = 2\n function g(){ return b }\n}", "g", [("b", 0)]),
    ],
)
def test_captures(source, inner, want):
    assert taken(source, inner) == want


def test_arrows_and_defaults():
    found = scopes("function f(a, b = () => a){ return x => y => a + x; }")
    arrows = [s for s in found if s["kind"] == "arrow"]
    assert [[c["name"] for c in s["captures"]] for s in arrows] == [["a"], ["a"], ["x", "a"]]
    assert slots("function f(a){ return () => a; }", "f") == ["a"]


def test_block_depth():
    source = "function f(){ let a; { let b; function g(){ a; b; } } }"
    assert taken(source, "g") == [("b", 0), ("a", 1)]
    assert [s["kind"] for s in scopes(source)] == ["function", "block", "function"]


def test_spans_count_utf16():
    s = scopes("'😀'; function f(){ let a; return () => a }")[0]
    assert (s["start"], s["start16"]) == (5, 6)


@pytest.mark.parametrize("bad", ["function f( {", "let a = `x${", "} {", "'open", "a = [1, 2"])
def test_unreadable(bad):
    assert scopes(bad) is None


def test_division_and_regex():
    kinds = [t.kind for t in tokenize("a / b; return /x/g; (c) / 2; [/d/]")]
    assert kinds.count("regex") == 2


def test_ten_thousand_arrows_in_one_another():
    names = [f"a{i}" for i in range(10_000)]
    found = scopes("let top; f(" + " => ".join(names) + " => a0 + a9998 + top)")
    assert len(found) == 10_000
    assert found[0]["slots"] == ["a0"] and [(c["name"], c["depth"]) for c in found[-1]["captures"]] == [("a9998", 0), ("a0", 1), ("top", 2)]
    assert scopes("x = " + "[" * 20_000 + "]" * 20_000) == [] and scopes("(" * 20_000) is None
    deep = "".join(f"function g{i}(){{ let v{i}; " for i in range(3000)) + "return v0;" + "}" * 3000
    assert [s["slots"] for s in scopes(deep)][:2] == [["v0"], []]
