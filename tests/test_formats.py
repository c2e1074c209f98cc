import pytest
from pyspark.sql import functions as F

from heaploom.functions import formats as f
from heaploom.operators import naming
from heaploom.operators.locations import format_frame, format_location
from heaploom.operators.trees import shifted
from heaploom.schema import weak_pair


def cells(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first())


def test_sizes_and_counts(spark):
    n = lambda x: F.lit(x).cast("long")
    assert cells(spark, *(f.format_size(n(x)) for x in (0, 1023, 1024, 1536, 1048575, 1572864))) == ("0 B", "1023 B", "1 kB", "2 kB", "1024 kB", "1.5 MB")
    assert cells(spark, f.format_count(n(1234567)), f.signed_count(n(5)), f.signed_count(n(-1234)), f.signed_count(n(0))) == ("1,234,567", "+5", "−1,234", "0")
    assert cells(spark, f.signed_size(n(-2048)), f.signed_size(n(0)), f.signed_size(n(7))) == ("−2 kB", "0 B", "+7 B")
    assert cells(spark, f.format_percent(n(1), n(3)), f.format_percent(n(1), n(0)), f.format_percent(n(1), n(2), 0)) == ("33.3%", "0.0%", "50%")


def test_distances_and_labels(spark):
    d = lambda x: f.format_distance(F.lit(x).cast("long"))
    assert cells(spark, d(3), d(2147483647), d(2147483649), d(4294967295)) == ("3", "U", "U+2", "N")
    edge = lambda k, n, i: f.edge_label(F.lit(k), F.lit(n), F.lit(i).cast("long"))
    assert cells(spark, edge("element", None, 4), edge("property", "x", None), edge("internal", "", None)) == ("[4]", "x", "??")
    place = (F.lit(7), F.lit(4), F.lit(9))
    assert cells(spark, format_location(F.lit("/app/src/utils.js"), *place), format_location(F.lit(None).cast("string"), *place)) == ("utils.js:5:10", "script_id=7:L5:10")
    frame = lambda script: format_frame(F.lit("run"), F.lit(script), F.lit(4), F.lit(9))
    assert cells(spark, frame("https://a/b/c.js"), frame("")) == ("run (c.js:5:10)", "run (<unknown>:5:10)")


def test_property_names(spark):
    names = ["plain", "two words", "é,", "it's", 'a"b\\c', "{x}", "Symbol(it)", "get x"]
    want = ["plain", "two words", '"é,"', '"it\'s"', '"a\\"b\\\\c"', '"{x}"', "Symbol(it)", "get x"]
    assert [naming.quoted(n) for n in names] == want
    assert list(cells(spark, *(f.quote_property(F.lit(n)) for n in names))) == want
    assert cells(spark, f.symbol_property(F.lit("Symbol(it)")), f.symbol_property(F.lit("get x"))) == ("<symbol it>", "get x")


def test_object_labels_stop_at_their_length():
    assert naming.object_label([]) == "{}" and naming.object_label(["a"]) == "{a}" and naming.object_label(["x" * 200, "b"]) == "{" + "x" * 200 + ", …}"
    assert naming.object_label(["a", "b", "c"]) == "{a, b, c}"
    # 48 + 48 letters and both braces make 98: two more letters fit in front, three do not
    long = ["p" * 48, "q" * 2, "q" * 48]
    assert naming.object_label(long) == "{" + ", ".join(long) + "}"
    assert naming.object_label([long[0], "q" * 3, long[2]]) == "{" + long[0] + ", …, " + long[2] + "}"


def test_weak_pairs():
    told = weak_pair("12 / part of key (A) b @5) -> value (Object @77) pair in WeakMap (table @9)")
    assert (told.key, told.value, told.table) == (("A) b", 5), ("Object", 77), 9) and told.text.startswith(" / part of key")
    for other in ("elements", "x / part of key (A @5) -> value (B @7) pair in WeakMap (table @9)", "1 / part of key (A @) -> value (B @7) pair in WeakMap (table @9)"):
        assert weak_pair(other) is None


def test_windows_move():
    # size 10 of 25: on, to the last partial page, not beyond, and back
    assert [shifted(0, 10, 25, 10), shifted(10, 10, 25, 10), shifted(20, 10, 25, 10), shifted(20, 10, 25, -30), shifted(5, 3, 25, 100)] == [10, 20, 20, 0, 24]


def test_edge_refs(spark):
    name = "12 / part of key (HTMLDivElement @5) -> value (Object @77) pair in WeakMap (table @9)"
    got = spark.range(1).select(F.inline(f.edge_refs(F.lit(name)))).collect()
    assert [tuple(r) for r in got] == [("key/HTMLDivElement", 5), ("value/Object", 77), ("table", 9)]
    assert spark.range(1).select(F.inline(f.edge_refs(F.lit("elements")))).collect() == []


def test_widths():
    assert (f.width("abc"), f.width("日本"), f.width("é"), f.width("日本", 3)) == (3, 4, 1, 3)
    assert (f.truncate("abcdef", 4), f.truncate("日本語", 5), f.truncate("ab", 4), f.pad("日", 4)) == ("abc…", "日本…", "ab", "日  ")


def test_utf16():
    text = "a😀b\nc"
    assert [f.utf16_to_utf8(text, i) for i in range(7)] == [0, 1, None, 5, 6, 7, 8]
    assert (f.utf16_line_col(text, 3), f.utf16_line_col(text, 5), f.utf16_line_col(text, 2)) == ((0, 3), (1, 0), None)
    assert f.utf16_to_utf8("", 0) == 0 and f.utf16_to_utf8("", 1) is None


def test_options():
    assert (f.parse_size("64K"), f.parse_size("1 MiB"), f.parse_size("7")) == (65536, 1 << 20, 7)
    assert (f.parse_object_id("@12"), f.parse_object_id("5"), f.parse_window("a:b:3:4")) == (12, 5, ("a:b", 3, 4))
    assert (f.parse_window("a"), f.parse_window("a:7"), f.parse_window("a:b"), f.parse_window("a:x:2")) == (("a", None, None), ("a", 7, None), ("a:b", None, None), ("a:x", 2, None))
    for bad in ("", "x", "1Q", "99999999999G"):
        with pytest.raises(ValueError):
            f.parse_size(bad)
    with pytest.raises(ValueError, match="@12345"):
        f.parse_object_id("x")
