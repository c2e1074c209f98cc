"""Class names and display names of nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heaploom.operators.edges import edge_targets, number_values
from heaploom.plans.fixpoint import Found
from heaploom.plans.staging import free, stage

LABEL_CHARS, CONS_BYTES = 100, 1024


def class_name(kind: Column, name: Column, interface: Column | None = None) -> Column:
    """The class that a node is counted under."""
    cut = F.when(F.startswith(name, F.lit("system / ")), F.regexp_extract(name, r"^(system / .*?)(?: / |$)", 1)).otherwise(name)
    tag = F.when(F.startswith(name, F.lit("<")) & F.contains(name, F.lit(" ")), F.concat(F.substring_index(name, " ", 1), F.lit(">"))).otherwise(name)
    own = F.coalesce(interface, tag) if interface is not None else tag
    return (
        F.when(kind.isin("hidden", "code"), F.when(name == "", F.concat(F.lit("("), kind, F.lit(")"))).otherwise(cut))
        .when(kind.isin("object", "native"), own)
        .when(kind == "closure", "Function")
        .when(kind == "regexp", "RegExp")
        .otherwise(F.concat(F.lit("("), kind, F.lit(")")))
    )


def category(kind: Column) -> Column:
    """Equal class names of different categories are different classes."""
    return F.when(kind.isin("hidden", "code"), "internal").when(kind.isin("object", "native"), "object").otherwise(kind)


_ESCAPES = {i: f"\\u{i:04x}" for i in range(32)} | str.maketrans({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"})


def quoted(name: str) -> str:
    return f'"{name.translate(_ESCAPES)}"' if any(c in ",'\"{}" for c in name) else name


def object_label(props: list[str]) -> str:
    """Property names of a plain object, from the front and the back in turn.

    One is always shown, and more while braces, names and what parts them, but for the
    next separator, keep within LABEL_CHARS.
    """
    names = [quoted(p) for p in props]
    front, back = names[:1], []
    spent = 2 + sum(map(len, front))
    left = names[1:]
    while left and spent + len(left[0 if len(front) == len(back) else -1]) <= LABEL_CHARS:
        side = front if len(front) == len(back) else back
        item = left.pop(0 if side is front else -1)
        spent += len(item) + (2 if side else 0)
        front, back = (front + [item], back) if side is front else (front, [item] + back)
    return "{" + ", ".join(front + (["…"] if left else []) + back) + "}"


def object_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, object_label) of plain objects. An object's property names meet in one row, as they do in the label."""

    @F.pandas_udf("string")
    def labelled(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: object_label([x["name"] for x in sorted(xs, key=lambda x: x["pos"])] if xs is not None else []))

    plain = nodes.where("type = 'object' and name = 'Object'").select("ord")
    props = edges.where("type = 'property' and name != '__proto__'").join(plain, F.col("src") == F.col("ord")).groupBy("ord").agg(F.collect_list(F.struct("pos", "name")).alias("_p"))
    return plain.join(props, "ord", "left").select("ord", labelled("_p").alias("object_label"))


def _pieces(text: Column, ends: Column) -> Column:
    return F.struct(text.alias("text"), ends.alias("ends"))


def _joined(*parts: Column) -> Column:
    """Pieces one behind another: their bytes, and where each ends in these."""
    before, ends = F.lit(0), []
    for p in parts:
        ends.append(_moved(p["ends"], before))
        before = before + F.octet_length(p["text"])
    return _pieces(F.concat(*[p["text"] for p in parts]), F.concat(*ends))


def _moved(ends: Column, by: Column) -> Column:
    return F.transform(ends, lambda e: e + by)


def _kept(pieces: Column) -> Column:
    """The pieces that are shown: those before which there are fewer bytes than are shown."""

    def cut(p: Column) -> Column:
        at = F.array_min(F.filter(p["ends"], lambda e: e >= CONS_BYTES))
        return F.when(F.octet_length(p["text"]) < CONS_BYTES, p).otherwise(_pieces(F.substring(p["text"], F.lit(1), at), F.filter(p["ends"], lambda e: e <= at)))

    # an array of one, so that what is told of ``pieces`` is worked out once
    return F.transform(F.array(pieces), cut)[0]


def cons_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, cons_text) of concatenated strings: their pieces from the left until CONS_BYTES are there.

    A rope is pieces, a rope, another rope, pieces. A round puts in what is known of the ropes
    within: one that is all pieces goes in whole, and one with a single rope within hands on its
    pieces and that rope, so a spine of n ropes takes about log2(n) rounds wherever it hangs.
    A rope that holds itself shows what comes before it stops growing, as any other.
    """
    none = _pieces(F.lit(b""), F.array().cast("array<int>"))
    cons = nodes.where("type = 'concatenated string'").select("ord")
    t = edge_targets(edges, "first", "second", internal=True).select("ord", "first", "second")
    halves = stage(cons.join(t, "ord", "left").select("ord", F.coalesce("first", "second").alias("x"), F.when(F.col("first").isNotNull(), F.col("second")).alias("y")), "cons-halves")
    if halves.isEmpty():
        return halves.select("ord", F.lit("").alias("cons_text"))
    inside = halves.select(F.col("x").alias("ord")).unionByName(halves.select(F.col("y").alias("ord"))).where("ord is not null").distinct()
    name = F.col("name").cast("binary")
    leaves = nodes.where("type != 'concatenated string'").join(inside, "ord", "left_semi").select("ord", _pieces(name, F.array(F.octet_length(name))).alias("pre"), F.lit(False).alias("rope"))
    found, open_, rounds = Found(stage(leaves, "cons-leaves"), "cons"), stage(halves.select("ord", none.alias("pre"), "x", "y", none.alias("post")), "cons-0"), 0
    # after as many rounds as a spine of 2**64 ropes would take, what is open holds itself and nothing else
    while rounds < 64 and not open_.isEmpty():
        rounds += 1
        known = found.all.select("ord", "pre", F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("y"), none.alias("post")).unionByName(open_)
        left = known.select(F.col("ord").alias("x"), F.col("pre").alias("_pre"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("post").alias("_post"))
        right = found.all.select(F.col("ord").alias("y"), F.col("pre").alias("_second"))
        met = open_.join(left, "x", "left").join(right, "y", "left").withColumn("_pre", F.coalesce("_pre", none))
        lone, whole, spine, second = F.col("y").isNull(), F.col("_x").isNull() & F.col("_y").isNull(), F.col("_x").isNotNull() & F.col("_y").isNull(), F.col("_second").isNotNull()
        step = met.select(
            "ord",
            F.when(whole & (lone | second), _joined(F.col("pre"), F.col("_pre"), F.coalesce("_second", none), F.col("post"))).when(whole | lone & spine, _joined(F.col("pre"), F.col("_pre"))).otherwise(F.col("pre")).alias("pre"),
            F.when(whole, F.when(lone | second, None).otherwise(F.col("y"))).when(lone & spine, F.col("_x")).otherwise(F.col("x")).cast("bigint").alias("x"),
            F.when(~whole & ~second, F.col("y")).cast("bigint").alias("y"),
            F.when(lone & spine, _joined(F.col("_post"), F.col("post"))).when(~whole & second, _joined(F.col("_second"), F.col("post"))).otherwise(F.col("post")).alias("post"),
        )
        step = stage(step.select("ord", _kept(F.col("pre")).alias("pre"), "x", "y", _kept(F.col("post")).alias("post")), f"cons-step-{rounds}")
        ended = F.col("x").isNull() & F.col("y").isNull() | (F.octet_length("pre.text") >= CONS_BYTES)
        found.add(stage(step.where(ended).select("ord", "pre", F.lit(True).alias("rope")), f"cons-{rounds}"))
        before, open_ = open_, stage(step.where(~ended), f"cons-open-{rounds}")
        free(before, step)
    out = found.all.where("rope").unionByName(open_.select("ord", "pre", F.lit(True).alias("rope")))
    return out.select("ord", F.col("pre.text").cast("string").alias("cons_text"))


def flat_cons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord) of concatenated strings of which one half is empty."""
    cons = nodes.where("type = 'concatenated string'").select("ord")
    e = edges.where("type = 'internal' and name in ('first', 'second')")
    empty = nodes.where("name = ''").select(F.col("ord").alias("dst"))
    return cons.join(e.join(empty, "dst", "left_semi"), cons["ord"] == e["src"], "left_semi")


def display_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``display_name``."""
    numbers = number_values(nodes, edges).select("ord", F.col("label").alias("_value"), "_kind")
    out = nodes.join(object_labels(nodes, edges), "ord", "left").join(cons_texts(nodes, edges), "ord", "left").join(numbers, "ord", "left")
    kind = F.when(F.col("name") == "smi number", "smi").when(F.col("name") == "heap number", "double").otherwise(F.col("name"))
    number = F.when(F.col("_value").isNull(), F.col("name")).otherwise(F.concat(kind, F.lit(" "), F.col("_value")))
    shown = (
        F.when(F.col("type") == "concatenated string", F.coalesce("cons_text", "name"))
        .when(F.col("object_label").isNotNull(), F.col("object_label"))
        .when(F.col("type") == "number", number)
        .when(F.col("type") == "closure", F.concat(F.when(F.col("name") == "", "<anonymous>").otherwise(F.col("name")), F.lit(" [JSFunction]")))
        .otherwise(F.col("name"))
    )
    return out.withColumn("display_name", shown).drop("object_label", "cons_text", "_value", "_kind")
