"""Variables that contexts keep and no living closure uses; context trees; scopes of scripts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.functions.jsscope import scopes as js_scopes
from heaploom.operators.edges import hop
from heaploom.operators.locations import number_of
from heaploom.operators.realms import closures, context_vars, contexts
from heaploom.operators.scopes import smallest_enclosing
from heaploom.plans.staging import stage

SCOPE_FIELDS = "scope int, parent int, kind string, name string, start int, end int, start16 int, end16 int, slots array<string>, captures array<struct<name:string,depth:int>>"


def positions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(shared, start, end, script): where shared functions lie in their scripts."""
    s = nodes.where("name = 'system / SharedFunctionInfo' or startswith(name, 'system / SharedFunctionInfo / ')").select(F.col("ord").alias("shared"))
    for name, out in (("start_position", "start"), ("end_position", "end")):
        s = number_of(nodes, edges, s, "shared", name, out)
    return hop(s, "shared", edges, "script", "script")


def script_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(script, source): texts of scripts, empty ones left out."""
    scripts = nodes.where("startswith(name, 'system / Script')").select(F.col("ord").alias("script"))
    at = hop(scripts, "script", edges, "source", "_s")
    return at.join(nodes.select(F.col("ord").alias("_s"), F.col("name").alias("source")), "_s").where("source != ''").select("script", "source")


def function_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, text) of closures and shared functions. Each script is read once, with all its functions' places."""
    places = positions(nodes, edges).where("start >= 0 and end >= start").groupBy("script").agg(F.collect_list(F.struct("shared", "start", "end")).alias("functions"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for source, functions in zip(f["source"], f["functions"]):
                text = source.encode("utf-16-le", "surrogatepass")
                for x in functions:
                    part = text[2 * x["start"] : 2 * x["end"]]
                    if 2 * x["end"] <= len(text):
                        try:
                            rows.append((x["shared"], part.decode("utf-16-le")))
                        except UnicodeDecodeError:  # a place between the halves of a character
                            continue
            yield pd.DataFrame(rows, columns=["ord", "text"])

    shared = stage(script_sources(nodes, edges).join(places, "script").select("source", "functions").mapInPandas(cut, "ord bigint, text string"), "sources")
    of_closures = hop(nodes.where("type = 'closure'").select("ord"), "ord", edges, "shared", "_s")
    return shared.unionByName(of_closures.join(shared.withColumnRenamed("ord", "_s"), "_s").select("ord", "text"))


def script_scopes(sources: DataFrame) -> DataFrame:
    """(script, readable, scope...) for every scope of every script; each script is read once."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in SCOPE_FIELDS.split(", ")]
        for f in frames:
            rows = []
            for script, source in zip(f["script"], f["source"]):
                found = js_scopes(source)
                rows.append({"script": script, "readable": found is not None})
                rows += [{"script": script, "readable": True, **{n: s[n] for n in names}} for s in found or ()]
            yield pd.DataFrame(rows, columns=["script", "readable", *names]).astype(object).where(lambda d: d.notna(), None)

    return sources.mapInPandas(read, f"script bigint, readable boolean, {SCOPE_FIELDS}")


def subtree_closures(nodes_x: DataFrame, edges: DataFrame) -> DataFrame:
    """(ctx, closure, depth): closures at or below each context, with the steps between."""
    held = closures(nodes_x, edges).where("context is not null").select(F.col("context").alias("ctx"), F.col("ord").alias("closure"))
    ordinary = contexts(nodes_x).select(F.col("ord").alias("ctx"))
    up = hop(ordinary, "ctx", edges, "previous", "_up").join(ordinary.select(F.col("ctx").alias("_up")), "_up", "left_semi").select(F.col("ctx").alias("_c"), "_up")
    level = stage(held.join(ordinary, "ctx", "left_semi").select("ctx", "closure", F.lit(0).alias("depth")), "subtree-0")
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        higher = level.join(up, level["ctx"] == up["_c"]).select(F.col("_up").alias("ctx"), "closure", F.lit(depth).alias("depth"))
        # contexts that lead to each other in a circle are met once
        level = stage(higher.join(out.select("ctx", "closure"), ["ctx", "closure"], "left_anti"), f"subtree-{depth}")
        out = out.unionByName(level)
    return out


def unused_vars(nodes_x: DataFrame, edges: DataFrame) -> DataFrame:
    """(ctx, var, reason): variables that no closure below uses, or with a null variable why that cannot be told."""
    below = stage(subtree_closures(nodes_x, edges), "leaks-below")
    ids = nodes_x.select(F.col("ord").alias("_o"), F.col("id").alias("_id"))
    sources = script_sources(nodes_x, edges)
    found = stage(script_scopes(sources), "leaks-scopes")
    readable = found.where("scope is null and readable").select(F.col("script").alias("_rs"), F.lit(True).alias("_ok"))
    c = closures(nodes_x, edges).select(F.col("ord").alias("closure"), F.col("id").alias("cid"), "shared")
    c = c.join(positions(nodes_x, edges).select("shared", "start", "script"), "shared", "left").join(readable, F.col("script") == F.col("_rs"), "left").join(ids.withColumnsRenamed({"_o": "_so", "_id": "sid"}), F.col("shared") == F.col("_so"), "left").join(ids.withColumnsRenamed({"_o": "_po", "_id": "pid"}), F.col("script") == F.col("_po"), "left")
    reason = (
        F.when(F.col("shared").isNull(), F.format_string("no code is known for closure @%d", "cid"))
        .when(F.col("script").isNull(), F.format_string("no script belongs to function @%d", "sid"))
        .when(F.col("_ok").isNull(), F.format_string("the text of script @%d is unknown or unreadable", "pid"))
        .when(F.col("start").isNull(), F.format_string("function @%d does not say where it begins", "sid"))
        .when(F.col("start") < 0, F.format_string("function @%d begins at %d, before its script", "sid", "start"))
    )
    c = stage(c.select("closure", "script", "start", reason.alias("reason")), "leaks-closures")
    broken = below.join(c.where("reason is not null"), "closure").groupBy("ctx").agg(F.min_by("reason", "closure").alias("reason"))
    spans = found.where("scope is not null").select("script", "scope", F.col("start16").alias("start"), F.col("end16").alias("end"), "captures")
    inside = smallest_enclosing(c.where("reason is null").select("closure", "script", F.col("start").alias("pos")), spans.select("script", "scope", "start", "end"), ["script"])
    used = inside.join(spans.select("script", "scope", F.explode("captures").alias("_u")), ["script", "scope"]).select("closure", F.col("_u.name").alias("var"), F.col("_u.depth").alias("depth"))
    accessed = below.join(used, ["closure", "depth"]).select("ctx", "var").distinct()
    variables = context_vars(nodes_x, edges).select("ctx", "var").distinct()
    idle = variables.join(broken, "ctx", "left_anti").join(accessed, ["ctx", "var"], "left_anti").withColumn("reason", F.lit(None).cast("string"))
    return idle.unionByName(broken.join(variables.select("ctx"), "ctx", "left_semi").select("ctx", F.lit(None).cast("string").alias("var"), "reason"))


def closure_leaks(nodes_x: DataFrame, edges: DataFrame, incomplete: bool = False) -> DataFrame:
    """Contexts with idle variables: ctx, id, retained_size, var, target_id, target_retained, reason."""
    first = closures(nodes_x, edges).where("context is not null").groupBy(F.col("context").alias("ctx")).agg(F.min_by(F.struct("builtin", "template", "extension"), "ord").alias("_f"))
    found = unused_vars(nodes_x, edges)
    if not incomplete:
        found = found.where("reason is null")
    targets = context_vars(nodes_x, edges, last=False).select("ctx", "var", F.col("id").alias("target_id"), F.col("retained_size").alias("target_retained"))
    own = nodes_x.select(F.col("ord").alias("ctx"), "id", "retained_size")
    out = found.join(first, "ctx", "left").where("_f is null or not (_f.builtin or _f.template or _f.extension)").join(targets, ["ctx", "var"], "left").join(own, "ctx")
    return out.select("ctx", "id", "retained_size", "var", "target_id", "target_retained", "reason").orderBy(F.desc("retained_size"), "ctx", "var")


def context_tree(nodes_x: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    """(depth, path, ctx, n_closures, unused): contexts under one, level by level."""
    from heaploom.operators.realms import NATIVE_CONTEXT, is_named

    kind = nodes_x.where(F.col("ord") == root).select(F.col("name")).first()[0]
    if not kind.startswith(("system / Context", "system / NativeContext")):
        raise ValueError(f"not a context: {kind!r}")
    every = nodes_x.where(is_named(F.col("name"), "system / Context") | is_named(F.col("name"), NATIVE_CONTEXT)).select("ord")
    up = stage(hop(every, "ord", edges, "previous", "_up").where("_up is not null and _up != ord"), "context-links")
    level = nodes_x.where(F.col("ord") == root).select(F.col("ord").alias("ctx"), F.lit(0).alias("depth"), F.array("ord").alias("path"))
    out = level = stage(level, "contexts-0")
    depth = 0
    while not level.isEmpty():
        depth += 1
        level = stage(level.join(up, level["ctx"] == up["_up"]).where(~F.array_contains("path", F.col("ord"))).select(F.col("ord").alias("ctx"), F.lit(depth).alias("depth"), F.concat("path", F.array("ord")).alias("path")), f"contexts-{depth}")
        out = out.unionByName(level)
    held = closures(nodes_x, edges).groupBy(F.col("context").alias("ctx")).agg(F.count(F.lit(1)).alias("n_closures"))
    idle = unused_vars(nodes_x, edges).where("var is not null").groupBy("ctx").agg(F.sort_array(F.collect_set("var")).alias("unused"))
    return out.join(held, "ctx", "left").join(idle, "ctx", "left").select("depth", "path", "ctx", F.coalesce("n_closures", F.lit(0)).alias("n_closures"), "unused").orderBy("path")


def scopes_of(nodes_x: DataFrame, edges: DataFrame, ord_: int) -> DataFrame:
    """Scopes of a script, or of a shared function's script, with the depth of their nesting."""
    script = positions(nodes_x, edges).where(F.col("shared") == ord_).select("script").unionByName(nodes_x.where(F.col("ord") == ord_).where("startswith(name, 'system / Script')").select(F.col("ord").alias("script")))
    source = script_sources(nodes_x, edges).join(script, "script", "left_semi")
    if source.isEmpty():
        raise ValueError(f"object {ord_} is no script or shared function with a source")
    found = stage(script_scopes(source).where("scope is not null"), "scopes")
    outer = found.select(F.col("scope").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    depth = found.join(outer, (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b")) & (F.col("_s") != F.col("scope")), "left").groupBy("scope").agg(F.count("_s").alias("depth"))
    return found.join(depth, "scope").orderBy("start", "scope")
