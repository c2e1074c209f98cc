"""Where functions, contexts and allocations lie in their scripts, and what scopes are called."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heaploom.functions.formats import utf16_line_cols
from heaploom.operators.edges import edge_targets, hop
from heaploom.operators.realms import NATIVE_CONTEXT, is_named
from heaploom.plans.fixpoint import chase

SHARED_FUNCTION, SCRIPT, SCOPE = "system / SharedFunctionInfo", "system / Script", "system / ScopeInfo"


def is_shared_function(kind: Column, name: Column) -> Column:
    return (kind == "code") & is_named(name, SHARED_FUNCTION)


def is_scope_info(name: Column) -> Column:
    return name == SCOPE


def script_title(name: Column) -> Column:
    """A script node's name without what the runtime puts before it."""
    return F.when(F.startswith(name, F.lit(f"{SCRIPT} / ")), F.substr(name, F.lit(len(SCRIPT) + 4))).otherwise(name)


def last_part(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def format_location(script_name: Column, script_id: Column, line: Column, col: Column) -> Column:
    """``file:line:column``, counted from one; ``script_id=S:Lline:column`` where the script is not known."""
    place = F.concat(F.lit(":"), (line + 1).cast("string"), F.lit(":"), (col + 1).cast("string"))
    unknown = F.concat(F.lit("script_id="), script_id.cast("string"), F.lit(":L"), (line + 1).cast("string"), F.lit(":"), (col + 1).cast("string"))
    return F.when(script_name.isNotNull(), F.concat(last_part(script_name), place)).otherwise(unknown)


def format_frame(function_name: Column, script_name: Column, line: Column, col: Column) -> Column:
    """``function (file:line:column)`` of an allocation's frame."""
    file = F.when(F.coalesce(script_name, F.lit("")) == "", "<unknown>").otherwise(last_part(script_name))
    return F.concat(function_name, F.lit(" ("), file, F.lit(":"), (line + 1).cast("string"), F.lit(":"), (col + 1).cast("string"), F.lit(")"))


def located(locations: DataFrame) -> DataFrame:
    """(ord, script_id, line, col): of several locations of a node the last."""
    return locations.groupBy("ord").agg(F.max_by(F.struct("script_id", "line", "col"), "seq").alias("_at")).select("ord", "_at.*")


def shared_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, shared): of closures what their first ``shared`` leads to, of shared functions themselves."""
    own = nodes.where(is_shared_function(F.col("type"), F.col("name"))).select("ord", F.col("ord").alias("shared"))
    return own.unionByName(hop(nodes.where("type = 'closure'").select("ord"), "ord", edges, "shared", "shared").where("shared is not null"))


def script_names(nodes: DataFrame, edges: DataFrame, locations: DataFrame) -> DataFrame:
    """(script_id, script_name), told by the located function of the lowest number whose script has a name."""
    functions = shared_of(nodes, edges).join(located(locations).select("ord", "script_id"), "ord")
    shared = nodes.where(is_shared_function(F.col("type"), F.col("name"))).select(F.col("ord").alias("shared"))
    scripts = hop(functions.join(shared, "shared", "left_semi"), "shared", edges, "script", "_s").where("_s is not null")
    named = scripts.join(nodes.where(F.startswith("name", F.lit(f"{SCRIPT} / "))).select(F.col("ord").alias("_s"), script_title(F.col("name")).alias("script_name")), "_s")
    return named.groupBy("script_id").agg(F.min_by("script_name", "ord").alias("script_name"))


def node_locations(nodes: DataFrame, edges: DataFrame, locations: DataFrame) -> DataFrame:
    """(ord, script_id, line, col, script_name, location): a node's own, or a closure's shared function's."""
    at = located(locations)
    through = shared_of(nodes, edges).where("ord != shared").join(at.withColumnRenamed("ord", "shared"), "shared").drop("shared")
    found = at.unionByName(through.join(at.select("ord"), "ord", "left_anti"))
    found = found.join(script_names(nodes, edges, locations), "script_id", "left")
    return found.select("ord", "script_id", "line", "col", "script_name", format_location(F.col("script_name"), F.col("script_id"), F.col("line"), F.col("col")).alias("location"))


def number_of(nodes: DataFrame, edges: DataFrame, rows: DataFrame, column: str, name: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the whole number that ``name`` leads to from the node in ``column``, whatever the node between is."""
    to = hop(rows, column, edges, name, "_t")
    values = edge_targets(edges, "value").select(F.col("ord").alias("_t"), F.col("value").alias("_v")).join(nodes.select(F.col("ord").alias("_v"), F.col("name").try_cast("bigint").alias(out)), "_v").drop("_v")
    return to.join(values, "_t", "left").drop("_t")


def function_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line, col): where functions end, counted from zero in UTF-16 units. Each script is read once, with all its functions' ends."""
    functions = shared_of(nodes, edges)
    ends = number_of(nodes, edges, functions, "shared", "end_position", "end").where("end >= 0")
    placed = hop(ends, "shared", edges, "script", "script").where("script is not null")
    wanted = placed.groupBy("script").agg(F.collect_set("end").alias("ends"))
    text = nodes.select(F.col("ord").alias("_s"), F.col("name").alias("source"))
    sources = hop(wanted, "script", edges, "source", "_s").join(text, "_s").select("script", "source", "ends")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for script, source, ends in zip(f["script"], f["source"], f["ends"]):
                sound, line, col = utf16_line_cols(source, ends)
                yield pd.DataFrame({"script": script, "end": np.asarray(ends)[sound], "line": line[sound], "col": col[sound]})

    return placed.join(sources.mapInPandas(read, "script bigint, end bigint, line bigint, col bigint"), ["script", "end"]).select("ord", "line", "col")


def child_by_name(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(ord, child): the target of the first edge that leads to a node of this name."""
    named = edges.join(nodes.where(F.col("name") == name).select(F.col("ord").alias("dst")), "dst")
    return named.groupBy(F.col("src").alias("ord")).agg(F.min_by("dst", F.struct("pos", "eid")).alias("child"))


def instance_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, instance_type): the type that an object's map names; empty names tell nothing."""
    first = lambda name: edge_targets(edges, name, internal=True)
    through = first("map").join(first("instance_type_name").select(F.col("ord").alias("map"), "instance_type_name"), "map")
    return through.join(nodes.where("name != ''").select(F.col("ord").alias("instance_type_name"), F.col("name").alias("instance_type")), "instance_type_name").select("ord", "instance_type")


def scope_scripts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, script): the script of the first shared function that names the scope, else that of the nearest outer scope that has one."""
    scopes = nodes.where(is_scope_info(F.col("name"))).select(F.col("ord").alias("scope"))
    functions = nodes.where(is_shared_function(F.col("type"), F.col("name"))).select(F.col("ord").alias("shared"))
    own = None
    for name in ("name_or_scope_info", "raw_outer_scope_info_or_feedback_metadata"):
        told = hop(hop(functions, "shared", edges, name, "scope"), "shared", edges, "script", "script").where("scope is not null and script is not null")
        own = told if own is None else own.unionByName(told)
    own = own.join(scopes, "scope", "left_semi").groupBy("scope").agg(F.min_by("script", "shared").alias("script"))
    outer = hop(scopes, "scope", edges, "outer_scope_info", "_outer").join(scopes.select(F.col("scope").alias("_outer")), "_outer", "left_semi")
    links = scopes.join(own, "scope", "left").join(outer, "scope", "left")
    ends = chase(links.select(F.col("scope").alias("ord"), F.when(F.col("script").isNull(), F.col("_outer")).alias("next")), "scope-scripts")
    return ends.join(own.select(F.col("scope").alias("last"), "script"), "last").select(F.col("ord").alias("scope"), "script")


def scope_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, scope_name): the function's name, else for script scopes the script's, else the kind of scope, else ``-``."""
    scopes = nodes.where(is_scope_info(F.col("name"))).select(F.col("ord").alias("scope"))
    functions = nodes.where(is_shared_function(F.col("type"), F.col("name"))).select(F.col("ord").alias("shared"), F.nullif(F.regexp_extract("name", rf"(?s)^{SHARED_FUNCTION} / (.+)$", 1), F.lit("")).alias("_f")).where("_f is not null")
    named = hop(functions, "shared", edges, "name_or_scope_info", "scope").where("scope is not null").groupBy("scope").agg(F.min_by("_f", "shared").alias("_f"))
    kinds = hop(scopes, "scope", edges, "scope_type_name", "_k").join(nodes.select(F.col("ord").alias("_k"), F.col("name").alias("_kind")), "_k").select("scope", "_kind")
    titles = scope_scripts(nodes, edges).join(nodes.select(F.col("ord").alias("script"), script_title(F.col("name")).alias("_title")), "script").select("scope", "_title")
    out = scopes.join(named, "scope", "left").join(kinds, "scope", "left").join(titles, "scope", "left")
    return out.select("scope", F.coalesce("_f", F.when(F.col("_kind") == "SCRIPT_SCOPE", F.col("_title")), "_kind", F.lit("-")).alias("scope_name"))


def context_locations(nodes: DataFrame, edges: DataFrame, locations: DataFrame) -> DataFrame:
    """(ctx, location): that of the first closure of a context that has one."""
    held = hop(nodes.where("type = 'closure'").select("ord"), "ord", edges, "context", "ctx").where("ctx is not null")
    return held.join(node_locations(nodes, edges, locations), "ord").groupBy("ctx").agg(F.min_by("location", "ord").alias("location"))


def bucket_labels(nodes_x: DataFrame, realms: DataFrame) -> DataFrame:
    """(ord, bucket, bucket_label): whose a node is, in short and at length."""
    named = nodes_x.select("ord", "bucket_kind", "bucket_ctx").join(F.broadcast(realms.select(F.col("realm").alias("bucket_ctx"), "label")), "bucket_ctx", "left")
    short = F.when(F.col("bucket_kind") == "Context", F.format_string("#%d", "bucket_ctx")).when(F.col("bucket_kind") == "Shared", "S").otherwise("")
    return named.select("ord", short.alias("bucket"), F.when(F.col("bucket_kind") == "Context", F.col("label")).when(F.col("bucket_kind") == "Shared", "Shared (multiple contexts)").otherwise("").alias("bucket_label"))


def is_extension_realm(name: Column) -> Column:
    return is_named(name, NATIVE_CONTEXT) & F.startswith(F.regexp_extract(name, rf"^{NATIVE_CONTEXT} / (.*)$", 1), F.lit("chrome-extension://"))
