"""Realms, contexts and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaploom.functions.formats import has_tag
from heaploom.operators.edges import edge_targets, hop, number_values
from heaploom.plans.fixpoint import bits_of, chase, reachable, reachable_words

NATIVE_CONTEXT, CONTEXT = "system / NativeContext", "system / Context"


def is_named(name: Column, what: str) -> Column:
    return (name == what) | F.startswith(name, F.lit(what + " / "))


def realm_url(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^system / NativeContext / (.*)$", 1), F.lit(""))


def realms(nodes_x: DataFrame, edges: DataFrame) -> DataFrame:
    """(realm, ord, id, kind, is_extension, url, detachedness, self_size, retained_size, attributed_size, label)."""
    r = nodes_x.where(is_named(F.col("name"), NATIVE_CONTEXT))
    t = edge_targets(edges, "global_object", "global_proxy_object")
    state = nodes_x.select(F.col("ord").alias("_g"), F.col("name").alias("_gname"), F.nullif(F.col("detachedness"), F.lit(0)).alias("_gdet"))
    proxy = nodes_x.select(F.col("ord").alias("_p"), F.nullif(F.col("detachedness"), F.lit(0)).alias("_pdet"))
    degree = edges.groupBy(F.col("src").alias("_p")).agg(F.count(F.lit(1)).alias("_pedges"))
    r = r.join(t, "ord", "left").join(state, F.col("global_object") == F.col("_g"), "left").join(proxy.join(degree, "_p", "left"), F.col("global_proxy_object") == F.col("_p"), "left")
    frame = F.coalesce(F.startswith("_gname", F.lit("Window")), F.lit(False))
    kind = F.when(frame & (F.coalesce("_pedges", F.lit(0)) >= 10), "main").when(frame, "iframe").otherwise("utility")
    url = realm_url(F.col("name"))
    extension = F.coalesce(F.startswith(url, F.lit("chrome-extension://")), F.lit(False))
    r = r.withColumns({"kind": kind, "url": url, "is_extension": extension, "realm_detachedness": F.coalesce("_gdet", "_pdet", F.lit(0))})
    order = Window.orderBy("is_extension", F.when(F.col("kind") == "main", 0).when(F.col("kind") == "iframe", 1).otherwise(2), "ord")
    r = r.withColumn("realm", (F.row_number().over(order) - 1).cast("int"))
    sizes = nodes_x.where("bucket_kind = 'Context'").groupBy(F.col("bucket_ctx").alias("realm")).agg(F.sum("self_size").alias("attributed_size"))
    label = F.concat_ws(" ", F.format_string("[%s]", "kind"), F.format_string("#%d", "realm"), "url", F.format_string("@%d", "id"))
    return r.join(sizes, "realm", "left").select("realm", "ord", "id", "kind", "is_extension", "url", F.col("realm_detachedness").alias("detachedness"), "self_size", "retained_size", F.coalesce("attributed_size", F.lit(0)).alias("attributed_size"), label.alias("label"))


def realm_sizes(nodes_x: DataFrame) -> DataFrame:
    """Bytes per realm, shared and of no realm."""
    return nodes_x.groupBy("bucket_kind", "bucket_ctx").agg(F.sum("self_size").alias("size"))


def common_fields(nodes: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    """Edge names that every global object of a kind has."""
    globals_ = nodes.where(has_tag(F.col("name"), tag)).select(F.col("ord").alias("src"))
    n = globals_.count()
    named = edges.where("type not in ('element', 'hidden')").join(globals_, "src", "left_semi")
    return named.groupBy("name").agg(F.count_distinct("src").alias("_n")).where(F.col("_n") == n).select("name")


def unique_vars(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(ord, vars) of each realm: names on its global object or in its script contexts that are not ``known``."""
    r = nodes.where(is_named(F.col("name"), NATIVE_CONTEXT)).select("ord")
    own = hop(r, "ord", edges, "global_object", "_at").where("_at is not null")
    named = own.join(edges.where("type not in ('element', 'hidden')"), F.col("_at") == F.col("src")).select("ord", "name").join(known.select("name"), "name", "left_anti")
    tables = hop(r, "ord", edges, "script_context_table", "_t").where("_t is not null")
    scripts = tables.join(edges.where("type in ('element', 'hidden')"), F.col("_t") == F.col("src")).select("ord", F.col("dst").alias("_c"))
    declared = scripts.join(edges.where("type = 'context' and name != 'this'"), F.col("_c") == F.col("src")).select("ord", "name")
    return named.unionByName(declared).distinct().groupBy("ord").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("vars"))


#: Tags of global objects, whose fields are common to all objects of a kind or their own.
GLOBAL_TAGS = ("[JSGlobalObject]", "[JSGlobalProxy]")


def common_of(nodes: DataFrame, edges: DataFrame, ord_: int) -> DataFrame | None:
    """Fields that a global object shares with all others of its kind; None for other objects."""
    me = nodes.where(F.col("ord") == ord_)
    tag = next((t for t in GLOBAL_TAGS if not me.where(has_tag(F.col("name"), t)).isEmpty()), None)
    return common_fields(nodes, edges, tag) if tag else None


def is_original(raw: Column, state: Column) -> Column:
    """Whether a node's state of detachedness is the one that the file tells of it."""
    told = F.when(raw.isNull() | (raw < 0), 0).otherwise(raw.bitwiseAND(F.lit(3)))
    return F.when(told == 3, 0).otherwise(told) == state


def reached(nodes: DataFrame, edges: DataFrame, root: int = 0, label: str = "reached") -> DataFrame:
    """(ord): what the root reaches. Weak edges count here."""
    return reachable(edges, nodes.where(F.col("ord") == root).select("ord"), label=label)


def retained_only(nodes: DataFrame, edges: DataFrame, skip: Column, root: int = 0, label: str = "only", reached_: DataFrame | None = None) -> DataFrame:
    """(ord): what the root reaches (``reached_``, where that is known), but not without the edges that ``skip`` names."""
    every = reached_ if reached_ is not None else reached(nodes, edges, root, f"{label}-all")
    return every.join(reached(nodes, edges.where(~skip), root, f"{label}-cut"), "ord", "left_anti")


def with_ends(nodes_x: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with what the retained-only filters ask of their ends."""
    source = nodes_x.select(F.col("ord").alias("src"), (F.col("type") == "synthetic").alias("from_synthetic"))
    target = nodes_x.select(F.col("ord").alias("dst"), (F.col("detachedness") == 2).alias("to_detached"))
    handlers = event_handlers(nodes_x, edges).select(F.col("ord").alias("dst"), F.lit(True).alias("_h"))
    return edges.join(source, "src").join(target, "dst").join(handlers, "dst", "left").withColumns({"to_handler": F.coalesce("_h", F.lit(False)), "console": F.coalesce(F.col("from_synthetic") & F.col("name").endswith(" / DevTools console"), F.lit(False))}).drop("_h")


def event_handlers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord): functions that event listeners call: the callback if it has code, else its first child that has, else itself."""
    listeners = nodes.where("name = 'V8EventListener'").select("ord")
    called = hop(listeners, "ord", edges, "callback_object_", "_cb").where("_cb is not null").select("_cb").distinct()
    coded = edges.where("name = 'code' and type not in ('element', 'hidden')").select(F.col("src").alias("_c")).distinct()
    kids = edges.select(F.col("src").alias("_cb"), F.col("dst").alias("_c"), "pos", "eid").join(called, "_cb").join(coded, "_c").groupBy("_cb").agg(F.min_by("_c", F.struct("pos", "eid")).alias("_kid"))
    own = called.join(coded.select(F.col("_c").alias("_cb"), F.lit(True).alias("_own")), "_cb", "left").join(kids, "_cb", "left")
    return own.select(F.when(F.col("_own"), F.col("_cb")).otherwise(F.coalesce("_kid", "_cb")).alias("ord")).distinct()


def contexts(nodes_x: DataFrame) -> DataFrame:
    return nodes_x.where(is_named(F.col("name"), CONTEXT))


def owning_realms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, realm_ord) of contexts whose chain of ``previous`` ends in a realm."""
    either = nodes.where(is_named(F.col("name"), CONTEXT) | is_named(F.col("name"), NATIVE_CONTEXT)).select("ord", is_named(F.col("name"), NATIVE_CONTEXT).alias("_end"))
    links = hop(either, "ord", edges, "previous", "_up").select("ord", F.when(~F.col("_end"), F.col("_up")).alias("next"), "_end")
    ends = links.where("_end").select(F.col("ord").alias("last"))
    return chase(links.select("ord", "next"), "realm-chain").join(ends, "last").select("ord", F.col("last").alias("realm_ord"))


def variable_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ctx, vars): names of each context's variables in order, as often as there are edges of them."""
    e = edges.where("type = 'context' and name != 'this'").join(contexts(nodes).select(F.col("ord").alias("src")), "src", "left_semi")
    return e.groupBy(F.col("src").alias("ctx")).agg(F.sort_array(F.collect_list("name")).alias("vars"))


def context_vars(nodes_x: DataFrame, edges: DataFrame, last: bool = True) -> DataFrame:
    """(ctx, var, ord, id, retained_size): variables of contexts; of a repeated name the last or the first edge."""
    pick = F.max_by if last else F.min_by
    e = edges.where("type = 'context' and name != 'this'").groupBy(F.col("src").alias("ctx"), F.col("name").alias("var")).agg(pick("dst", F.struct("pos", "eid")).alias("ord"))
    return e.join(contexts(nodes_x).select(F.col("ord").alias("ctx")), "ctx", "left_semi").join(nodes_x.select("ord", "id", "retained_size"), "ord")


def context_groups(nodes_x: DataFrame, edges: DataFrame, min_retained: int = 8192) -> DataFrame:
    """Contexts by scope: scope, count, retained_size (nested contexts count in each), largest first, no scope last."""
    c = hop(contexts(nodes_x).select("ord", "retained_size"), "ord", edges, "scope_info", "scope")
    groups = c.groupBy("scope").agg(F.count(F.lit(1)).alias("count"), F.sum("retained_size").alias("retained_size"))
    return groups.where(F.col("retained_size") >= min_retained).orderBy(F.col("scope").isNull(), F.desc("retained_size"), "scope")


def closures(nodes_x: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, id, name, shared, script, context, retained_size, builtin, template, extension)."""
    f = nodes_x.where("type = 'closure'").select("ord", "id", "name", "retained_size", "bucket_ctx")
    for column, name in (("shared", "shared"), ("context", "context")):
        f = hop(f, "ord", edges, name, column)
    f = hop(f, "shared", edges, "script", "script")
    f = hop(hop(f, "shared", edges, "builtin_id", "_b"), "shared", edges, "untrusted_function_data", "_u")
    f = hop(f, "script", edges, "script_type_name", "_k")
    names = nodes_x.select("ord", "name")
    numbers = number_values(nodes_x, edges).select(F.col("ord").alias("_b"), F.col("int_value").alias("_builtin"))
    f = f.join(numbers, "_b", "left").join(names.select(F.col("ord").alias("_u"), F.col("name").alias("_uname")), "_u", "left").join(names.select(F.col("ord").alias("_k"), F.col("name").alias("_kname")), "_k", "left")
    return f.select("ord", "id", "name", "shared", "script", "context", "retained_size", "bucket_ctx", F.col("_builtin").isNotNull().alias("builtin"), F.coalesce(F.contains("_uname", F.lit("FunctionTemplateInfo")), F.lit(False)).alias("template"), F.coalesce(F.col("_kname") == "extension", F.lit(False)).alias("extension"))


def reachable_sizes(nodes: DataFrame, edges: DataFrame, roots: DataFrame, label: str = "sizes") -> DataFrame:
    """(root, size, realms): bytes that each root leads to over edges that hold, and the realms met.

    Roots are carried as bits, 64 to a row, and sizes are added up by bit at the end.
    """
    numbered, words = reachable_words(edges, roots, F.expr("type not in ('weak', 'shortcut')"), label)
    at = words.join(nodes.select("ord", "self_size", is_named(F.col("name"), NATIVE_CONTEXT).alias("_realm")), "ord")
    has = lambda i: F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1)) == 1
    sums = at.groupBy("word").agg(F.array(*[F.sum(F.when(has(i), F.col("self_size"))) for i in range(64)]).alias("_sums"))
    sizes = sums.select("word", F.posexplode("_sums").alias("bit", "size")).where("size is not null")
    seen = at.where("_realm").select("word", F.col("ord").alias("_r"), F.explode(bits_of(F.col("bits"))).alias("bit")).groupBy("word", "bit").agg(F.sort_array(F.collect_set("_r")).alias("realms"))
    none = F.array().cast("array<bigint>")
    return numbered.join(sizes, ["word", "bit"]).join(seen, ["word", "bit"], "left").select("root", "size", F.coalesce("realms", none).alias("realms"))


def stack_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, source): what the stack holds, once for every edge."""
    holders = nodes.where("name in ('(Stack roots)', 'C++ native stack roots')").select(F.col("ord").alias("src"), F.col("name").alias("source"))
    return edges.join(holders, "src").select(F.col("dst").alias("ord"), "source")


def allocation_stacks(trace_nodes: DataFrame, trace_functions: DataFrame) -> DataFrame:
    """(id, frame_no, function_name, script_name, line, col), innermost first; the root and unnamed frames are left out.

    All stacks are walked in the same rounds, one level at a time.
    """
    from heaploom.plans.staging import stage

    tree = trace_nodes.select(F.col("id").alias("_id"), "parent", "func_idx")
    at = stage(tree.where("parent != 0").select(F.col("_id").alias("id"), F.lit(0).alias("step"), "parent", "func_idx"), "stack-0")
    found, step = at, 0
    while True:
        step += 1
        up = at.join(tree.withColumnsRenamed({"parent": "_p", "func_idx": "_f"}), at["parent"] == F.col("_id")).where("_p != 0")
        at = stage(up.select("id", F.lit(step).alias("step"), F.col("_p").alias("parent"), F.col("_f").alias("func_idx")), f"stack-{step}")
        if at.isEmpty():
            break
        found = found.unionByName(at)
    named = found.join(trace_functions.where("function_name != ''"), found["func_idx"] == trace_functions["idx"])
    w = Window.partitionBy("id").orderBy("step")
    return named.select("id", (F.row_number().over(w) - 1).cast("int").alias("frame_no"), "function_name", "script_name", "line", "col")
