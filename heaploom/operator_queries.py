"""Operators over small heaps made from the star schema's rows, with independent SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heaploom.functions import formats
from heaploom.operators import edges as E
from heaploom.operators import grouping, leaks, locations, naming, realms, trees
from heaploom.operators.analyse import NESTING, analyse
from heaploom.plans import fixpoint
from heaploom.schema import EDGES, GC_ROOTS, NODES, UNREACHABLE_BASE
from heaploom.sources.relational import read
from heaploom.sources.relational import _schema as schema_of

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Numbers of a kind of node begin at its number times this.
KIND = 1_000_000_000


def query(sql: str):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def at(kind: int, key: str | Column) -> Column:
    return (F.lit(kind * KIND) + (F.col(key) if isinstance(key, str) else key)).cast("long")


def text(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def nodes_of(df: DataFrame, ord_: Column, kind: str | Column, name: str | Column, size: int | Column = 1, raw: Column | None = None) -> DataFrame:
    size = F.lit(size) if isinstance(size, int) else size
    raw = F.lit(None) if raw is None else raw
    made = df.select(F.lit(1).cast("long").alias("snapshot_id"), ord_.cast("long").alias("ord"), text(kind).alias("type"), text(name).alias("name"), size.cast("long").alias("self_size"), raw.cast("int").alias("raw_detachedness"))
    return made.withColumns({"id": F.col("ord") * 2 + 1, "edge_count": F.lit(0).cast("long"), "trace_node_id": F.lit(None).cast("long")}).to(schema_of(NODES))


def edges_of(df: DataFrame, src: Column, dst: Column, kind: str, name: str | Column, pos: int | Column = 0) -> DataFrame:
    pos = F.lit(pos) if isinstance(pos, int) else pos
    made = df.select(F.lit(1).cast("long").alias("snapshot_id"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(kind).alias("type"), text(name).cast("string").alias("name"), pos.cast("long").alias("pos"))
    indexed = F.col("type").isin("element", "hidden")
    return made.withColumns({"eid": F.xxhash64("src", "dst", "name", "pos"), "idx": F.when(indexed, F.col("pos"))}).to(schema_of(EDGES))


def joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def base(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The root and the GC roots."""
    one = spark.range(1)
    return joined([nodes_of(one, F.lit(0), "synthetic", "", 0), nodes_of(one, F.lit(1), "synthetic", GC_ROOTS, 0)]), edges_of(one, F.lit(0), F.lit(1), "element", F.lit(None))


def analysed(spark: SparkSession, nodes: list[DataFrame], edges: list[DataFrame], label: str, *parts: str) -> DataFrame:
    """Analysed whole in one task, or the named parts in rounds."""
    n, e = base(spark)
    return analyse(joined([n, *nodes]), joined([e, *edges]), label=label, parts=parts or None)


# -- functions, scripts and scopes: parts are closures, suppliers scripts -----------------


def functions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closures (kind 1) of shared functions (2) in the scripts (3) of suppliers, with their sources (4) and the places (5, 6) where functions end."""
    p = read(spark, sf_dir, "part").withColumn("s", F.col("p_partkey") % 101)
    s = read(spark, sf_dir, "supplier")
    source = F.concat("s_name", F.lit("\n"), F.col("s_suppkey").cast("string"), F.lit("\n\nend "), "s_name")
    nodes = [
        nodes_of(p, at(1, "p_partkey"), "closure", F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).otherwise("")),
        nodes_of(p, at(2, "p_partkey"), "code", F.concat(F.lit("system / SharedFunctionInfo / "), "p_name")),
        nodes_of(s, at(3, "s_suppkey"), "code", F.concat(F.lit("system / Script / https://shop/"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".js"))),
        nodes_of(s, at(4, "s_suppkey"), "string", source),
        nodes_of(p, at(5, "p_partkey"), "number", "int"),
        nodes_of(p, at(6, "p_partkey"), "string", F.col("p_size").cast("string")),
    ]
    edges = [
        edges_of(p, at(1, "p_partkey"), at(2, "p_partkey"), "internal", "shared"),
        edges_of(p, at(2, "p_partkey"), at(3, "s"), "internal", "script"),
        edges_of(s, at(3, "s_suppkey"), at(4, "s_suppkey"), "internal", "source"),
        edges_of(p, at(2, "p_partkey"), at(5, "p_partkey"), "internal", "end_position"),
        edges_of(p, at(5, "p_partkey"), at(6, "p_partkey"), "internal", "value"),
    ]
    n = joined(nodes)
    # edges to scripts that there are not lead nowhere in a file; here they go
    e = joined(edges).join(n.select(F.col("ord").alias("dst")), "dst", "left_semi")
    places = p.select(F.lit(1).cast("long").alias("snapshot_id"), F.col("p_partkey").alias("seq"), at(2, "p_partkey").alias("ord"), F.col("s").alias("script_id"), F.col("p_size").cast("long").alias("line"), (F.col("p_partkey") % 80).alias("col"))
    return n, e, places


@query(
    """SELECT kind * 1000000000 + p_partkey AS ord, CASE WHEN s_name IS NULL THEN 'script_id=' || CAST(p_partkey % 101 AS VARCHAR) || ':L' ELSE s_name || '.js:' END || CAST(p_size + 1 AS VARCHAR) || ':' || CAST(p_partkey % 80 + 1 AS VARCHAR) AS location
       FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 101, (SELECT unnest([1, 2]) AS kind)"""
)
def q33_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, places = functions(spark, sf_dir)
    return locations.node_locations(nodes, edges, places).select("ord", "location")


@query("SELECT DISTINCT CAST(p_partkey % 101 AS BIGINT) AS script_id, 'https://shop/' || CAST(s_nationkey AS VARCHAR) || '/' || s_name || '.js' AS script_name FROM part JOIN supplier ON s_suppkey = p_partkey % 101")
def q34_script_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.script_names(*functions(spark, sf_dir))


@query(
    """WITH s AS (SELECT p_partkey, p_size, left(s_name || chr(10) || CAST(s_suppkey AS VARCHAR) || chr(10) || chr(10) || 'end ' || s_name, p_size) AS head FROM part JOIN supplier ON s_suppkey = p_partkey % 101)
       SELECT kind * 1000000000 + p_partkey AS ord, CAST(length(head) - length(replace(head, chr(10), '')) AS BIGINT) AS line, CAST(length(string_split(head, chr(10))[-1]) AS BIGINT) AS col
       FROM s, (SELECT unnest([1, 2]) AS kind) WHERE length(head) = p_size"""
)
def q35_function_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = functions(spark, sf_dir)
    return locations.function_ends(nodes, edges)


@query(
    """SELECT 1000000000 + p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN '<anonymous>' ELSE p_name END || ' [JSFunction]' AS name, 2000000000 + p_partkey AS shared, 3000000000 + s_suppkey AS script
       FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 101"""
)
def q36_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = functions(spark, sf_dir)
    x = nodes.withColumns({"retained_size": F.col("self_size"), "bucket_ctx": F.lit(0)})
    shown = naming.display_names(nodes.where("type = 'closure'"), edges).select("ord", F.col("display_name").alias("_shown"))
    return realms.closures(x, edges).join(shown, "ord").select(F.col("ord").alias("id"), F.col("_shown").alias("name"), "shared", "script")


@query("SELECT kind * 1000000000 + p_partkey AS ord, left(s_name || chr(10) || CAST(s_suppkey AS VARCHAR), 3 + CAST(p_partkey % 5 AS INT)) AS text FROM part JOIN supplier ON s_suppkey = p_partkey % 101, (SELECT unnest([1, 2]) AS kind)")
def q37_function_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = functions(spark, sf_dir)
    p = read(spark, sf_dir, "part")
    short = nodes.withColumn("name", F.when(F.col("ord").between(6 * KIND, 7 * KIND - 1), (F.lit(3) + (F.col("ord") - 6 * KIND) % 5).cast("string")).otherwise(F.col("name")))
    start = joined([nodes_of(p, at(7, "p_partkey"), "number", "int"), nodes_of(spark.range(1), F.lit(8 * KIND), "string", "0")])
    begins = joined([edges_of(p, at(2, "p_partkey"), at(7, "p_partkey"), "internal", "start_position"), edges_of(p, at(7, "p_partkey"), F.lit(8 * KIND), "internal", "value")])
    return leaks.function_sources(short.unionByName(start), edges.unionByName(begins)).select("ord", "text")


@query(
    """SELECT 7000000000 + n_nationkey AS scope, CASE WHEN n_nationkey % 3 = 0 THEN 'f' || n_name WHEN n_nationkey % 3 = 1 THEN 'https://shop/' || r_name ELSE 'BLOCK_SCOPE' END AS scope_name FROM nation JOIN region ON r_regionkey = n_regionkey
       UNION ALL SELECT 8000000000 + r_regionkey, '-' FROM region"""
)
def q38_scope_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = scopes(spark, sf_dir)
    return locations.scope_names(nodes, edges)


@query("SELECT 7000000000 + n_nationkey AS scope, 3000000000 + n_regionkey AS script FROM nation UNION ALL SELECT 8000000000 + r_regionkey, 3000000000 + r_regionkey FROM region")
def q39_scope_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.scope_scripts(*scopes(spark, sf_dir))


def scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations' scopes (7) within regions' (8), which regions' functions (2) of regions' scripts (3) tell of; a third of the nations have functions of their own."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    own = n.where("n_nationkey % 3 = 0")
    nodes = [
        nodes_of(r, at(3, "r_regionkey"), "code", F.concat(F.lit("system / Script / https://shop/"), "r_name")), nodes_of(r, at(2, "r_regionkey"), "code", "system / SharedFunctionInfo"),
        nodes_of(r, at(8, "r_regionkey"), "code", "system / ScopeInfo"), nodes_of(n, at(7, "n_nationkey"), "code", "system / ScopeInfo"), nodes_of(own, at(2, F.col("n_nationkey") + 100), "code", F.concat(F.lit("system / SharedFunctionInfo / f"), "n_name")),
        nodes_of(n, at(9, "n_nationkey"), "string", F.when(F.col("n_nationkey") % 3 == 2, "BLOCK_SCOPE").otherwise("SCRIPT_SCOPE")),
    ]
    edges = [
        edges_of(r, at(2, "r_regionkey"), at(3, "r_regionkey"), "internal", "script"), edges_of(r, at(2, "r_regionkey"), at(8, "r_regionkey"), "internal", "raw_outer_scope_info_or_feedback_metadata"),
        edges_of(n, at(7, "n_nationkey"), at(8, "n_regionkey"), "internal", "outer_scope_info"), edges_of(own, at(2, F.col("n_nationkey") + 100), at(7, "n_nationkey"), "internal", "name_or_scope_info"),
        edges_of(n, at(7, "n_nationkey"), at(9, "n_nationkey"), "internal", "scope_type_name"),
    ]
    return joined(nodes), joined(edges)


@query(
    """WITH c AS (SELECT p_size AS ctx, min(p_partkey) AS p FROM part GROUP BY 1)
       SELECT 9000000000 + ctx AS ctx, CASE WHEN s_name IS NULL THEN 'script_id=' || CAST(p_partkey % 101 AS VARCHAR) || ':L' ELSE s_name || '.js:' END || CAST(p_size + 1 AS VARCHAR) || ':' || CAST(p_partkey % 80 + 1 AS VARCHAR) AS location
       FROM c JOIN part ON p_partkey = p LEFT JOIN supplier ON s_suppkey = p_partkey % 101"""
)
def q40_context_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, places = functions(spark, sf_dir)
    p = read(spark, sf_dir, "part")
    nodes = nodes.unionByName(nodes_of(p.select("p_size").distinct(), at(9, "p_size"), "object", "system / Context"))
    return locations.context_locations(nodes, edges.unionByName(edges_of(p, at(1, "p_partkey"), at(9, "p_size"), "internal", "context")), places)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS script, o_orderstatus || ' (' || CASE WHEN o_orderkey % 3 = 0 THEN '<unknown>' ELSE 'b' END || ':' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || ':' || CAST(o_orderkey % 40 + 1 AS VARCHAR) || ')' AS frame FROM orders")
def q41_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    script = F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    path = F.when(k % 3 == 0, "").otherwise(F.concat("o_orderpriority", F.lit("/a/b")))
    return read(spark, sf_dir, "orders").select(k.alias("id"), script.alias("script"), locations.format_frame(F.col("o_orderstatus"), path, k % 9, k % 40).alias("frame"))


# -- names ---------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_name, p_brand FROM part)
       SELECT id, CASE k WHEN 0 THEN '<' || split_part(p_brand, ' ', 1) || '>' WHEN 1 THEN '<a>' WHEN 2 THEN p_name WHEN 3 THEN 'system / Map' WHEN 4 THEN '(hidden)' ELSE '<b>x' END AS class_name FROM n"""
)
def q42_class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    kind = F.when(k.isin(0, 1, 5), "native").when(k == 2, "object").otherwise("hidden")
    name = F.when(k == 0, F.concat(F.lit("<"), F.substring_index("p_brand", " ", 1), F.lit(" id=7>"))).when(k == 1, "<a>").when(k == 2, F.col("p_name")).when(k == 3, "system / Map / x / y").when(k == 4, "").otherwise("<b>x")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), naming.class_name(kind, name).alias("class_name"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'smi ' WHEN 1 THEN 'double ' WHEN 2 THEN 'int ' ELSE 'bool' END || CASE WHEN o_orderkey % 4 < 3 THEN o_orderstatus || CAST(o_orderkey AS VARCHAR) ELSE '' END AS display_name FROM orders"""
)
def q43_number_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "smi number").when(k == 1, "heap number").when(k == 2, "int").otherwise("bool")
    nodes = joined([nodes_of(o, at(1, "o_orderkey"), "number", kind), nodes_of(o, at(2, "o_orderkey"), "string", F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))])
    edges = edges_of(o.where("o_orderkey % 4 < 3"), at(1, "o_orderkey"), at(2, "o_orderkey"), "internal", "value")
    return naming.display_names(nodes, edges).where("type = 'number'").select((F.col("ord") - KIND).alias("id"), "display_name")


@query(
    """WITH p AS (SELECT c_nationkey AS n, c_mktsegment AS s, min(c_custkey) AS k FROM customer GROUP BY 1, 2),
       shown AS (SELECT n, k, CASE s WHEN 'BUILDING' THEN '"BUILDING,"' WHEN 'MACHINERY' THEN '"MACHINERY''s"' ELSE s || ' x' END AS s FROM p)
       SELECT CAST(n AS BIGINT) AS id, '{' || string_agg(s, ', ' ORDER BY k) || '}' AS display_name FROM shown GROUP BY n"""
)
def q44_object_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("k"))
    n = c.select("c_nationkey").distinct()
    name = F.when(F.col("c_mktsegment") == "BUILDING", "BUILDING,").when(F.col("c_mktsegment") == "MACHINERY", "MACHINERY's").otherwise(F.concat("c_mktsegment", F.lit(" x")))
    held = edges_of(c, at(1, "c_nationkey"), F.lit(2), "property", name, F.col("k"))
    proto = edges_of(n, at(1, "c_nationkey"), F.lit(2), "property", "__proto__")
    return naming.object_labels(nodes_of(n, at(1, "c_nationkey"), "object", "Object"), held.unionByName(proto)).select((F.col("ord") - KIND).alias("id"), F.col("object_label").alias("display_name"))


@query(
    """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name || r_name || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS cons_text, n_nationkey % 2 = 1 AS flat FROM nation JOIN region ON r_regionkey = n_regionkey"""
)
def q45_cons_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    last = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("")
    nodes = joined([nodes_of(n, at(1, "n_nationkey"), "concatenated string", "(cons)"), nodes_of(n, at(2, "n_nationkey"), "concatenated string", "(cons)"), nodes_of(n, at(3, "n_nationkey"), "string", F.col("n_name")), nodes_of(r, at(4, "r_regionkey"), "string", F.col("r_name")), nodes_of(n, at(5, "n_nationkey"), "string", last)])
    legs = [(1, 2, "n_nationkey", "first"), (1, 5, "n_nationkey", "second"), (2, 3, "n_nationkey", "first"), (2, 4, "n_regionkey", "second")]
    edges = joined([edges_of(n, at(a, "n_nationkey"), at(b, k), "internal", name) for a, b, k, name in legs])
    flat = naming.flat_cons(nodes, edges).withColumn("flat", F.lit(True))
    return naming.cons_texts(nodes, edges).where(F.col("ord") < 2 * KIND).join(flat, "ord", "left").select((F.col("ord") - KIND).alias("id"), "cons_text", F.coalesce("flat", F.lit(False)).alias("flat"))


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 5 = 0 THEN '<symbol ' || c_name || '>' ELSE c_mktsegment END AS symbol, CASE c_custkey % 4 WHEN 0 THEN '"{' || c_name || '"' WHEN 1 THEN '"a' || chr(92) || '"' || c_name || '"' ELSE c_name || ' é' END AS quoted,
       contains(lower(c_name), lower('ER#0')) AS found, CASE c_custkey % 3 WHEN 0 THEN '[' || CAST(c_custkey AS VARCHAR) || ']' WHEN 1 THEN '??' ELSE c_name END AS edge FROM customer"""
)
def q46_property_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    symbol = F.when(k % 5 == 0, F.concat(F.lit("Symbol("), name, F.lit(")"))).otherwise(F.col("c_mktsegment"))
    quoted = F.when(k % 4 == 0, F.concat(F.lit("{"), name)).when(k % 4 == 1, F.concat(F.lit('a"'), name)).otherwise(F.concat(name, F.lit(" é")))
    edge = formats.edge_label(F.when(k % 3 == 0, "element").otherwise("property"), F.when(k % 3 == 2, name).otherwise(""), k)
    return read(spark, sf_dir, "customer").select(k.cast("long").alias("id"), formats.symbol_property(symbol).alias("symbol"), formats.quote_property(quoted).alias("quoted"), formats.contains_folded(name, "ER#0", ascii_only=True).alias("found"), edge.alias("edge"))


@query(
    f"""WITH n AS (SELECT o_orderkey AS id, CAST(o_orderkey % 2000 - 1000 AS BIGINT) AS d, CAST(o_orderkey % 7 AS BIGINT) AS q FROM orders)
       SELECT id, CASE WHEN d > 0 THEN '+' || format('{{:,}}', d) WHEN d < 0 THEN '{formats.MINUS}' || format('{{:,}}', -d) ELSE '0' END AS delta, CASE WHEN d > 0 THEN '+' || CAST(d AS VARCHAR) || ' B' WHEN d < 0 THEN '{formats.MINUS}' || CAST(-d AS VARCHAR) || ' B' ELSE '0 B' END AS size,
       CASE q WHEN 0 THEN 'N' WHEN 1 THEN 'U' WHEN 2 THEN 'U+' || CAST(id AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS distance, repeat('{formats.BAR}', CAST(q * 50 / 5 AS INT)) AS bar, format('{{:.1f}}%', q * 100.0::DOUBLE / 8) AS share FROM n"""
)
def q47_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, k = (F.col("o_orderkey") % 2000 - 1000).cast("long"), (F.col("o_orderkey") % 7).cast("long"), F.col("o_orderkey").cast("long")
    distance = F.when(q == 0, (1 << 32) - 1).when(q == 1, UNREACHABLE_BASE).when(q == 2, F.lit(UNREACHABLE_BASE) + k).otherwise(q)
    return read(spark, sf_dir, "orders").select(k.alias("id"), formats.signed_count(d).alias("delta"), formats.signed_size(d).alias("size"), formats.format_distance(distance).alias("distance"), formats.bar(q, F.lit(5)).alias("bar"), formats.format_percent(q, F.lit(8)).alias("share"))


# -- the analysis of a heap -----------------------------------------------------------------


def weak_map_heap(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nations as weak tables under the roots, customers as keys two steps from them, orders as values."""
    n, c, o = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    o = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    nodes = [nodes_of(n, at(1, "n_nationkey"), "object", "WeakMap", 10), nodes_of(spark.range(1), F.lit(2 * KIND), "object", "Holder", 5), nodes_of(c, at(3, "c_custkey"), "object", "Key", 7), nodes_of(o, at(4, "o_orderkey"), "object", "Value", F.length("o_orderpriority"))]
    pair = F.concat(F.lit("1 / part of key (Key @"), (at(3, "o_custkey") * 2 + 1).cast("string"), F.lit(") -> value (Value @"), (at(4, "o_orderkey") * 2 + 1).cast("string"), F.lit(") pair in WeakMap (table @"), (at(1, "c_nationkey") * 2 + 1).cast("string"), F.lit(")"))
    gc = F.lit(1)
    edges = [edges_of(n, gc, at(1, "n_nationkey"), "property", "table"), edges_of(spark.range(1), gc, F.lit(2 * KIND), "property", "holder"), edges_of(c, F.lit(2 * KIND), at(3, "c_custkey"), "property", "key"), edges_of(o, at(3, "o_custkey"), at(4, "o_orderkey"), "internal", pair), edges_of(o, at(1, "c_nationkey"), at(4, "o_orderkey"), "internal", pair)]
    return nodes, edges


@query("SELECT 4000000000 + o_orderkey AS ord, 1000000000 + c_nationkey AS idom, CAST(3 AS BIGINT) AS distance FROM orders JOIN customer ON o_custkey = c_custkey")
def q48_weak_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, *weak_map_heap(spark, sf_dir), "weak-maps", "distance", "dominators").where("name = 'Value'").select("ord", "idom", "distance")


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(10 + coalesce(sum(length(o_orderpriority)), 0) AS BIGINT) AS retained_size FROM nation LEFT JOIN (customer JOIN orders ON o_custkey = c_custkey) ON c_nationkey = n_nationkey GROUP BY 1")
def q49_weak_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, *weak_map_heap(spark, sf_dir), "weak-maps", "retained").where("name = 'WeakMap'").select((F.col("ord") - KIND).alias("nation"), "retained_size")


def page_heap(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Customers as elements of pages, attached, detached or unknown, with orders below; suppliers that nothing holds, with their nations' lists below."""
    c, o, s = (read(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    state = F.col("c_custkey") % 3
    nodes = [nodes_of(c, at(1, "c_custkey"), "native", F.concat(F.lit("<DIV id="), F.col("c_mktsegment"), F.lit(">")), 3, state), nodes_of(o, at(2, "o_orderkey"), "object", F.col("o_orderpriority"), F.length("o_orderstatus") + 1, F.lit(0)), nodes_of(s, at(3, "s_suppkey"), "object", "Lost", 11, F.lit(0)), nodes_of(s, at(4, "s_suppkey"), "array", "", 13, F.lit(0))]
    edges = [edges_of(c, F.lit(1), at(1, "c_custkey"), "property", "element"), edges_of(o, at(1, "o_custkey"), at(2, "o_orderkey"), "property", "order"), edges_of(s, at(3, "s_suppkey"), at(4, "s_suppkey"), "property", "list")]
    return nodes, edges


@query("SELECT 1000000000 + c_custkey AS ord, CAST(c_custkey % 3 AS INT) AS detachedness, true AS original FROM customer UNION ALL SELECT 2000000000 + o_orderkey, CAST(CASE WHEN o_custkey % 3 = 2 THEN 2 ELSE 0 END AS INT), o_custkey % 3 <> 2 FROM orders")
def q50_detachedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = analysed(spark, *page_heap(spark, sf_dir), "pages", "states").where(f"ord >= {KIND} and ord < {3 * KIND}")
    return x.select("ord", "detachedness", realms.is_original(F.col("raw_detachedness"), F.col("detachedness")).alias("original"))


_PAGE_GROUPS = """SELECT '<DIV>' AS name, c_custkey % 3 AS state, 3 AS size, 1 AS distance FROM customer UNION ALL SELECT o_orderpriority, CASE WHEN o_custkey % 3 = 2 THEN 2 ELSE 0 END, length(o_orderstatus) + 1, 2 FROM orders"""


@query(f"SELECT name, count(*) AS count, CAST(min(distance) AS BIGINT) AS distance, CAST(sum(size) AS BIGINT) AS self_size FROM ({_PAGE_GROUPS}) WHERE state = 2 GROUP BY 1")
def q51_summary_detached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.summary(analysed(spark, *page_heap(spark, sf_dir), "pages", "distance", "retained", NESTING, "states"), grouping.FILTERS["detached"]).select("name", "count", "distance", "self_size")


@query(f"SELECT name, count(*) AS count, CAST(sum(size) AS BIGINT) AS self_size FROM ({_PAGE_GROUPS}) WHERE state = 1 GROUP BY 1")
def q52_summary_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.summary(analysed(spark, *page_heap(spark, sf_dir), "pages", "distance", "retained", NESTING, "states"), grouping.FILTERS["attached"]).select("name", "count", "self_size")


@query(f"SELECT 'Lost' AS name, count(*) AS count, CAST({UNREACHABLE_BASE} AS BIGINT) AS distance, CAST(11 * count(*) AS BIGINT) AS self_size, CAST(24 * count(*) AS BIGINT) AS retained_size FROM supplier UNION ALL SELECT '(array)', count(*), {UNREACHABLE_BASE + 1}, 13 * count(*), 13 * count(*) FROM supplier")
def q53_summary_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.summary(analysed(spark, *page_heap(spark, sf_dir), "pages", "distance", "retained", NESTING), grouping.FILTERS["unreachable"]).select("name", "count", "distance", "self_size", "retained_size")


@query(
    """SELECT CAST(2 + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM supplier) AS BIGINT) AS node_count, CAST((SELECT 3 * count(*) FROM customer) + 5 AS BIGINT) AS native_total,
       CAST((SELECT sum(length(o_orderstatus) + 1) FROM orders) + (SELECT 24 * count(*) FROM supplier) AS BIGINT) AS v8_total, CAST(2 * (SELECT count(*) FROM supplier) AS BIGINT) AS unreachable_count, CAST(24 * (SELECT count(*) FROM supplier) AS BIGINT) AS unreachable_size"""
)
def q54_statistics_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = page_heap(spark, sf_dir)
    return grouping.statistics(analysed(spark, nodes, edges, "pages", "distance", "states"), joined(edges), 5).select("node_count", "native_total", "v8_total", "unreachable_count", "unreachable_size")


def context_heap(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Customers' contexts, of which nations' scopes tell, with orders as variables; parts that the roots hold; suppliers' contexts held by nothing."""
    c, o, p, s, n = (read(spark, sf_dir, t) for t in ("customer", "orders", "part", "supplier", "nation"))
    nodes = [nodes_of(c, at(1, "c_custkey"), "object", "system / Context", 20), nodes_of(o, at(2, "o_orderkey"), "object", "Order", F.length("o_orderpriority")), nodes_of(p, at(3, "p_partkey"), "object", "Part", 4), nodes_of(s, at(4, "s_suppkey"), "object", "system / Context / x", 6), nodes_of(n, at(5, "n_nationkey"), "code", "system / ScopeInfo", 1)]
    edges = [edges_of(c, F.lit(1), at(1, "c_custkey"), "property", "ctx"), edges_of(c, at(1, "c_custkey"), at(5, "c_nationkey"), "internal", "scope_info"), edges_of(o, at(1, "o_custkey"), at(2, "o_orderkey"), "context", F.substring("o_orderpriority", 1, 1), F.col("o_orderkey")), edges_of(c, at(1, "c_custkey"), F.lit(1), "context", "this"), edges_of(p, F.lit(1), at(3, "p_partkey"), "property", "part"), edges_of(n, F.lit(1), at(5, "n_nationkey"), "property", "scope")]
    return nodes, edges


@query(
    """SELECT 'Order' AS name, 'Retained' AS context_retention, count(*) AS count FROM orders HAVING count(*) > 0 UNION ALL SELECT 'system / Context', 'Retained', count(*) FROM customer
       UNION ALL SELECT 'Part', 'NotRetained', count(*) FROM part UNION ALL SELECT 'system / ScopeInfo', 'NotRetained', count(*) FROM nation UNION ALL SELECT 'system / Context / x', 'Unreachable', count(*) FROM supplier"""
)
def q55_context_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = analysed(spark, *context_heap(spark, sf_dir), "contexts", "states").where(f"ord >= {KIND}")
    return x.groupBy("name", "context_retention").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT) AS context_count, CAST((SELECT sum(length(o_orderpriority)) FROM orders) + (SELECT 20 * count(*) FROM customer) AS BIGINT) AS retained_by_contexts, CAST((SELECT 4 * count(*) FROM part) + (SELECT count(*) FROM nation) AS BIGINT) AS not_retained_by_contexts")
def q56_context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = context_heap(spark, sf_dir)
    return grouping.statistics(analysed(spark, nodes, edges, "contexts", "distance", "states"), joined(edges)).select("context_count", "retained_by_contexts", "not_retained_by_contexts")


@query("SELECT name, count(*) AS count, CAST(sum(size) AS BIGINT) AS self_size FROM (SELECT 'Order' AS name, length(o_orderpriority) AS size FROM orders UNION ALL SELECT 'system / Context', 20 FROM customer) GROUP BY 1")
def q57_summary_by_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.summary(analysed(spark, *context_heap(spark, sf_dir), "contexts", "distance", "retained", NESTING, "states"), grouping.FILTERS["retained-by-contexts"]).select("name", "count", "self_size")


@query("SELECT CAST(5000000000 + c_nationkey AS BIGINT) AS scope, count(DISTINCT c_custkey) AS count, CAST(20 * count(DISTINCT c_custkey) + coalesce(sum(length(o_orderpriority)), 0) AS BIGINT) AS retained_size FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT NULL, count(*), 6 * count(*) FROM supplier")
def q58_context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = context_heap(spark, sf_dir)
    return realms.context_groups(analysed(spark, nodes, edges, "contexts", "retained"), joined(edges), 7)


@query("SELECT 1000000000 + o_custkey AS ctx, string_agg(left(o_orderpriority, 1), ',' ORDER BY o_orderpriority) AS vars FROM orders GROUP BY 1")
def q59_variable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = context_heap(spark, sf_dir)
    return realms.variable_names(joined(nodes), joined(edges)).select("ctx", F.array_join("vars", ",").alias("vars"))


@query("SELECT 1000000000 + o_custkey AS ctx, left(o_orderpriority, 1) AS var, 2000000000 + max(o_orderkey) AS ord FROM orders GROUP BY 1, 2")
def q60_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = context_heap(spark, sf_dir)
    x = joined(nodes).withColumn("retained_size", F.col("self_size"))
    return realms.context_vars(x, joined(edges)).select("ctx", "var", "ord")


# -- realms ------------------------------------------------------------------------------------


def realm_heap(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nations as realms with global objects and proxies; customers and orders below; line items' suppliers share some."""
    n, c, o = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    url = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("chrome-extension://"), "n_name")).otherwise(F.concat(F.lit("https://"), "n_name"))
    window = F.when(F.col("n_nationkey") % 3 > 0, "Window [JSGlobalObject]").otherwise("Object [JSGlobalObject]")
    many = n.where("n_nationkey % 3 = 1").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    nodes = [nodes_of(n, at(1, "n_nationkey"), "object", F.concat(F.lit("system / NativeContext / "), url), 50), nodes_of(n, at(2, "n_nationkey"), "object", window, 5, F.lit(0)), nodes_of(n, at(3, "n_nationkey"), "object", "Proxy", 5), nodes_of(c, at(4, "c_custkey"), "object", "Customer", 2), nodes_of(o, at(5, "o_orderkey"), "object", "Order", 3), nodes_of(s, at(6, "s_suppkey"), "object", "Supplier", 7), nodes_of(spark.range(1), F.lit(7 * KIND), "object", "Free", 9)]
    edges = [
        edges_of(n, F.lit(1), at(1, "n_nationkey"), "property", "realm"), edges_of(n, at(1, "n_nationkey"), at(2, "n_nationkey"), "internal", "global_object"), edges_of(n, at(1, "n_nationkey"), at(3, "n_nationkey"), "internal", "global_proxy_object"),
        edges_of(many, at(3, "n_nationkey"), at(2, "n_nationkey"), "property", F.col("k").cast("string"), F.col("k")), edges_of(c, at(2, "c_nationkey"), at(4, "c_custkey"), "property", "c"), edges_of(o, at(4, "o_custkey"), at(5, "o_orderkey"), "property", "o"),
        edges_of(s, at(2, "s_nationkey"), at(6, "s_suppkey"), "property", "s"), edges_of(s, at(2, (F.col("s_nationkey") + 1) % 25), at(6, "s_suppkey"), "property", "s"), edges_of(spark.range(1), F.lit(1), F.lit(7 * KIND), "property", "free"),
    ]
    return nodes, edges


_REALMS = """WITH r AS (SELECT n_nationkey AS n, CASE n_nationkey % 3 WHEN 0 THEN 'utility' WHEN 1 THEN 'main' ELSE 'iframe' END AS kind, n_nationkey % 5 = 0 AS is_extension, CASE WHEN n_nationkey % 5 = 0 THEN 'chrome-extension://' ELSE 'https://' END || n_name AS url FROM nation),
  q AS (SELECT *, CAST(row_number() OVER (ORDER BY is_extension, CASE kind WHEN 'main' THEN 0 WHEN 'iframe' THEN 1 ELSE 2 END, n) - 1 AS INT) AS realm FROM r),
  own AS (SELECT c_nationkey AS n, 2 AS size FROM customer UNION ALL SELECT c_nationkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT n_nationkey, 60 FROM nation),
  sizes AS (SELECT realm, CAST(sum(size) AS BIGINT) AS size FROM own JOIN q USING (n) GROUP BY 1)"""


@query(f"{_REALMS} SELECT realm, kind, is_extension, url, size AS attributed_size, '[' || kind || '] #' || CAST(realm AS VARCHAR) || ' ' || url || ' @' || CAST((1000000000 + n) * 2 + 1 AS VARCHAR) AS label FROM q JOIN sizes USING (realm)")
def q61_realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = realm_heap(spark, sf_dir)
    return realms.realms(analysed(spark, nodes, edges, "realms", "retained", "states", "buckets"), joined(edges)).select("realm", "kind", "is_extension", "url", "attributed_size", "label")


@query(f"{_REALMS} SELECT 'Context' AS bucket_kind, realm AS bucket_ctx, size FROM sizes UNION ALL SELECT 'Shared', NULL, CAST(7 * count(*) AS BIGINT) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'Unattributed', NULL, 9")
def q62_realm_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realms.realm_sizes(analysed(spark, *realm_heap(spark, sf_dir), "realms", "buckets"))


@query(f"{_REALMS} SELECT 4000000000 + c_custkey AS ord, '#' || CAST(realm AS VARCHAR) AS bucket, '[' || kind || '] #' || CAST(realm AS VARCHAR) || ' ' || url || ' @' || CAST((1000000000 + n) * 2 + 1 AS VARCHAR) AS bucket_label FROM customer JOIN q ON n = c_nationkey UNION ALL SELECT 6000000000 + s_suppkey, 'S', 'Shared (multiple contexts)' FROM supplier WHERE s_suppkey % 2 = 0")
def q63_bucket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = realm_heap(spark, sf_dir)
    x = analysed(spark, nodes, edges, "realms", "retained", "states", "buckets")
    return locations.bucket_labels(x.where("name in ('Customer', 'Supplier')"), realms.realms(x, joined(edges)))


@query("SELECT 4000000000 + c_custkey AS ord, 1000000000 + c_nationkey AS realm_ord FROM customer UNION ALL SELECT 1000000000 + n_nationkey, 1000000000 + n_nationkey FROM nation")
def q64_owning_realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    nodes = nodes_of(n, at(1, "n_nationkey"), "object", "system / NativeContext").unionByName(nodes_of(c, at(4, "c_custkey"), "object", "system / Context"))
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    # contexts lead to their nation's first, which leads to the realm
    up = c.join(first, "c_nationkey")
    edges = edges_of(up, at(4, "c_custkey"), F.when(F.col("c_custkey") == F.col("first"), at(1, "c_nationkey")).otherwise(at(4, "first")), "internal", "previous")
    return realms.owning_realms(nodes, edges)


# -- strings, edges and trees ----------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS BIGINT) END AS length, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey * 3 AS BIGINT) END AS hash, o_orderkey % 5 = 0 AS truncated, o_orderkey % 7 = 0 AS two_byte FROM orders"""
)
def q65_string_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    nodes, edges = [nodes_of(o, at(1, "o_orderkey"), "string", F.col("o_orderpriority"))], [edges_of(o, at(1, "o_orderkey"), F.lit(1), "internal", "map")]
    facts = [("length", "int", F.col("o_custkey"), "o_orderkey % 3 > 0"), ("hash", "int", F.col("o_orderkey") * 3, "o_orderkey % 4 = 0"), ("truncated", "bool", F.lit("true"), "o_orderkey % 5 = 0"), ("two_byte_representation", "bool", F.when(F.col("o_orderkey") % 7 == 0, "true").otherwise("false"), "true")]
    for i, (name, kind, value, test) in enumerate(facts):
        some = o.where(test)
        nodes += [nodes_of(some, at(10 + i, "o_orderkey"), "number", kind), nodes_of(some, at(20 + i, "o_orderkey"), "string", value.cast("string"))]
        edges += [edges_of(some, at(1, "o_orderkey"), at(10 + i, "o_orderkey"), "internal", name), edges_of(some, at(10 + i, "o_orderkey"), at(20 + i, "o_orderkey"), "internal", "value")]
    return grouping.string_facts(joined(nodes), joined(edges)).where(F.col("ord").between(KIND, 2 * KIND)).select((F.col("ord") - KIND).alias("id"), "length", "hash", "truncated", "two_byte")


def _cut_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' priorities as strings; every fourth is cut off, so its length and hash count too."""
    k = F.col("o_orderkey").cast("long")
    return grouping.duplicate_groups(read(spark, sf_dir, "orders").select(k.alias("ord"), k.alias("id"), F.col("o_orderpriority").alias("value"), (k % 5 + 1).alias("self_size"), (k % 5 + 2).alias("retained_size"), (k % 9).alias("distance"), (k % 2).alias("length"), (k % 3).alias("hash"), (k % 4 == 0).alias("truncated"), F.lit(False).alias("two_byte")), 3)


_CUT = """WITH s AS (SELECT o_orderkey AS k, o_orderpriority AS value, o_orderkey % 4 = 0 AS cut FROM orders),
  g AS (SELECT value || CASE WHEN cut THEN ' [truncated]' ELSE '' END AS name, count(*) AS count, CAST(min(k % 9) AS BIGINT) AS distance, CAST(sum(k % 5 + 1) AS BIGINT) AS self_size, CAST(sum(k % 5 + 2) AS BIGINT) AS retained_size, CAST(sum(k % 5 + 1) - arg_min(k % 5 + 1, k) AS BIGINT) AS wasted
    FROM s GROUP BY value, cut, CASE WHEN cut THEN k % 2 END, CASE WHEN cut THEN k % 3 END HAVING count(*) >= 3)"""


@query(f"{_CUT} SELECT name, count, distance, self_size, retained_size FROM g")
def q66_duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.duplicate_summary(_cut_strings(spark, sf_dir))


@query(f"{_CUT} SELECT count(*) AS groups, CAST(sum(count) AS BIGINT) AS count, CAST(sum(self_size) AS BIGINT) AS total_size, CAST(sum(wasted) AS BIGINT) AS wasted FROM g")
def q67_duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.duplicate_totals(_cut_strings(spark, sf_dir))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, count(o_orderkey) AS n_retainers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q68_retainer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    found = E.retainer_counts(edges_of(o, at(2, "o_orderkey"), at(1, "o_custkey"), "property", "of"), nodes_of(c, at(1, "c_custkey"), "object", "Customer"))
    return found.select((F.col("ord") - KIND).alias("id"), "n_retainers")


@query(
    """SELECT 2000000000 + o_orderkey AS ord, 1000000000 + CAST(o_custkey AS BIGINT) AS child, o_orderpriority || '!' AS instance_type FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 6 > 0"""
)
def q69_instance_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    nodes = joined([nodes_of(c, at(1, "c_custkey"), "object", "Customer"), nodes_of(o, at(2, "o_orderkey"), "object", "Order"), nodes_of(o, at(3, "o_orderkey"), "object", "system / Map"), nodes_of(o, at(4, "o_orderkey"), "string", F.when(F.col("o_orderkey") % 6 > 0, F.concat("o_orderpriority", F.lit("!"))).otherwise(""))])
    edges = joined([edges_of(o, at(2, "o_orderkey"), at(1, "o_custkey"), "property", "customer", 5), edges_of(o, at(2, "o_orderkey"), at(3, "o_orderkey"), "internal", "map", 1), edges_of(o, at(3, "o_orderkey"), at(4, "o_orderkey"), "internal", "instance_type_name"), edges_of(o, at(2, "o_orderkey"), at(4, "o_orderkey"), "property", "map", 0)])
    return locations.child_by_name(nodes, edges, "Customer").join(locations.instance_types(nodes, edges), "ord")


@query("SELECT 'x' AS source, count(*) AS count, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'y', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey % 3 = 1")
def q70_stack_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    one = spark.range(1)
    nodes = joined([nodes_of(one, F.lit(2), "synthetic", "(Stack roots)"), nodes_of(one, F.lit(3), "synthetic", "C++ native stack roots"), nodes_of(one, F.lit(4), "synthetic", "(Handle scope)"), nodes_of(c, at(1, "c_custkey"), "object", "Customer")])
    edges = edges_of(c, F.lit(2) + F.col("c_custkey") % 3, at(1, "c_custkey"), "element", F.lit(None))
    held = realms.stack_roots(nodes, edges).groupBy("source").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("ord") - KIND).alias("keys"))
    return held.withColumn("source", F.when(F.col("source") == "(Stack roots)", "x").otherwise("y"))


@query("SELECT 2000000000 + min(o_orderkey) FILTER (o_orderkey % 2 = 0) AS ord FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 2 = 0) > 0 UNION ALL SELECT 1000000000 + o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 2 = 0) = 0")
def q71_event_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as callbacks without code, orders as their children, of which even ones have code."""
    o = read(spark, sf_dir, "orders")
    c = o.select("o_custkey").distinct()
    nodes = joined([nodes_of(c, at(3, "o_custkey"), "native", "V8EventListener"), nodes_of(c, at(1, "o_custkey"), "object", "Callback"), nodes_of(o, at(2, "o_orderkey"), "closure", "f")])
    edges = joined([edges_of(c, at(3, "o_custkey"), at(1, "o_custkey"), "internal", "callback_object_"), edges_of(o, at(1, "o_custkey"), at(2, "o_orderkey"), "property", "f", F.col("o_orderkey")), edges_of(o.where("o_orderkey % 2 = 0"), at(2, "o_orderkey"), F.lit(1), "internal", "code")])
    return realms.event_handlers(nodes, edges)


@query("SELECT CAST(1 + (o_orderkey % 3) AS INT) AS ranked, count(*) AS count, CAST(sum(CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS built FROM orders GROUP BY 1")
def q72_closure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closures: builtins, made from templates, or of extensions' scripts."""
    o = read(spark, sf_dir, "orders")
    k, one = F.col("o_orderkey") % 3, spark.range(1)
    nodes = joined([nodes_of(o, at(1, "o_orderkey"), "closure", "f"), nodes_of(o, at(2, "o_orderkey"), "code", "system / SharedFunctionInfo"), nodes_of(one, F.lit(2), "number", "int"), nodes_of(one, F.lit(3), "string", "77"), nodes_of(one, F.lit(4), "code", "system / FunctionTemplateInfo"), nodes_of(one, F.lit(5), "code", "system / Script"), nodes_of(one, F.lit(6), "string", "extension")])
    edges = joined([edges_of(o, at(1, "o_orderkey"), at(2, "o_orderkey"), "internal", "shared"), edges_of(o.where(k == 0), at(2, "o_orderkey"), F.lit(2), "internal", "builtin_id"), edges_of(o.where(k == 1), at(2, "o_orderkey"), F.lit(4), "internal", "untrusted_function_data"), edges_of(o.where(k == 2), at(2, "o_orderkey"), F.lit(5), "internal", "script"), edges_of(one, F.lit(2), F.lit(3), "internal", "value"), edges_of(one, F.lit(5), F.lit(6), "internal", "script_type_name")])
    x = nodes.withColumns({"retained_size": F.col("self_size"), "bucket_ctx": F.lit(None).cast("int")})
    ranked = F.when(F.col("builtin"), 1).when(F.col("template"), 2).when(F.col("extension"), 3)
    return realms.closures(x, edges).groupBy(ranked.alias("ranked")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.when(F.col("builtin") | F.col("template"), 1).otherwise(0)).alias("built"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey % 7 + 1 AS BIGINT) AS size, o_orderpriority AS name FROM orders)
       SELECT name, count(*) AS new FROM o WHERE id % 2 = 1 AND contains(lower(name), 'low') GROUP BY 1"""
)
def q73_diff_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class_name"), (F.col("o_orderkey") % 7 + 1).alias("self_size"))
    return grouping.class_diff(o, o.where("id % 2 = 0")).where(formats.contains_folded(F.col("name"), "LOW", ascii_only=True)).select("name", "new")


@query("SELECT count(*) AS count, CAST(sum(length(event_type)) AS BIGINT) AS size, (SELECT CAST(max(s) AS BIGINT) FROM (SELECT sum(length(event_type)) AS s FROM events WHERE event_id > 0 AND event_id <= (SELECT max(event_id) FROM events WHERE event_id % 500 = 499) GROUP BY (event_id - CASE WHEN event_id % 500 = 0 THEN 0 ELSE 0 END) // 500)) AS most FROM events WHERE event_id > 0 AND event_id <= (SELECT max(event_id) FROM events WHERE event_id % 500 = 499)")
def q74_timeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaploom.queries import _samples

    e = read(spark, sf_dir, "events").where("event_id > 0").select(F.col("event_id").alias("id"), F.length("event_type").cast("long").alias("self_size"))
    return grouping.timeline_totals(grouping.timeline(e, _samples(spark, sf_dir)))


@query(
    """SELECT * FROM (SELECT o_custkey AS parent, o_orderkey AS child, CAST(row_number() OVER w - 1 AS BIGINT) AS rank, CAST((row_number() OVER w - 1) // 4 * 4 AS BIGINT) AS page,
       CAST((row_number() OVER w - 1) // 4 * 4 + 1 AS VARCHAR) || '–' || CAST(least((row_number() OVER w - 1) // 4 * 4 + 4, count(*) OVER (PARTITION BY o_custkey)) AS VARCHAR) || ' of ' || CAST(count(*) OVER (PARTITION BY o_custkey) AS VARCHAR) AS status FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE rank < 100"""
)
def q75_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"))
    ranked = trees.page_by_parent(o, "parent", [F.col("child")], size=100)
    page = trees.page_start(F.col("rank"), 4)
    return ranked.select("parent", "child", "rank", page.alias("page"), trees.status(page, F.least(F.lit(4), F.col("total") - page), F.col("total")).alias("status"))


@query("SELECT CAST(step AS INT) AS step, CAST(rank AS BIGINT) AS rank FROM (SELECT 0 AS step, 0 AS rank UNION ALL SELECT 1, (SELECT count(*) FROM region WHERE r_regionkey < (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)) UNION ALL SELECT 2, (SELECT count(*) FROM nation WHERE n_nationkey < 7 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)))")
def q76_containment_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    nodes = [nodes_of(r, at(1, "r_regionkey"), "object", "Region"), nodes_of(n, at(2, "n_nationkey"), "object", "Nation")]
    edges = [edges_of(r, F.lit(1), at(1, "r_regionkey"), "property", "r", F.col("r_regionkey")), edges_of(n, at(1, "n_regionkey"), at(2, "n_nationkey"), "property", "n", F.col("n_nationkey"))]
    x = analysed(spark, nodes, edges, "reveal").withColumn("distance", F.when(F.col("ord") == 1, 0).otherwise(F.col("distance")))
    return trees.containment_reveal(x, joined(edges), 2 * KIND + 7).select("step", "rank")


@query("SELECT CAST(step AS BIGINT) AS step, CAST(rank AS BIGINT) AS rank FROM (SELECT 0 AS step, 0 AS rank UNION ALL SELECT 1, (SELECT rank FROM (SELECT n_nationkey AS n, row_number() OVER (ORDER BY (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) DESC, n_nationkey) - 1 AS rank FROM nation) WHERE n = 7))")
def q77_dominator_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    nodes = [nodes_of(n, at(1, "n_nationkey"), "object", "Nation", 0), nodes_of(c, at(2, "c_custkey"), "object", "Customer")]
    edges = [edges_of(n, F.lit(1), at(1, "n_nationkey"), "property", "n"), edges_of(c, at(1, "c_nationkey"), at(2, "c_custkey"), "property", "c")]
    return trees.dominator_reveal(analysed(spark, nodes, edges, "reveal"), KIND + 7).select("step", "rank")


@query("SELECT CAST(depth AS INT) AS depth, 1000000000 * depth + key AS ord, CAST(rank AS BIGINT) AS rank FROM (SELECT 1 AS depth, r_regionkey AS key, row_number() OVER (ORDER BY r_regionkey) - 1 AS rank FROM region UNION ALL SELECT 2, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region ORDER BY 1 LIMIT 4)) WHERE rank < 4")
def q78_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    nodes = joined([nodes_of(r, at(1, "r_regionkey"), "object", "Region"), nodes_of(n, at(2, "n_nationkey"), "object", "Nation")])
    edges = joined([edges_of(r, F.lit(1), at(1, "r_regionkey"), "property", "r", F.col("r_regionkey")), edges_of(n, at(1, "n_regionkey"), at(2, "n_nationkey"), "property", "n", F.col("n_nationkey"))])
    return trees.containment(nodes, edges, 1, 2, page=4).select("depth", "ord", "rank")


@query("SELECT CASE WHEN c_custkey % 4 = 1 THEN 2000000000 ELSE 2000000001 END AS src, count(*) AS count FROM customer WHERE c_custkey % 4 IN (1, 2) GROUP BY 1")
def q79_essential_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of weak, shortcut and strong edges from two holders, those that decide who keeps a customer."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    held = spark.range(2).withColumn("key", F.col("id"))
    nodes = [nodes_of(held, at(2, "key"), "object", "Holder", 0), nodes_of(c, at(1, "c_custkey"), "object", "Customer")]
    edges = [edges_of(held, F.lit(1), at(2, "key"), "property", "h"), edges_of(c.where(k == 1), F.lit(2 * KIND), at(1, "c_custkey"), "property", "p"), edges_of(c.where(k == 1), F.lit(2 * KIND + 1), at(1, "c_custkey"), "weak", "w"), edges_of(c.where(k == 2), F.lit(2 * KIND + 1), at(1, "c_custkey"), "property", "p"), edges_of(c.where(k == 2), F.lit(2 * KIND), at(1, "c_custkey"), "shortcut", "s"), edges_of(c.where(k.isin(0, 3)), F.lit(2 * KIND), at(1, "c_custkey"), "property", "p"), edges_of(c.where(k.isin(0, 3)), F.lit(2 * KIND + 1), at(1, "c_custkey"), "property", "p")]
    x = analysed(spark, nodes, edges, "essential").where("name = 'Customer' and idom > 1")
    return x.groupBy(F.col("idom").alias("src")).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT o_custkey AS id, count(*) AS count FROM orders WHERE o_orderkey % 5 > 1 GROUP BY 1")
def q80_map_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of descriptor arrays whose index is two or more and one more than a multiple of three lead nowhere."""
    o = read(spark, sf_dir, "orders")
    c = o.select("o_custkey").distinct()
    index = F.when(F.col("o_orderkey") % 5 > 1, F.col("o_orderkey") * 3).otherwise(F.col("o_orderkey") * 3 + 4)
    nodes = [nodes_of(c, at(1, "o_custkey"), "array", "(map descriptors)"), nodes_of(o, at(2, "o_orderkey"), "object", "Order")]
    edges = [edges_of(c, F.lit(1), at(1, "o_custkey"), "property", "d"), edges_of(o, at(1, "o_custkey"), at(2, "o_orderkey"), "element", F.lit(None), index)]
    x = analysed(spark, nodes, edges, "descriptors", "distance").where(f"name = 'Order' and distance < {UNREACHABLE_BASE}")
    return x.join(o.select(at(2, "o_orderkey").alias("ord"), F.col("o_custkey").alias("_c")), "ord").groupBy(F.col("_c").alias("id")).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT 3000000000 + c_custkey AS ord FROM customer UNION ALL SELECT 4000000000 + o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def q81_kept_by_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What event handlers alone keep: customers as callbacks, and those of their orders that nothing else holds."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    nodes = [nodes_of(c, at(2, "c_custkey"), "native", "V8EventListener"), nodes_of(c, at(3, "c_custkey"), "closure", "f"), nodes_of(o, at(4, "o_orderkey"), "object", "Order"), nodes_of(spark.range(1), F.lit(5 * KIND), "code", "code")]
    edges = [edges_of(c, F.lit(1), at(2, "c_custkey"), "property", "l"), edges_of(c, at(2, "c_custkey"), at(3, "c_custkey"), "internal", "callback_object_"), edges_of(c, at(3, "c_custkey"), F.lit(5 * KIND), "internal", "code"), edges_of(spark.range(1), F.lit(1), F.lit(5 * KIND), "property", "code"), edges_of(o.where("o_orderkey % 2 = 0"), F.lit(1), at(4, "o_orderkey"), "property", "held"), edges_of(o, at(3, "o_custkey"), at(4, "o_orderkey"), "property", "o")]
    n, e = base(spark)
    nodes_x, every = joined([n, *nodes]).withColumn("detachedness", F.lit(0)), joined([e, *edges])
    return realms.retained_only(nodes_x, realms.with_ends(nodes_x, every), F.col("to_handler"))


@query("SELECT r_name AS name, 1000000000 + r_regionkey AS root, CAST(3 + 2 * count(n_nationkey) AS BIGINT) AS size FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def q82_sizes_of_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    nodes = joined([nodes_of(r, at(1, "r_regionkey"), "object", F.col("r_name"), 3), nodes_of(n, at(2, "n_nationkey"), "object", "Nation", 2)])
    edges = edges_of(n, at(1, "n_regionkey"), at(2, "n_nationkey"), "property", "n").unionByName(edges_of(n, at(2, "n_nationkey"), at(1, "n_regionkey"), "weak", "back"))
    sizes = realms.reachable_sizes(nodes, edges, nodes.where(F.col("ord") < 2 * KIND).select("ord"))
    return sizes.join(nodes.select(F.col("ord").alias("root"), "name"), "root").select("name", "root", "size")


@query("SELECT 1000000000 + r_regionkey AS ord, CAST(1 AS BIGINT) AS distance FROM region UNION ALL SELECT 2000000000 + n_nationkey, 2 FROM nation UNION ALL SELECT 1, 0")
def q83_distances_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    edges = joined([edges_of(r, F.lit(1), at(1, "r_regionkey"), "property", "r"), edges_of(n, at(1, "n_regionkey"), at(2, "n_nationkey"), "property", "n"), edges_of(n, at(2, "n_nationkey"), at(1, "n_regionkey"), "property", "back")])
    return fixpoint.bfs(edges, spark.range(1).select(F.lit(1).cast("long").alias("ord")))
