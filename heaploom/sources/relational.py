"""Tables as a graph: rows are nodes, and foreign keys lead from the referenced row to the referencing one.

A node's number is its table's number above 40 bits and its key below, so both sides of a
key know it without a join. Line items share an order number; within it they are told
apart by rank over all columns.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heaploom.plans.staging import stage
from heaploom.schema import EDGES, GC_ROOTS, NODES

KINDS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: Line items of an order that share a table number; further ones take the next table numbers, which no table has.
LINES = 1024


def node_id(kind: str, key: Column) -> Column:
    return (F.lit((KINDS.index(kind) + 1) << 40) + key.cast("long")).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS[1:]))
    ranked = read(spark, sf_dir, "lineitem").withColumn("_rank", rank)
    further = F.floor(F.col("_rank") / LINES) * F.lit(1 << 40)
    return ranked.withColumn("ord", (node_id("lineitem", F.col("l_orderkey") * LINES + F.col("_rank") % LINES) + further).cast("long")).drop("_rank")


def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nodes and edges need of the line items, written, so that these are ranked once for both."""
    return stage(lineitems(spark, sf_dir).select("ord", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber"), "lines")


def star_nodes(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Nodes of the star schema; a row's size is a small integer of its own. ``lines``: of ``ranked_lines``."""

    def rows(kind: str, key: str, size: Column, df: DataFrame | None = None) -> DataFrame:
        df = read(spark, sf_dir, kind) if df is None else df
        at = F.col("ord") if "ord" in df.columns else node_id(kind, F.col(key))
        return df.select(at.alias("ord"), F.lit("object").alias("type"), F.lit(kind).alias("name"), size.cast("long").alias("self_size"))

    made = [
        spark.range(1).select(F.lit(0).cast("long").alias("ord"), F.lit("synthetic").alias("type"), F.lit("").alias("name"), F.lit(0).cast("long").alias("self_size")),
        spark.range(1).select(F.lit(1).cast("long").alias("ord"), F.lit("synthetic").alias("type"), F.lit(GC_ROOTS).alias("name"), F.lit(0).cast("long").alias("self_size")),
        rows("region", "r_regionkey", F.length("r_name")),
        rows("nation", "n_nationkey", F.length("n_name")),
        rows("customer", "c_custkey", F.length("c_mktsegment")),
        rows("supplier", "s_suppkey", F.length("s_name")),
        rows("part", "p_partkey", F.col("p_size")),
        rows("orders", "o_orderkey", F.length("o_orderpriority")),
        rows("lineitem", "l_orderkey", F.col("l_linenumber"), lineitems(spark, sf_dir) if lines is None else lines),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    # ids as a runtime gives them: unique and odd
    return out.select(F.lit(1).cast("long").alias("snapshot_id"), "ord", "type", "name", (F.col("ord") * 2 + 1).alias("id"), "self_size", F.lit(0).cast("long").alias("edge_count"), F.lit(None).cast("int").alias("raw_detachedness"), F.lit(None).cast("long").alias("trace_node_id")).to(_schema(NODES))


def star_edges(spark: SparkSession, sf_dir: str, with_parts: bool = False, weak_supplier: bool = False, names: Collection[str] | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Foreign keys as property edges; optionally parts lead to line items, or suppliers hold them weakly.

    With ``names`` only the edges of these names are made, and no table is read for others. ``lines``: of ``ranked_lines``.
    """

    def link(df: DataFrame, src: Column, dst: Column, name: str, kind: str = "property") -> DataFrame:
        return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(kind).alias("type"), F.lit(name).alias("name"))

    gc = F.lit(1).cast("long")
    region, nation, customer, supplier, part, orders = (read(spark, sf_dir, k) for k in KINDS[:6])
    made = [
        spark.range(1).select(F.lit(0).cast("long").alias("src"), gc.alias("dst"), F.lit("element").alias("type"), F.lit(None).cast("string").alias("name")),
        link(region, gc, node_id("region", F.col("r_regionkey")), "region"),
        link(part, gc, node_id("part", F.col("p_partkey")), "part"),
        link(nation, node_id("region", F.col("n_regionkey")), node_id("nation", F.col("n_nationkey")), "nation"),
        link(customer, node_id("nation", F.col("c_nationkey")), node_id("customer", F.col("c_custkey")), "customer"),
        link(supplier, node_id("nation", F.col("s_nationkey")), node_id("supplier", F.col("s_suppkey")), "supplier"),
        link(orders, node_id("customer", F.col("o_custkey")), node_id("orders", F.col("o_orderkey")), "order"),
    ]
    # a line item's edges are made in one pass over the numbered items
    legs = [("orders", "l_orderkey", "line", "property"), ("supplier", "l_suppkey", "supplied", "weak" if weak_supplier else "property")] + [("part", "l_partkey", "of_part", "property")] * with_parts
    legs = [leg for leg in legs if names is None or leg[2] in names]
    if names is not None:
        made = made[:1] + [m for n, m in zip(("region", "part", "nation", "customer", "supplier", "order"), made[1:], strict=True) if n in names]
    if legs:
        lines = lineitems(spark, sf_dir) if lines is None else lines
        made.append(lines.select(F.inline(F.array(*[F.struct(node_id(kind, F.col(k)).alias("src"), F.col("ord").alias("dst"), F.lit(t).alias("type"), F.lit(n).alias("name")) for kind, k, n, t in legs]))))
    out = made[0] if names is None else made[0].where(F.lit(False))
    for m in made[1:]:
        out = out.unionByName(m)
    element = F.col("type") == "element"
    return out.select(F.lit(1).cast("long").alias("snapshot_id"), F.xxhash64("src", "dst", "name").alias("eid"), "src", "dst", "type", "name", F.when(element, F.lit(1).cast("long")).alias("idx"), F.lit(0).cast("long").alias("pos")).to(_schema(EDGES))


def _schema(ddl: str):  # noqa: ANN202
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
