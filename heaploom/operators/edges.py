"""First named targets, values reached through them, and retainers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMED = "type not in ('element', 'hidden')"


def edge_targets(edges: DataFrame, *names: str, internal: bool = False) -> DataFrame:
    """(ord, one column per name): where the first edge of that name leads, in one pass over the edges."""
    wanted = edges.where(F.col("name").isin(*names)).where("type = 'internal'" if internal else NAMED)
    return wanted.groupBy(F.col("src").alias("ord")).agg(*[F.min_by(F.when(F.col("name") == n, F.col("dst")), F.when(F.col("name") == n, F.struct("pos", "eid"))).alias(n) for n in names])


def hop(df: DataFrame, column: str, edges: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with ``out``: the target of ``name`` from the node in ``column``, or null."""
    t = edge_targets(edges, name).select(F.col("ord").alias("_o"), F.col(name).alias(out))
    return df.join(t, df[column] == t["_o"], "left").drop("_o")


def number_values(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, int_value, bool_value, label): what number nodes hold through their ``value`` edge."""
    numbers = nodes.where("type = 'number'").select("ord", F.col("name").alias("_kind"))
    t = hop(numbers, "ord", edges, "value", "_v")
    v = nodes.select(F.col("ord").alias("_v"), F.col("name").alias("_text"))
    t = t.join(v, "_v", "left")
    whole = F.when(F.col("_kind") == "int", F.col("_text").try_cast("bigint"))
    truth = F.when((F.col("_kind") == "bool") & F.col("_text").isin("true", "false"), F.col("_text") == "true")
    return t.select("ord", whole.alias("int_value"), truth.alias("bool_value"), F.col("_text").alias("label"), "_kind")


def retainer_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("dst").alias("ord")).agg(F.count(F.lit(1)).alias("_n"))
    return nodes.select("ord").join(n, "ord", "left").select("ord", F.coalesce("_n", F.lit(0)).alias("n_retainers"))
