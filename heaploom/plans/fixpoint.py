"""Fixpoints over graphs of any size: rounds of joins from written tables.

A round joins a frontier with the edges, adds up what arrives at each node, and keeps what
is new. Every round is written before the next one starts, so plans stay small and a lost
executor costs one round. Edges are written once, in buckets of their sources, so that no round
shuffles them: the frontier is brought to them, or broadcast where Spark finds it small.
What earlier rounds found is put into one table every FOLD rounds, and tables that no later
round reads are freed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heaploom.plans.staging import bucketed, free, stage

#: Rounds after which what has been found is put into one table.
FOLD = 8


class Found:
    """What the rounds have found so far, as one table and those of the latest rounds."""

    def __init__(self, first: DataFrame, label: str) -> None:
        self.tables, self.label, self.rounds = [first], label, 0

    @property
    def all(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def add(self, table: DataFrame) -> None:
        self.rounds += 1
        self.tables.append(table)
        if len(self.tables) > FOLD:
            # the latest stays a table of its own, as the next frontier
            whole = stage(self.all, f"{self.label}-found-{self.rounds}")
            free(*self.tables[:-1])
            self.tables = [whole]


def _edges(edges: DataFrame, follow: Column | None, label: str) -> DataFrame:
    kept = (edges.where(follow) if follow is not None else edges).select("src", "dst")
    return bucketed(kept, "src", f"{label}-edges")


def met(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that leave ``frontier`` (ord, ...), with its other columns.

    The frontier is looked up in a hash table per bucket, so edges are neither shuffled nor sorted.
    """
    return edges.join(frontier.withColumnRenamed("ord", "src").hint("shuffle_hash"), "src")


def bfs(edges: DataFrame, roots: DataFrame, follow: Column | None = None, label: str = "bfs", max_rounds: int | None = None) -> DataFrame:
    """(ord, distance): steps from the nearest of ``roots`` (ord, optionally distance) over followed edges."""
    e = _edges(edges, follow, label)
    start = roots if "distance" in roots.columns else roots.withColumn("distance", F.lit(0).cast("long"))
    frontier = stage(start.groupBy("ord").agg(F.min("distance").alias("distance")), f"{label}-0")
    found, rounds = Found(frontier, label), 0
    while not frontier.isEmpty() and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        arrived = met(frontier, e).groupBy(F.col("dst").alias("ord")).agg(F.min(F.col("distance") + 1).alias("distance"))
        frontier = stage(arrived.join(found.all.select("ord"), "ord", "left_anti"), f"{label}-{rounds}")
        found.add(frontier)
    free(e)
    return found.all


def reachable(edges: DataFrame, roots: DataFrame, follow: Column | None = None, label: str = "reach") -> DataFrame:
    """(ord): what the roots lead to, themselves included."""
    return bfs(edges, roots, follow, label).select("ord")


def reachable_words(edges: DataFrame, roots: DataFrame, follow: Column | None = None, label: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Which of ``roots`` (ord) lead to each node, 64 roots to a number: (root, word, bit) and (ord, word, bits).

    A node has rows of a word whose bits do not overlap, so there are as many rows as nodes
    times words times the rounds in which bits came, not as pairs of root and node.
    """
    e = _edges(edges, follow, label)
    n = F.col("_n")
    numbered = stage(roots.select("ord").distinct().orderBy("ord").withColumn("_n", F.monotonically_increasing_id()).select(F.col("ord").alias("root"), F.shiftright(n, 6).alias("word"), n.bitwiseAND(F.lit(63)).cast("int").alias("bit")), f"{label}-roots")
    frontier = stage(numbered.select(F.col("root").alias("ord"), "word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("bits")), f"{label}-0")
    found, rounds = Found(frontier, label), 0
    while not frontier.isEmpty():
        rounds += 1
        arrived = met(frontier, e).groupBy(F.col("dst").alias("ord"), "word").agg(F.bit_or("bits").alias("bits"))
        have = arrived.join(found.all.withColumnRenamed("bits", "_have"), ["ord", "word"], "left").groupBy("ord", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or(F.coalesce("_have", F.lit(0).cast("long"))).alias("_have"))
        frontier = stage(have.select("ord", "word", F.col("bits").bitwiseAND(F.bitwise_not("_have")).alias("bits")).where("bits != 0"), f"{label}-{rounds}")
        found.add(frontier)
    free(e)
    return numbered, found.all


def bits_of(bits: Column) -> Column:
    """The numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", bits, i).bitwiseAND(F.lit(1)) == 1)


def reachable_from_each(edges: DataFrame, roots: DataFrame, follow: Column | None = None, label: str = "batch") -> DataFrame:
    """(root, ord): for each of ``roots`` (ord) what it leads to, all in the same rounds."""
    numbered, words = reachable_words(edges, roots, follow, label)
    return words.select("ord", "word", F.explode(bits_of(F.col("bits"))).alias("bit")).join(numbered, ["word", "bit"]).select("root", "ord")


def attribute(edges: DataFrame, owners: DataFrame, label: str = "owners") -> DataFrame:
    """(ord, low, high): least and greatest owner whose label flows into each node.

    ``owners`` (ord, owner) are fixed: nothing flows into them. Where low = high there is one
    owner; otherwise the node is shared. Labels only widen, so the order of rounds is immaterial.
    """
    fixed = owners.select(F.col("ord").alias("dst"))
    e = bucketed(edges.where("type != 'shortcut' and src != dst").select("src", "dst").distinct().join(fixed, "dst", "left_anti"), "src", f"{label}-edges")
    frontier = stage(owners.select("ord", F.col("owner").alias("low"), F.col("owner").alias("high")), f"{label}-0")
    found, rounds = Found(frontier, label), 0
    while not frontier.isEmpty():
        rounds += 1
        arrived = met(frontier, e).groupBy(F.col("dst").alias("ord")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        have = found.all.withColumnsRenamed({"low": "_low", "high": "_high"})
        wide = arrived.join(have, "ord", "left").groupBy("ord").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        frontier = stage(wide.where("_low is null or low < _low or high > _high").select("ord", "low", "high"), f"{label}-{rounds}")
        found.add(frontier)
    free(e)
    return found.all.groupBy("ord").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def chase(links: DataFrame, label: str = "chase") -> DataFrame:
    """(ord, last): the end of each chain of ``links`` (ord, next), by pointer doubling; next is null at an end.

    A chain that runs in a circle has no end and yields no row: after as many rounds as a
    chain of 2**64 links would take, what has no end yet runs in circles.
    """
    at = stage(links.select("ord", F.col("next"), F.when(F.col("next").isNull(), F.col("ord")).alias("last")), f"{label}-0")
    rounds = 0
    while not at.where("last is null").isEmpty() and rounds < 64:
        rounds += 1
        ahead = at.select(F.col("ord").alias("_n"), F.col("next").alias("_next"), F.col("last").alias("_last"))
        moved = at.join(ahead, at["next"] == ahead["_n"], "left")
        at = stage(moved.select("ord", F.when(F.col("last").isNotNull(), F.col("next")).otherwise(F.col("_next")).alias("next"), F.coalesce("last", "_last", F.when(F.col("_n").isNull(), F.col("next"))).alias("last")), f"{label}-{rounds}")
    return at.where("last is not null").select("ord", "last")
