"""Aggregates over analysed nodes: classes, statistics, duplicate strings, differences, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaploom.operators.edges import edge_targets, number_values
from heaploom.operators.naming import flat_cons
from heaploom.schema import UNREACHABLE_BASE

#: Ids of a range of a timeline, about, and numbers of a range of a preorder.
RANGE_ROWS = 1 << 20

#: What a summary can be filtered by.
FILTERS: dict[str, str] = {
    "all": "true",
    "attached": "detachedness = 1",
    "detached": "detachedness = 2",
    "retained-by-contexts": "context_retention = 'Retained'",
    "not-retained-by-contexts": "context_retention = 'NotRetained'",
    "shared": "bucket_kind = 'Shared'",
    "unattributed": "bucket_kind = 'Unattributed'",
    "unreachable": f"distance >= {UNREACHABLE_BASE}",
    "unreachable-roots": f"distance = {UNREACHABLE_BASE}",
}


def outermost(nodes_x: DataFrame, key: str = "class_key") -> DataFrame:
    """``nodes_x`` with ``outer``: no dominator of the node is in its group.

    Subtrees are intervals, so a node has such a dominator just when an earlier member's
    interval has not ended. The running maximum of ends is made in two levels: within ranges
    of numbers, and over the ranges' maxima, a row a range, so that no group fills a task.
    """
    rows = nodes_x.withColumn("_range", F.floor(F.col("tin") / RANGE_ROWS))
    by_range = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(key, "_range").agg(F.max("tout").alias("_most")).select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.max("_most").over(by_range).alias("_before")).where("_before is not null")
    w = Window.partitionBy(key, "_range").orderBy("tin").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("_here", F.max("tout").over(w)).join(before, rows[key].eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")), "left")
    return held.withColumn("outer", F.coalesce(F.greatest("_here", "_before") < F.col("tin"), F.lit(True))).drop("_range", "_here", "_key", "_at", "_before")


def summary(nodes_x: DataFrame, where: Column | str = "true", key: str = "class_key") -> DataFrame:
    """Groups: key, name, count, distance, self_size, retained_size, first_seen.

    The filter comes first, so nodes outside it or of no size hide nothing. Members that share an
    interval, as childless ones below the same node do where intervals only nest, are added up first.
    """
    alike = nodes_x.where(where).where("self_size > 0").groupBy(key, "tin", "tout").agg(F.first("group_name").alias("_shown"), F.count(F.lit(1)).alias("_n"), F.min("distance").alias("distance"), F.sum("self_size").alias("self_size"), F.sum("retained_size").alias("retained_size"), F.min("ord").alias("_first"))
    groups = outermost(alike, key).groupBy(key).agg(F.first("_shown").alias("name"), F.sum("_n").alias("count"), F.min("distance").alias("distance"), F.sum("self_size").alias("self_size"), F.sum(F.when(F.col("outer"), F.col("retained_size")).otherwise(0)).alias("retained_size"), F.min("_first").alias("_first"))
    return groups.withColumn("first_seen", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long")).drop("_first")


def members(nodes_x: DataFrame, name: str, offset: int = 0, limit: int = 20, where: Column | str = "true") -> DataFrame:
    """A page of a group's members by retained size; the page comes from a top-k, not a full sort."""
    inside = nodes_x.where(where).where("self_size > 0").where(F.col("group_name") == name)
    return inside.orderBy(F.desc("retained_size"), "ord").offset(offset).limit(limit)


def statistics(nodes_x: DataFrame, edges: DataFrame, extra_native: int = 0) -> DataFrame:
    """One row of totals. Each size is counted in the first branch that fits it."""
    only = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    arrays = nodes_x.where("name = 'Array' and type not in ('hidden', 'native', 'code', 'string', 'concatenated string', 'sliced string')").select("ord")
    elements = edge_targets(edges, "elements").join(arrays, "ord").join(only, F.col("elements") == only["dst"]).select(F.col("elements").alias("ord")).distinct().withColumn("_owned", F.lit(True))
    rows = nodes_x.join(elements, "ord", "left")
    part = lambda test: F.sum(F.when(F.expr(test), F.col("self_size")).otherwise(0))
    string = "type in ('string', 'concatenated string', 'sliced string')"
    plain = f"type not in ('hidden', 'native', 'code') and not {string}"
    out = rows.agg(
        F.count(F.lit(1)).alias("node_count"), (F.sum("self_size") + extra_native).alias("total"), (part("type = 'native'") + extra_native).alias("native_total"),
        part("type = 'native' and name = 'system / JSArrayBufferData'").alias("typed_arrays"), part("type = 'code'").alias("code"), part(string).alias("strings"),
        part("type = 'hidden'").alias("system"), (part(f"{plain} and name = 'Array'") + part("_owned")).alias("js_arrays"),
        F.count(F.when((F.col("distance") >= UNREACHABLE_BASE) & (F.col("self_size") > 0), 1)).alias("unreachable_count"), part(f"distance >= {UNREACHABLE_BASE}").alias("unreachable_size"),
        F.count(F.when(F.col("name").eqNullSafe("system / Context") | F.startswith("name", F.lit("system / Context / ")), 1)).alias("context_count"),
        part("context_retention = 'Retained'").alias("retained_by_contexts"), part("context_retention = 'NotRetained'").alias("not_retained_by_contexts"),
    )
    return out.withColumn("v8_total", F.col("total") - F.col("native_total"))


def string_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, length, hash, truncated, two_byte) of strings, through their named edges."""
    t = edge_targets(edges, "length", "hash", "truncated", "two_byte_representation")
    values = number_values(nodes, edges)
    for name, column in (("length", "int_value"), ("hash", "int_value"), ("truncated", "bool_value"), ("two_byte_representation", "bool_value")):
        v = values.select(F.col("ord").alias("_o"), F.col(column).alias(f"_{name}"))
        t = t.join(v, t[name] == v["_o"], "left").drop("_o")
    return t.select("ord", F.col("_length").alias("length"), F.col("_hash").alias("hash"), F.coalesce("_truncated", F.lit(False)).alias("truncated"), F.coalesce("_two_byte_representation", F.lit(False)).alias("two_byte"))


def duplicate_groups(strings: DataFrame, min_count: int = 2, with_ids: bool = False) -> DataFrame:
    """Groups of equal strings. ``strings``: ord, id, value, self_size, retained_size, distance,
    length, hash, truncated, two_byte. A cut-off value must agree in length and hash too."""
    cut = F.col("truncated")
    keyed = strings.where("self_size > 0 and value != '' and length is not null").withColumns({"_l": F.when(cut, F.col("length")), "_h": F.when(cut, F.col("hash"))})
    aggs = [
        F.count(F.lit(1)).alias("count"), F.min_by("self_size", "ord").alias("instance_size"), F.sum("self_size").alias("total_size"), F.sum("retained_size").alias("retained_size"),
        F.min("distance").alias("distance"), F.min_by("length", "ord").alias("length"), F.min_by("hash", "ord").alias("hash"), F.min_by("two_byte", "ord").alias("two_byte"),
    ]
    if with_ids:
        aggs.append(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = keyed.groupBy("value", "truncated", "_l", "_h").agg(*aggs).where(F.col("count") >= max(2, min_count)).drop("_l", "_h")
    return groups.withColumn("wasted", F.col("total_size") - F.col("instance_size")).orderBy(F.desc("wasted"), F.desc("count"), "value")


def duplicate_strings(nodes_x: DataFrame, edges: DataFrame, min_count: int = 2, with_ids: bool = False) -> DataFrame:
    return duplicate_groups(_strings(nodes_x, edges), min_count, with_ids)


def skipped_strings(nodes_x: DataFrame, edges: DataFrame) -> DataFrame:
    """How many strings, and bytes of them, tell no length and so cannot be compared."""
    s = _strings(nodes_x, edges).where("self_size > 0 and value != '' and length is null")
    return s.agg(F.count(F.lit(1)).alias("skipped_count"), F.coalesce(F.sum("self_size"), F.lit(0)).alias("skipped_size"))


def _strings(nodes_x: DataFrame, edges: DataFrame) -> DataFrame:
    shown = nodes_x.where("type in ('string', 'concatenated string')").join(flat_cons(nodes_x, edges), "ord", "left_anti")
    facts = string_facts(nodes_x, edges)
    return shown.join(facts, "ord", "left").select("ord", "id", F.col("display_name").alias("value"), "self_size", "retained_size", "distance", "length", "hash", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("two_byte", F.lit(False)).alias("two_byte"))


def class_diff(main: DataFrame, baseline: DataFrame) -> DataFrame:
    """New and deleted objects per class name, matched by id: name, new, deleted, delta, alloc, freed, size_delta.

    Both sides need id, class_name, self_size; objects of no size do not count.
    """
    new, gone = diff_objects(main, baseline)
    signed = new.withColumn("_s", F.lit(1)).unionByName(gone.withColumn("_s", F.lit(-1)))
    side = lambda s, what: F.sum(F.when(F.col("_s") == s, what).otherwise(0))
    out = signed.groupBy(F.col("class_name").alias("name")).agg(side(1, F.lit(1)).alias("new"), side(-1, F.lit(1)).alias("deleted"), side(1, F.col("self_size")).alias("alloc"), side(-1, F.col("self_size")).alias("freed"))
    return out.withColumns({"delta": F.col("new") - F.col("deleted"), "size_delta": F.col("alloc") - F.col("freed")}).orderBy(F.desc("alloc"), "name")


def diff_objects(main: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    a, b = (d.where("self_size > 0").select("id", "class_name", "self_size") for d in (main, baseline))
    return a.join(b.select("id"), "id", "left_anti"), b.join(a.select("id"), "id", "left_anti")


def edge_diff(main: DataFrame, main_edges: DataFrame, baseline: DataFrame, baseline_edges: DataFrame) -> DataFrame:
    """Edges that only one of two snapshots has: src_id, dst_id, type, name, idx, added, removed.

    An edge is known by the ids of its ends, its type and its label; of edges alike in these it
    counts how many more one side has. Labels and indices that are null equal each other. Both
    sides are added up before they are shuffled, so a hub is no task of its own.
    """

    def side(nodes: DataFrame, edges: DataFrame, added: int) -> DataFrame:
        ids = lambda end: nodes.select(F.col("ord").alias(end), F.col("id").alias(f"{end}_id"))
        return edges.join(ids("src"), "src").join(ids("dst"), "dst").select("src_id", "dst_id", "type", "name", "idx", F.lit(added).alias("_n"))

    both = side(main, main_edges, 1).unionByName(side(baseline, baseline_edges, -1))
    changed = both.groupBy("src_id", "dst_id", "type", "name", "idx").agg(F.sum("_n").alias("_n")).where("_n != 0")
    zero = F.lit(0).cast("long")
    return changed.select("src_id", "dst_id", "type", "name", "idx", F.greatest("_n", zero).alias("added"), F.greatest(-F.col("_n"), zero).alias("removed"))


def intervals(samples: DataFrame) -> DataFrame:
    """Samples as intervals of ids; ``low`` is where counting starts if ids ever step back.

    Samples are few, one per tick of a profiler; their order is one short list.
    """
    w = Window.orderBy("seq")
    before = F.lag("last_assigned_id", 1, 0).over(w)
    return samples.select("seq", "timestamp_us", before.alias("id_from"), F.col("last_assigned_id").alias("id_to")).withColumn("low", F.coalesce(F.max("id_to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def timeline(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """Objects and bytes alive per interval (from, to] of ids.

    Intervals that open do not overlap. Sample ends and objects are laid out in the order of
    ids, in ranges of ids of bounded number; within a range each object belongs to the first
    end at or behind it, and what is behind a range's last end goes to the first of a later one.
    """
    spans = intervals(samples).withColumn("_open", F.col("id_to") > F.col("low"))
    sized = nodes.where("self_size > 0").select("id", F.lit(1).cast("long").alias("_n"), F.col("self_size").alias("_s"))
    ends = spans.where("_open").select(F.col("id_to").alias("id"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_s"), F.col("seq").alias("_seq"))
    both = sized.withColumn("_seq", F.lit(None).cast(ends.schema["_seq"].dataType)).unionByName(ends)
    low, high, n = both.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, n // RANGE_ROWS) + 1)
    ranged = both.withColumn("_r", F.floor((F.col("id") - F.lit(low or 0)) / width))
    # from the back, as a frame that starts at the front is one running minimum
    here = Window.partitionBy("_r").orderBy(F.desc("id"), F.col("_seq").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = ranged.withColumn("_owner", F.min("_seq").over(here)).groupBy("_r", "_owner").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    # first end of each range, looked up from the ranges before it: one row a range
    first = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    later = ranged.groupBy("_r").agg(F.min("_seq").alias("_first")).select("_r", F.min("_first").over(first).alias("_later"))
    counted = owned.join(later, "_r").groupBy(F.coalesce("_owner", "_later").alias("seq")).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    return spans.join(counted, "seq", "left").select("seq", "timestamp_us", "id_from", "id_to", F.coalesce("_n", F.lit(0)).alias("count"), F.coalesce("_s", F.lit(0)).alias("size")).orderBy("seq")


def timeline_totals(rows: DataFrame) -> DataFrame:
    """Objects and bytes of all intervals, and the most that one holds."""
    return rows.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.max("size"), F.lit(0)).alias("most"))


def duplicate_summary(duplicates: DataFrame) -> DataFrame:
    """Groups of equal strings as groups of a summary: name with what is to be said of it, count, distance, self_size, retained_size."""
    tags = F.concat_ws(", ", F.when(F.col("truncated"), "truncated"), F.when(F.col("two_byte"), "2-byte"))
    return duplicates.select(F.when(tags != "", F.concat("value", F.lit(" ["), tags, F.lit("]"))).otherwise(F.col("value")).alias("name"), "count", "distance", F.col("total_size").alias("self_size"), "retained_size")


def duplicate_totals(duplicates: DataFrame) -> DataFrame:
    """How many groups and strings there are, and their bytes in all and beyond one of each."""
    zero = F.lit(0).cast("long")
    return duplicates.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("count"), zero).alias("count"), F.coalesce(F.sum("total_size"), zero).alias("total_size"), F.coalesce(F.sum("wasted"), zero).alias("wasted"))
