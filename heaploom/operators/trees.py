"""Pages of children and retainers, containment and dominator trees, paths to the roots."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaploom.functions.formats import contains_folded, edge_label
from heaploom.plans.staging import stage

PAGE, MAX_DEPTH, MAX_NODES = 10, 50, 5000
PINNED = ("scope_info", "global_object", "global_proxy_object", "script_context_table")


def children(nodes: DataFrame, edges: DataFrame, ord_: int, text: str = "", pinned: bool = False, common: DataFrame | None = None) -> DataFrame:
    """Out-edges of a node with their targets, in edge order; a realm's main edges first."""
    e = edges.where((F.col("src") == ord_) & (F.col("type") != "invisible")).withColumnsRenamed({"name": "edge_name", "type": "edge_type"})
    out = e.join(nodes, e["dst"] == nodes["ord"])
    out = _matching(out, text)
    order = [F.when(F.col("edge_name").isin(*PINNED), F.array_position(F.array(*map(F.lit, PINNED)), F.col("edge_name"))).otherwise(99)] if pinned else []
    if common is not None:
        out = out.join(common.select(F.col("name").alias("edge_name"), F.lit(1).alias("_common")), "edge_name", "left")
        order.append(F.coalesce("_common", F.lit(0)))
    return out.orderBy(*order, "pos", "eid")


def retainers(nodes: DataFrame, edges: DataFrame, ord_: int, text: str = "") -> DataFrame:
    e = edges.where(F.col("dst") == ord_).withColumnsRenamed({"name": "edge_name", "type": "edge_type"})
    return _matching(e.join(nodes, e["src"] == nodes["ord"]), text).orderBy(F.desc("eid"))


def _matching(rows: DataFrame, text: str) -> DataFrame:
    if not text:
        return rows
    return rows.where(contains_folded(F.coalesce("edge_name", F.col("idx").cast("string")), text) | contains_folded(F.col("name"), text))


def page_by_parent(rows: DataFrame, parent: str, order: list[Column], size: int = PAGE, start: int = 0) -> DataFrame:
    """A window of ``size`` rows under each parent, with their rank and the number there are.

    A task sends no more of a parent's rows than the window can show (Spark limits groups
    of a rank before the shuffle), and the count comes from an aggregate that is added up
    before it is shuffled, so a parent with many rows is no task of its own.
    """
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("_n") <= start + size)
    ranked = first.withColumn("rank", (F.col("_n") - 1).cast("long")).where(F.col("rank") >= start).drop("_n")
    totals = rows.groupBy(parent).agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(totals, parent)


def containment(nodes: DataFrame, edges: DataFrame, root: int, depth: int = 1, page: int = PAGE, expand: dict[int, tuple[int, int]] | None = None, reverse: bool = False, guard: bool = True, top_offset: int = 0) -> DataFrame:
    """The tree under a node to ``depth`` levels: depth, path, edge, node; ``expand`` opens more nodes with a page of their own.

    Rounds over one level each; ``guard`` keeps a path from entering a node twice.
    """
    expand = expand or {}
    a, b = ("dst", "src") if reverse else ("src", "dst")
    seen = edges.where("type != 'invisible'").select(F.col(a).alias("_from"), F.col(b).alias("_to"), "type", F.col("name").alias("edge_name"), "idx", "pos", "eid")
    spark = nodes.sparkSession
    level = spark.range(1).select(F.lit(root).cast("long").alias("_at"), F.array(F.lit(root).cast("long")).alias("path"))
    out = None
    for d in range(1, max(depth, 1) + len(expand) + 1):
        allowed = level if d <= depth else level.where(F.col("_at").isin(*expand)) if expand else None
        if allowed is None:
            break
        lo = F.lit(top_offset if d == 1 else 0)
        n = F.lit(page)
        for node, (start, count) in expand.items():
            lo, n = F.when(F.col("_at") == node, start).otherwise(lo), F.when(F.col("_at") == node, count).otherwise(n)
        step = allowed.join(seen, F.col("_at") == F.col("_from"))
        if guard:
            step = step.where(~F.array_contains("path", F.col("_to")))
        order = F.desc("eid") if reverse else F.asc("pos")
        step = step.withColumn("rank", (F.row_number().over(Window.partitionBy("path").orderBy(order, "eid")) - 1).cast("long")).where((F.col("rank") >= lo) & (F.col("rank") < lo + n))
        rows = stage(step.select(F.lit(d).alias("depth"), F.concat("path", F.array("_to")).alias("path"), "rank", "type", "edge_name", "idx", "eid", F.col("_to").alias("ord")), f"tree-{d}")
        if rows.isEmpty():
            break
        out = rows if out is None else out.unionByName(rows)
        level = rows.select(F.col("ord").alias("_at"), "path")
    if out is None:
        return nodes.limit(0)
    label = edge_label(F.col("type"), F.col("edge_name"), F.col("idx")).alias("edge")
    return out.select("depth", "path", "rank", label, "eid", "ord").join(nodes.withColumnRenamed("type", "node_type"), "ord")


def dominator_chain(nodes_x: DataFrame, ord_: int) -> DataFrame:
    """The node and all that dominate it, nearest first: intervals that hold its own."""
    x = F.broadcast(nodes_x.where(F.col("ord") == ord_).select(F.col("tin").alias("_a"), F.col("tout").alias("_b")).limit(1))
    # the interval of a node with nothing below it may be empty
    return nodes_x.join(x, ((F.col("tin") <= F.col("_a")) & (F.col("tout") >= F.greatest("_a", "_b"))) | (F.col("ord") == ord_)).drop("_a", "_b").orderBy(F.desc("dom_depth"))


def dominated_children(nodes_x: DataFrame, ord_: int, offset: int = 0, limit: int = 100) -> DataFrame:
    return nodes_x.where((F.col("idom") == ord_) & (F.col("ord") != ord_)).orderBy(F.desc("retained_size"), "ord").offset(offset).limit(limit)


def shortest_path(nodes_x: DataFrame, edges: DataFrame, ord_: int) -> DataFrame:
    """(step, ord): a shortest path from the roots to a node, each step from the in-edge of the least source."""
    found, at = [], ord_
    while True:
        found.append(at)
        row = nodes_x.where(F.col("ord") == at).select("distance").first()
        if row is None or row[0] <= 0:
            break
        before = edges.where((F.col("dst") == at) & (F.col("type") != "weak")).join(nodes_x.where(F.col("distance") == row[0] - 1).select(F.col("ord").alias("src")), "src").agg(F.min("src")).first()[0]
        if before is None or before in found:
            break
        at = before
    return nodes_x.sparkSession.createDataFrame([(i, o) for i, o in enumerate(reversed(found))], "step int, ord bigint")


def page_start(rank: Column, size: int = PAGE) -> Column:
    """First row of the page that shows a row."""
    return F.floor(rank / size) * size


def shifted(start: int, size: int, total: int, by: int) -> int:
    """Where a window starts after a move: within the rows, and no further on once it shows the last of them."""
    return max(0, min(start + by, start if start + size >= total else total - 1))


def status(start: Column, shown: Column, total: Column) -> Column:
    """``a–b of n`` of a page."""
    return F.concat((start + 1).cast("string"), F.lit("–"), (start + shown).cast("string"), F.lit(" of "), total.cast("string"))


def dominator_reveal(nodes_x: DataFrame, ord_: int, size: int = PAGE) -> DataFrame:
    """(step, ord, rank, page): dominators of a node from the root on, with each one's place among its parent's children."""
    chain = dominator_chain(nodes_x, ord_).select("ord", "idom", "dom_depth", "retained_size")
    others = nodes_x.where("ord != idom").select(F.col("idom").alias("_p"), F.col("ord").alias("_o"), F.col("retained_size").alias("_r"))
    ahead = chain.join(F.broadcast(chain.select(F.col("ord").alias("_p"))), chain["idom"] == F.col("_p")).drop("_p")
    ahead = others.join(F.broadcast(ahead), F.col("_p") == F.col("idom")).where("_o != ord and (_r > retained_size or (_r = retained_size and _o < ord))").groupBy("ord").agg(F.count(F.lit(1)).alias("rank"))
    out = chain.join(ahead, "ord", "left").select(F.col("dom_depth").alias("step"), "ord", F.coalesce("rank", F.lit(0)).alias("rank"))
    return out.withColumn("page", page_start(F.col("rank"), size)).orderBy("step")


def containment_reveal(nodes_x: DataFrame, edges: DataFrame, ord_: int, size: int = PAGE) -> DataFrame:
    """(step, ord, rank, page): a shortest path to a node, with each step's place among the edges of the one before."""
    path = stage(shortest_path(nodes_x, edges, ord_), "reveal")
    pairs = path.select("step", "ord").join(path.select((F.col("step") + 1).alias("step"), F.col("ord").alias("src")), "step")
    seen = edges.where("type != 'invisible'").join(F.broadcast(pairs.select("src").distinct()), "src").select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("pos", "eid")).alias("_n"))
    ranks = seen.join(F.broadcast(pairs), (seen["src"] == pairs["src"]) & (seen["dst"] == pairs["ord"])).groupBy("step").agg((F.min("_n") - 1).cast("long").alias("rank"))
    out = path.join(ranks, "step", "left").withColumn("rank", F.coalesce("rank", F.lit(0).cast("long")))
    return out.withColumn("page", page_start(F.col("rank"), size)).orderBy("step")


def retainers_report(nodes_x: DataFrame, edges: DataFrame, ord_: int, plan: Plan, start: int = 0, count: int = PAGE) -> DataFrame:
    """(rank, depth, seq, eid, ord, on_plan, expanded, total): direct retainers, those that lead to roots
    first and then by distance, a window of them; below those of the plan what it found, in its order."""
    spark = nodes_x.sparkSession
    rows = spark.createDataFrame([(d, q, e, r, i + 1 < len(plan.rows) and plan.rows[i + 1][0] > d) for i, (d, q, e, r, _) in enumerate(plan.rows)], "depth int, seq int, eid bigint, ord bigint, expanded boolean")
    top = rows.where("depth = 1").select("eid", F.col("seq").alias("_top"), "expanded")
    direct = edges.where(F.col("dst") == ord_).select("eid", F.col("src").alias("ord")).join(nodes_x.select("ord", "distance"), "ord").join(F.broadcast(top), "eid", "left")
    order = Window.orderBy(F.col("_top").isNull(), "distance", F.desc("eid"))
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    page = direct.select("*", (F.row_number().over(order) - 1).cast("long").alias("rank"), total.alias("total")).where((F.col("rank") >= start) & (F.col("rank") < start + count))
    page = stage(page.select("rank", F.lit(1).alias("depth"), F.coalesce("_top", F.lit(-1)).alias("seq"), "eid", "ord", F.col("_top").isNotNull().alias("on_plan"), F.coalesce("expanded", F.lit(False)).alias("expanded"), "total"), "retainers")
    # a row of the plan lies below the last direct retainer before it
    under = rows.withColumn("_under", F.max(F.when(F.col("depth") == 1, F.col("seq"))).over(Window.orderBy("seq")))
    below = under.where("depth > 1").join(page.where("on_plan").select("rank", F.col("seq").alias("_under"), "total"), "_under").select("rank", "depth", "seq", "eid", "ord", F.lit(True).alias("on_plan"), "expanded", "total")
    return page.unionByName(below).orderBy("rank", "seq")


@dataclass
class Plan:
    """What of a node's retainers leads to the roots."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # depth, seq, eid, retainer, distance
    path_edges: set[int] = field(default_factory=set)
    reached: bool = False
    truncated: bool = False


def retaining_plan(nodes_x: DataFrame, edges: DataFrame, ord_: int, gc_roots: int, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Plan:
    """Paths from a node back to holders of roots, nearest retainers first.

    The search looks at ``max_nodes`` nodes and ``max_depth`` levels at most, nearest first;
    that part of the graph is fetched by levels and searched here. Of a node with more than
    ``max_nodes`` retainers the nearest so many are fetched, and ``truncated`` says so, as it
    does wherever a limit left something out.
    """
    strong = edges.where("type != 'weak'").select("eid", "src", "dst")
    into: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    fetched, frontier = {ord_}, [ord_]
    spark = nodes_x.sparkSession
    distances = nodes_x.select(F.col("ord").alias("src"), "distance")
    plan, spent = Plan(), [0]
    nearest = Window.partitionBy("dst").orderBy("distance", "src", "eid")
    for _ in range(max_depth):
        if not frontier:
            break
        if len(fetched) > max_nodes:
            plan.truncated = True
            break
        near: dict[int, int] = {}
        for lo in range(0, len(frontier), max_nodes):
            wanted = F.broadcast(spark.createDataFrame([(x,) for x in frontier[lo : lo + max_nodes]], "dst bigint"))
            level = strong.join(wanted, "dst").join(distances, "src").withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= max_nodes + 1)
            for r in level.toLocalIterator():
                if r["_rank"] > max_nodes:
                    plan.truncated = True
                    continue
                into[r["dst"]].append((r["distance"], r["src"], r["eid"]))
                near[r["src"]] = r["distance"]
        new = sorted(set(near) - fetched - {gc_roots}, key=lambda x: (near[x], x))
        frontier, left = new[:max_nodes], new[max_nodes:]
        plan.truncated |= bool(left)
        fetched |= set(frontier)
    held = {d for d, sources in into.items() if any(s == gc_roots for _, s, _ in sources)}
    memo: dict[int, tuple[bool, int]] = {}

    def leads(node: int, depth: int, trail: set[int]) -> bool:
        if node in held or node == gc_roots:
            return True
        if depth >= max_depth or spent[0] >= max_nodes:
            plan.truncated = True
            return False
        known = memo.get(node)
        if known and (known[0] or depth >= known[1]):
            return known[0]
        spent[0] += 1
        found = False
        for _, src, eid in sorted(into.get(node, ())):
            if src not in trail and leads(src, depth + 1, trail | {src}):
                plan.path_edges.add(eid)
                found = True
        memo[node] = (found, depth)
        return found

    plan.reached = leads(ord_, 0, {ord_})
    used: set[int] = set()
    opened: set[int] = set()

    def write(node: int, depth: int) -> None:
        if node in opened or node in held:
            return
        opened.add(node)
        for distance, src, eid in sorted(into.get(node, ())):
            if eid in plan.path_edges and eid not in used:
                used.add(eid)
                plan.rows.append((depth, len(plan.rows), eid, src, distance))
                write(src, depth + 1)

    write(ord_, 1)
    return plan


def path_edges(nodes: DataFrame, edges: DataFrame, roots: DataFrame, target: int, label: str = "paths") -> DataFrame:
    """Edges on some path from ``roots`` (ord) to a node, for graphs of any size: what the roots
    reach, cut with what reaches the node."""
    from heaploom.plans.fixpoint import reachable

    strong = edges.where("type != 'weak'")
    ahead = reachable(strong, roots, label=f"{label}-ahead")
    turned = strong.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = reachable(turned, nodes.where(F.col("ord") == target).select("ord"), label=f"{label}-back")
    both = stage(ahead.join(back, "ord"), f"{label}-both")
    return strong.join(both.select(F.col("ord").alias("src")), "src").join(both.select(F.col("ord").alias("dst")), "dst")
