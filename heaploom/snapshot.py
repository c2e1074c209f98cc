"""A loaded snapshot and everything that can be asked of it; results are DataFrames unless said otherwise."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heaploom.functions import formats
from heaploom.operators import grouping, leaks, locations, naming, realms, trees
from heaploom.operators.analyse import PARTS, analyse
from heaploom.operators.edges import hop
from heaploom.plans.staging import stage
from heaploom.schema import GC_ROOTS
from heaploom.sources import heapsnapshot, splits


#: Nodes of a snapshot that one task analyses whole; larger ones are analysed in rounds.
TASK_NODES = 30_000_000


class Snapshot:
    """Tables of one snapshot; the analysis runs once, on first use."""

    def __init__(self, tables: dict[str, DataFrame], weak_is_reachable: bool = False) -> None:
        self.tables, self.weak_is_reachable = tables, weak_is_reachable
        self.spark: SparkSession = tables["nodes"].sparkSession

    @classmethod
    def load(cls, spark: SparkSession, path: str, weak_is_reachable: bool = False) -> Snapshot:
        return cls(splits.load_tables(spark, path), weak_is_reachable)

    @classmethod
    def from_bytes(cls, spark: SparkSession, content: bytes, weak_is_reachable: bool = False) -> Snapshot:
        return cls(heapsnapshot.tables_from_bytes(spark, content), weak_is_reachable)

    def save(self, folder: str) -> None:
        """Write all tables and the analysed nodes, so that later sessions skip the analysis."""
        for name, table in {**self.tables, "analysed": self.nodes}.items():
            table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str) -> Snapshot:
        """A snapshot as it was saved."""
        at = folder.rstrip("/")
        out = cls({name: spark.read.schema(ddl).parquet(f"{at}/{name}") for name, ddl in heapsnapshot.TABLES.items()})
        out.nodes = spark.read.parquet(f"{at}/analysed")
        return out

    @property
    def edges(self) -> DataFrame:
        return self.tables["edges"]

    @cached_property
    def info(self) -> dict:
        return self.tables["snapshots"].first().asDict()

    @cached_property
    def nodes(self) -> DataFrame:
        """Nodes with all analysed columns and ``display_name``."""
        parts = tuple(PARTS) if self.info["node_count"] > TASK_NODES else None
        x = analyse(self.tables["nodes"], self.edges, self.weak_is_reachable, self.tables["locations"], locations.script_names(self.tables["nodes"], self.edges, self.tables["locations"]), parts=parts)
        return stage(naming.display_names(x, self.edges), "displayed")

    @cached_property
    def gc_roots(self) -> int:
        return self.nodes.where(F.col("name") == GC_ROOTS).where("root_kind != 'NonRoot'").first()["ord"]

    def _ord(self, object_id: int | str) -> int:
        n = formats.parse_object_id(str(object_id))
        row = self.nodes.where(F.col("id") == n).agg(F.min("ord")).first()
        if row[0] is None:
            raise KeyError(f"no object with id @{n}")
        return row[0]

    # -- summaries --------------------------------------------------------------------

    def _filter(self, name: str, interval: int | None = None, realm: int | None = None, text: str | None = None) -> DataFrame:
        if interval is not None:
            spans = {r["seq"]: r for r in grouping.intervals(self.tables["samples"]).collect()}
            if interval not in spans:
                raise ValueError(f"invalid interval index {interval}; there are {len(spans)}")
            rows = self.nodes.where((F.col("id") > spans[interval]["id_from"]) & (F.col("id") <= spans[interval]["id_to"]))
        elif realm is not None:
            rows = self.nodes.where((F.col("bucket_kind") == "Context") & (F.col("bucket_ctx") == realm))
        elif name in grouping.FILTERS:
            rows = self.nodes.where(grouping.FILTERS[name])
        elif name in self._only:
            if name == "detached-dom" and not self.info["has_detachedness"]:
                return self.nodes.limit(0)
            rows = self.nodes.join(self.only(name), "ord", "left_semi")
        else:
            raise ValueError(f"unknown filter {name!r}; valid filters: {', '.join(self.filters)}")
        if text:
            own, raw = formats.contains_folded(F.col("group_name"), text), formats.contains_folded(F.col("name"), text)
            rows = rows.where(own | raw)
        return rows

    @cached_property
    def _ends(self) -> DataFrame:
        return stage(realms.with_ends(self.nodes, self.edges), "ends")

    @cached_property
    def reached(self) -> DataFrame:
        """(ord): what the root reaches over any edges, worked out once."""
        return stage(realms.reached(self.nodes, self.edges), "reached")

    def only(self, name: str) -> DataFrame:
        """(ord): what is kept by detached elements, the console or event handlers alone; each worked out once."""
        if name not in self._kept:
            self._kept[name] = stage(realms.retained_only(self.nodes, self._ends, F.col(self._only[name]), reached_=self.reached), f"only-{name}")
        return self._kept[name]

    @cached_property
    def _kept(self) -> dict[str, DataFrame]:
        return {}

    _only = {"detached-dom": "to_detached", "console": "console", "event-handlers": "to_handler"}
    filters = (*grouping.FILTERS, *_only)

    def summary(self, filter: str = "all", interval: int | None = None, realm: int | None = None, text: str | None = None) -> DataFrame:  # noqa: A002
        plain = filter == "all" and interval is None and realm is None and not text
        groups = grouping.summary(self._filter(filter, interval, realm, text))
        return groups.orderBy(F.desc("retained_size" if plain else "self_size"), "first_seen")

    def summary_report(self, filter: str = "all", **more: object) -> DataFrame:  # noqa: A002
        """Summary with shares of the totals. A filtered one leaves retained sizes out, as a node outside it may hold what is inside."""
        groups = self.summary(filter, **more)
        if filter != "all" or any(v is not None and v != "" for v in more.values()):
            groups = groups.drop("retained_size")
        total = F.sum("self_size").over(Window.partitionBy(F.lit(1)))
        return groups.withColumn("self_share", formats.format_percent(F.col("self_size"), total))

    def summary_members(self, name: str, offset: int = 0, limit: int = 20, filter: str = "all") -> DataFrame:  # noqa: A002
        rows = self._filter(filter)
        if rows.where(F.col("group_name") == name).isEmpty():
            # a class by its name alone: all its groups by source position
            rows = rows.where(F.regexp_extract("group_name", r"^(.*) \[[^\]]*:\d+\]$", 1) == name).withColumn("group_name", F.lit(name))
            if rows.isEmpty():
                raise KeyError(f"no constructor group {name!r}")
        return grouping.members(rows, name, offset, limit).select("id", "display_name", "self_size", "retained_size", "detachedness", "bucket_kind", "bucket_ctx")

    def group_of(self, object_id: int | str) -> tuple[str, int]:
        """Name of the group that holds an object, and its place there by retained size."""
        me = self.nodes.where(F.col("ord") == self._ord(object_id)).first()
        ahead = (F.col("retained_size") > me["retained_size"]) | ((F.col("retained_size") == me["retained_size"]) & (F.col("ord") < me["ord"]))
        return me["group_name"], self.nodes.where(F.col("class_key") == me["class_key"]).where("self_size > 0").where(ahead).count()

    def statistics(self) -> DataFrame:
        return grouping.statistics(self.nodes, self.edges, self.info["extra_native_bytes"] or 0)

    def realm_sizes(self) -> DataFrame:
        return realms.realm_sizes(self.nodes)

    def duplicate_strings(self, min_count: int = 2, offset: int = 0, limit: int = 100, show_ids: bool = False) -> DataFrame:
        return grouping.duplicate_strings(self.nodes, self.edges, min_count, show_ids).offset(offset).limit(limit)

    def duplicate_summary(self, min_count: int = 2) -> DataFrame:
        """Equal strings as groups of a summary."""
        return grouping.duplicate_summary(grouping.duplicate_strings(self.nodes, self.edges, min_count))

    def duplicate_totals(self, min_count: int = 2) -> DataFrame:
        return grouping.duplicate_totals(grouping.duplicate_strings(self.nodes, self.edges, min_count))

    def timeline_totals(self) -> DataFrame:
        return grouping.timeline_totals(grouping.timeline(self.nodes, self.tables["samples"]))

    def skipped_strings(self) -> DataFrame:
        return grouping.skipped_strings(self.nodes, self.edges)

    def timeline(self) -> DataFrame:
        out = grouping.timeline(self.nodes, self.tables["samples"])
        most = F.max("size").over(Window.partitionBy(F.lit(1)))
        return out.withColumns({"seconds": formats.seconds(F.col("timestamp_us")), "bar": formats.bar(F.col("size"), most)})

    def diff(self, baseline: Snapshot) -> DataFrame:
        return grouping.class_diff(self.nodes, baseline.nodes)

    def edge_diff(self, baseline: Snapshot, object_id: int | str | None = None) -> DataFrame:
        """Edges, of one object or of all, that only one of the two snapshots has."""
        found = grouping.edge_diff(self.nodes, self.edges, baseline.nodes, baseline.edges)
        return found if object_id is None else found.where(F.col("src_id") == formats.parse_object_id(str(object_id)))

    def diff_members(self, baseline: Snapshot, class_name: str, offset: int = 0, limit: int = 20) -> DataFrame:
        new, gone = grouping.diff_objects(self.nodes, baseline.nodes)
        both = new.withColumn("sign", F.lit("+")).unionByName(gone.withColumn("sign", F.lit("-"))).where(F.col("class_name") == class_name)
        if both.isEmpty():
            raise KeyError(f"no differences in class {class_name!r}")
        return both.orderBy(F.col("sign") == "-", "id").offset(offset).limit(limit).select("sign", "id", "self_size")

    # -- objects --------------------------------------------------------------------------

    def node(self, object_id: int | str) -> DataFrame:
        return self.nodes.where(F.col("ord") == self._ord(object_id)).withColumn("distance_text", formats.format_distance(F.col("distance")))

    def children(self, object_id: int | str, offset: int = 0, limit: int = 10, text: str = "") -> DataFrame:
        at = self._ord(object_id)
        realm = not self.nodes.where((F.col("ord") == at) & realms.is_named(F.col("name"), realms.NATIVE_CONTEXT)).isEmpty()
        common = realms.common_of(self.nodes, self.edges, at)
        return trees.children(self.nodes, self.edges.drop("snapshot_id"), at, text, pinned=realm, common=common).offset(offset).limit(limit)

    def retainers(self, object_id: int | str, offset: int = 0, limit: int = 10, text: str = "") -> DataFrame:
        return trees.retainers(self.nodes, self.edges.drop("snapshot_id"), self._ord(object_id), text).offset(offset).limit(limit)

    def show(self, object_id: int | str, depth: int = 1, offset: int = 0, limit: int = 100) -> DataFrame:
        return trees.containment(self.nodes, self.edges, self._ord(object_id), depth, limit, guard=False, top_offset=offset)

    def show_retainers(self, object_id: int | str, depth: int = 1, offset: int = 0, limit: int = 100) -> DataFrame:
        return trees.containment(self.nodes, self.edges, self._ord(object_id), depth, limit, reverse=True, guard=False, top_offset=offset)

    def containment(self, object_id: int | str | None = None, depth: int = 1, expand: dict[int, tuple[int, int]] | None = None) -> DataFrame:
        at = self.gc_roots if object_id is None else self._ord(object_id)
        return trees.containment(self.nodes, self.edges, at, depth, expand={self._ord(k): v for k, v in (expand or {}).items()})

    def containment_roots(self) -> DataFrame:
        under = self.edges.where(F.col("src") == self.gc_roots).select(F.col("dst").alias("ord")).distinct()
        roots = self.nodes.where("root_kind = 'SystemRoot'").select("ord").unionByName(under).distinct()
        kids = self.edges.groupBy(F.col("src").alias("ord")).agg(F.count(F.lit(1)).alias("child_count"))
        return self.nodes.join(roots, "ord", "left_semi").join(kids, "ord", "left").select("ord", "id", "display_name", "root_kind", "self_size", "retained_size", F.coalesce("child_count", F.lit(0)).alias("child_count")).orderBy("ord")

    def roots(self) -> DataFrame:
        """System and user roots in the order of the root's edges, and the categories under the GC roots."""
        top = self.edges.join(self.nodes.where("root_kind = 'SyntheticRoot'").select(F.col("ord").alias("src")), "src").select(F.col("dst").alias("ord"), "pos", F.lit(0).alias("level"))
        under = self.edges.where(F.col("src") == self.gc_roots).select(F.col("dst").alias("ord"), "pos", F.lit(1).alias("level"))
        return top.unionByName(under).join(self.nodes, "ord").select("level", "pos", "root_kind", "id", "display_name", "self_size", "retained_size").orderBy("level", "pos")

    def dominators_of(self, object_id: int | str) -> DataFrame:
        return trees.dominator_chain(self.nodes, self._ord(object_id))

    def dominated_children(self, object_id: int | str, offset: int = 0, limit: int = 100) -> DataFrame:
        return trees.dominated_children(self.nodes, self._ord(object_id), offset, limit)

    def dominator_root(self) -> DataFrame:
        return self.nodes.where(F.col("ord") == self.gc_roots)

    def reveal(self, object_id: int | str, view: str = "containment", size: int = trees.PAGE) -> DataFrame:
        """The steps that lead to an object in a view, each with its place and the page that shows it."""
        if view == "containment":
            return trees.containment_reveal(self.nodes, self.edges, self._ord(object_id), size)
        if view == "dominators":
            return trees.dominator_reveal(self.nodes, self._ord(object_id), size)
        name, rank = self.group_of(object_id)
        return self.spark.createDataFrame([(0, name, rank, rank // size * size)], "step int, name string, rank bigint, page bigint")

    def retaining_plan(self, object_id: int | str, max_depth: int = trees.MAX_DEPTH, max_nodes: int = trees.MAX_NODES) -> trees.Plan:
        return trees.retaining_plan(self.nodes, self.edges, self._ord(object_id), self.gc_roots, max_depth, max_nodes)

    def retaining_paths(self, object_id: int | str, max_depth: int = trees.MAX_DEPTH, max_nodes: int = trees.MAX_NODES) -> DataFrame:
        """(depth, path_seq, eid, retainer, distance, reached, truncated) of the pruned tree of paths to roots."""
        plan = self.retaining_plan(object_id, max_depth, max_nodes)
        return self.spark.createDataFrame([(*r, plan.reached, plan.truncated) for r in plan.rows], "depth int, path_seq int, eid bigint, retainer bigint, distance bigint, reached boolean, truncated boolean")

    def reachable_size(self, *object_ids: int | str) -> DataFrame:
        roots = self.spark.createDataFrame([(self._ord(i),) for i in object_ids], "ord bigint")
        return realms.reachable_sizes(self.nodes, self.edges, roots)

    def stack_roots(self, min_reachable_mb: float | None = None) -> DataFrame:
        held = stage(realms.stack_roots(self.nodes, self.edges), "stack-roots")
        sizes = realms.reachable_sizes(self.nodes, self.edges, held.select("ord").distinct()).withColumnsRenamed({"root": "ord", "size": "reachable_size"})
        out = held.join(sizes, "ord").join(self.nodes.select("ord", "id", "display_name", "detachedness", "retained_size"), "ord")
        if min_reachable_mb is not None:
            out = out.where(F.col("reachable_size") >= min_reachable_mb * (1 << 20))
        return out.orderBy(F.desc("reachable_size"), "ord")

    # -- realms, contexts, closures -------------------------------------------------------

    def realms(self, known: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
        """Realms with their sizes and own names; ``titles`` (extension, title) names extensions, as nothing is looked up elsewhere."""
        r = self.realm_table
        if titles is not None:
            told = titles.select(F.concat(F.lit("chrome-extension://"), F.col("extension")).alias("_e"), "title").dropDuplicates(["_e"])
            r = r.withColumn("_e", F.regexp_extract("url", "^chrome-extension://[^/]+", 0)).join(told, "_e", "left").drop("_e")
        sizes = realms.reachable_sizes(self.nodes, self.edges, r.select("ord")).select(F.col("root").alias("ord"), F.col("size").alias("reachable_size"))
        known = known if known is not None else realms.common_fields(self.nodes, self.edges, realms.GLOBAL_TAGS[0])
        return r.join(sizes, "ord", "left").join(realms.unique_vars(self.nodes, self.edges, known), "ord", "left").orderBy("realm")

    def contexts(self, min_retained: str | int = "8K", min_var_retained: str | int = "1K") -> DataFrame:
        least = formats.parse_size(str(min_var_retained))
        groups = realms.context_groups(self.nodes, self.edges, formats.parse_size(str(min_retained)))
        inside = hop(realms.contexts(self.nodes).select(F.col("ord").alias("ctx")), "ctx", self.edges, "scope_info", "scope")
        variables = realms.context_vars(self.nodes, self.edges).where(F.col("retained_size") >= least).join(inside, "ctx")
        held = variables.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct((-F.col("retained_size")).alias("_r"), "var", "id"))).alias("vars"))
        return groups.join(held, groups["scope"].eqNullSafe(held["scope"]), "left").drop(held["scope"])

    def contexts_left_out(self, min_retained: str | int = "8K") -> int:
        """How many groups of contexts hold less than ``min_retained``."""
        return realms.context_groups(self.nodes, self.edges, 0).where(F.col("retained_size") < formats.parse_size(str(min_retained))).count()

    def closures(self, offset: int = 0, limit: int = 100, builtins: bool = False, templates: bool = False, extensions: bool = False, realm: int | None = None) -> DataFrame:
        c = realms.closures(self.nodes, self.edges)
        for shown, column in ((builtins, "builtin"), (templates, "template"), (extensions, "extension")):
            c = c if shown else c.where(~F.col(column))
        if realm is not None:
            c = c.where(F.col("bucket_ctx") == realm)
        return c.orderBy(F.desc("retained_size"), "ord").offset(offset).limit(limit)

    def closure_leaks(self, incomplete: bool = False) -> DataFrame:
        return leaks.closure_leaks(self.nodes, self.edges, incomplete)

    def context_tree(self, object_id: int | str) -> DataFrame:
        return leaks.context_tree(self.nodes, self.edges, self._ord(object_id))

    def scopes(self, object_id: int | str) -> DataFrame:
        return leaks.scopes_of(self.nodes, self.edges, self._ord(object_id))

    def allocation_stack(self, object_id: int | str) -> DataFrame:
        at = self.nodes.where(F.col("ord") == self._ord(object_id)).select(F.col("trace_node_id").alias("id")).where("id > 0")
        return realms.allocation_stacks(self.tables["trace_nodes"], self.tables["trace_functions"]).join(at, "id", "left_semi").orderBy("frame_no")

    def function_source(self, object_id: int | str) -> str | None:
        row = leaks.function_sources(self.nodes, self.edges).where(F.col("ord") == self._ord(object_id)).first()
        return row["text"] if row else None

    def edge_refs(self, edge_name: str) -> DataFrame:
        return self.spark.range(1).select(F.inline(formats.edge_refs(F.lit(edge_name))))

    def locations(self) -> DataFrame:
        """(ord, script_id, line, col, script_name, location): of an object, or of a closure's shared part."""
        return locations.node_locations(self.nodes, self.edges, self.tables["locations"])

    def scope_names(self) -> DataFrame:
        return locations.scope_names(self.nodes, self.edges)

    def context_locations(self) -> DataFrame:
        return locations.context_locations(self.nodes, self.edges, self.tables["locations"])

    @cached_property
    def realm_table(self) -> DataFrame:
        return stage(realms.realms(self.nodes, self.edges), "realm-table")

    def realm(self, number: int | None = None, object_id: int | str | None = None) -> DataFrame:
        """One realm, by its number or by its object."""
        return self.realm_table.where(F.col("realm") == number if number is not None else F.col("ord") == self._ord(object_id))

    def node_info(self, object_id: int | str) -> DataFrame:
        """All that is known of an object, in one row."""
        me = self.nodes.where(F.col("ord") == self._ord(object_id))
        at = me.select("ord")
        place = self.locations().join(at, "ord", "left_semi").select("ord", F.col("location").alias("_from"))
        end = locations.function_ends(self.nodes, self.edges).join(at, "ord", "left_semi").select("ord", F.format_string("-%d:%d", F.col("line") + 1, F.col("col") + 1).alias("_to"))
        # one object's stack and dominators: lists as long as these are deep
        frames = self.allocation_stack(object_id).select(locations.format_frame(F.col("function_name"), F.col("script_name"), F.col("line"), F.col("col")).alias("frame")).collect()
        chain = self.dominators_of(object_id).where(F.col("ord") != self._ord(object_id)).select("id").collect()
        out = me.join(locations.bucket_labels(me, self.realm_table), "ord").join(place, "ord", "left").join(end, "ord", "left")
        out = out.join(locations.instance_types(self.nodes, self.edges), "ord", "left")
        out = out.withColumns({"allocated_at": F.array(*[F.lit(r["frame"]) for r in frames]).cast("array<string>"), "dominators": F.array(*[F.lit(r["id"]) for r in chain]).cast("array<bigint>")})
        has_source = (F.col("type") == "closure") | locations.is_shared_function(F.col("type"), F.col("name"))
        return out.select(
            "id", "ord", "display_name", "class_name", "type", "instance_type", "self_size", "retained_size", formats.format_distance(F.col("distance")).alias("distance"), "edge_count", "detachedness", realms.is_original(F.col("raw_detachedness"), F.col("detachedness")).alias("detachedness_is_original"),
            "bucket", "bucket_label", F.concat("_from", F.coalesce("_to", F.lit(""))).alias("location"), has_source.alias("has_source"), "allocated_at", "dominators",
        )

    def search(self, text: str, view: str = "summary", baseline: Snapshot | None = None) -> DataFrame | None:
        """What a search line asks for: the object of an ``@id``, else groups whose names hold the text; None for an empty line."""
        text = text.strip()
        if not text:
            return None
        if text.startswith("@"):
            return self.node(text)
        if view == "diff" and baseline is not None:
            return self.diff(baseline).where(formats.contains_folded(F.col("name"), text, ascii_only=True))
        return self.summary(text=text)

    def baseline_children(self, baseline: Snapshot, object_id: int | str, offset: int = 0, limit: int = 10) -> DataFrame:
        """Children of an object as the baseline has them, which is asked for objects that are gone since."""
        holder = self if not self.nodes.where(F.col("id") == formats.parse_object_id(str(object_id))).isEmpty() else baseline
        return holder.children(object_id, offset, limit)

    def sizes_around(self, object_id: int | str) -> DataFrame:
        """Reachable sizes of an object and of its children, each once, in the same rounds."""
        at = self._ord(object_id)
        wanted = self.edges.where(F.col("src") == at).select(F.col("dst").alias("ord")).unionByName(self.spark.range(1).select(F.lit(at).cast("long").alias("ord"))).distinct()
        return realms.reachable_sizes(self.nodes, self.edges, wanted)

    def retainers_report(self, object_id: int | str, start: int = 0, count: int = trees.PAGE, max_depth: int = trees.MAX_DEPTH, max_nodes: int = trees.MAX_NODES) -> DataFrame:
        """Direct retainers, those on paths to roots first and opened, the others closed; any of them can be asked for in turn."""
        plan = self.retaining_plan(object_id, max_depth, max_nodes)
        rows = trees.retainers_report(self.nodes, self.edges, self._ord(object_id), plan, start, count)
        named = rows.join(self.nodes.select("ord", "id", "display_name", "distance", "self_size", "retained_size"), "ord").join(self.edges.select("eid", formats.edge_label(F.col("type"), F.col("name"), F.col("idx")).alias("edge")), "eid")
        return named.withColumns({"reached": F.lit(plan.reached), "truncated": F.lit(plan.truncated)}).orderBy("rank", "seq")


class Registry:
    """Snapshots by number, for clients that hold several."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._held, self._next = spark, {}, 1

    def load(self, path: str, weak_is_reachable: bool = False) -> int:
        self._held[self._next] = Snapshot.load(self.spark, path, weak_is_reachable)
        self._next += 1
        return self._next - 1

    def get(self, number: int) -> Snapshot:
        if number not in self._held:
            raise KeyError(f"no snapshot with id {number}")
        return self._held[number]

    def close(self, number: int) -> bool:
        return self._held.pop(number, None) is not None


class History:
    """Objects visited and sizes computed, kept as Parquet by a file's content; a changed file starts afresh."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def key(self, content: bytes) -> str:
        return hashlib.sha256(content).hexdigest()

    def save(self, content: bytes, visited: list[int], sizes: dict[int, int]) -> None:
        rows = [(i, n, sizes.get(o), o) for n, (i, o) in enumerate(enumerate(visited))]
        df = self.spark.createDataFrame([(o, n, s) for _, n, s, o in rows], "id bigint, seq bigint, reachable_size bigint")
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{self.key(content)}")

    def load(self, content: bytes) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.folder}/{self.key(content)}").orderBy("seq")
        except AnalysisException:
            return None
