"""Analysis of one whole snapshot in one task: numpy over frontiers, not objects.

Many snapshots are analysed side by side, one task each; a graph that does not fit a
task is analysed by the rounds in :mod:`heaploom.plans.fixpoint` instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from heaploom.schema import DOM_TREES, GC_ROOTS, NO_DISTANCE, UNREACHABLE_BASE, weak_pair

SHARED, UNATTRIBUTED = -2, -1
INTERFACE_BYTES, INTERFACE_LEAST, INTERFACE_SHARE = 60, 2, 1000


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All integers of the ranges that start at ``first`` and hold ``count`` each."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def property_name(name: str) -> str:
    return f"<symbol {name[7:-1]}>" if name.startswith("Symbol(") else name


class Coded:
    """A column of strings as codes, so that tests run once per distinct string. Null is empty."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray | None = None) -> None:
        coded = column.combine_chunks().fill_null("").dictionary_encode()
        self.values = np.array(coded.dictionary.to_pylist() or [""], object)
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        if order is not None:
            self.codes = self.codes[order]

    def __getitem__(self, at: object) -> object:
        return self.values[self.codes[at]]

    def where(self, test: Callable[[str], bool]) -> np.ndarray:
        return np.array([bool(test(v)) for v in self.values])[self.codes]

    def __eq__(self, text: object) -> np.ndarray:
        return self.where(lambda v: v == text)

    __hash__ = None


class Graph:
    """Out-edges of each node as ranges, with what decides whether an edge is followed."""

    def __init__(self, nodes: pa.Table, edges: pa.Table) -> None:
        nodes = nodes.sort_by("ord")
        self.ord = nodes["ord"].to_numpy()
        self.n = len(self.ord)
        self.type, self.name = Coded(nodes["type"]), Coded(nodes["name"])
        self.id = nodes["id"].to_numpy()
        self.size = nodes["self_size"].to_numpy().astype(np.int64)
        self.raw = nodes["raw_detachedness"].combine_chunks().fill_null(-1).to_numpy().astype(np.int64)
        order = np.lexsort((edges["eid"].to_numpy(), edges["src"].to_numpy()))
        self.src = np.searchsorted(self.ord, edges["src"].to_numpy()[order])
        self.dst = np.searchsorted(self.ord, edges["dst"].to_numpy()[order])
        self.kind, self.edge_name = Coded(edges["type"], order), Coded(edges["name"], order)
        idx = edges["idx"].combine_chunks().fill_null(-1).to_numpy()[order]
        self.first = np.searchsorted(self.src, np.arange(self.n))
        self.count = np.bincount(self.src, minlength=self.n)
        self.weak, self.shortcut = self.kind == "weak", self.kind == "shortcut"
        named = lambda what: self.name.where(lambda v: v == what or v.startswith(what + " / "))
        self.native_context, self.context = named("system / NativeContext"), named("system / Context")
        self._ephemerons()
        self.structural = self._structural(idx)
        self.root = 0
        under = self.dst[self.first[0] : self.first[0] + self.count[0]]
        found = [int(i) for i in under if self.name[i] == GC_ROOTS]
        if not found:
            raise ValueError(f"no {GC_ROOTS} under the root, which has {[self.name[i] for i in under]}")
        self.gc_roots = found[0]
        self.root_kind = np.full(self.n, "NonRoot", object)
        user = np.array([self.type[i] != "synthetic" or self.name[i] == DOM_TREES for i in under], bool)
        self.root_kind[under] = np.where(user, "UserRoot", "SystemRoot")
        self.root_kind[0] = "SyntheticRoot"
        self.system_roots = np.unique(under[~user])

    def _ephemerons(self) -> None:
        """``pair``: the number of an edge's WeakMap pair, or -1; ``table``: the table id its name tells."""
        self.pair, self.table = np.full(len(self.src), -1), np.full(len(self.src), -1)
        numbers: dict[str, int] = {}
        pair, table = np.full(len(self.edge_name.values), -1), np.full(len(self.edge_name.values), -1)
        for i, name in enumerate(self.edge_name.values):
            if (told := weak_pair(name)) is not None:
                pair[i], table[i] = numbers.setdefault(told.text, len(numbers)), told.table
        internal = self.kind == "internal"
        self.pair[internal], self.table[internal] = pair[self.edge_name.codes[internal]], table[self.edge_name.codes[internal]]
        self.pairs = len(numbers)

    def _structural(self, idx: np.ndarray) -> np.ndarray:
        sloppy = (self.edge_name == "sloppy_function_map") & self.native_context[self.src]
        descriptors = ((self.type == "array") & (self.name == "(map descriptors)"))[self.src]
        indexed = (self.kind == "element") | (self.kind == "hidden")
        return ~sloppy & ~(descriptors & indexed & (idx >= 2) & (idx % 3 == 1))

    def essential(self) -> np.ndarray:
        other_table = (self.table >= 0) & (self.table != self.id[self.src])
        return ~other_table & ~self.weak & (self.src != self.dst) & ~(self.shortcut & (self.src != self.gc_roots)) & (self.src != self.root)

    def out(self, frontier: np.ndarray) -> np.ndarray:
        return spread(self.first[frontier], self.count[frontier])

    # -- reachability ---------------------------------------------------------------

    def levels(self, level: np.ndarray, frontier: np.ndarray, depth: int, follow: np.ndarray, gate: np.ndarray | None, blocked: np.ndarray | None = None, expand: np.ndarray | None = None) -> None:
        """Breadth-first from ``frontier`` at ``depth``; fills ``level`` where it is negative.

        A pair's value opens when both its key and its table have been expanded; ``gate``
        counts that and lives on from one call to the next.
        """
        while len(frontier):
            frontier = frontier if expand is None else frontier[expand[frontier]]
            e = self.out(frontier)
            e = e[follow[e] & (level[self.dst[e]] < 0)]
            if blocked is not None:
                e = e[~blocked[self.dst[e]]]
            if gate is not None and self.pairs:
                paired = e[self.pair[e] >= 0]
                np.add.at(gate, self.pair[paired], 1)
                e = e[(self.pair[e] < 0) | (gate[self.pair[e]] >= 2)]
            depth += 1
            frontier = np.unique(self.dst[e])
            level[frontier] = depth

    def reach(self, starts: np.ndarray, follow: np.ndarray, gated: bool = False, blocked: np.ndarray | None = None, expand: np.ndarray | None = None) -> np.ndarray:
        level = np.full(self.n, -1)
        starts = np.unique(starts)
        level[starts] = 0
        self.levels(level, starts, 0, follow, np.zeros(self.pairs, np.int64) if gated else None, blocked, expand)
        return level >= 0

    def distances(self) -> np.ndarray:
        """Depths from the GC roots, then from the other system roots; -1: neither."""
        level, gate, follow = np.full(self.n, -1), np.zeros(self.pairs, np.int64), self.structural & ~self.weak
        level[self.gc_roots] = 0
        self.levels(level, np.array([self.gc_roots]), 0, follow, gate)
        level[self.root] = 0 if level[self.root] < 0 else level[self.root]
        rest = self.system_roots[level[self.system_roots] < 0]
        level[rest] = 1
        self.levels(level, rest, 1, follow, gate)
        return np.where(level < 0, NO_DISTANCE, level)

    def relax(self, d: np.ndarray, frontier: np.ndarray, follow: np.ndarray) -> None:
        while len(frontier):
            e = self.out(frontier)
            e = e[follow[e]]
            e = e[d[self.src[e]] + 1 < d[self.dst[e]]]
            np.minimum.at(d, self.dst[e], d[self.src[e]] + 1)
            frontier = np.unique(self.dst[e])

    def with_unreachable(self, distance: np.ndarray, weak_is_reachable: bool = False) -> np.ndarray:
        """Depths below unreachable seeds, counted from the first unreachable depth."""
        d = distance.astype(np.int64).copy()
        follow = self.structural & (~self.weak | weak_is_reachable)
        if weak_is_reachable:
            e = np.flatnonzero(self.weak & (d[self.src] < UNREACHABLE_BASE) & (d[self.dst] == NO_DISTANCE))
            found, least = np.unique(self.dst[e]), d.copy()
            np.minimum.at(least, self.dst[e], d[self.src[e]] + 1)
            d[found] = least[found]
            self.relax(d, found, follow)
        lost = d == NO_DISTANCE
        strong, held = np.zeros(self.n, bool), np.zeros(self.n, bool)
        strong[self.dst[~self.weak]] = True
        held[self.dst[d[self.src] < UNREACHABLE_BASE]] = True
        seeds = np.flatnonzero(lost & (held | ~strong))
        d[seeds] = UNREACHABLE_BASE
        self.relax(d, seeds, follow)
        for i in np.flatnonzero(lost):
            if d[i] == NO_DISTANCE:
                d[i] = UNREACHABLE_BASE
                self.relax(d, np.array([i]), follow)
        return d

    # -- dominators -----------------------------------------------------------------

    def dominators(self) -> tuple[np.ndarray, ...]:
        """Immediate dominators from the GC roots, with nodes nothing essential leads to as
        further children of these; unreachable cycles lie flat under them. Returns idom,
        depth, first and last number of each subtree, and retained sizes."""
        keep, r = self.essential(), self.gc_roots
        src, dst = self.src[keep], self.dst[keep]
        entered = np.zeros(self.n, bool)
        entered[dst] = True
        reached = self.reach(np.array([r]), keep)
        orphans = np.flatnonzero(~reached & ~entered)
        orphans = orphans[orphans != r]
        alive = self.reach(np.concatenate([[r], orphans]), keep)
        order = np.lexsort((dst, src))
        out_first = np.searchsorted(src[order], np.arange(self.n + 1)).tolist()
        out_dst = dst[order].tolist()
        extra = orphans.tolist()
        post, seen = [], bytearray(self.n)
        stack: list[tuple[int, int]] = [(r, out_first[r])]
        seen[r] = 1
        while stack:
            v, at = stack.pop()
            end = out_first[v + 1]
            while at < end and seen[out_dst[at]]:
                at += 1
            if at < end:
                w = out_dst[at]
                seen[w] = 1
                stack += [(v, at + 1), (w, out_first[w])]
                continue
            if v == r:
                while extra and seen[extra[-1]]:
                    extra.pop()
                if extra:
                    w = extra.pop()
                    seen[w] = 1
                    stack += [(v, end), (w, out_first[w])]
                    continue
            post.append(v)
        rank = [-1] * self.n
        for i, v in enumerate(post):
            rank[v] = i
        into = np.lexsort((src, dst))
        in_first = np.searchsorted(dst[into], np.arange(self.n + 1)).tolist()
        in_src = src[into].tolist()
        lone = bytearray(self.n)
        for o in orphans.tolist():
            lone[o] = 1
        top = rank[r]
        up = [-1] * len(post)
        up[top] = top
        changed = True
        while changed:
            changed = False
            for i in range(len(post) - 2, -1, -1):
                v = post[i]
                new = top if lone[v] else -1
                for at in range(in_first[v], in_first[v + 1]):
                    p = rank[in_src[at]]
                    if p < 0 or up[p] < 0:
                        continue
                    if new < 0:
                        new = p
                        continue
                    while p != new:
                        while p < new:
                            p = up[p]
                        while new < p:
                            new = up[new]
                if up[i] != new:
                    up[i] = new
                    changed = True
        idom = np.full(self.n, r)
        live = np.array(post)
        idom[live] = live[np.array(up)]
        assert len(post) == int(alive.sum())
        return (idom, *self._tree(idom))

    def _tree(self, idom: np.ndarray) -> tuple[np.ndarray, ...]:
        r = self.gc_roots
        kids = np.flatnonzero(np.arange(self.n) != r)
        order = kids[np.argsort(idom[kids], kind="stable")]
        first = np.searchsorted(idom[order], np.arange(self.n + 1)).tolist()
        child = order.tolist()
        depth, tin, tout = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        seq, stack = [], [r]
        while stack:
            v = stack.pop()
            seq.append(v)
            kids_of = child[first[v] : first[v + 1]]
            stack += kids_of[::-1]
        seq_a = np.array(seq)
        tin[seq_a] = np.arange(len(seq))
        parents = idom.tolist()
        levels, below = [0] * self.n, [1] * self.n
        for v in seq[1:]:
            levels[v] = levels[parents[v]] + 1
        retained = self.size.tolist()
        for v in reversed(seq[1:]):
            p = parents[v]
            below[p] += below[v]
            retained[p] += retained[v]
        depth[:] = levels
        tout = tin + np.array(below) - 1
        return depth, tin, tout, np.array(retained, np.int64)

    # -- detachedness, contexts, realms -----------------------------------------------

    def detachedness(self) -> np.ndarray:
        if not (self.raw >= 0).any():
            return np.zeros(self.n, np.int64)
        state = np.where(self.raw < 0, 0, self.raw & 3)
        state[state == 3] = 0
        native = self.type == "native"
        seen = np.where(native & (state > 0), 0, -1)
        follow = ~self.weak & ~(self.kind == "invisible") & native[self.dst]
        for value in (1, 2):
            seeds = np.flatnonzero(native & (state == value))
            before = seen.copy()
            self.levels(seen, seeds, 0, follow, None)
            state[(before < 0) & (seen >= 0)] = value
        follow = ~self.weak & self.structural
        normally = self.reach(self.system_roots, follow, gated=True)
        without = self.reach(self.system_roots, follow, gated=True, expand=state != 2)
        state[normally & ~without] = 2
        return state

    def retention(self, distance: np.ndarray) -> np.ndarray:
        free = self.reach(self.system_roots, ~self.weak & self.structural, gated=True, blocked=self.context)
        return np.where(distance >= UNREACHABLE_BASE, "Unreachable", np.where(free, "NotRetained", "Retained"))

    def target(self, name: str) -> np.ndarray:
        """Where the first edge of that name leads from each node; -1: none."""
        out = np.full(self.n, -1)
        e = np.flatnonzero((self.edge_name == name) & ~(self.kind == "element") & ~(self.kind == "hidden"))[::-1]
        out[self.src[e]] = self.dst[e]
        return out

    def realms(self) -> list[int]:
        globals_, proxies = self.target("global_object"), self.target("global_proxy_object")

        def place(i: int) -> tuple:
            url = self.name[i][len("system / NativeContext / ") :]
            frame = globals_[i] >= 0 and self.name[globals_[i]].startswith("Window")
            main = frame and proxies[i] >= 0 and self.count[proxies[i]] >= 10
            return url.startswith("chrome-extension://"), 0 if main else 1 if frame else 2, i

        return sorted(np.flatnonzero(self.native_context).tolist(), key=place)

    def buckets(self, realms: list[int]) -> np.ndarray:
        """Realm number of each node, or SHARED, or UNATTRIBUTED."""
        number = np.full(self.n + 1, -1)
        number[realms] = np.arange(len(realms))
        hop = lambda t, at: np.where(at >= 0, t[at], -1)
        map_, owner = self.target("map"), self.target("native_context")
        maps_map = hop(map_, map_)
        fixed = number[hop(owner, maps_map)]
        fixed = np.where(number[: self.n] >= 0, number[: self.n], fixed)
        far = len(realms) + 1
        low, high = np.where(fixed >= 0, fixed, far), fixed.copy()
        follow = ~self.shortcut & (self.src != self.dst) & (fixed[self.dst] < 0)
        frontier = np.flatnonzero(fixed >= 0)
        while len(frontier):
            e = self.out(frontier)
            e = e[follow[e]]
            a, b = low.copy(), high.copy()
            np.minimum.at(a, self.dst[e], low[self.src[e]])
            np.maximum.at(b, self.dst[e], high[self.src[e]])
            frontier = np.flatnonzero((a != low) | (b != high))
            low, high = a, b
        return np.where(high < 0, UNATTRIBUTED, np.where(low == high, low, SHARED))

    # -- interfaces -------------------------------------------------------------------

    def interfaces(self) -> np.ndarray:
        """For plain objects the best-matching frequent property list, else None."""
        out = np.full(self.n, None, object)
        plain = np.flatnonzero((self.type == "object") & (self.name == "Object"))
        props: dict[int, list[str]] = {}
        for i in plain:
            e = np.arange(self.first[i], self.first[i] + self.count[i])
            names = [self.edge_name[x] for x in e if self.kind[x] == "property" and self.edge_name[x] != "__proto__"]
            props[int(i)] = names
        counted: dict[str, list] = {}
        for names in props.values():
            taken, text = [], "{"
            for p in names:
                # the list stops before it would outgrow its bytes
                shown = property_name(p)
                if len(text) > 1 and len(text.encode()) + len(shown.encode()) > INTERFACE_BYTES:
                    break
                text += ("" if len(text) == 1 else ", ") + shown
                taken.append(p)
            if taken:
                counted.setdefault(text + "}", [0, taken])[0] += 1
        least = max(INTERFACE_LEAST, len(plain) // INTERFACE_SHARE)
        ranked = sorted(((-n, text, frozenset(p)) for text, (n, p) in counted.items() if n >= least), key=lambda x: x[:2])
        by_property: dict[str, list[int]] = {}
        for k, (_, _, s) in enumerate(ranked):
            by_property.setdefault(min(s), []).append(k)
        for i, names in props.items():
            mine = set(names)
            fits = [k for p in mine for k in by_property.get(p, ()) if ranked[k][2] <= mine]
            if fits:
                out[i] = ranked[min(fits, key=lambda k: (-len(ranked[k][2]), k))][1]
        return out


def analysis(weak_is_reachable: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function for a cogroup of nodes and edges of one snapshot: nodes with the analysis' columns."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        if not len(nodes):
            return nodes.schema.empty_table()
        g = Graph(nodes, edges)
        near = g.distances()
        idom, depth, tin, tout, retained = g.dominators()
        realms = g.realms()
        bucket = g.buckets(realms)
        extra = {
            "distance": pa.array(g.with_unreachable(near, weak_is_reachable), pa.int64()),
            "idom": pa.array(g.ord[idom], pa.int64()),
            "dom_depth": pa.array(depth),
            "tin": pa.array(tin),
            "tout": pa.array(tout),
            "retained_size": pa.array(retained),
            "detachedness": pa.array(g.detachedness().astype(np.int32)),
            "root_kind": pa.array(g.root_kind.tolist(), pa.string()),
            "bucket_kind": pa.array(np.where(bucket >= 0, "Context", np.where(bucket == SHARED, "Shared", "Unattributed")).tolist(), pa.string()),
            "bucket_ctx": pa.array(bucket.astype(np.int32), mask=bucket < 0),
            "context_retention": pa.array(g.retention(near).tolist(), pa.string()),
            "interface": pa.array(g.interfaces().tolist(), pa.string()),
        }
        out = nodes.sort_by("ord")
        for name, column in extra.items():
            out = out.append_column(name, column)
        return out

    return run
