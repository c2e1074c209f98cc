"""Small graphs, written as files of the snapshot format."""

import json

NODE_TYPES = ["hidden", "array", "string", "object", "code", "closure", "regexp", "number", "native", "synthetic", "concatenated string", "sliced string", "symbol", "bigint"]
EDGE_TYPES = ["context", "element", "property", "internal", "hidden", "shortcut", "weak"]


class Heap:
    """Nodes by name; ``root`` and ``R`` (the GC roots) are there from the start."""

    def __init__(self, detachedness=False, traced=False):
        self.nodes, self.edges, self.names = [], [], {}
        self.detachedness, self.traced = detachedness, traced
        self.more = {}
        self.add("root", "synthetic", "", 0)
        self.add("R", "synthetic", "(GC roots)", 0)
        self.link("root", "R", "element", 1)

    def add(self, key, kind="object", name=None, size=0, det=0, trace=0, id=None):
        self.names[key] = len(self.nodes)
        self.nodes.append((kind, key if name is None else name, id or 2 * len(self.nodes) + 1, size, det, trace))
        return self

    def link(self, a, b, kind="property", name=None):
        self.edges.append((self.names[a], self.names[b], kind, b if name is None else name))
        return self

    def chain(self, *keys, kind="property"):
        for a, b in zip(keys, keys[1:]):
            self.link(a, b, kind)
        return self

    def id(self, key):
        return self.nodes[self.names[key]][2]

    def content(self):
        strings, at = [], {}

        def s(text):
            if text not in at:
                at[text] = len(strings)
                strings.append(text)
            return at[text]

        fields = ["type", "name", "id", "self_size", "edge_count"] + ["detachedness"] * self.detachedness + ["trace_node_id"] * self.traced
        nodes, edges, out = [], [], {}
        for e in self.edges:
            out.setdefault(e[0], []).append(e)
        for i, (kind, name, id_, size, det, trace) in enumerate(self.nodes):
            mine = out.get(i, [])
            nodes += [NODE_TYPES.index(kind), s(name), id_, size, len(mine)] + [det] * self.detachedness + [trace] * self.traced
            for _, to, ekind, ename in mine:
                edges += [EDGE_TYPES.index(ekind), ename if ekind in ("element", "hidden") else s(ename), to * len(fields)]
        meta = {"node_fields": fields, "node_types": [NODE_TYPES] + ["number"] * (len(fields) - 1), "edge_fields": ["type", "name_or_index", "to_node"], "edge_types": [EDGE_TYPES, "string_or_number", "node"]}
        for key in ("location_fields", "sample_fields", "trace_function_info_fields", "trace_node_fields"):
            if key in self.more:
                meta[key] = self.more[key]
        body = {k: v for k, v in self.more.items() if not k.endswith("_fields")}
        if "trace_function_infos" in body:
            body["trace_function_infos"] = [s(x) if isinstance(x, str) else x for x in body["trace_function_infos"]]
        if "locations" in body:
            body["locations"] = [self.names[x] * len(fields) if isinstance(x, str) else x for x in body["locations"]]
        return json.dumps({"snapshot": {"meta": meta, "node_count": len(self.nodes), "edge_count": len(self.edges)}, "nodes": nodes, "edges": edges, "strings": strings, **body}).encode()

    def graph(self):
        """The kernel's graph."""
        from heaploom.plans.kernel import Graph
        from heaploom.sources.heapsnapshot import Snapshot

        s = Snapshot(self.content())
        return Graph(s.nodes(), s.edges())

    def by_name(self, values):
        return {k: values[i] for k, i in self.names.items()}
