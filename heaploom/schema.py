"""Tables of a snapshot. All ids, counts and sizes are BIGINT; a snapshot is a key, not a file."""

from __future__ import annotations

from dataclasses import dataclass

NODES = "snapshot_id bigint, ord bigint, type string, name string, id bigint, self_size bigint, edge_count bigint, raw_detachedness int, trace_node_id bigint"
EDGES = "snapshot_id bigint, eid bigint, src bigint, dst bigint, type string, name string, idx bigint, pos bigint"
LOCATIONS = "snapshot_id bigint, seq bigint, ord bigint, script_id bigint, line bigint, col bigint"
SAMPLES = "snapshot_id bigint, seq bigint, timestamp_us bigint, last_assigned_id bigint"
TRACE_NODES = "snapshot_id bigint, id bigint, parent bigint, func_idx bigint"
TRACE_FUNCTIONS = "snapshot_id bigint, idx bigint, function_name string, script_name string, script_id bigint, line bigint, col bigint"
SNAPSHOTS = "snapshot_id bigint, path string, node_count bigint, edge_count bigint, root_ord bigint, extra_native_bytes bigint, has_detachedness boolean, has_trace boolean"

#: Columns that the analysis adds to a node.
ANALYSIS = "distance bigint, idom bigint, dom_depth bigint, tin bigint, tout bigint, retained_size bigint, detachedness int, root_kind string, bucket_kind string, bucket_ctx int, context_retention string, interface string"

#: Fixed values of the distance column: no distance, and the first unreachable depth.
NO_DISTANCE = (1 << 32) - 1
UNREACHABLE_BASE = ((1 << 32) - 1) // 2

GC_ROOTS = "(GC roots)"
DOM_TREES = "(Document DOM trees)"
#: Edge types whose names are numbers.
INDEXED_EDGES = ("element", "hidden")

#: Fixed words of the names that the runtime gives to edges of WeakMap pairs, in their order.
PAIR_WORDS = (" / part of key (", ") -> value (", ") pair in WeakMap (table @")


@dataclass(frozen=True)
class WeakPair:
    """What such a name tells: its part after the number, the labels and ids of key and value, and the table's id."""

    text: str
    key: tuple[str, int]
    value: tuple[str, int]
    table: int


def weak_pair(name: str) -> WeakPair | None:
    """The parts of a pair's name; None for other names."""
    number, first, rest = name.partition(PAIR_WORDS[0])
    key, second, rest = rest.partition(PAIR_WORDS[1])
    value, third, table = rest.partition(PAIR_WORDS[2])
    ends = [part.rpartition(" @") for part in (key, value)]
    digits = [number, ends[0][2], ends[1][2], table[:-1]]
    if not (first and second and third and table.endswith(")") and all(d.isascii() and d.isdigit() for d in digits)):
        return None
    (k, _, key_id), (v, _, value_id) = ends
    return WeakPair(name[len(number) :], (k, int(key_id)), (v, int(value_id)), int(table[:-1]))
