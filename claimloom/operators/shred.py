"""Flat tables from deeply nested records by interval labels (problem 4).

Method.  A depth-first traversal numbers every node of a record: ``pre`` when it is entered, ``post`` when it is left,
both from one counter, so that node A encloses node B exactly if ``A.pre < B.pre and B.post < A.post``.  A *shape rule* gives
each node a type from its path of keys.  ``label_nodes`` emits the typed node tables; ``link`` connects child to nearest
enclosing parent by interval containment alone.  A record's intervals never reach beyond the record, so linking is a
binary search over the sorted ``pre`` numbers of one record and needs no shuffle, whatever the number of records.

Values may be wrapped as text (a JSON string that holds JSON); up to three wrappings are taken off.  Text that is no
JSON is one scalar node.  Null and blank records give no nodes, nor do JSON null and empty objects; text that looks like JSON but cannot
be parsed, or is nested beyond what the parser can hold, gives no nodes either.  Repeated rows give repeated nodes (queries apply distinct).
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (type, key value, place) of a node, or None.
Label = tuple[str, "str | None", "int | None"]
Rule = Callable[[tuple, object, "str | int | None"], "Label | None"]


def unwrap(text: str | None):
    """The value of a stored text: parsed JSON, or the text itself where it is no JSON."""
    value = text
    for _ in range(4):
        if not isinstance(value, str):
            return value
        s = value.strip()
        if not s or s == "null":
            return None
        if s[0] not in '[{"':
            return s
        try:
            value = json.loads(s)
        except (ValueError, RecursionError):
            return None
    return value


def label_nodes(value, rule: Rule) -> list[tuple]:
    """(pre, post, depth, type, key, place) of each typed node of one record, by ``pre``.  The traversal keeps its own stack."""
    out: list[list] = []
    clock = 0
    stack: list[tuple] = [(value, (), None, 0, None)]  # value, path of keys, place in the parent, depth, open node
    while stack:
        node, path, place, depth, row = stack.pop()
        clock += 1
        if depth < 0:  # leaving
            if row is not None:
                row[1] = clock
            continue
        label = rule(path, node, place)
        row = None
        if label is not None:
            row = [clock, 0, depth, *label]
            out.append(row)
        stack.append((None, (), None, -1, row))
        if isinstance(node, dict):
            for i, (k, v) in reversed(list(enumerate(node.items()))):
                stack.append((v, (*path, k), i, depth + 1, None))
        elif isinstance(node, list):
            for i in range(len(node) - 1, -1, -1):
                stack.append((node[i], (*path, "*"), i, depth + 1, None))
    return [tuple(r) for r in out]


def link(children: list[tuple], parents: list[tuple]) -> list[int]:
    """For each child the index of the nearest parent whose interval encloses it, or -1.  ``parents`` are sorted by ``pre``."""
    starts = [p[0] for p in parents]
    above: list[int] = []  # nearest enclosing parent of each parent
    for i, p in enumerate(parents):
        j = i - 1
        while j >= 0 and parents[j][1] < p[1]:
            j = above[j]
        above.append(j)
    found = []
    for c in children:
        j = bisect_right(starts, c[0]) - 1
        while j >= 0 and (parents[j][1] < c[1] or parents[j][0] == c[0]):
            j = above[j]
        found.append(j)
    return found


NODE_SCHEMA = "work_id string, source string, pre int, post int, depth int, node_type string, node_key string, place int"
CHILD_SCHEMA = "work_id string, child_kind string, parent_seq int, child_seq int, child_key string"


def _keys(path: tuple) -> tuple:
    return tuple(k for k in path if k != "*")


def topic_rule(path: tuple, node, place) -> Label | None:
    """Topics: a scalar, a list of scalars, an object with an id, or a list of such objects."""
    keys = _keys(path)
    if keys == ("id",) or keys == ():
        if isinstance(node, str) and node.strip():
            return ("topic", node, place)
    return None


def lineage_rule(path: tuple, node, place) -> Label | None:
    """Host organisations: ids in lists, objects, or chains of ``parent`` objects; the outermost comes first."""
    if isinstance(node, str) and node.strip() and all(k in ("lineage", "org", "parent", "id") for k in _keys(path)):
        return ("lineage", node, place)
    return None


def index_rule(path: tuple, node, place) -> Label | None:
    """An inverted index as {token: positions}, a list of {token, positions}, or either below ``InvertedIndex``."""
    p = path[1:] if path[:1] == ("InvertedIndex",) else path
    if len(p) == 1 and p[0] not in ("*", "IndexLength", "InvertedIndex") and isinstance(node, (list, int)):
        if isinstance(node, int) and not isinstance(node, bool):
            return ("token_at", p[0], node)
        return ("entry", p[0], place)
    if p == ("*",) and isinstance(node, dict) and isinstance(node.get("token"), str):
        return ("entry", node["token"], place)
    if isinstance(node, int) and not isinstance(node, bool) and (len(p) == 2 and p[1] == "*" or p[:2] == ("*", "positions") and len(p) <= 3):
        return ("position", None, node)
    if len(p) == 1 and p[0] in ("IndexLength", "InvertedIndex") and isinstance(node, list) and path[0] != "InvertedIndex":
        return ("entry", p[0], place)
    return None


def work_rule(path: tuple, node, place) -> Label | None:
    """A whole work."""
    if not path:
        return None
    head, rest = path[0], path[1:]
    if head == "id" and not rest and isinstance(node, str):
        return ("work", node, None)
    if head == "topics":
        return topic_rule(rest, node, place)
    if head == "abstract_inverted_index":
        return index_rule(rest, node, place)
    if head == "primary_location" and "host_organization_lineage" in path:
        return lineage_rule(path[path.index("host_organization_lineage") + 1 :], node, place)
    if head == "authorships":
        if rest == ("*",):
            return ("authorship", None, place)
        keys = _keys(rest)
        if keys in (("author",), ("author", "id")) and isinstance(node, str):
            return ("author", node, None)
        if keys == ("institutions",) and isinstance(node, dict):
            return ("institution_slot", None, place if rest[-1] == "*" else 0)
        if keys == ("institutions", "id") and isinstance(node, str):
            return ("institution", node, place)
        if keys == ("institutions",) and isinstance(node, str):
            return ("institution_bare", node, place)
    return None


RULES: dict[str, Rule] = {"topics": topic_rule, "lineage": lineage_rule, "index": index_rule, "work": work_rule}


def children(source: str, text: str | None, base: int | None) -> Iterator[tuple[str | None, str, int, int, str]]:
    """Child rows (work id where the record holds it, kind, parent_seq, child_seq, key) of one stored record."""
    value = unwrap(text)
    if value is None:
        return
    nodes = label_nodes(value, RULES[source])
    by: dict[str, list[tuple]] = {}
    for n in nodes:
        by.setdefault(n[3], []).append(n)
    work = by["work"][0][4] if "work" in by else None
    for i, n in enumerate(by.get("topic", ())):
        yield work, "topic", -1, (base or 0) + i, n[4]
    for i, n in enumerate(by.get("lineage", ())):
        yield work, "lineage", -1, i, n[4]
    for n in by.get("token_at", ()):
        yield work, "token", -1, n[5], n[4]
    entries, positions = by.get("entry", []), by.get("position", [])
    for n, j in zip(positions, link(positions, entries), strict=True):
        if j >= 0:
            yield work, "token", -1, n[5], entries[j][4]
    slots = by.get("authorship", [])
    authors = by.get("author", [])
    for n, j in zip(authors, link(authors, slots), strict=True):
        if j >= 0:
            yield work, "author", -1, slots[j][5], n[4]
    places, inst = by.get("institution_slot", []), by.get("institution", [])
    for n, j, k in zip(inst, link(inst, slots), link(inst, places), strict=True):
        if j >= 0 and k >= 0:
            yield work, "institution", slots[j][5], places[k][5], n[4]
    bare = by.get("institution_bare", [])
    for n, j in zip(bare, link(bare, slots), strict=True):
        if j >= 0:
            yield work, "institution", slots[j][5], n[5] or 0, n[4]


def _records(base, topics, abstracts, raw) -> DataFrame:
    none = F.lit(None).cast("int")
    parts = [
        topics.select("work_id", F.lit("topics").alias("source"), F.col("topic_id").alias("body"), F.col("topic_seq").cast("int").alias("base")),
        base.select("work_id", F.lit("lineage").alias("source"), F.col("source_host_organization_lineage_json").alias("body"), none.alias("base")),
        abstracts.select("work_id", F.lit("index").alias("source"), F.col("abstract_inverted_index_json").alias("body"), none.alias("base")),
        raw.select(F.lit(None).cast("string").alias("work_id"), F.lit("work").alias("source"), F.col("payload_json").alias("body"), none.alias("base")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("body is not null")


def shred(base: DataFrame, topics: DataFrame, abstracts: DataFrame, raw: DataFrame, slice_rows: int = 20_000) -> DataFrame:
    """All children of all works as distinct flat rows with parent and position.

    Records are parsed where they are read; only the flat rows are shuffled, once, to drop repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], [], []]

        def flush():
            arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())]
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, ["work_id", "child_kind", "parent_seq", "child_seq", "child_key"])

        for b in batches:
            for work, source, body, seq in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for own, kind, parent, child, key in children(source, body, seq):
                    for c, v in zip(cols, (work if work is not None else own, kind, parent, child, key), strict=True):
                        c.append(v)
                if len(cols[0]) >= slice_rows:
                    yield flush()
        if cols[0]:
            yield flush()

    return _records(base, topics, abstracts, raw).mapInArrow(run, CHILD_SCHEMA).distinct()


def node_tables(base: DataFrame, topics: DataFrame, abstracts: DataFrame, raw: DataFrame) -> DataFrame:
    """The typed node table itself: every labelled node of every record with its interval (filter on node_type for one table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for work, source, body, _ in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                value = unwrap(body)
                if value is None:
                    continue
                nodes = label_nodes(value, RULES[source])
                own = next((n[4] for n in nodes if n[3] == "work"), None)
                rows += [(work if work is not None else own, source, *n) for n in nodes]
            names = ["work_id", "source", "pre", "post", "depth", "node_type", "node_key", "place"]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return _records(base, topics, abstracts, raw).mapInArrow(run, NODE_SCHEMA)
