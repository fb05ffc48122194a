"""Deeply nested records as flat node tables linked by interval labels.

A depth-first walk gives every node of a delivered body a pre-order and a post-order
number. A node lies inside another exactly if its interval lies inside:
``outer.pre < inner.pre and inner.post < outer.post``. ``shred`` emits one row per node,
``node_table`` cuts out the table of one type, ``inside`` links two such tables.

Scale: one pass over the bodies, no shuffle until tables are linked; linking is an
equi-join on (document, record) with the interval test as residual condition, so a large
document spreads over its records and adaptive execution may split a large record.
``array_items`` needs no join at all: it links the items of each body while walking it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.jsonwalk import parse, records

SIDES = ("requestParameters", "responseElements")
SCHEMA = "doc_id long, record_pos long, pre long, post long, level int, node_type string, side string, array_path string, item_pos long, key string, value string"
_OUT = pa.schema([("doc_id", pa.int64()), ("record_pos", pa.int64()), ("pre", pa.int64()), ("post", pa.int64()), ("level", pa.int32()), ("node_type", pa.string()), ("side", pa.string()), ("array_path", pa.string()), ("item_pos", pa.int64()), ("key", pa.string()), ("value", pa.string())])
#: Rows and characters of paths and values per emitted batch, so that one huge body does not
#: become one huge batch. (Paths grow with the depth, so deep nesting writes long ones.)
_BATCH, _CHARS = 20_000, 8_000_000


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def walk(body: str | None) -> Iterator[tuple]:
    """Nodes of one body: (record_pos, pre, post, level, node_type, side, array_path, item_pos, key, value).

    Types: ``record``, ``side`` (an object or array below a side), ``object``, ``array``
    and ``value`` for object members, ``item`` for every array element, null included.
    A side given as JSON text counts like what it says; deeper texts are plain values. A
    record's ``value`` is its userIdentity.arn, or an empty string.
    """
    pre = post = 0
    for pos, record in enumerate(records(body)):
        own, pre = pre, pre + 1
        if not isinstance(record, dict):
            yield pos, own, post, 0, "record", None, None, None, None, ""
            post += 1
            continue
        who = record.get("userIdentity")
        arn = who.get("arn") if isinstance(who, dict) else None
        for side in SIDES:
            root = record.get(side)
            if isinstance(root, str):
                try:
                    root = parse(root) if root.lstrip("﻿ \t\r\n")[:1] in ("{", "[") else None
                except ValueError:
                    root = None
            if not isinstance(root, (dict, list)):
                continue
            # A frame: children still to visit, and the node's own row but for its post number.
            side_pre, pre = pre, pre + 1
            frames = [(_children(root, ""), (side_pre, 1, "side", side, None, None, side, None))]
            while frames:
                todo, node = frames[-1]
                entry = next(todo, None)
                if entry is None:
                    frames.pop()
                    yield pos, node[0], post, *node[1:]
                    post += 1
                    continue
                kind, path, array_path, item_pos, key, child = entry
                row = (pre, len(frames) + 1, kind, side, array_path, item_pos, key, None if isinstance(child, (dict, list)) else _scalar(child))
                pre += 1
                if isinstance(child, (dict, list)):
                    frames.append((_children(child, path), row))
                else:
                    yield pos, row[0], post, *row[1:]
                    post += 1
        yield pos, own, post, 0, "record", None, None, None, None, arn if isinstance(arn, str) else ""
        post += 1


def _children(node: dict | list, path: str) -> Iterator[tuple]:
    """(node_type, path below the side, array_path and item_pos of items, key, child)."""
    if isinstance(node, dict):
        for key, child in node.items():
            kind = "object" if isinstance(child, dict) else "array" if isinstance(child, list) else "value"
            yield kind, f"{path}.{key}" if path else key, None, None, key, child
    else:
        for i, child in enumerate(node):
            yield "item", f"{path}[{i}]", path, i, None, child


def shred(bodies: DataFrame, doc_id: str = "raw_id", body: str = "body", types: tuple[str, ...] | None = None) -> DataFrame:
    """One row per node of every body; see ``walk``. ``types`` keeps only those node types.

    A null, blank or incomplete body has no nodes. Repeated bodies each count under their
    own id. Nesting depth is bounded by memory only, never by recursion.
    """
    wanted = frozenset(types) if types else None

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for node in walk(text.as_py()):
                    if wanted is None or node[4] in wanted:
                        rows.append((doc, *node))
                        chars += len(node[6] or "") + len(node[9] or "")
                        if len(rows) >= _BATCH or chars >= _CHARS:
                            yield _batch(rows)
                            rows, chars = [], 0
        if rows:
            yield _batch(rows)

    return bodies.select(F.col(doc_id).cast("long"), F.col(body)).mapInArrow(flat, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def node_table(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def inside(inner: DataFrame, outer: DataFrame, carry: dict[str, str]) -> DataFrame:
    """Rows of ``inner`` with columns of the ``outer`` node whose interval contains them.

    ``carry``: columns of ``outer`` by their new names.
    """
    held = outer.select(F.col("doc_id").alias("_d"), F.col("record_pos").alias("_r"), F.col("pre").alias("_pre"), F.col("post").alias("_post"), *[F.col(c).alias(n) for n, c in carry.items()])
    on = (F.col("doc_id") == F.col("_d")) & (F.col("record_pos") == F.col("_r")) & (F.col("_pre") < F.col("pre")) & (F.col("post") < F.col("_post"))
    return inner.join(held, on).drop("_d", "_r", "_pre", "_post")


_ITEMS = pa.schema([("raw_id", pa.int64()), ("record_pos", pa.int64()), ("arn", pa.string()), ("side", pa.string()), ("array_path", pa.string()), ("item_pos", pa.int64())])


def linked_items(body: str | None) -> Iterator[tuple]:
    """(record_pos, arn, side, array_path, item_pos) of every item, by the interval of the record that contains it.

    Nodes come in post-order, so a record's items are waiting when the record itself comes:
    the same link as ``inside`` makes between two tables, without a join.
    """
    waiting: list[tuple] = []
    for node in walk(body):
        if node[4] == "item":
            waiting.append(node)
        elif node[4] == "record":
            pos, pre, post, arn = node[0], node[1], node[2], node[9]
            inner = [n for n in waiting if pre < n[1] and n[2] < post]
            yield from ((pos, arn, n[5], n[6], n[7]) for n in inner)
            waiting = waiting if len(inner) < len(waiting) else []


def array_items(bodies: DataFrame, doc_id: str = "raw_id", body: str = "body") -> DataFrame:
    """Every array element of both sides with its way to the record: raw_id, record_pos, arn, side, array_path, item_pos.

    Each body is parsed and labelled once, and its items are linked where they are; nothing
    is shuffled. A null, blank or incomplete body has none; repeated bodies each count.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ITEMS)], schema=_ITEMS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for item in linked_items(text.as_py()):
                    rows.append((doc, *item))
                    chars += len(item[1]) + len(item[3])
                    if len(rows) >= _BATCH or chars >= _CHARS:
                        yield out()
                        rows, chars = [], 0
        if rows:
            yield out()

    schema = "raw_id long, record_pos long, arn string, side string, array_path string, item_pos long"
    return bodies.select(F.col(doc_id).cast("long"), F.col(body)).mapInArrow(flat, schema)
