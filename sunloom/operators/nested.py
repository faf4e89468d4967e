"""Nested site records to flat tables, linked by interval labels.

Every value of a body is a node of a tree.  A depth-first traversal gives each
node a pre-order and a post-order number; node ``a`` is an ancestor of ``b`` of
the same body exactly if ``a.pre < b.pre`` and ``b.post < a.post``.  The typed
nodes (site, mount, inverter, string, module) become rows, and the parent of a
row is found by interval containment, in one pass over the nodes of a body in
pre-order, so no pairs of nodes are formed.

Defined results
* null, empty, truncated or otherwise unreadable bodies, bodies that are JSON
  but no object, and bodies nested deeper than the JSON reader goes: no rows in
  the flat tables, one row with the reason in ``rejected_bodies``;
* parts that are absent or null: no rows; a part that is JSON text is read as
  if it stood there itself;
* a collection may be a list, an object keyed by name, or a single element;
  ``{}`` in place of strings or modules is one element without fields;
* field names match in any letter case, a repeated key keeps its last value;
* repeated ids give repeated rows, a repeated ``json_id`` too (each of its bodies
  is labelled and linked for itself); extra columns of the input are ignored;
* an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunloom.session import cut_lineage, ship

NODE_SCHEMA = (
    "json_id long, body_no long, entity string, pre int, post int, depth int, position int, "
    "ident string, number int, attrs map<string,string>"
)
_NAMED = re.compile(r"\s*(mount|inverter)\s*(\d{1,9})\s*", re.IGNORECASE)
#: Names of a collection's field by the entity it holds.
_PARTS = {"mount": "mount", "mounts": "mount", "inverters": "inverter", "inverter": "inverter", "strings": "string", "modules": "module"}
#: Entity in which a collection may stand: at the root or in the site record, or in its parent.
_PLACES = {"mount": ("root", "site"), "inverter": ("root", "site"), "string": ("inverter",), "module": ("string",)}
#: Fields that show an object to be one element and not a collection keyed by name.
_OWN_FIELDS = {"mount": {"tilt", "azimuth", "name"}, "inverter": {"inverter_id", "strings", "name"}}


def _opened(value):
    """The value, or what its text holds if that is a JSON object or list."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _members(entity: str, value) -> list[tuple[str | None, object]]:
    """(key, element) of each element of a collection in any of its shapes."""
    value = _opened(value)
    if isinstance(value, list):
        return [(None, _opened(x)) for x in value]
    if isinstance(value, dict):
        own = _OWN_FIELDS.get(entity)
        if own is None or (value and own & {k.lower() for k in value}):
            return [(None, value)]
        return [(k, _opened(x)) for k, x in value.items()]
    return []


def read_body(body: str | None) -> tuple[dict | None, str | None]:
    """(root object, None), or (None, reason) of a body that has none."""
    if body is None or not body.strip():
        return None, "empty"
    try:
        root = json.loads(body)
    except RecursionError:
        return None, "too deep"
    except ValueError:
        return None, "no JSON"
    return (root, None) if isinstance(root, dict) else (None, "no object")


def label_body(body: str | None, with_attrs: bool = True) -> list[tuple]:
    """The typed nodes of one body: (entity, pre, post, depth, position, ident, number, attrs)."""
    root, reason = read_body(body)
    if reason:
        return []
    rows: list[list] = []
    pre = post = 0
    # A frame holds (entity of the node, its row or None, its remaining children); the walk is iterative, so depth is no limit.
    stack = [("root", None, iter(_children("root", root)))]
    pre += 1
    while stack:
        kind, row, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            post += 1
            if row is not None:
                row[2] = post
            stack.pop()
            continue
        entity, key, position, value = step
        pre += 1
        made = None
        if entity in ("site", "mount", "inverter", "string", "module"):
            made = [entity, pre, 0, len(stack), position, *_identity(entity, key, position, value), _attrs(value) if with_attrs else None]
            rows.append(made)
        stack.append((entity, made, iter(_children(entity, value))))
    return [tuple(r) for r in rows]


def _children(entity: str, value) -> list[tuple]:
    """Children of a node in the order in which they stand: (entity, key, position, value)."""
    out: list[tuple] = []
    if isinstance(value, dict):
        for key, x in value.items():
            low = key.lower()
            part = _PARTS.get(low)
            if part and entity in _PLACES[part]:
                out += [(part, k, i, v) for i, (k, v) in enumerate(_members(part, x), 1) if isinstance(v, dict)]
            elif low == "site" and entity == "root":
                x = _opened(x)
                if isinstance(x, dict):
                    out.append(("site", None, 1, x))
            else:
                out.append(("value", key, 0, x))
    elif isinstance(value, list):
        out = [("value", None, i, x) for i, x in enumerate(value, 1)]
    return out


def _identity(entity: str, key: str | None, position: int, value: dict) -> tuple[str, int | None]:
    low = {k.lower(): v for k, v in value.items()}
    if entity == "site":
        return "", None
    if entity in ("mount", "inverter"):
        name = key if key is not None else low.get("name")
        name = str(name) if name not in (None, "") else f"{entity.capitalize()} {position}"
        if m := _NAMED.fullmatch(name):
            return f"{m[1].capitalize()} {int(m[2])}", int(m[2])
        return name, None
    ident = low.get("string_id" if entity == "string" else "serial")
    if ident is None or str(ident).strip() == "":
        return f"#{position}", None
    return str(ident), None


def _attrs(value: dict) -> dict[str, str]:
    return {k.lower(): v if isinstance(v, str) else json.dumps(v) for k, v in value.items() if v is not None and not isinstance(v, (dict, list))}


def site_nodes(bodies: DataFrame, id_col: str = "json_id", body_col: str = "body", with_attrs: bool = True) -> DataFrame:
    """All typed nodes of all bodies with their interval labels (``NODE_SCHEMA``)."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["json_id", "body_no", "entity", "pre", "post", "depth", "position", "ident", "number", "attrs"]
        for batch in batches:
            rows = [(i, n, *node) for i, n, body in zip(batch.json_id, batch.body_no, batch.body) for node in label_body(body, with_attrs)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"number": "Int32", "pre": "int32", "post": "int32", "depth": "int32", "position": "int32"})

    ship(bodies.sparkSession)
    source = bodies.select(F.col(id_col).cast("long").alias("json_id"), F.monotonically_increasing_id().alias("body_no"), F.col(body_col).cast("string").alias("body"))
    return source.mapInPandas(label, NODE_SCHEMA)


def link_nodes(nodes: DataFrame) -> DataFrame:
    """Add ``entity_key`` and ``parent_key`` to labelled nodes by interval containment.

    The nodes of a body are met in pre-order; the enclosing inverter or string of a
    node is the last one met, provided its interval holds the node's.
    """
    body = Window.partitionBy("json_id", "body_no")
    met = body.orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    same_number = Window.partitionBy("json_id", "body_no", "number")

    def enclosing(entity: str):
        return F.last(F.when(F.col("entity") == entity, F.struct("ident", "post")), ignorenulls=True).over(met)

    linked = nodes.withColumns({"inv": enclosing("inverter"), "str": enclosing("string")}).withColumns(
        {
            "mount": F.max(F.when((F.col("entity") == "mount") & F.col("number").isNotNull(), F.col("ident"))).over(same_number),
            "inv_key": F.when(F.col("inv.post") >= F.col("post"), F.col("inv.ident")),
        }
    ).withColumn("str_key", F.when(F.col("str.post") >= F.col("post"), F.concat_ws("/", "inv_key", "str.ident")))
    entity = F.col("entity")
    return linked.select(
        "json_id",
        "body_no",
        "entity",
        F.when(entity == "string", F.col("str_key")).when(entity == "module", F.concat_ws("/", "str_key", "ident")).otherwise(F.col("ident")).alias("entity_key"),
        F.when(entity == "inverter", F.coalesce("mount", F.lit("")))
        .when(entity == "string", F.col("inv_key"))
        .when(entity == "module", F.col("str_key"))
        .otherwise(F.lit(""))
        .alias("parent_key"),
        "pre",
        "post",
        "depth",
        "position",
        "attrs",
    )


def rejected_bodies(bodies: DataFrame, id_col: str = "json_id", body_col: str = "body") -> DataFrame:
    """(json_id, reason) of each body that gives no rows because it can't be read: empty, no JSON, no object, too deep."""

    def reasons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reason = [read_body(b)[1] for b in batch.body]
            yield batch.assign(reason=reason).loc[[r is not None for r in reason], ["json_id", "reason"]]

    ship(bodies.sparkSession)
    return bodies.select(F.col(id_col).cast("long").alias("json_id"), F.col(body_col).cast("string").alias("body")).mapInPandas(reasons, "json_id long, reason string")


#: Fields of an entity's own table; all other fields that a record has are in ``attrs``.
FIELDS = {
    "site": ("location", "longitude", "latitude"),
    "mount": ("tilt", "azimuth"),
    "inverter": ("inverter_id",),
    "string": ("string_id", "fuse_a"),
    "module": ("serial", "wp"),
}
NUMBERS = {"longitude", "latitude", "tilt", "azimuth", "fuse_a", "wp"}


def _field(name: str):
    return (F.col("attrs")[name].try_cast("double") if name in NUMBERS else F.col("attrs")[name]).alias(name)


def flat_rows(bodies: DataFrame, id_col: str = "json_id", body_col: str = "body") -> DataFrame:
    """The rows of all entities under one another, in one pass: keys, interval labels, each entity's fields (null for the others) and ``attrs`` with all fields."""
    nodes = link_nodes(site_nodes(bodies, id_col, body_col))
    names = dict.fromkeys(n for fields in FIELDS.values() for n in fields)
    return nodes.select("json_id", "entity", "entity_key", "parent_key", "pre", "post", *[_field(n) for n in names], "attrs")


def flatten_sites(bodies: DataFrame, id_col: str = "json_id", body_col: str = "body") -> dict[str, DataFrame]:
    """One flat table for each entity type, linked by ``parent_key`` and by interval labels; the bodies are labelled once for all of them."""
    rows = cut_lineage(flat_rows(bodies, id_col, body_col))
    keys = ("json_id", "entity_key", "parent_key", "pre", "post")
    return {entity: rows.filter(F.col("entity") == entity).select(*keys, *names, "attrs") for entity, names in FIELDS.items()}


def found(bodies: DataFrame) -> DataFrame:
    """Mounts, inverters, strings and modules of each body with their keys and their parents' keys."""
    nodes = link_nodes(site_nodes(bodies, with_attrs=False))
    return nodes.filter(F.col("entity") != "site").select("json_id", "entity", "entity_key", "parent_key")
