"""Relations projected from JSON trees: singletons, arrays, object maps and recursive arrays.

A source is a DataFrame of documents with a JSON text column; collections are read with from_json and explode, so each document's
rows are made where the document is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattisca.sources.relations import RelationInput

MAX_DEPTH, MAX_ROWS = 512, 100_000


def _at(column, path: list[str]):
    """The JSON text at a path, or null."""
    return F.get_json_object(column, "$" + "".join(f"['{p}']" for p in path)) if path else column


def project(docs: DataFrame, text: str, mapping: dict, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a mapped relation and the candidates rejected.

    mapping: collection {kind: singleton, array, object-map or recursive-array, path, absent: empty, creatable or invalid, descendants},
    keys and fields: name -> {path, type} | {kind: map-key} | {kind: literal, value} | {kind: position} | {kind: parent} |
    {kind: source-metadata, value} | {kind: absent}. A candidate without a key, or one whose collection is absent where that is invalid,
    is rejected; so is a map entry whose mirrored key differs. An absent collection that is creatable has no rows, as an empty one;
    singletons can't be. keep: columns of docs that identify the document.

    Source metadata: collection-position is a place in an array (pre-order in recursive ones), collection-element-identity
    the document's columns with that place, as a JSON text, and recursive-parent-element-identity that of the parent, null at the top.
    Plain JSON gives its items no other identity, so it changes when items before them come or go. What a collection doesn't have is
    null; as a key it rejects the candidate.
    """
    c = mapping["collection"]
    if c["absent"] not in (("empty", "invalid") if c["kind"] == "singleton" else ("empty", "creatable", "invalid")):
        raise ValueError("mapping.invalid")
    placed = c["kind"] in ("array", "recursive-array")
    identity = lambda place: F.when(F.col(place).isNotNull(), F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in keep], F.col(place).cast("string"))))
    base = docs.select(*keep, _at(F.col(text), c["path"]).alias("_json"))
    none = F.lit(None).cast("string")
    if c["kind"] == "singleton":
        items = base.select(*keep, F.col("_json").alias("_item"), F.lit(0).alias("_position"), none.alias("_map_key"), none.alias("_parent"))
        items = items.filter("_item IS NOT NULL")
    elif c["kind"] == "array":
        items = base.select(*keep, F.posexplode(F.from_json("_json", T.ArrayType(T.StringType()))).alias("_position", "_item")).select("*", none.alias("_map_key"), none.alias("_parent"))
    elif c["kind"] == "object-map":
        entries = F.array_sort(F.map_entries(F.from_json("_json", T.MapType(T.StringType(), T.StringType()))))
        items = base.select(*keep, F.posexplode(entries).alias("_position", "_e")).select(*keep, F.col("_e.value").alias("_item"), "_position", F.col("_e.key").alias("_map_key"), none.alias("_parent"))
    else:
        items = _walk(base, c, mapping, keep)
    columns, bad = [], F.lit(False)
    for name, how in (mapping["keys"] | mapping["fields"]).items():
        kind = how.get("kind")
        if kind == "map-key":
            v = F.col("_map_key")
            if "mirror" in how:
                bad = bad | ~_at(F.col("_item"), how["mirror"]).eqNullSafe(v)
        elif kind == "literal":
            v = F.lit(how["value"])
        elif kind == "position":
            v = F.col("_position").cast("bigint")
        elif kind == "parent":
            v = F.col("_parent")
        elif kind == "source-metadata":
            v = {
                "collection-position": F.col("_position").cast("bigint") if placed else F.lit(None).cast("bigint"),
                "collection-element-identity": identity("_position") if placed else none,
                "recursive-parent-element-identity": identity("_above") if "_above" in items.columns else none,
            }[how["value"]]
        elif kind == "absent":
            v = none
        else:
            v = _at(F.col("_item"), how["path"]).cast(how.get("type", "string"))
        columns.append(v.alias(name))
        if name in mapping["keys"]:
            bad = bad | v.isNull()
    made = items.select("*", bad.alias("_bad"), *[x for x in columns])
    names = list(mapping["keys"] | mapping["fields"])
    rejected = made.filter("_bad").select(*keep, "_item")
    if c["absent"] == "invalid":
        rejected = rejected.unionByName(base.filter("_json IS NULL").select(*keep, F.lit(None).cast("string").alias("_item")))
    return made.filter("NOT _bad").select(*keep, *names), rejected


def relation(docs: DataFrame, text: str, mapping: dict, keep: list[str], source: str | None = None) -> RelationInput:
    """A mapped relation as an input of plans, known by keep and its keys. One rejected candidate makes its completeness unknown."""
    rows, rejected = project(docs, text, mapping, keep)
    return RelationInput(rows, (*keep, *mapping["keys"]), "exact" if rejected.isEmpty() else "unknown", source)


def _walk(base: DataFrame, c: dict, mapping: dict, keep: list[str]) -> DataFrame:
    """Pre-order rows of nested arrays. A tree lives in one document, so it is walked where it is, under depth and row budgets."""
    key = next(iter(mapping["keys"].values())).get("path")
    path, deepest, most = c["descendants"], c.get("maxDepth", MAX_DEPTH), c.get("maxRows", MAX_ROWS)

    def nested(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                tree = json.loads(row["_json"]) if row["_json"] else []
                stack, n = [(x, 0, None, None) for x in reversed(tree)], 0
                while stack:
                    item, depth, parent, above = stack.pop()
                    n += 1
                    if depth > deepest or n > most:
                        raise ValueError("mapping.traversal_budget_exceeded")
                    own, kids = item, item
                    for p in key or []:
                        own = own.get(p) if isinstance(own, dict) else None
                    for p in path:
                        kids = kids.get(p) if isinstance(kids, dict) else None
                    text = json.dumps({k: v for k, v in item.items() if k != path[0]}, ensure_ascii=False) if isinstance(item, dict) else json.dumps(item)
                    out.append({k: row[k] for k in keep} | {"_item": text, "_position": n - 1, "_map_key": None, "_parent": parent, "_above": above})
                    stack += [(x, depth + 1, None if own is None else str(own), n - 1) for x in reversed(kids or [])]
            yield type(pdf)(out, columns=[*keep, "_item", "_position", "_map_key", "_parent", "_above"]).astype({"_above": "Int32"})

    schema = T.StructType([*[base.schema[k] for k in keep], *T.StructType.fromDDL("_item string, _position int, _map_key string, _parent string, _above int").fields])
    return base.mapInPandas(nested, schema)
