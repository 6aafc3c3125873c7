"""Views of a relation through the steps of a schema lens, edits translated back, and paths between schema versions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LensError(Exception):
    pass


def view(df: DataFrame, steps: list[dict], relations: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows seen through steps, and rows rejected with ``_reason``.

    lens.field copies a field under a new name, lens.default adds a constant, lens.hide leaves one out, lens.value-map
    maps values by cases and rejects unmapped ones, lens.lookup finds exactly one row of another relation and rejects none and several.
    """
    fields: dict = {}
    reasons = []
    at = df
    for k, s in enumerate(steps):
        kind = s["kind"]
        if kind == "lens.field":
            fields[s["to"]] = F.col(f"`{s['from']}`")
        elif kind == "lens.default":
            fields[s["to"]] = F.lit(s["value"])
        elif kind == "lens.hide":
            fields.pop(s["from"], None)
        elif kind == "lens.value-map":
            cases = F.create_map(*[F.lit(x) for x in chain(*((c["from"], c["to"]) for c in s["cases"]))])
            v = F.try_element_at(cases, F.col(f"`{s['from']}`"))
            fields[s["to"]] = v
            reasons.append(F.when(v.isNull(), F.lit(f"{s['from']}: unmapped")))
        elif kind == "lens.lookup":
            through = (relations or {})[s["through"]]
            source, result = s["sourceFields"][0], s["resultFields"][0]
            found = through.groupBy(F.col(f"`{source}`").alias(f"#k{k}")).agg(F.count(F.lit(1)).alias(f"#n{k}"), F.first(f"`{result}`").alias(f"#v{k}"))
            at = at.join(found, at[f"`{s['from']}`"].eqNullSafe(found[f"`#k{k}`"]), "left")
            n = F.coalesce(F.col(f"`#n{k}`"), F.lit(0))
            fields[s["to"]] = F.col(f"`#v{k}`")
            reasons.append(F.when(n != 1, F.concat(F.lit(f"{s['from']}: found "), n.cast("string"))))
        else:
            raise LensError("lens.capability_missing")
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    marked = at.withColumn("_reason", reason)
    return marked.filter("_reason IS NULL").select(*[c.alias(n) for n, c in fields.items()]), marked.filter("_reason IS NOT NULL").select(*[F.col(f"`{c}`") for c in df.columns], "_reason")


def lossy(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Warnings of a view: field, value (as text) and n, for each case of a value map that occurs and can't be written back. One row a case."""
    out = df.sparkSession.createDataFrame([], "field string, value string, n bigint")
    for s in steps:
        if s["kind"] == "lens.value-map" and (cases := [c for c in s["cases"] if c["writeBack"] == "reject"]):
            to = F.try_element_at(F.create_map(*[F.lit(x) for c in cases for x in (c["from"], c["to"])]), F.col(f"`{s['from']}`"))
            hit = df.filter(F.col(f"`{s['from']}`").isin(*[c["from"] for c in cases])).select(to.cast("string").alias("value"))
            out = out.unionByName(hit.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s["to"]).alias("field"), "value", "n"))
    return out


def translate(edit: dict, steps: list[dict]) -> dict:
    """An edit of view fields as an edit of stored fields; raises LensError for what a step doesn't let back."""
    out = {}
    for name, value in edit.items():
        step = next((s for s in steps if s.get("to") == name), None)
        if step is None or step["kind"] == "lens.default":
            raise LensError(f"{name}: not writable")
        if step["kind"] in ("lens.field", "lens.lookup"):
            if step["write"] != "invertible" or step["kind"] == "lens.lookup":
                raise LensError(f"{name}: read-only")
            out[step["from"]] = value
        else:
            back = [c for c in step["cases"] if c["to"] == value]
            if len(back) != 1 or back[0]["writeBack"] != "to-from":
                raise LensError(f"{name}: no single value maps to {value!r}")
            out[step["from"]] = back[0]["from"]
    return out


def path(lenses: list[tuple[str, str, str]], start: str, end: str, most: int = 32) -> list[str]:
    """Ids of the lenses, (id, from version, to version), that lead from start to end; raises if there is no path, or more than one."""
    found, frontier = [], [(start, [])]
    for _ in range(most):
        frontier = [(b, [*ids, i]) for at, ids in frontier for i, a, b in lenses if a == at and i not in ids]
        found += [ids for at, ids in frontier if at == end]
    if len(found) != 1 and start != end:
        raise LensError("lens.path_missing" if not found else "lens.path_ambiguous")
    return found[0] if found else []
