"""The eleven aggregates, with their own rules for null, missing and unknown, on Spark's partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattisca.functions.expressions import Lowered


def _measure(engine, m: dict, lower, frame) -> tuple[Column, T.DataType, bool]:
    """The aggregate's column, its type, and whether its result can be unknown."""
    op = m["op"]
    if op == "count" and "value" not in m:
        return F.count(F.lit(1)), T.LongType(), False
    x = lower(m["value"])
    v, gone = x.value, x.no_value()
    known = F.lit(True) if gone is None else ~gone
    if op == "count":
        return F.count(v), T.LongType(), False
    if op == "count-distinct":
        return F.count_distinct(v), T.LongType(), False
    if op in ("sum", "average"):
        number = v.cast("double") if x.kind == "number" else F.lit(None).cast("double")
        return (F.sum if op == "sum" else F.avg)(number), T.DoubleType(), False
    if op == "minimum":  # an explicit null is the smallest value
        null = F.max(v.isNull() if gone is None else v.isNull() & known)
        return F.when(~F.coalesce(null, F.lit(False)), F.min(v)), x.type, False
    if op == "maximum":
        return F.max(v), x.type, False
    if op in ("any", "every"):  # strong Kleene: what isn't a boolean is unknown
        b = v if x.kind == "boolean" else F.lit(None).cast("boolean")
        wins = F.coalesce(F.bool_or(b if op == "any" else ~b), F.lit(False))
        settled = F.when(wins, F.lit(op == "any")).when(F.count(F.lit(1)) == F.count(b), F.lit(op == "every"))
        return settled, T.BooleanType(), True
    terms = [*_keys(m.get("orderBy", []), lower), frame.identity()]
    if op == "collect":
        row = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(terms)], v.alias("v"))
        rows = F.collect_list(row if gone is None else F.when(known, row))
        return F.transform(F.array_sort(rows), lambda e: e["v"]), T.ArrayType(x.type), False
    place = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(terms)])
    place = place if gone is None else F.when(known, place)
    boxed = (F.min_by if op == "first" else F.max_by)(F.struct(v.alias("v")), place)
    return boxed["v"], x.type, False


def _keys(terms: list[dict], lower) -> list[Column]:
    """Order terms as values that sort ascending: nulls and missing by a rank of their own, falling numbers negated, falling strings by their inverted bytes."""
    out = []
    for t in terms:
        x, first = lower(t["value"]), t.get("nulls", "last") == "first"
        v = x.value
        rank = F.when(v.isNull(), 1).otherwise(2 if first else 0)
        out.append(rank if x.missing is None else F.when(x.missing, 3 if not first else 2).otherwise(rank * 2 if not first else F.when(v.isNull(), 1).otherwise(4)))
        if t["direction"] == "desc":
            if x.kind == "number":
                v = -v
            elif x.kind == "boolean":
                v = ~v
            elif x.kind == "string":
                v = F.translate(F.hex(F.encode(v, "UTF-8")), "0123456789ABCDEF", "fedcba9876543210")
                v = F.concat(v, F.lit("g"))  # a prefix sorts after what it begins
            else:  # timestamps and dates
                v = -F.unix_micros(v.cast("timestamp"))
        out.append(v)
    return out


def aggregate(engine, frame, node: dict, keys: bool, outer):
    """Groups by a record of expressions: missing, null and unknown make different groups; without groups an empty input has one row."""
    from lattisca.plans.engine import Frame, name

    lower, alias = engine.expressions(frame, outer), node["alias"]
    groups, measures = {f: lower(e) for f, e in node["groupBy"].items()}, {f: _measure(engine, m, lower, frame) for f, m in node["measures"].items()}
    columns, scope = engine.put(frame, alias, groups)
    aggs, shown = [], {}
    for f, (c, kind, unsure) in measures.items():
        at = f"{alias}/{f}~{next(engine.fresh)}"
        aggs.append(c.alias(at))
        shown[f] = Lowered(name(at), kind, None, name(at).isNull() if unsure else None)
    if groups:
        df = frame.df.groupBy(*columns).agg(*aggs) if aggs else frame.df.select(*columns).distinct()
    else:
        df = frame.df.select(*aggs)  # a select stays open to an enclosing query's columns
    ids = {}
    if keys:
        parts = []
        for f in sorted(scope):  # a missing field is left out, an unknown one is marked
            x = scope[f]
            text = F.to_json(F.struct(x.value.alias(f)), {"ignoreNullFields": "false"})
            part = F.substring(text, F.lit(2), F.char_length(text) - 2)
            if x.unknown is not None:
                part = F.when(x.unknown, F.concat(part, F.lit("?"))).otherwise(part)
            parts.append(part if x.missing is None else F.when(~x.missing, part))
        ids[alias] = F.concat(F.lit("aggregate:{"), F.array_join(F.array(*parts), ",") if parts else F.lit(""), F.lit("}"))
    return Frame(df, {alias: scope | shown}, ids)
