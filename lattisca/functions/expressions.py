"""Lowering of expressions to Spark columns.

An expression's state is known, null, missing or unknown. ``Lowered`` keeps the value as a plain nullable column and
adds a column for missing and one for unknown only where they can occur, so that expressions over required fields are the
bare columns that Catalyst pushes down and joins on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class QueryError(Exception):
    """A plan that cannot be evaluated; code names the rule."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


#: The order of unlike kinds in total comparisons.
KINDS = ("null", "string", "number", "boolean", "array", "record")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, NUMBERS):
        return "number"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.NullType):
        return "null"
    return "record" if isinstance(t, (T.StructType, T.MapType)) else type(t).__name__


def alike(a: T.DataType, b: T.DataType) -> bool:
    """Whether Spark compares values of two types as plans do: the same kinds at every depth, and records of the same fields in order of name."""
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, T.ArrayType):
        return alike(a.elementType, b.elementType)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return a.fieldNames() == b.fieldNames() == sorted(b.fieldNames()) and all(alike(x.dataType, y.dataType) for x, y in zip(a.fields, b.fields))
    return True


def total_order(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """-1, 0 or 1, as a is before, like or after b. Null is first, then strings, numbers, booleans, arrays (item by item) and records (field by field, in order of name)."""
    ka, kb = kind_of(ta), kind_of(tb)
    if ka != kb:
        rank = {k: i for i, k in enumerate(KINDS)}
        out = F.lit(-1 if rank.get(ka, 6) < rank.get(kb, 6) else 1)
    elif ka == "array":
        n = F.least(F.size(a), F.size(b))
        each = F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: total_order(x, ta.elementType, y, tb.elementType)), lambda c: c != 0)
        out = F.when(F.size(each) > 0, F.try_element_at(each, F.lit(1))).otherwise(F.signum(F.size(a) - F.size(b)).cast("int"))
    elif isinstance(ta, T.StructType) and isinstance(tb, T.StructType):
        xs, ys = sorted(ta.fieldNames()), sorted(tb.fieldNames())
        out, pairs = F.lit((len(xs) > len(ys)) - (len(xs) < len(ys))), []
        for x, y in zip(xs, ys):
            if x != y:
                out = F.lit(-1 if x < y else 1)
                break
            pairs.append(total_order(a.getField(x), ta[x].dataType, b.getField(y), tb[y].dataType))
        for c in reversed(pairs):
            out = F.when(c != 0, c).otherwise(out)
    elif ka == "null":
        out = F.lit(0)
    else:
        out = F.when(a < b, -1).when(a == b, 0).otherwise(1)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).otherwise(out)


@dataclass(frozen=True)
class Lowered:
    value: Column
    type: T.DataType
    missing: Column | None = None
    unknown: Column | None = None

    @property
    def kind(self) -> str:
        return kind_of(self.type)

    def settled(self) -> Column:
        """The value; NULL where it is missing or unknown, which every value already is."""
        return self.value

    def no_value(self) -> Column | None:
        """True where the expression is missing or unknown; None if it never is."""
        flags = [c for c in (self.missing, self.unknown) if c is not None]
        return None if not flags else flags[0] if len(flags) == 1 else flags[0] | flags[1]

    def known(self) -> Column:
        none = self.no_value()
        return F.lit(True) if none is None else ~none


def _type_of(value) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, (list, tuple)):
        return T.ArrayType(next((t for v in value if not isinstance(t := _type_of(v), T.NullType)), T.NullType()))
    return T.StructType([T.StructField(k, _type_of(value[k])) for k in sorted(value)])


def constant(value) -> Lowered:
    kind = _type_of(value)
    if isinstance(value, float) and not math.isfinite(value):
        raise QueryError("query.literal_invalid", "numbers are finite")
    if isinstance(value, (list, tuple)):
        return Lowered(F.array(*[constant(v).value for v in value]).cast(kind), kind)
    if isinstance(value, dict):
        return Lowered(F.struct(*[constant(value[k]).value.alias(k) for k in sorted(value)]), kind)
    return Lowered(F.lit(value), kind)


def _nothing(kind: T.DataType | None = None) -> Lowered:
    return Lowered(F.lit(None), kind or T.NullType(), missing=F.lit(True))


def _unknown_if_null(value: Column, kind: T.DataType) -> Lowered:
    return Lowered(value, kind, unknown=value.isNull())


def common_type(types: list[T.DataType]) -> T.DataType:
    real = [t for t in types if not isinstance(t, T.NullType)]
    if not real:
        return T.NullType()
    if all(isinstance(t, NUMBERS) for t in real):
        return real[0] if all(t == real[0] for t in real) else T.DoubleType()
    if any(type(t) is not type(real[0]) for t in real):
        raise QueryError("query.type_mixed", f"one field can't hold {', '.join(t.simpleString() for t in real)}")
    return real[0]


class Lowering:
    """Lowers expressions in a scope: alias -> field -> Lowered, with the enclosing query's scope outside."""

    def __init__(self, scope: dict, parameters: dict, functions: dict, subquery, outer: dict | None = None, meta: dict | None = None):
        self.scope, self.parameters, self.functions, self.subquery, self.outer, self.meta = scope, parameters, functions, subquery, outer or {}, meta or {}

    def __call__(self, e: dict) -> Lowered:
        return getattr(self, "_" + e["kind"].replace("-", "_"))(e)

    def _literal(self, e):
        return constant(e["value"])

    def _parameter(self, e):
        return constant(self.parameters[e["name"]]) if e["name"] in self.parameters else _nothing()

    def _field(self, e):
        if e["alias"] in self.scope:
            return self.scope[e["alias"]].get(e["name"]) or _nothing()
        if e["alias"] in self.outer:
            found = self.outer[e["alias"]].get(e["name"])
            return found or _nothing()
        return _nothing()

    def _key_of(self, e):
        return self.meta.get((e["alias"], "key")) or self.scope.get(e["alias"], {}).get("id") or _nothing()

    def _source_of(self, e):
        return self.meta.get((e["alias"], "source")) or Lowered(F.lit(None).cast("string"), T.StringType(), missing=F.lit(True))

    def _compare(self, e):
        left, right, op = self(e["left"]), self(e["right"]), e["op"]
        a, b = left.value, right.value
        if "null" in (left.kind, right.kind):
            return Lowered(F.lit(None).cast("boolean"), T.BooleanType(), unknown=F.lit(True))
        if not alike(left.type, right.type):
            both = a.isNotNull() & b.isNotNull()
            if op not in ("eq", "ne") and left.kind != right.kind and {left.kind, right.kind} != {"array", "record"}:
                return Lowered(F.lit(None).cast("boolean"), T.BooleanType(), unknown=F.lit(True))
            c = F.when(both, total_order(a, left.type, b, right.type))
            return _unknown_if_null({"eq": c == 0, "ne": c != 0, "lt": c < 0, "lte": c <= 0, "gt": c > 0, "gte": c >= 0}[op], T.BooleanType())
        result = {"eq": a == b, "ne": a != b, "lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[op]
        return _unknown_if_null(result, T.BooleanType())

    def _truth(self, e) -> Column:
        x = self(e)
        return x.value if x.kind == "boolean" else F.lit(None).cast("boolean")

    def _boolean(self, e):
        if e["op"] == "not":
            return _unknown_if_null(~self._truth(e["arg"]), T.BooleanType())
        out = None
        for arg in e["args"]:
            x = self._truth(arg)
            out = x if out is None else out & x if e["op"] == "and" else out | x
        return _unknown_if_null(out, T.BooleanType())

    def _is_null(self, e):
        x = self(e["value"])
        result = x.value.isNull()
        if x.missing is not None:
            result = result & ~x.missing
        if x.unknown is not None:
            return _unknown_if_null(F.when(~x.unknown, result), T.BooleanType())
        return Lowered(result, T.BooleanType())

    def _is_missing(self, e):
        x = self(e["value"])
        return Lowered(F.lit(False) if x.missing is None else x.missing, T.BooleanType())

    def _arithmetic(self, e):
        left, right = self(e["left"]), self(e["right"])
        if left.kind != "number" or right.kind != "number":
            return Lowered(F.lit(None).cast("double"), T.DoubleType(), unknown=F.lit(True))
        a, b = left.value.cast("double"), right.value.cast("double")
        op = e["op"]
        if op == "divide":
            result = F.try_divide(a, b)
        elif op == "modulo":
            result = F.try_mod(a, b)
        else:
            result = a + b if op == "add" else a - b if op == "subtract" else a * b
        finite = F.when((result < float("inf")) & (result > float("-inf")), result)
        return _unknown_if_null(finite, T.DoubleType())

    def _string(self, e):
        args = [self(a) for a in e["args"]]
        kind = T.LongType() if e["op"] == "length" else T.StringType()
        if any(a.kind != "string" for a in args):
            return Lowered(F.lit(None).cast(kind), kind, unknown=F.lit(True))
        v = [a.value for a in args]
        result = F.concat(*v) if e["op"] == "concat" else F.lower(v[0]) if e["op"] == "lower" else F.upper(v[0]) if e["op"] == "upper" else F.char_length(v[0]).cast("bigint")
        return _unknown_if_null(result, kind)

    def _array(self, e):
        items = [self(i) for i in e["items"]]
        kind = common_type([i.type for i in items])
        value = F.array(*[i.value.cast(kind) if i.kind != "null" else F.lit(None).cast(kind) for i in items])
        gone = [c for i in items if (c := i.no_value()) is not None]
        if not gone:
            return Lowered(value, T.ArrayType(kind))
        any_gone = gone[0]
        for c in gone[1:]:
            any_gone = any_gone | c
        return Lowered(F.when(~any_gone, value), T.ArrayType(kind), unknown=any_gone)

    def _record(self, e):
        items = {k: self(v) for k, v in sorted(e["fields"].items())}
        value = F.struct(*[v.value.alias(k) for k, v in items.items()])
        kind = T.StructType([T.StructField(k, v.type) for k, v in items.items()])
        gone = [v.unknown for v in items.values() if v.unknown is not None]
        if not gone:
            return Lowered(value, kind)
        any_gone = gone[0]
        for c in gone[1:]:
            any_gone = any_gone | c
        return Lowered(F.when(~any_gone, value), kind, unknown=any_gone)

    def _pick(self, picks: list[tuple[Column | None, Lowered]]) -> Lowered:
        """The first choice whose condition is true; the last has none."""
        kind = common_type([x.type for _, x in picks])

        def chain(part):
            out = part(picks[-1][1])
            for when, x in reversed(picks[:-1]):
                out = F.when(when, part(x)).otherwise(out)
            return out

        def flag(name):
            if all(getattr(x, name) is None for _, x in picks):
                return None
            return chain(lambda x: F.lit(False) if getattr(x, name) is None else getattr(x, name))

        value = chain(lambda x: x.value if isinstance(kind, T.NullType) or x.type == kind else x.value.cast(kind))
        return Lowered(value, kind, flag("missing"), flag("unknown"))

    def _case(self, e):
        return self._pick([(F.coalesce(self._truth(b["when"]), F.lit(False)), self(b["then"])) for b in e["branches"]] + [(None, self(e["otherwise"]))])

    def _coalesce(self, e):
        picks = []
        for a in e["args"]:
            x = self(a)
            here = x.value.isNotNull()
            picks.append((here | x.unknown if x.unknown is not None else here, Lowered(x.value, x.type, None, x.unknown)))
        return self._pick([*picks, (None, Lowered(F.lit(None), T.NullType()))])

    def _call(self, e):
        name = (e["capability"]["id"], e["capability"].get("version", "1"))
        if name not in self.functions:
            raise QueryError("query.capability_missing", "@".join(name))
        args = [self(a) for a in e["args"]]
        function, kind = self.functions[name]
        gone = None
        for a in args:
            if (c := a.no_value()) is not None:
                gone = c if gone is None else gone | c
        value = function(*[a.value for a in args])
        return Lowered(value, kind) if gone is None else Lowered(F.when(~gone, value), kind, unknown=gone)

    def _subquery(self, e):
        return self.subquery(e, self)
