"""Evaluation of plans: validation and completeness on the driver, then one DataFrame for Catalyst to plan.

Physical columns are named ``alias/field``; a scope maps aliases and fields to lowered columns, so renames and omissions
cost nothing and unused columns are pruned at the scan. Row identities, which break ties and make result keys, are
built only where a node above asks for them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattisca.functions.expressions import Lowered, Lowering, QueryError, common_type, constant
from lattisca.operators import aggregates, joins, windows
from lattisca.plans.completeness import EXACT, UNKNOWN, completeness
from lattisca.plans.nodes import plan_id
from lattisca.plans.validate import validate
from lattisca.sources.relations import RelationInput

Scope = dict[str, dict[str, Lowered]]


def name(*parts: str) -> Column:
    return F.col("`" + "/".join(parts).replace("`", "``") + "`")


@dataclass(frozen=True)
class Frame:
    """Rows in the middle of a plan. ids: alias -> occurrence column, if asked for; order: sort columns that hold, if any; meta: (alias, "key" or "source") -> column."""

    df: DataFrame
    scope: Scope
    ids: dict[str, Column] = field(default_factory=dict)
    order: tuple[Column, ...] | None = None
    meta: dict = field(default_factory=dict)

    def identity(self) -> Column:
        """The row's result key: each alias in order of name with its occurrence, both length-prefixed."""
        parts = []
        for alias in sorted(self.ids):
            occ = self.ids[alias]
            parts.append(F.when(occ.isNotNull(), F.concat(F.lit(f"{len(alias)}:{alias}"), F.char_length(occ).cast("string"), F.lit(":"), occ)).otherwise(F.lit("")))
        return F.concat(*parts) if parts else F.lit("")

    def columns(self) -> list[tuple[str, str, Lowered]]:
        return [(a, f, x) for a, fields in sorted(self.scope.items()) for f, x in fields.items()]


@dataclass(frozen=True)
class Result:
    """df: the visible rows. keys: they have a column of result keys, ``_key``. Without completeness there are no rows and issues say why."""

    df: DataFrame | None
    completeness: str
    issues: tuple[str, ...] = ()


class Engine:
    """One evaluation: relations (name -> inputs), parameters, functions ((id, version) -> (column function, type))."""

    #: Whether joins count their pairs before.
    counts_pairs = True

    def __init__(self, spark: SparkSession, relations: dict[str, list[RelationInput]], parameters: dict | None = None, functions: dict | None = None, basis=None, membership: int = 0):
        self.spark, self.relations, self.parameters, self.functions = spark, relations, parameters or {}, functions or {}
        self.basis, self.membership = basis, membership
        self.frontiers: dict[str, Frame] = {}
        self.frontier_keys: dict[str, list[dict]] = {}
        self.issues: list[str] = []
        self.fresh = itertools.count()

    # Entry points.

    def evaluate(self, root: dict, keys: bool = False, keep_status: bool = False) -> Result:
        """Validates root, folds completeness and lowers it. A plan that fails a check raises QueryError; one over incomplete inputs gives completeness ``unknown``."""
        problems = validate(root, set(self.relations), set(self.parameters) if self.parameters else None)
        if problems:
            raise QueryError("query.plan_invalid", "; ".join(f"{p}: {c}" for p, c in problems))
        issues: list[str] = []
        known = completeness(root, {r: [i.completeness for i in own] for r, own in self.relations.items()}, issues)
        if known == UNKNOWN:
            return Result(None, UNKNOWN, tuple(issues))
        try:
            return Result(self.visible(self.lower(root, keys), keys, keep_status), known, tuple(self.issues))
        except QueryError as e:
            if e.code in ("query.plan_invalid", "query.type_mixed", "query.literal_invalid"):
                raise
            return Result(None, UNKNOWN, (e.code,))

    def visible(self, frame: Frame, keys: bool = False, keep_status: bool = False) -> DataFrame:
        """One alias: its fields. Several: a struct of each. Missing and unknown values are NULL; keep_status tells them apart in ``field?missing`` and ``field?unknown``."""

        def fields(alias):
            out = []
            for f, x in frame.scope[alias].items():
                out.append(x.value.alias(f))
                if keep_status:
                    out += [c.alias(f"{f}?{k}") for k, c in (("missing", x.missing), ("unknown", x.unknown)) if c is not None]
            return out

        key = [frame.identity().alias("_key")] if keys else []
        if len(frame.scope) == 1:
            return frame.df.select(*fields(next(iter(frame.scope))), *key)
        return frame.df.select(*[F.struct(*fields(a)).alias(a) if frame.scope[a] else F.struct().alias(a) for a in sorted(frame.scope)], *key)

    # Lowering.

    def lower(self, node: dict, keys: bool = False, outer: Frame | None = None) -> Frame:
        return getattr(self, "_" + node["kind"].replace("-", "_"))(node, keys, outer)

    def expressions(self, frame: Frame, outer: Frame | None = None) -> Lowering:
        def subquery(e, _):
            return self.subquery(e, frame)

        outside = {a: {f: Lowered(x.value.outer(), x.type, *(c.outer() if c is not None else None for c in (x.missing, x.unknown))) for f, x in fields.items()} for a, fields in outer.scope.items()} if outer else None
        return Lowering(frame.scope, self.parameters, self.functions, subquery, outside, frame.meta)

    def subquery(self, e: dict, frame: Frame) -> Lowered:
        """Correlated subqueries are left to Catalyst, which turns them into joins."""
        inner = self.lower(e["query"], False, frame)
        if e["mode"] == "exists":
            return Lowered(inner.df.exists(), T.BooleanType())
        cells = [x for _, _, x in inner.columns()]
        if len(cells) != 1:
            raise QueryError("query.scalar_subquery_cardinality")
        found = inner.df.select(F.struct(F.count(F.lit(1)).alias("n"), F.first(cells[0].value).alias("v")).alias("r")).scalar()
        value = F.when(found["n"] == 1, found["v"])
        return Lowered(value, cells[0].type, unknown=F.coalesce(found["n"] != 1, F.lit(True)))

    def put(self, frame: Frame, alias: str, fields: dict[str, Lowered]) -> tuple[list[Column], dict[str, Lowered]]:
        """New physical columns for fields, and the scope of them."""
        columns, scope = [], {}
        for f, x in fields.items():
            at = f"{alias}/{f}~{next(self.fresh)}"
            columns.append(x.value.alias(at))
            flags = {}
            for k in ("missing", "unknown"):
                c = getattr(x, k)
                if c is not None:
                    columns.append(c.alias(f"{at}?{k}"))
                    flags[k] = name(f"{at}?{k}")
            scope[f] = Lowered(name(at), x.type, flags.get("missing"), flags.get("unknown"))
        return columns, scope

    def held(self, frame: Frame, values: dict[str, Column]) -> tuple[list[Column], dict[str, Column]]:
        columns, names = [], {}
        for k, c in values.items():
            at = f"#{k}~{next(self.fresh)}"
            columns.append(c.alias(at))
            names[k] = name(at)
        return columns, names

    def _from(self, node, keys, outer):
        relation, alias, frames = node["relation"], node["alias"], []
        if relation not in self.relations:
            raise QueryError("query.relation_missing", relation)
        for own in self.relations[relation]:
            df = own.df
            fields = {f.name: Lowered(F.col(f"`{f.name}`"), f.dataType, F.col(f"`{f.name}`").isNull() if f.name in own.optional else None) for f in df.schema.fields}
            columns = [x.value.alias(f"{alias}/{f}") for f, x in fields.items()]
            scope = {f: Lowered(name(alias, f), x.type, name(alias, f).isNull() if x.missing is not None else None) for f, x in fields.items()}
            ids, meta = {}, {}
            if keys:
                columns.append(own.occurrence_id(relation).alias(f"#id/{alias}"))
                ids[alias] = name("#id", alias)
            if own.source is not None or len(self.relations[relation]) > 1:
                columns.append(F.lit(own.source).cast("string").alias(f"#source/{alias}"))
                meta[alias, "source"] = Lowered(name("#source", alias), T.StringType(), name("#source", alias).isNull())
            frames.append(Frame(df.select(*columns), {alias: scope}, ids, None, meta))
        out = frames[0]
        for more in frames[1:]:
            out = self.stack(out, more, keys)
        return out

    def _values(self, node, keys, outer):
        alias, rows = node["alias"], node["rows"]
        names = list(dict.fromkeys(k for r in rows for k in r))
        kinds = {k: common_type([constant(r[k]).type for r in rows if k in r]) for k in names}
        gaps = [k for k in names if any(k not in r for r in rows)]
        schema = T.StructType([T.StructField(f"{alias}/{k}", kinds[k]) for k in names] + [T.StructField(f"{alias}/{k}?missing", T.BooleanType()) for k in gaps] + [T.StructField(f"#id/{alias}", T.StringType())])

        def cell(v, kind):
            return float(v) if isinstance(kind, T.DoubleType) and isinstance(v, int) else v

        data = [tuple([cell(r.get(k), kinds[k]) for k in names] + [k not in r for k in gaps] + [f"values:{i}"]) for i, r in enumerate(rows)]
        df = self.spark.createDataFrame(data, schema)
        scope = {k: Lowered(name(alias, k), kinds[k], name(alias, f"{k}?missing") if k in gaps else None) for k in names}
        return Frame(df, {alias: scope}, {alias: name("#id", alias)} if keys else {}, None)

    def _recursion_ref(self, node, keys, outer):
        if node["name"] not in self.frontiers:
            raise QueryError("query.recursion_reference_missing", node["name"])
        return self.frontiers[node["name"]]

    def _where(self, node, keys, outer):
        frame = self.lower(node["input"], keys, outer)
        test = self.expressions(frame, outer)(node["predicate"])
        if test.kind != "boolean":
            return replace(frame, df=frame.df.filter(F.lit(False)))
        return replace(frame, df=frame.df.filter(test.value if test.missing is None else test.value & ~test.missing))

    def _select(self, node, keys, outer):
        frame = self.lower(node["input"], keys, outer)
        lower = self.expressions(frame, outer)
        columns, scope = self.put(frame, node["alias"], {f: lower(e) for f, e in node["fields"].items()})
        ids = {node["alias"]: F.concat(frame.identity(), F.lit(":select"))} if keys else {}
        kept, ids = self.held(frame, ids)
        sort, order = self.held(frame, dict(enumerate(frame.order or ())))
        return Frame(frame.df.select(*columns, *kept, *sort), {node["alias"]: scope}, ids, tuple(order.values()) or None)

    def overlay(self, frame: Frame, alias: str, fields: dict[str, Lowered]) -> Frame:
        columns, scope = self.put(frame, alias, fields)
        return replace(frame, df=frame.df.select("*", *columns), scope=frame.scope | {alias: frame.scope[alias] | scope})

    def _with_fields(self, node, keys, outer):
        frame = self.lower(node["input"], keys, outer)
        if node["alias"] not in frame.scope:
            raise QueryError("query.alias_missing", node["alias"])
        lower, old, new = self.expressions(frame, outer), frame.scope[node["alias"]], {}
        for f, e in node["fields"].items():
            x = lower(e)
            if x.missing is not None and f in old:  # a missing value leaves the old one in place
                kind = common_type([old[f].type, x.type])
                flags = [F.when(x.missing, F.lit(False) if o is None else o).otherwise(F.lit(False) if n is None else n) if o is not None or n is not None else None for o, n in ((old[f].missing, None), (old[f].unknown, x.unknown))]
                x = Lowered(F.when(x.missing, old[f].value.cast(kind)).otherwise(x.value.cast(kind)), kind, *flags)
            new[f] = x
        return self.overlay(frame, node["alias"], new)

    def _rename(self, node, keys, outer):
        frame = self.lower(node["input"], keys, outer)
        fields = {node["fields"].get(f, f): x for f, x in frame.scope[node["alias"]].items()}
        return replace(frame, scope=frame.scope | {node["alias"]: fields})

    def _omit(self, node, keys, outer):
        frame = self.lower(node["input"], keys, outer)
        return replace(frame, scope=frame.scope | {node["alias"]: {f: x for f, x in frame.scope[node["alias"]].items() if f not in node["fields"]}})

    def _unnest(self, node, keys, outer):
        frame = self.lower(node["input"], keys, outer)
        x = self.expressions(frame, outer)(node["expression"])
        if x.kind != "array":
            item, values = T.NullType(), F.expr("CAST(NULL AS ARRAY<INT>)")
        else:
            item, values = x.type.elementType, x.value
        at = f"{node['alias']}/{node['field']}~{next(self.fresh)}"
        if keys:
            df = frame.df.select("*", F.posexplode(values).alias(at + "#pos", at))
            ids = frame.ids | {node["alias"]: F.concat(frame.identity(), F.lit(":"), name(at + "#pos").cast("string"))}
        else:
            df, ids = frame.df.select("*", F.explode(values).alias(at)), {}
        return replace(frame, df=df, scope=frame.scope | {node["alias"]: {node["field"]: Lowered(name(at), item)}}, ids=ids)

    def _join(self, node, keys, outer):
        how = node["join"]
        left = self.lower(node["left"], keys, outer)
        right = self.lower(node["right"], keys and how not in ("semi", "anti"), outer)
        both = Frame(left.df, left.scope | right.scope, {}, None, left.meta | right.meta)
        on = None
        if "on" in node:
            test = self.expressions(both, outer)(node["on"])
            on = test.value if test.kind == "boolean" else F.lit(False)
        if how in ("semi", "anti"):
            return replace(left, df=left.df.join(right.df, F.lit(True) if on is None else on, f"left_{how}"))
        scope = right.scope
        if how == "left":
            mark = f"#match~{next(self.fresh)}"
            df = left.df.join(right.df.select("*", F.lit(True).alias(mark)), F.lit(True) if on is None else on, "left")
            gone = name(mark).isNull()
            scope = {a: {f: Lowered(x.value, x.type, gone if x.missing is None else gone | x.missing, None if x.unknown is None else ~gone & x.unknown) for f, x in fields.items()} for a, fields in scope.items()}
        elif on is None:
            df = left.df.crossJoin(right.df)
        elif outer is None and test.kind == "boolean" and (many := joins.blocks(self, node, left, right, keys)):
            left, right, df = many
            scope = right.scope
        else:
            df = left.df.join(right.df, on, "inner")
        return Frame(df, left.scope | scope, left.ids | right.ids if keys else {}, None, left.meta | right.meta)

    def _aggregate(self, node, keys, outer):
        ordered = any(m["op"] in ("collect", "first", "last") for m in node["measures"].values())
        frame = self.lower(node["input"], ordered, outer)
        return aggregates.aggregate(self, frame, node, keys, outer)

    def _distinct(self, node, keys, outer):
        return self.unique(self.lower(node["input"], keys, outer), keys)

    def flat(self, frame: Frame, keys: bool, like: list | None = None, more: dict[str, Column] | None = None) -> tuple[DataFrame, list[str], Scope]:
        """frame with one physical column for each value and flag, in order of name: the form in which rows are compared.

        like: the (alias, field, type) of a shape that is shared with another frame, flags and all; more: columns that ride along.
        """
        shape = [(a, f, x.type) for a, f, x in frame.columns()] if like is None else like
        columns: dict[str, Column] = {}
        scope: Scope = {a: {} for a in frame.scope}
        for a, f, kind in shape:
            x = frame.scope[a].get(f) or Lowered(F.lit(None).cast(kind), kind, F.lit(True))
            at = f"{a}/{f}"
            columns[at] = x.value if x.type == kind else x.value.cast(kind)
            flags = {k: getattr(x, k) for k in ("missing", "unknown") if like is not None or getattr(x, k) is not None}
            columns |= {f"{at}?{k}": F.lit(False) if c is None else c for k, c in flags.items()}
            scope[a][f] = Lowered(name(at), kind, *(name(f"{at}?{k}") if k in flags else None for k in ("missing", "unknown")))
        ids = {f"#id/{a}": frame.ids[a] for a in sorted(frame.ids)} if keys else {}
        return frame.df.select(*[c.alias(n) for n, c in (columns | ids | (more or {})).items()]), list(columns), scope

    def unique(self, frame: Frame, keys: bool, last: bool = False) -> Frame:
        df, names, scope = self.flat(frame, keys)
        if not keys:
            return Frame(df.distinct(), scope)
        ids = [f"#id/{a}" for a in sorted(frame.ids)]
        pick = F.max if last else F.min
        df = df.groupBy(*[f"`{n}`" for n in names]).agg(pick(F.struct(*[name(i) for i in ids])).alias("#ids")).select(*[name(n) for n in names], *[name("#ids").getField(i).alias(i) for i in ids])
        return Frame(df, scope, {a: name("#id", a) for a in frame.ids})

    def shared_shape(self, left: Frame, right: Frame) -> list:
        out = []
        for a in sorted(left.scope):
            for f in dict.fromkeys([*left.scope[a], *right.scope.get(a, {})]):
                kinds = [s[a][f].type for s in (left.scope, right.scope) if f in s.get(a, {})]
                out.append((a, f, common_type(kinds)))
        return out

    def _trim(self, scope: Scope, left: Frame, right: Frame) -> Scope:
        """Drops flags that neither side can raise."""

        def may(a, f, k):
            return any(f not in s.scope[a] and k == "missing" or f in s.scope[a] and getattr(s.scope[a][f], k) is not None for s in (left, right))

        return {a: {f: Lowered(x.value, x.type, x.missing if may(a, f, "missing") else None, x.unknown if may(a, f, "unknown") else None) for f, x in fields.items()} for a, fields in scope.items()}

    def stack(self, left: Frame, right: Frame, keys: bool) -> Frame:
        """Rows of both; what is known of their sources rides along."""
        like = self.shared_shape(left, right)
        meta = {k: f"#{k[1]}/{k[0]}" for k in left.meta | right.meta}
        sides = [self.flat(s, keys, like, {at: s.meta[k].value if k in s.meta else F.lit(None).cast("string") for k, at in meta.items()}) for s in (left, right)]
        ids = {a: name("#id", a) for a in left.ids} if keys else {}
        known = {k: Lowered(name(at), T.StringType(), name(at).isNull()) for k, at in meta.items()}
        return Frame(sides[0][0].unionByName(sides[1][0]), self._trim(sides[0][2], left, right), ids, None, known)

    def _set(self, node, keys, outer):
        left, right = self.lower(node["left"], keys, outer), self.lower(node["right"], keys, outer)
        if set(left.scope) != set(right.scope):
            raise QueryError("query.plan_invalid", "set_shape")
        op = node["op"]
        if op == "union-all":
            if keys:
                left = replace(left, ids={a: F.concat(F.lit("left:"), c) for a, c in left.ids.items()})
                right = replace(right, ids={a: F.concat(F.lit("right:"), c) for a, c in right.ids.items()})
            return self.stack(left, right, keys)
        if op == "union":
            if keys:  # a match takes the right row's identity
                side = [replace(f, ids=f.ids | {"": F.lit(n)}) for f, n in ((left, "0"), (right, "1"))]
                both = self.stack(*side, keys)
                df, names, scope = self.flat(both, True)
                ids = [f"#id/{a}" for a in sorted(left.ids)]
                best = F.max_by(F.struct(*[name(i) for i in ids]), name("#id/"))
                df = df.groupBy(*[f"`{n}`" for n in names]).agg(best.alias("#ids")).select(*[name(n) for n in names], *[name("#ids").getField(i).alias(i) for i in ids])
                return Frame(df, scope, {a: name("#id", a) for a in left.ids})
            return self.unique(self.stack(left, right, False), False)
        like = self.shared_shape(left, right)
        kept = self.unique(left, keys, last=True)
        (a, names, scope), (b, _, _) = self.flat(kept, keys, like), self.flat(right, False, like)
        test = None
        renamed = b.select(*[name(n).alias("#r/" + n) for n in names])
        for n in names:
            same = name(n).eqNullSafe(name("#r/" + n))
            test = same if test is None else test & same
        df = a.join(renamed, F.lit(True) if test is None else test, "left_semi" if op == "intersect" else "left_anti")
        return Frame(df, self._trim(scope, left, right), {x: name("#id", x) for x in kept.ids} if keys else {})

    def sort_columns(self, terms: list[dict], lower: Callable, collapse: bool = False) -> list[Column]:
        """Sort columns of order terms. Null, then missing, go last in either direction, or first if a term says so; collapse: the two tie."""
        out = []
        for t in terms:
            x, first = lower(t["value"]), t.get("nulls", "last") == "first"
            down = t["direction"] == "desc"
            if x.missing is not None and not collapse:
                out.append(F.when(x.missing, 2).when(x.value.isNull(), 1).otherwise(3 if first else 0).asc())
            v = x.value
            out.append((v.desc_nulls_first() if first else v.desc_nulls_last()) if down else v.asc_nulls_first() if first else v.asc_nulls_last())
        return out

    def _order(self, node, keys, outer):
        frame = self.lower(node["input"], True, outer)
        by = self.sort_columns(node["by"], self.expressions(frame, outer))
        by.append(frame.identity().asc())
        return replace(frame, df=frame.df.orderBy(*by), order=tuple(by))

    def _slice(self, node, keys, outer):
        frame = self.lower(node["input"], keys, outer)
        df = frame.df
        if node.get("offset"):
            df = df.offset(max(0, node["offset"]))
        if "limit" in node:
            df = df.limit(max(0, node["limit"]))
        return replace(frame, df=df)

    def _window(self, node, keys, outer):
        frame = self.lower(node["input"], True, outer)
        return windows.window(self, frame, node, outer)

    def _seek(self, node, keys, outer):
        """Rows strictly after the cursor in the order given."""
        after = node["after"]
        if after.get("basis") != self.basis or after.get("membershipRevision", 0) != self.membership:
            raise QueryError("query.cursor_stale")
        frame = self.lower(node["input"], True, outer)
        lower = self.expressions(frame, outer)
        beyond, same = F.lit(False), F.lit(True)
        for t, v in zip(node["by"], after["order"]):
            x, first, down = lower(t["value"]), t.get("nulls", "last") == "first", t["direction"] == "desc"
            here = 3 if first else 0  # as in sort_columns(): null is before missing, both behind or both ahead of values
            rank = F.when(x.value.isNull(), 1).otherwise(here)
            rank = rank if x.missing is None else F.when(x.missing, 2).otherwise(rank)
            if v is None:
                later, equal = rank > 1, rank == 1
            else:
                at = constant(v).value.cast(x.type)
                moved = x.value < at if down else x.value > at
                later, equal = (rank > here) | F.coalesce(moved, F.lit(False)), F.coalesce(x.value == at, F.lit(False))
            beyond, same = beyond | (same & later), same & equal
        frame = replace(frame, df=frame.df.filter(beyond | (same & (frame.identity() > F.lit(after["resultKey"])))))
        by = [*self.sort_columns(node["by"], lower), frame.identity().asc()]
        return replace(frame, df=frame.df.orderBy(*by), order=tuple(by))

    def _recursive(self, node, keys, outer):
        from lattisca.operators.recursion import recursive

        return recursive(self, node, keys, outer)


def evaluate(spark: SparkSession, root: dict, relations: dict[str, list[RelationInput]], **options) -> Result:
    """Evaluates a plan; options: parameters, functions, basis, membership, keys, keep_status."""
    shown = {k: options.pop(k) for k in ("keys", "keep_status") if k in options}
    return Engine(spark, relations, **options).evaluate(root, **shown)


__all__ = ["EXACT", "Engine", "Frame", "Result", "Window", "evaluate", "plan_id"]
