"""Incremental maintenance: the rows of queries kept up to date from exact, keyed changes.

A change to a relation is a pair of row sets, removed and added. It moves up a plan as pairs of the same kind:

* local nodes and union-all apply to both sides;
* a join meets each side's change with the other input; left, semi and anti joins evaluate the left rows that a change of
  the right side touches again, before and after it;
* aggregates and distinct keep their groups with a row count. Added rows are folded into the groups they touch, where the measures allow it;
  otherwise, and for removed rows unless all measures are counts, the touched groups alone are read anew;
* windows recompute the partitions that a change touches.

What has no rule is computed anew on both versions and compared. Few changed rows stay on the driver, where plans over
them fold without a job, so an update costs what it touches; many are written to the shared folder. Queries in one graph
share relations, groups and changes of equal sub-plans. Updates name the basis they build on; a stale one is refused and changes nothing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.functions.expressions import QueryError
from lattisca.plans.completeness import UNKNOWN, completeness
from lattisca.plans.engine import Engine, Frame, name
from lattisca.plans.nodes import children, plan_id, relations_of
from lattisca.plans.validate import validate
from lattisca.sources.relations import RelationInput
from lattisca.sources.shared import SMALL, Held, hold, local, spool

LOCAL = {"where", "select", "with-fields", "rename", "omit", "unnest", "order"}
#: Measures whose groups take added rows without reading their other rows; counts also give rows up.
FOLDED = {"count", "sum", "average", "minimum", "maximum", "any", "every"}


class StaleBasis(Exception):
    """An update that builds on another version than the current one."""


class ChangeError(Exception):
    """A change that doesn't fit its relation: it adds a key that is there, or removes one that isn't."""


@dataclass(frozen=True)
class Change:
    """Rows that leave and enter a relation, both with its columns."""

    removed: DataFrame
    added: DataFrame


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, change (insert, delete or update) of each row that differs between two snapshots; rows pair by key, null-safe."""
    sides = [df.select(F.struct(*key).alias("k"), F.struct(*[F.col(f"`{c}`") for c in before.columns]).alias(s)) for df, s in ((before, "b"), (after, "a"))]
    both = sides[0].join(sides[1], "k", "full_outer")
    change = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return both.select("k.*", change.alias("change")).filter("change IS NOT NULL")


def _matching(df: DataFrame, other: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Semi or anti join on columns of the same names, null-safe."""
    own = other.select(*[name(k).alias(f"#{i}") for i, k in enumerate(columns)])
    test = F.lit(True)
    for i, k in enumerate(columns):
        test = test & df[name_of(k)].eqNullSafe(own[f"`#{i}`"])
    return df.join(F.broadcast(own) if how == "few" else own, test, "left_semi" if how != "left_anti" else how)


def name_of(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def bag_minus(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows without removed, counting duplicates. Only rows equal to a removed one are grouped; the others pass a join against the small side."""
    gone = removed.distinct()
    return _matching(rows, gone, rows.columns, "left_anti").unionByName(_matching(rows, gone, rows.columns, "left_semi").exceptAll(removed))


def change_between(before: DataFrame, after: DataFrame, key: list[str]) -> Change:
    """The change that leads from one snapshot to another: updated rows leave and enter."""
    moved = snapshot_diff(before, after, key)
    return Change(before.join(moved.filter("change != 'insert'").select(*key), key, "left_semi").select(*before.columns), after.join(moved.filter("change != 'delete'").select(*key), key, "left_semi").select(*before.columns))


def keyed(removed: DataFrame, added: DataFrame) -> DataFrame:
    """A result's change by result key, of a session with keys: _key, change (added, removed or updated), before and after (rows)."""
    sides = [df.select("_key", F.struct(*[F.col(name_of(c)) for c in df.columns if c != "_key"]).alias(s)) for df, s in ((removed, "before"), (added, "after"))]
    both = sides[0].join(sides[1], "_key", "full_outer")
    return both.select("_key", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("updated").alias("change"), "before", "after")


def _where(df: DataFrame, values: list, keys: Held) -> DataFrame:
    """df where values (columns) are, null-safe, those of a row of keys (its columns in the same order). Few keys reach the scan as filters as well."""
    names, test = [name_of(c) for c in keys.df.columns], F.lit(True)
    if keys.table is not None and keys.table.num_rows <= 20:
        for c, v in zip(keys.table.columns, values):
            if not c.null_count:
                df = df.filter(v.isin(*[F.lit(x) for x in set(c.to_pylist())]))
    own = keys.df.select(*[F.col(c).alias(f"#key/{i}") for i, c in enumerate(names)])
    for i, v in enumerate(values):
        test = test & v.eqNullSafe(name("#key", str(i)))
    return df.join(F.broadcast(own) if keys.table is not None else own, test, "left_semi") if values else df


def _tuples(table: pa.Table, columns: list[str] | None = None) -> list[str]:
    """Rows as texts that are equal where rows are."""
    return [repr(list(r.values())) for r in (table.select(columns) if columns is not None else table).to_pylist()]


def _net(removed: pa.Table, added: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Both bags without the rows that are on both."""
    a, b = _tuples(removed), _tuples(added)
    both = Counter(a) & Counter(b)

    def rest(rows):
        left, kept = Counter(both), []
        for i, r in enumerate(rows):
            if left[r]:
                left[r] -= 1
            else:
                kept.append(i)
        return pa.array(kept, pa.int64())

    return (removed.take(rest(a)), added.take(rest(b))) if both else (removed, added)


class Stored:
    """A table and the changes since it was written: rows that left it (by key, or as a bag without one) and rows that entered.

    Few changes stay on the driver; when they are more than SMALL rows, or a change isn't small, the table is written anew.
    """

    def __init__(self, spark: SparkSession, base: DataFrame, key: list[str], gone: pa.Table | None = None, there: pa.Table | None = None):
        self.spark, self.base, self.key, self.gone, self.there = spark, base, key, gone, there

    @cached_property
    def df(self) -> DataFrame:
        out = self.base
        if self.gone is not None and self.gone.num_rows:
            like = self.base.select(*map(name_of, self.key or self.base.columns))
            gone = local(self.spark, self.gone, like).df
            out = _matching(out, gone, self.key, "left_anti") if self.key else bag_minus(out, gone)
        if self.there is not None and self.there.num_rows:
            out = out.unionByName(local(self.spark, self.there, self.base).df)
        return out

    def at(self, keys: Held, columns: list[str]) -> Held:
        """Columns, the key's among them, of the rows with one of keys. Few keys reach the scan as filters."""
        own = list(map(name_of, columns))
        if keys.table is None:
            return hold(_matching(self.df, keys.df, self.key, "left_semi").select(*own), "at")
        base = self.base.select(*own)
        if keys.table.num_rows <= 20 and not any(keys.table[k].null_count for k in self.key):
            found = base
            for k in self.key:
                found = found.filter(F.col(name_of(k)).isin(*[F.lit(v) for v in set(keys.table[k].to_pylist())]))
        else:
            found = _matching(base, keys.df, self.key, "few")
        found = hold(found, "at")
        if found.table is None:
            return hold(_matching(self.df, keys.df, self.key, "few").select(*own), "at")
        wanted = set(_tuples(keys.table, self.key))
        parts = [(found.table, wanted - (set(_tuples(self.gone)) if self.gone is not None else set()))]
        if self.there is not None:
            parts.append((self.there.select(columns).cast(found.table.schema), wanted))
        rows = [t.take(pa.array([i for i, k in enumerate(_tuples(t, self.key)) if k in which], pa.int64())) for t, which in parts]
        return local(self.spark, pa.concat_tables(rows), base)

    def after(self, removed: Held, added: Held) -> Stored:
        if removed.table is not None and added.table is not None:
            there = self.there if self.there is not None else added.table.slice(0, 0)
            if self.key:
                lost = set(_tuples(removed.table, self.key))
                left, there = removed.table.select(self.key), there.take(pa.array([i for i, k in enumerate(_tuples(there, self.key)) if k not in lost], pa.int64()))
            else:
                left, there = _net(removed.table, there)
            gone = left if self.gone is None else pa.concat_tables([self.gone, left.cast(self.gone.schema)])
            new = Stored(self.spark, self.base, self.key, gone, pa.concat_tables([there, added.table.cast(there.schema)]))
            return new if gone.num_rows + new.there.num_rows <= SMALL else Stored(self.spark, spool(new.df, "stored"), self.key)
        df = self.df
        df = (_matching(df, removed.df, self.key, "left_anti") if self.key else bag_minus(df, removed.df)) if not removed.empty else df
        return Stored(self.spark, spool(df.unionByName(added.df), "stored"), self.key)


class _Over(Engine):
    """An engine that takes given frames for some nodes, and kept groups (by id of their node)."""

    counts_pairs = False  # an update would count a whole relation

    def __init__(self, spark, relations, replaced: dict[int, Frame], kept: dict[int, tuple[Stored, Frame]] | None = None, **options):
        super().__init__(spark, relations, **options)
        self.replaced, self.kept = replaced, kept or {}

    def lower(self, node, keys=False, outer=None):
        if id(node) in self.replaced:
            return self.replaced[id(node)]
        if id(node) in self.kept:
            stored, frame = self.kept[id(node)]
            return _shown(replace(frame, df=stored.df))
        return super().lower(node, keys, outer)


@dataclass
class _Root:
    """A maintained plan. kept: the node whose rows are stored, the plan itself or the input of its order; stored: those rows and a frame of their columns, None where they are those of a kept group table."""

    node: dict
    kept: dict
    keys: bool
    known: str
    issues: tuple[str, ...]
    stored: tuple[Stored, Frame] | None = None


def _down(node: dict, kinds: set[str]) -> dict:
    while node["kind"] in kinds and not _has_subquery(node):
        node = node["input"]
    return node


class Graph:
    """Maintained queries over shared relations; each relation has one input."""

    def __init__(self, spark: SparkSession, relations: dict[str, list[RelationInput]], basis: object = 0, **options):
        self.spark, self.basis, self.options, self.given = spark, basis, options, relations
        self.relations: dict[str, tuple[RelationInput, Stored]] = {}
        self.groups: dict[str, tuple[Stored, Frame]] = {}  # by plan: the kept groups, and a frame of their columns
        self.roots: dict[str, _Root] = {}
        self.counts: Counter = Counter()
        self.reasons: Counter = Counter()
        self.names: dict[int, str] = {}

    # Opening and reading.

    def attach(self, key: str, root: dict, keys: bool = False) -> _Root:
        """Validates a plan and keeps its rows under key. Over incomplete inputs its completeness is ``unknown``, and it has no rows."""
        problems = validate(root, set(self.given), set(self.options["parameters"]) if self.options.get("parameters") else None)
        if problems:
            raise QueryError("query.plan_invalid", "; ".join(f"{p}: {c}" for p, c in problems))
        issues: list[str] = []
        known = completeness(root, {r: [i.completeness for i in own] for r, own in self.given.items()}, issues)
        order = _down(root, LOCAL - {"order"})
        made = _Root(root, order["input"] if order["kind"] == "order" and not _has_subquery(order) else root, keys, known, tuple(issues))
        if known != UNKNOWN:
            for r in relations_of(root) - set(self.relations):
                if len(self.given[r]) != 1:
                    raise ValueError("maintained relations have one input each")
                (own,) = self.given[r]
                self.relations[r] = own, Stored(self.spark, own.df, list(own.occurrence))
            self._open(root)
            if id(_down(made.kept, LOCAL)) not in self.names or self.names[id(_down(made.kept, LOCAL))] not in self.groups:
                frame = self.flat(self.engine(self.inputs()).lower(made.kept, True))
                made.stored = Stored(self.spark, spool(frame.df, "result"), []), frame
        self.roots[key] = made
        return made

    def rows(self, root: _Root) -> DataFrame | None:
        """A root's rows, in the plan's order."""
        if root.known == UNKNOWN:
            return None
        replaced = {id(root.kept): replace(root.stored[1], df=root.stored[0].df)} if root.stored else {}
        return self.visible(root, self.engine(self.inputs(), replaced).lower(root.node, True))

    def visible(self, root: _Root, frame: Frame) -> DataFrame:
        return Engine(self.spark, {}).visible(frame, root.keys)

    def detach(self, key: str) -> None:
        """Drops a root, and the groups that no other one has."""
        del self.roots[key]
        self.names = {}
        for root in self.roots.values():
            if root.known != UNKNOWN:
                self._open(root.node)
        self.groups = {k: v for k, v in self.groups.items() if k in self.names.values()}

    def _open(self, node: dict) -> None:
        """Keeps the groups of a plan's aggregates and distincts, from the bottom up."""
        if _has_subquery(node):
            return
        for n in children(node) if node["kind"] not in ("recursive", "slice", "seek") else []:
            self._open(n)
        self.names[id(node)] = key = plan_id(node)
        if node["kind"] in ("aggregate", "distinct") and key not in self.groups:
            engine = self.engine(self.inputs())
            frame = self.grouped(engine, node, engine.lower(node["input"], True))
            self.groups[key] = Stored(self.spark, hold(frame.df, "groups").df, _group_columns(node, frame)), frame

    def inputs(self) -> dict[str, list[RelationInput]]:
        return {r: [replace(own, df=kept.df)] for r, (own, kept) in self.relations.items()}

    def engine(self, relations, replaced: dict[int, Frame] | None = None, groups: dict | None = None) -> _Over:
        held = self.groups | (groups or {})
        return _Over(self.spark, relations, replaced or {}, {i: held[k] for i, k in self.names.items() if k in held}, **self.options)

    def flat(self, frame: Frame) -> Frame:
        """A frame of plain columns: values, flags, identities and what is known of sources."""
        meta = {k: f"#{k[1]}/{k[0]}" for k in frame.meta if k[1] == "source"}
        df, _, scope = Engine(self.spark, {}).flat(frame, True, more={at: frame.meta[k].value for k, at in meta.items()})
        known = {k: replace(frame.meta[k], value=name(at), missing=name(at).isNull()) for k, at in meta.items()}
        return Frame(df, scope, {a: name("#id", a) for a in frame.ids}, None, known)

    def grouped(self, engine: Engine, node: dict, frame: Frame) -> Frame:
        """The groups that a frame's rows make, flat, with a count of rows and what folding needs besides the measures."""
        over = _Over(self.spark, engine.relations, {id(node["input"]): frame}, **self.options)
        over.fresh = engine.fresh
        if node["kind"] == "aggregate":
            more = {"#rows": {"op": "count"}}
            for f, m in node["measures"].items():
                if m["op"] == "minimum":
                    more[f"#nulls:{f}"] = {"op": "count", "value": {"kind": "case", "branches": [{"when": {"kind": "is-null", "value": m["value"]}, "then": {"kind": "literal", "value": 1}}], "otherwise": {"kind": "literal", "value": None}}}
                if m["op"] == "average":
                    more |= {f"#sum:{f}": {"op": "sum", "value": m["value"]}, f"#n:{f}": {"op": "count", "value": m["value"]}}
            return self.flat(Engine._aggregate(over, {**node, "measures": node["measures"] | more}, True, None))
        plain = self.flat(frame)
        ids = [c for c in plain.df.columns if c.startswith("#id/")]
        values = [c for c in plain.df.columns if not c.startswith(("#id/", "#source/"))]
        df = plain.df.groupBy(*map(name_of, values)).agg(F.count(F.lit(1)).alias("#rows"), F.min(F.struct(*map(name, ids))).alias("#ids")).select(*map(name, values), *[name("#ids").getField(i).alias(i) for i in ids], "#rows")
        return Frame(df, plain.scope, plain.ids)

    # Updates.

    def update(self, changes: dict[str, Change], expected: object, basis: object) -> dict[str, tuple[DataFrame, DataFrame] | None]:
        """Applies changes that build on ``expected``; for each root the rows removed and added, None where it has no rows. On a failure nothing has changed."""
        if expected != self.basis:
            raise StaleBasis(f"expected {expected}, at {self.basis}")
        step = _Step(self, {r: c for r, c in changes.items() if r in self.relations})
        out, stored = {}, {}
        for key, root in self.roots.items():
            if root.known == UNKNOWN:
                out[key] = None
            elif not relations_of(root.node) & set(step.changes):  # relations that a query doesn't read cost nothing
                self.counts["unaffected"] += 1
                none = self.rows(root).limit(0)
                out[key] = none, none
            else:
                removed, added = step.settled(root.kept, root.stored and root.stored[1])
                if root.stored:
                    stored[key] = root.stored[0].after(removed[0], added[0]), root.stored[1]
                out[key] = tuple(self.visible(root, self.engine({}, {id(root.kept): f}).lower(root.node, True) if root.kept is not root.node else f) for _, f in (removed, added))
        self.relations, self.groups, self.basis = step.after, self.groups | step.groups, basis
        for key, kept in stored.items():
            self.roots[key].stored = kept
        return out


def _group_columns(node: dict, frame: Frame) -> list[str]:
    """Flat columns that tell groups apart."""
    if node["kind"] == "distinct":
        return [c for c in frame.df.columns if not c.startswith("#")]
    return [c for c in frame.df.columns for f in node["groupBy"] if c in (f"{node['alias']}/{f}", f"{node['alias']}/{f}?missing", f"{node['alias']}/{f}?unknown")]


def _shown(frame: Frame) -> Frame:
    """Without the columns that only folding needs."""
    return replace(frame, scope={a: {f: x for f, x in fields.items() if not f.startswith("#")} for a, fields in frame.scope.items()})


class _Step:
    """One update: changes of relations, and what follows from them at the nodes of plans, each computed once."""

    def __init__(self, graph: Graph, changes: dict[str, Change]):
        self.graph, self.spark = graph, graph.spark
        self.changes: dict[str, tuple[Held, Held]] = {}
        self.after = dict(graph.relations)
        for r, c in changes.items():
            own, kept = graph.relations[r]
            kinds = {f.name: f.dataType for f in own.df.schema.fields}
            fitted = []
            for df in (c.removed, c.added):
                same = {f.name: f.dataType for f in df.schema.fields} == kinds
                fitted.append(df.select(*(map(name_of, kinds) if same else [F.col(name_of(k)).cast(t).alias(k) for k, t in kinds.items()])))
            both = fitted[0].withColumn("#side", F.lit(False)).union(fitted[1].withColumn("#side", F.lit(True)))
            removed, added = _sides(self.spark, hold(both, "change"), own.df)
            self._fits(r, kept, removed, added)
            self.changes[r] = removed, added
            self.after[r] = own, kept.after(removed, added)
        self.old = graph.inputs()
        self.new = {r: [replace(own, df=kept.df)] for r, (own, kept) in self.after.items()}
        self.groups: dict[str, tuple[Stored, Frame]] = {}
        self.memo: dict[str, tuple[Frame | None, Frame | None]] = {}

    def _fits(self, relation: str, kept: Stored, removed: Held, added: Held) -> None:
        """Refuses a change that adds a key which is there or comes twice, or removes one which isn't there."""
        if not kept.key:
            return
        columns = list(map(name_of, kept.key))
        if removed.table is not None and added.table is not None:
            lost, new = _tuples(removed.table, kept.key), _tuples(added.table, kept.key)
            keys = pa.concat_tables([removed.table.select(kept.key), added.table.select(kept.key)])
            found = set(_tuples(kept.at(local(self.spark, keys, kept.base.select(*columns)), kept.key).table))
            if len(set(lost)) < len(lost) or len(set(new)) < len(new) or set(lost) - found or set(new) & found - set(lost):
                raise ChangeError(relation)
            return
        absent = _matching(removed.df, kept.df, kept.key, "left_anti")
        taken = _matching(_matching(added.df, kept.df, kept.key, "left_semi"), removed.df, kept.key, "left_anti")
        twice = [h.df.groupBy(*columns).count().filter("count > 1").select(*columns) for h in (removed, added)]
        if not absent.select(*columns).unionByName(taken.select(*columns)).unionByName(twice[0]).unionByName(twice[1]).isEmpty():
            raise ChangeError(relation)

    def engine(self, new: bool, replaced: dict[int, Frame] | None = None) -> _Over:
        return self.graph.engine(self.new if new else self.old, replaced, self.groups if new else None)

    def settled(self, node: dict, like: Frame | None) -> tuple[tuple[Held, Frame], tuple[Held, Frame]]:
        """A node's change, computed, without rows that leave and enter alike. like: a flat frame of its columns, if there is one."""
        empty = like or self.graph.flat(self.engine(True).lower(node, True))
        sides = [self.graph.flat(f) if f is not None else None for f in self.delta(node)]
        both = None
        for f, side in zip(sides, (False, True)):
            if f is not None:
                df = f.df.select(*[name(c) if c in f.df.columns else F.lit(False if c.endswith(("?missing", "?unknown")) else None).alias(c) for c in empty.df.columns], F.lit(side).alias("#side"))
                both = df if both is None else both.unionByName(df)
        if both is None:
            both = empty.df.limit(0).withColumn("#side", F.lit(True))
        removed, added = _sides(self.spark, hold(both, "delta"), empty.df)
        if removed.table is not None and added.table is not None:
            removed, added = (local(self.spark, t, empty.df) for t in _net(removed.table, added.table))
        else:
            removed, added = (Held(spool(a.df.exceptAll(b.df), "delta"), None) for a, b in ((removed, added), (added, removed)))
        return (removed, replace(empty, df=removed.df)), (added, replace(empty, df=added.df))

    def delta(self, node: dict) -> tuple[Frame | None, Frame | None]:
        """Rows that a node loses and gains; None for none."""
        if not relations_of(node) & set(self.changes):
            return None, None
        key = plan_id(node)
        if key not in self.memo:
            self.memo[key] = self._delta(node)
        return self.memo[key]

    def _delta(self, node):
        kind = node["kind"]
        if _has_subquery(node):
            return self._again(node, "subquery")
        if kind == "from":
            self._count("selective")
            own = self.old[node["relation"]][0]
            return tuple(None if h.empty else Engine(self.spark, {node["relation"]: [replace(own, df=h.df)]}).lower(node, True) for h in self.changes[node["relation"]])
        if kind in LOCAL:
            return tuple(None if f is None else self._lower(node, {id(node["input"]): f}, True) for f in self.delta(node["input"]))
        if kind == "set" and node["op"] == "union-all":
            sides = [self.delta(node[s]) for s in ("left", "right")]
            return tuple(None if a is None and b is None else self._lower(node, {id(node["left"]): a or self._none(node["left"]), id(node["right"]): b or self._none(node["right"])}, True) for a, b in zip(*sides))
        if kind == "join":
            return self._join(node)
        if kind in ("aggregate", "distinct"):
            return self._groups(node)
        if kind == "window":
            wanted = [w.get("partitionBy", []) for w in node["fields"].values()]
            if wanted[0] and all(w == wanted[0] for w in wanted):
                return self._window(node, wanted[0])
            return self._again(node, "window without one partition")
        return self._again(node, kind)

    def _count(self, what: str, why: str = "") -> None:
        self.graph.counts[what] += 1
        if why:
            self.graph.reasons[why] += 1

    def _lower(self, node: dict, replaced: dict[int, Frame], new: bool) -> Frame:
        return self.engine(new, replaced).lower(node, True)

    def _none(self, node: dict) -> Frame:
        frame = self.engine(True).lower(node, True)
        return replace(frame, df=frame.df.filter(F.lit(False)))

    def _hold(self, frame: Frame, tag: str) -> tuple[Held, Frame]:
        flat = self.graph.flat(frame)
        held = hold(flat.df, tag)
        return held, replace(flat, df=held.df)

    def _stack(self, frames: list[Frame | None]) -> Frame | None:
        out = None
        for f in frames:
            if f is not None:
                out = f if out is None else self.engine(True).stack(out, f, True)
        return out

    def _again(self, node, why):
        self._count("fallback", why)
        before, after = (self.graph.flat(self.engine(new).lower(node, True)) for new in (False, True))
        a, b = spool(before.df, "before"), spool(after.df, "after")
        return replace(before, df=a.exceptAll(b)), replace(after, df=b.exceptAll(a))

    def _join(self, node):
        self._count("selective")
        left, right = self.delta(node["left"]), self.delta(node["right"])
        if node["join"] in ("inner", "cross"):
            # (L + dL)(R + dR) - LR = dL R + L' dR
            out = []
            for a, b in zip(left, right):
                one = None if a is None else self._lower(node, {id(node["left"]): a}, False)
                two = None if b is None else self._lower(node, {id(node["right"]): b}, True)
                out.append(self._stack([one, two]))
            return tuple(out)
        removed, added = ([None if f is None else self._lower(node, {id(node["left"]): f}, False)] for f in left)
        touching = self._stack(list(right))
        if touching is not None:
            semi = {**node, "join": "semi"}
            held, own = self._hold(self._lower(semi, {id(node["right"]): touching}, True), "touched")
            if not held.empty:
                removed.append(self._lower(node, {id(node["left"]): own}, False))
                added.append(self._lower(node, {id(node["left"]): own}, True))
        return self._stack(removed), self._stack(added)

    def _groups(self, node):
        key = plan_id(node)
        stored, like = self.graph.groups[key]
        by, graph = stored.key, self.graph
        near = all(h.table is not None for c in self.changes.values() for h in c) and not _has_subquery(node["input"]) and _down(node["input"], LOCAL)["kind"] == "from"
        own = lambda f: replace(f, df=f.df.coalesce(1)) if near else f  # noqa: E731 (few rows of the driver need no exchange)
        sides = [None if f is None else graph.grouped(self.engine(True), node, own(f)) for f in self.delta(node["input"])]
        if all(f is None for f in sides):
            self.groups[key] = stored, like
            return None, None
        wanted = [name(c) for c in like.df.columns]
        parts = [f.df.select(*wanted, F.lit(t).alias("#side")) for t, f in zip((1, 2), sides) if f is not None]
        held = hold(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "touched")
        keys = [name_of(c) for c in by]
        if held.table is not None and by:
            old = stored.at(local(self.spark, held.table.select(by).group_by(by).aggregate([]), like.df.select(*keys)), like.df.columns)
        else:
            old = hold(_matching(stored.df, held.df.select(*keys).distinct(), by, "left_semi") if by else stored.df, "groups")
        if held.table is not None and old.table is not None:
            mark = pa.array([0] * old.table.num_rows, held.table.schema.field("#side").type)
            held = local(self.spark, pa.concat_tables([old.table.append_column("#side", mark).select(held.table.column_names).cast(held.table.schema), held.table]), held.df)
        else:
            held = Held(old.df.select(*wanted, F.lit(0).alias("#side")).unionByName(held.df), None)
        ops = [m["op"] for m in node.get("measures", {}).values()]
        lost = sides[0] is not None and (not held.df.filter(name("#side") == 1).isEmpty() if held.table is None else 1 in held.table["#side"].to_pylist())
        counts = node["kind"] == "aggregate" and all(o == "count" for o in ops)
        few = held.table if old.table is not None else None
        if lost and not counts and not (few is not None and _extremes_stay(node, few, by)) or not set(ops) <= FOLDED:
            self._count("selective", "groups read anew")
            engine = self.engine(True)
            frame = engine.lower(node["input"], True)
            if node["kind"] == "aggregate":
                lower = engine.expressions(frame)
                own = {f"{node['alias']}/{f}": lower(e).value for f, e in node["groupBy"].items()}
            else:
                own = {f"{a}/{f}": x.value for a, f, x in frame.columns()}
            if own:
                which = hold(held.df.filter("`#side` > 0").select(*map(name_of, own)).distinct(), "touched")
                frame = replace(frame, df=_where(frame.df, list(own.values()), which))
            now = hold(graph.grouped(engine, node, frame).df.select(*wanted), "groups")
        else:
            self._count("selective", "groups folded")
            now = hold(self._folded(node, held.df if few is None else held.df.coalesce(1), by, like), "groups")
        rows, whole = "#rows" if node["kind"] == "distinct" else f"{node['alias']}/#rows", node["kind"] == "aggregate" and not node["groupBy"]
        if now.table is not None:
            tables = old, now if whole else local(self.spark, now.table.filter(pc.greater(now.table[rows], 0)), like.df)
        else:
            tables = old, now if whole else Held(now.df.filter(F.col(name_of(rows)) > 0), None)
        self.groups[key] = stored.after(*tables), like
        return tuple(_shown(replace(like, df=h.df)) for h in tables)

    def _folded(self, node: dict, parts: DataFrame, by: list[str], like: Frame) -> DataFrame:
        """Old groups (#side 0), groups that leave (1) and that enter (2), as one row a group."""
        side, alias = name("#side"), node.get("alias")
        sign = F.when(side == 1, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        total = lambda c: F.sum(name(c) * sign).cast("bigint")
        out = {"#rows": total("#rows")} if node["kind"] == "distinct" else {f"{alias}/#rows": total(f"{alias}/#rows")}
        for f, m in node.get("measures", {}).items():
            c, v = f"{alias}/{f}", name(f"{alias}/{f}")
            if m["op"] == "count":
                out[c] = total(c)
            elif m["op"] == "sum":
                out[c] = F.sum(v)
            elif m["op"] == "average":
                parts_of = [f"{alias}/#sum:{f}", f"{alias}/#n:{f}"]
                out |= {parts_of[0]: F.sum(name(parts_of[0])), parts_of[1]: total(parts_of[1])}
                out[c] = F.try_divide(F.sum(name(parts_of[0])), F.sum(name(parts_of[1])))
            elif m["op"] == "maximum":
                out[c] = F.max(F.when(side != 1, v))
            elif m["op"] == "minimum":
                nulls = f"{alias}/#nulls:{f}"
                out[nulls] = total(nulls)
                out[c] = F.when(F.sum(name(nulls) * sign) == 0, F.min(F.when(side != 1, v)))
            else:
                wins = F.coalesce(F.bool_or(v if m["op"] == "any" else ~v), F.lit(False))
                out[c] = F.when(wins, F.lit(m["op"] == "any")).when(F.count(F.lit(1)) == F.count(v), F.lit(m["op"] == "every"))
                out[c + "?unknown"] = out[c].isNull()
        rest = [c for c in like.df.columns if c not in by and c not in out]
        out |= {c: F.min(F.when(side != 1, name(c))) for c in rest}
        rows = parts.groupBy(*map(name, by)).agg(*[v.alias(c) for c, v in out.items()])
        return rows.select(*[name(c).cast(like.df.schema[c].dataType).alias(c) for c in like.df.columns])

    def _window(self, node, keys):
        self._count("selective")
        old, marks = self.engine(False), None
        for f in self.delta(node["input"]):
            if f is not None:
                lower = self.engine(True).expressions(f)
                own = f.df.select(*[lower(e).value.alias(f"#key/{i}") for i, e in enumerate(keys)])
                marks = own if marks is None else marks.unionByName(own)
        if marks is None:
            return None, None
        touched = hold(marks.distinct(), "touched")

        def only(engine) -> Frame:
            frame = engine.lower(node["input"], True)
            lower = engine.expressions(frame)
            return replace(frame, df=_where(frame.df, [lower(e).value for e in keys], touched))

        _, before = self._hold(only(old), "before")
        gone, new = self.delta(node["input"])
        if all(own.occurrence for r in relations_of(node["input"]) for own in self.old[r]) and _down(node["input"], LOCAL - {"unnest", "order"})["kind"] == "from":
            # Rows are known by their identities, so the partitions as they are now need no second scan.
            after, ids = before, [f"#id/{a}" for a in before.ids]
            if gone is not None:
                after = replace(before, df=_matching(before.df, self.graph.flat(gone).df, ids, "left_anti"))
            after = self._stack([after, new])
        else:
            after = only(self.engine(True))
        return self._lower(node, {id(node["input"]): before}, False), self._lower(node, {id(node["input"]): after}, True)


def _extremes_stay(node: dict, parts: pa.Table, by: list[str]) -> bool:
    """Whether groups that lose rows (parts as in _folded()) can do so without reading the others: what leaves is no maximum, no minimum and,
    of a distinct, not the row that the result is known by; or it is all that the group has."""
    if node["kind"] == "distinct":
        watched = {c: 1 for c in parts.column_names if c.startswith("#id/")}
        rows = "#rows"
    else:
        watched = {f"{node['alias']}/{f}": -1 if m["op"] == "maximum" else 1 for f, m in node["measures"].items() if m["op"] != "count"}
        rows = f"{node['alias']}/#rows"
        if any(m["op"] not in ("count", "maximum", "minimum") for m in node["measures"].values()):
            return False
    if len(watched) > 1 and node["kind"] == "distinct":
        return False
    kinds = [parts.schema.field(c).type for c in watched]
    if not all(pa.types.is_integer(t) or pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_date(t) or pa.types.is_decimal(t) for t in kinds):
        return False
    groups: dict[str, list[dict]] = {}
    for key, r in zip(_tuples(parts, by) if by else [""] * parts.num_rows, parts.select([*watched, rows, "#side"]).to_pylist()):
        groups.setdefault(key, [{}, {}, {}])[r["#side"]] = r
    for old, gone, new in groups.values():
        if not gone or by and old and not new and old[rows] == gone[rows]:
            continue
        if not old or any(old[c] is None or gone[c] is None or not (gone[c] > old[c] if way > 0 else gone[c] < old[c]) for c, way in watched.items()):
            return False
    return True


def _sides(spark: SparkSession, both: Held, like: DataFrame) -> tuple[Held, Held]:
    """Rows by their mark ``#side``: false, true."""
    if both.table is None:
        return tuple(Held(both.df.filter(name("#side") == t).drop("#side"), None) for t in (False, True))
    mark = both.table["#side"]
    rows = both.table.drop_columns(["#side"])
    return tuple(local(spark, rows.filter(pa.array([m == t for m in mark.to_pylist()], pa.bool_())), like) for t in (False, True))


def _has_subquery(part) -> bool:
    if isinstance(part, list):
        return any(map(_has_subquery, part))
    if not isinstance(part, dict):
        return False
    return part.get("kind") == "subquery" or any(_has_subquery(v) for k, v in part.items() if k not in ("rows",))


class Session:
    """One maintained query; ``rows`` is its current result, ``basis`` its version, ``completeness`` what is known of its rows.

    keys: rows carry their result keys (``_key``), and keyed() turns a change into rows added, removed and updated by key.
    counts says how many nodes were maintained, computed anew or unaffected, reasons why.
    """

    def __init__(self, spark: SparkSession, root: dict, relations: dict[str, list[RelationInput]], basis: object = 0, keys: bool = False, **options):
        self.graph = Graph(spark, relations, basis, **options)
        self.root, self.closed = self.graph.attach("", root, keys), False

    basis = property(lambda self: self.graph.basis)
    counts = property(lambda self: self.graph.counts)
    reasons = property(lambda self: self.graph.reasons)
    completeness = property(lambda self: self.root.known)
    issues = property(lambda self: self.root.issues)

    @property
    def rows(self) -> DataFrame | None:
        return self.graph.rows(self.root)

    def update(self, changes: dict[str, Change], expected: object, basis: object) -> tuple[DataFrame, DataFrame] | None:
        """Applies changes that build on ``expected``; the result rows removed and added, None over incomplete inputs. On a failure nothing has changed."""
        if self.closed:
            raise ValueError("the session is closed")
        return self.graph.update(changes, expected, basis)[""]

    def close(self) -> None:
        self.closed = True


class Pool:
    """Queries that share relations, kept groups and the changes of equal sub-plans. Equal plans are one query, unless they have a seek, a recursion or a subquery."""

    def __init__(self, spark: SparkSession, relations: dict[str, list[RelationInput]], basis: object = 0, **options):
        self.graph = Graph(spark, relations, basis, **options)
        self.uses: Counter = Counter()

    def attach(self, root: dict, keys: bool = False) -> str:
        """The name of a plan in the pool, for rows(), detach() and the results of update()."""
        key = plan_id(root) + "k" * keys + (f"#{len(self.uses)}-{sum(self.uses.values())}" if _unshared(root) else "")
        if not self.uses[key]:
            self.graph.attach(key, root, keys)
        self.uses[key] += 1
        return key

    def rows(self, key: str) -> DataFrame | None:
        return self.graph.rows(self.graph.roots[key])

    def detach(self, key: str) -> None:
        self.uses[key] -= 1
        if not self.uses[key]:
            del self.uses[key]
            self.graph.detach(key)

    def update(self, changes: dict[str, Change], expected: object, basis: object) -> dict[str, tuple[DataFrame, DataFrame] | None]:
        """Applies changes to all queries: by name, the rows removed and added."""
        return self.graph.update(changes, expected, basis)


def _unshared(node: dict) -> bool:
    return node["kind"] in ("seek", "recursive") or _has_subquery({k: v for k, v in node.items() if k not in ("input", "left", "right")}) or any(map(_unshared, children(node)))
