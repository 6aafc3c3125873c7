"""Keyed least fixpoints: semi-naive rounds over a frontier, cut and counted on the driver."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattisca.functions.expressions import QueryError
from lattisca.sources.shared import SMALL, Held, hold, local, spool

#: Tables of the shared folder that the rows of earlier rounds are read from.
TABLES = 8


def recursive(engine, node: dict, keys: bool, outer):
    """Seed rows, then the rows of each step over the last new ones, until none has a new key.

    The first derivation of a key stands, the one with the smallest identity among those of a round; rows without a known
    key drop out. More rounds or rows than the node allows raise ``query.recursion_budget_exceeded``; a limit of None
    allows any number. The rows of a round are computed once, on the driver where they are few and else in the shared
    folder, so rounds neither recompute nor pile up lineage; the driver never holds more than SMALL rows of earlier rounds.
    """
    label = node["name"]
    engine.frontier_keys[label] = node["key"]
    from lattisca.plans.engine import Frame, name

    def admitted(frame, seen):
        lower = engine.expressions(frame, outer)
        parts = [lower(e) for e in node["key"]]
        for p in parts:
            frame = replace(frame, df=frame.df.filter(p.value.isNotNull() if p.no_value() is None else p.known()))
        df, names, scope = engine.flat(frame, True)
        again = Frame(df, scope, {a: name("#id", a) for a in frame.ids})
        lower = engine.expressions(again, outer)
        df = df.select("*", *[lower(e).value.alias(f"#key/{i}") for i, e in enumerate(node["key"])])
        spec = Window.partitionBy(*[name("#key", str(i)) for i in range(len(parts))]).orderBy(again.identity())
        df = df.select("*", F.row_number().over(spec).alias("#n")).filter(name("#n") == 1).drop("#n")
        if seen is not None:
            old = seen.select(*[name("#key", str(i)).alias(f"#old/{i}") for i in range(len(parts))])
            test = None
            for i in range(len(parts)):
                t = name("#key", str(i)).eqNullSafe(name("#old", str(i)))
                test = t if test is None else test & t
            df = df.join(old, test, "left_anti")
        key = F.concat(*[F.coalesce(name("#key", str(i)).cast("string"), F.lit("null")) for i in range(len(parts))])
        own = F.concat(F.lit(f"{len(label)}:{label}"), F.char_length(key).cast("string"), F.lit(":"), key)
        df = df.select(*[own.alias(c) if c.startswith("#id/") else name(c) for c in df.columns])
        return hold(df, "round"), scope, {a: name("#id", a) for a in frame.ids}

    new, scope, ids = admitted(engine.lower(node["seed"], True, outer), None)
    rounds, total = 0, _count(new)
    most, longest = node.get("maxRows", 100_000), node.get("maxIterations", 100)
    count, all_rows, new = total, [(new, total)], new.df
    first = new
    while count:
        if most is not None and total > most or longest is not None and rounds >= longest:
            raise QueryError("query.recursion_budget_exceeded", label)
        rounds += 1
        before = engine.frontiers.get(label)
        engine.frontiers[label] = Frame(new, scope, ids)
        try:
            step = engine.lower(node["step"], True, outer)
        finally:
            engine.frontiers.pop(label) if before is None else engine.frontiers.__setitem__(label, before)
        found, step_scope, _ = admitted(step, _all(engine.spark, all_rows))
        for a, fields in step_scope.items():
            for f in set(fields) ^ set(scope.get(a, {})):
                raise QueryError("query.recursion_shape", f"{a}.{f}")
        count = _count(found)
        total += count
        new = found.df.select(*[name(c) if c in found.df.columns else F.lit(False).alias(c) for c in first.columns])
        all_rows.append((hold(new, "round") if found.table is not None and found.df.columns != first.columns else Held(new, found.table), count))
        all_rows = _packed(engine.spark, all_rows)
    return Frame(_all(engine.spark, all_rows), scope, ids if keys else {})


def _count(rows: Held) -> int:
    return rows.df.count() if rows.table is None else rows.table.num_rows


def _packed(spark, rows: list[tuple[Held, int]]) -> list[tuple[Held, int]]:
    """rows, counted, in few tables: those on the driver in the shared folder once they are more than SMALL, and the smaller half of more than TABLES tables as one."""
    here, there = [r for r in rows if r[0].table is not None], [r for r in rows if r[0].table is None]
    n = sum(k for _, k in here)
    if n > SMALL:
        here, there = [], [*there, (Held(spool(_all(spark, here), "rounds"), None), n)]
    if len(there) > TABLES:
        there.sort(key=lambda r: r[1])
        half, there = there[: TABLES // 2 + 1], there[TABLES // 2 + 1 :]
        there.append((Held(spool(_all(spark, half), "rounds"), None), sum(k for _, k in half)))
    return here + there


def _all(spark, rows: list[tuple[Held, int]]):
    """Rows of all rounds: those on the driver as one table."""
    few = [h.table for h, _ in rows if h.table is not None]
    out = local(spark, pa.concat_tables([t.cast(few[0].schema) for t in few]), next(h.df for h, _ in rows if h.table is not None)).df if few else None
    for h, _ in rows:
        if h.table is None:
            out = h.df if out is None else out.unionByName(h.df)
    return out
