"""Inner joins on equal keys that repeat on both sides, whose pairs outgrow their inputs: dealt out in blocks of bounded size.

A join by a key of few values makes its pairs in as few tasks, or in as many as the smaller input's file has parts. Here the rows
of each key are counted on both sides first; where the pairs are many, a key's rows are cut on either side into parts, and each
part of one side meets each part of the other in a block of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattisca.functions.expressions import alike
from lattisca.sources.shared import hold

#: Pairs for one task; fewer in all are left to Spark.
PAIRS = 1 << 23
#: Rows of a key in one part, so that a block has about a million pairs and Spark buffers a part in memory.
SIDE = 1024
#: Joins of fewer pairs than this for each row of their inputs are left to Spark too.
GROWTH = 8
#: Tasks of joining for one task that repeats rows: each takes PAIRS / SIDE rows of a side, so one task makes half a million.
REPEATS = 64
#: Tasks at most; beyond, each has more pairs, a block at a time.
TASKS = 20_000


@dataclass(frozen=True)
class _Equal:
    """Terms of a join's condition: pairs of expressions that must be equal, one of each side, and what else must hold."""

    left: list[dict]
    right: list[dict]
    rest: list[dict]


def _aliases(e) -> set[str] | None:
    """Aliases that an expression reads; None if it holds a query."""
    if isinstance(e, list):
        parts = [_aliases(x) for x in e]
        return None if None in parts else set().union(*parts)
    if not isinstance(e, dict) or e.get("kind") == "literal":
        return set()
    if e.get("kind") == "subquery":
        return None
    if e.get("kind") in ("field", "key-of", "source-of"):
        return {e["alias"]}
    return _aliases(list(e.values()))


def _terms(on: dict, left: set[str], right: set[str]) -> _Equal | None:
    out, todo = _Equal([], [], []), [on]
    while todo:
        e = todo.pop(0)
        if e["kind"] == "boolean" and e["op"] == "and":
            todo = e["args"] + todo
            continue
        read = _aliases(e)
        if read is None or not read <= left | right:
            return None
        sides = [_aliases(e[k]) for k in ("left", "right")] if e["kind"] == "compare" and e["op"] == "eq" else [set(), set()]
        if all(sides) and sides[0] <= left and sides[1] <= right:
            out.left.append(e["left"])
            out.right.append(e["right"])
        elif all(sides) and sides[0] <= right and sides[1] <= left:
            out.left.append(e["right"])
            out.right.append(e["left"])
        else:
            out.rest.append(e)
    return out if out.left else None


def unique(engine, node: dict) -> set[tuple[str, str]] | None:
    """Fields that no two rows of node share, as far as its form tells."""
    if node["kind"] in ("where", "order", "slice", "seek"):
        return unique(engine, node["input"])
    if node["kind"] == "from":
        own = engine.relations.get(node["relation"], ())
        return {(node["alias"], c) for c in own[0].occurrence} or None if len(own) == 1 else None
    if node["kind"] == "aggregate":
        return {(node["alias"], g) for g in node["groupBy"]}
    if node["kind"] == "recursion-ref":
        key = engine.frontier_keys.get(node["name"], [{}])
        return {(e["alias"], e["name"]) for e in key} if all(e.get("kind") == "field" for e in key) else None
    return None


def _settles(engine, node: dict, terms: list[dict]) -> bool:
    """Whether a row of node is known by the terms, so that each row of the other side has one partner at most."""
    own = unique(engine, node)
    return own is not None and own <= {(e["alias"], e["name"]) for e in terms if e["kind"] == "field"}


def _bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _same(one: list[Column], two: list[Column]) -> Column:
    out = one[0] == two[0]
    for a, b in zip(one[1:], two[1:]):
        out &= a == b
    return out


def blocks(engine, node: dict, left, right, keys: bool):
    """The join's sides and its rows, where they are many and made in blocks; else None.

    Counting takes a job over the key columns, for joins whose keys may repeat on both sides and whose inputs aren't small.
    """
    if not engine.counts_pairs or left.df.isStreaming or right.df.isStreaming:
        return None
    terms = _terms(node["on"], set(left.scope), set(right.scope))
    if terms is None or _settles(engine, node["left"], terms.left) or _settles(engine, node["right"], terms.right):
        return None
    values = [[engine.expressions(frame)(e) for e in own] for frame, own in ((left, terms.left), (right, terms.right))]
    if any(a.kind == "null" or not alike(a.type, b.type) for a, b in zip(*values)):
        return None
    if _bytes(left.df) * _bytes(right.df) <= PAIRS:  # a row has a byte at least
        return None
    counted = [frame.df.select(*[x.value.alias(f"#{s}{i}") for i, x in enumerate(own)]).groupBy(*[f"#{s}{i}" for i in range(len(own))]).agg(F.count("*").alias(f"#n{s}")) for s, frame, own in (("l", left, values[0]), ("r", right, values[1]))]
    own = {s: [F.col(f"#{s}{i}") for i in range(len(terms.left))] for s in "lr"}
    met = counted[0].join(counted[1], _same(own["l"], own["r"]), "inner")
    pairs, rows = met.agg(F.sum(F.col("#nl").cast("double") * F.col("#nr")), F.sum(F.col("#nl") + F.col("#nr"))).first()
    if not pairs or pairs <= PAIRS or pairs <= GROWTH * rows:
        return None
    parts = [F.ceil(F.col(f"#n{s}") / SIDE).cast("int").alias(f"#p{s}") for s in "lr"]
    held = hold(met.select(*own["l"], *own["r"], *parts, F.monotonically_increasing_id().alias("#k")), "pairs")
    if not keys:  # rows are dealt by identity, which holds when a lost task is run again
        left, right = engine.lower(node["left"], True), engine.lower(node["right"], True)
    tasks = min(math.ceil(pairs / PAIRS), TASKS)
    dealt = [_dealt(engine, frame, own_terms, held, s, other, tasks) for frame, own_terms, s, other in ((left, terms.left, "l", "r"), (right, terms.right, "r", "l"))]
    both = replace(left, scope=left.scope | right.scope, ids={}, meta=left.meta | right.meta)
    test = _same(*[[F.col(f"#{c}{s}") for c in "kab"] for s in "lr"])
    for e in terms.rest:
        x = engine.expressions(both)(e)
        test &= x.value if x.kind == "boolean" else F.lit(False)
    df = dealt[0].hint("merge").join(dealt[1], test, "inner").drop(*[f"#{c}{s}" for c in "kab" for s in "lr"])
    return left, right, df


def _dealt(engine, frame, terms: list[dict], held, s: str, other: str, tasks: int) -> DataFrame:
    """Rows of one side with the number of their key and both parts of a block, once for each part of the other side, dealt by block."""
    values = [engine.expressions(frame)(e).value for e in terms]
    known = held.df.select(F.col("#k").alias(f"#k{s}"), *[F.col(f"#{s}{i}") for i in range(len(terms))], "#pl", "#pr")
    known = F.broadcast(known) if held.table is not None else known
    axes = ("a", "b") if s == "l" else ("b", "a")
    mine = F.pmod(F.xxhash64(frame.identity()), F.col(f"#p{s}")).cast("int").alias(f"#{axes[0]}{s}")
    df = frame.df.join(known, _same(values, [F.col(f"#{s}{i}") for i in range(len(terms))]), "inner").select("*", mine)
    if tasks > REPEATS:  # the repeated rows are many more than those of the input, whose file may have one part
        df = df.repartition(math.ceil(tasks / REPEATS), f"#k{s}", f"#{axes[0]}{s}")
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.col(f"#p{other}") - 1)).alias(f"#{axes[1]}{s}"))
    return df.drop("#pl", "#pr", *[f"#{s}{i}" for i in range(len(terms))]).repartition(tasks, *[f"#{c}{s}" for c in "kab"])
