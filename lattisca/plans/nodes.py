"""Builders of portable plans. A plan is plain JSON data, so it can be stored, sent, hashed and compared.

Expressions and nodes are dicts with a ``kind``; operators take their input last, so ``pipe(source, op(...), op(...))`` reads
in the order of evaluation.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

Expr = dict
Node = dict


def pipe(value, *steps: Callable):
    for step in steps:
        value = step(value)
    return value


def plan_id(node: Node) -> str:
    """SHA-256 of the canonical JSON of a plan."""
    return hashlib.sha256(json.dumps(node, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


# Expressions.


def literal(value) -> Expr:
    return {"kind": "literal", "value": value}


def parameter(name: str) -> Expr:
    return {"kind": "parameter", "name": name}


def field(alias: str, name: str) -> Expr:
    return {"kind": "field", "alias": alias, "name": name}


def compare(op: str, left: Expr, right: Expr) -> Expr:
    return {"kind": "compare", "op": op, "left": left, "right": right}


def eq(left: Expr, right: Expr) -> Expr:
    return compare("eq", left, right)


def all_of(*args: Expr) -> Expr:
    return {"kind": "boolean", "op": "and", "args": list(args)}


def any_of(*args: Expr) -> Expr:
    return {"kind": "boolean", "op": "or", "args": list(args)}


def negate(arg: Expr) -> Expr:
    return {"kind": "boolean", "op": "not", "arg": arg}


def arithmetic(op: str, left: Expr, right: Expr) -> Expr:
    return {"kind": "arithmetic", "op": op, "left": left, "right": right}


def text(op: str, *args: Expr) -> Expr:
    return {"kind": "string", "op": op, "args": list(args)}


def array(*items: Expr) -> Expr:
    return {"kind": "array", "items": list(items)}


def record(**fields: Expr) -> Expr:
    return {"kind": "record", "fields": fields}


def case(branches: list[tuple[Expr, Expr]], otherwise: Expr) -> Expr:
    return {"kind": "case", "branches": [{"when": w, "then": t} for w, t in branches], "otherwise": otherwise}


def coalesce(*args: Expr) -> Expr:
    return {"kind": "coalesce", "args": list(args)}


def call(capability: str, *args: Expr, version: str = "1") -> Expr:
    return {"kind": "call", "capability": {"id": capability, "version": version}, "args": list(args)}


def exists(query: Node) -> Expr:
    return {"kind": "subquery", "mode": "exists", "query": query}


def scalar(query: Node) -> Expr:
    return {"kind": "subquery", "mode": "scalar", "query": query}


def is_null(value: Expr) -> Expr:
    return {"kind": "is-null", "value": value}


def is_missing(value: Expr) -> Expr:
    return {"kind": "is-missing", "value": value}


def key_of(alias: str) -> Expr:
    return {"kind": "key-of", "alias": alias}


def source_of(alias: str) -> Expr:
    return {"kind": "source-of", "alias": alias}


def by(value: Expr, direction: str = "asc", nulls: str = "last") -> dict:
    return {"value": value, "direction": direction, "nulls": nulls}


def measure(op: str, value: Expr | None = None, order: list[dict] | None = None) -> dict:
    return {"kind": "aggregate", "op": op} | ({"value": value} if value else {}) | ({"orderBy": order} if order else {})


def over(op: str, order: list[dict], partition: list[Expr] | None = None, value: Expr | None = None, offset: int | None = None) -> dict:
    return {"kind": "window", "op": op, "orderBy": order} | ({"partitionBy": partition} if partition else {}) | ({"value": value} if value else {}) | ({"offset": offset} if offset else {})


# Nodes.


def scan(relation: str, alias: str | None = None) -> Node:
    return {"kind": "from", "relation": relation, "alias": alias or relation}


def values(alias: str, rows: list[dict]) -> Node:
    return {"kind": "values", "alias": alias, "rows": rows}


def where(predicate: Expr):
    return lambda child: {"kind": "where", "input": child, "predicate": predicate}


def select(alias: str, **fields: Expr):
    return lambda child: {"kind": "select", "input": child, "alias": alias, "fields": fields}


def with_fields(alias: str, **fields: Expr):
    return lambda child: {"kind": "with-fields", "input": child, "alias": alias, "fields": fields}


def rename(alias: str, **fields: str):
    return lambda child: {"kind": "rename", "input": child, "alias": alias, "fields": fields}


def omit(alias: str, *fields: str):
    return lambda child: {"kind": "omit", "input": child, "alias": alias, "fields": list(fields)}


def unnest(expression: Expr, alias: str, name: str):
    return lambda child: {"kind": "unnest", "input": child, "expression": expression, "alias": alias, "field": name}


def join(right: Node, how: str, on: Expr | None = None):
    return lambda left: {"kind": "join", "join": how, "left": left, "right": right} | ({"on": on} if on else {})


def aggregate(alias: str, groups: dict[str, Expr], **measures: dict):
    return lambda child: {"kind": "aggregate", "input": child, "alias": alias, "groupBy": groups, "measures": measures}


def distinct():
    return lambda child: {"kind": "distinct", "input": child}


def combine(op: str, right: Node):
    """union, union-all, intersect or except."""
    return lambda left: {"kind": "set", "op": op, "left": left, "right": right}


def order(*terms: dict):
    return lambda child: {"kind": "order", "input": child, "by": list(terms)}


def cut(offset: int | None = None, limit: int | None = None):
    return lambda child: {"kind": "slice", "input": child} | ({} if offset is None else {"offset": offset}) | ({} if limit is None else {"limit": limit})


def window(alias: str, **fields: dict):
    return lambda child: {"kind": "window", "input": child, "alias": alias, "fields": fields}


def seek(terms: list[dict], after: dict):
    """after: order (the last row's order values), resultKey, basis and membershipRevision."""
    return lambda child: {"kind": "seek", "input": child, "by": terms, "after": after}


def again(name: str) -> Node:
    return {"kind": "recursion-ref", "name": name}


def recursive(name: str, seed: Node, step: Node, key: list[Expr], max_iterations: int | None = 100, max_rows: int | None = 100_000) -> Node:
    """A least fixpoint; a limit of None is none."""
    return {"kind": "recursive", "name": name, "seed": seed, "step": step, "key": key, "maxIterations": max_iterations, "maxRows": max_rows}


def children(node: Node) -> list[Node]:
    return [node[k] for k in ("input", "left", "right", "seed", "step") if k in node]


def relations_of(part) -> set[str]:
    """Names of all relations that a plan or expression reads, subqueries included."""
    if isinstance(part, list):
        return set().union(*map(relations_of, part), set())
    if not isinstance(part, dict):
        return set()
    own = {part["relation"]} if part.get("kind") == "from" else set()
    return own.union(*(relations_of(v) for k, v in part.items() if not (part.get("kind") in ("literal", "values") and k in ("value", "rows"))), set())
