"""Completeness of a result, folded over the plan on the driver before anything runs.

``exact``: all rows; ``lower-bound``: only proven rows; ``unknown``: no assertion, so no rows.
"""

from __future__ import annotations

EXACT, LOWER, UNKNOWN = "exact", "lower-bound", "unknown"
#: Nodes whose rows can't be proven from part of their input.
NEEDS_EXACT = {"aggregate", "order", "slice", "window", "seek"}


def weakest(*parts: str) -> str:
    return UNKNOWN if UNKNOWN in parts else LOWER if LOWER in parts else EXACT


def _subqueries(part, found: list) -> list:
    if isinstance(part, list):
        for p in part:
            _subqueries(p, found)
    elif isinstance(part, dict):
        if part.get("kind") == "subquery":
            found.append(part)
        for k, v in part.items():
            if k not in ("input", "left", "right", "seed", "step", "query") or "kind" not in (v if isinstance(v, dict) else {}) or part.get("kind") in ("compare", "arithmetic"):
                _subqueries(v, found)
    return found


def completeness(node: dict, inputs: dict[str, list[str]], issues: list[str]) -> str:
    """inputs: relation -> completeness of each of its inputs. Reasons for ``unknown`` are added to issues."""

    def of(n: dict) -> str:
        kind = n["kind"]
        if kind == "from":
            own = inputs.get(n["relation"])
            if own is None:
                issues.append("query.relation_missing")
                return UNKNOWN
            if UNKNOWN in own:
                issues.append("query.relation_incomplete")
            return weakest(*own)
        if kind in ("values", "recursion-ref"):
            return EXACT
        if kind == "join":
            left, right = of(n["left"]), of(n["right"])
            if n["join"] in ("left", "anti"):
                return left if right == EXACT else fail("query.input_incomplete")
            return weakest(left, right)
        if kind == "set":
            left, right = of(n["left"]), of(n["right"])
            if n["op"] == "except":
                return left if right == EXACT else fail("query.input_incomplete")
            return weakest(left, right)
        if kind == "recursive":
            return EXACT if of(n["seed"]) == EXACT == of(n["step"]) else fail("query.input_incomplete")
        child = of(n["input"])
        if kind in NEEDS_EXACT and child != EXACT:
            return fail("query.input_incomplete") if child != UNKNOWN else UNKNOWN
        for sub in _subqueries({k: v for k, v in n.items() if k != "input"}, []):
            inner = of(sub["query"])
            if inner == UNKNOWN or inner == LOWER:  # an exists over proven rows may hold, but which rows it drops isn't known
                return fail("query.subquery_incomplete")
        return child

    def fail(code: str) -> str:
        issues.append(code)
        return UNKNOWN

    return of(node)
