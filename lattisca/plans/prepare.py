"""Prepared plans: validated once, frozen as text, and known by the hash of it; and parameters checked against declarations."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lattisca.functions.expressions import QueryError
from lattisca.plans.engine import Result, evaluate
from lattisca.plans.nodes import plan_id
from lattisca.plans.validate import validate
from lattisca.sources.relations import RelationInput
from lattisca.sources.schema import BYTES, DECIMAL, INSTANT, SAFE


@dataclass(frozen=True)
class Prepared:
    text: str
    id: str
    parameters: tuple[tuple[str, str], ...] = ()

    @property
    def root(self) -> dict:
        return json.loads(self.text)

    def evaluate(self, spark: SparkSession, relations: dict[str, list[RelationInput]], parameters: dict | None = None, **options) -> Result:
        declared = {k: json.loads(v) for k, v in self.parameters}
        return evaluate(spark, self.root, relations, parameters=parse_parameters(declared, parameters or {}), **options)


def prepare(root: dict, relations: set[str] | None = None, parameters: dict[str, dict] | None = None) -> Prepared:
    """Checks a plan and detaches it from the caller's data; raises QueryError with all that is wrong."""
    problems = validate(root, relations, set(parameters or {}))
    if problems:
        raise QueryError("query.plan_invalid", "; ".join(f"{p}: {c}" for p, c in problems))
    return Prepared(json.dumps(root, sort_keys=True), plan_id(root), tuple((k, json.dumps(v)) for k, v in sorted((parameters or {}).items())))


def parse_parameters(declared: dict[str, dict], given: dict) -> dict:
    """given, if every declared parameter is there, no other, and each keeps its declaration; else QueryError names them."""
    issues = [f"{k}: extra" for k in sorted(set(given) - set(declared))] + [f"{k}: missing" for k in sorted(set(declared) - set(given))]
    issues += [f"{k}: invalid" for k in sorted(set(given) & set(declared)) if not fits(declared[k], given[k])]
    if issues:
        raise QueryError("query.parameter_invalid", "; ".join(issues))
    return dict(given)


def fits(declared: dict, value) -> bool:
    """Whether a plain value keeps a value declaration."""
    kind = declared["kind"]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "string":
        return isinstance(value, str) and ("values" not in declared or value in declared["values"])
    if kind == "boolean":
        return isinstance(value, bool)
    if kind == "number":
        return number and math.isfinite(value)
    if kind == "integer":
        return number and float(value).is_integer() and abs(value) <= SAFE
    if kind in ("decimal", "instant", "bytes"):
        return isinstance(value, str) and bool(re.match({"decimal": DECIMAL, "instant": INSTANT, "bytes": BYTES}[kind], value))
    if kind == "null":
        return value is None
    if kind in ("array", "ref"):
        return isinstance(value, list) and len(value) <= declared.get("maxItems", len(value)) and all(fits(declared.get("items", {"kind": "json"}), v) for v in value)
    if kind == "tuple":
        return isinstance(value, list) and len(value) == len(declared["items"]) and all(map(fits, declared["items"], value))
    if kind == "record":
        fields, loose = declared["fields"], set(declared.get("optional", []))
        return isinstance(value, dict) and set(value) <= set(fields) and all(k in value and fits(d, value[k]) or k not in value and k in loose for k, d in fields.items())
    if kind == "union":
        return sum(fits(d, value) for d in declared["alternatives"]) == 1
    return kind in ("json", "custom")
