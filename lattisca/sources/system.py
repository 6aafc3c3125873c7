"""Catalogue relations of a session, and discovery of linked sources."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattisca.sources.relations import RelationInput

_TABLES = {
    "sources": "sourceId string, basis string",
    "attachments": "attachmentId string, sourceId string, relationId string",
    "memberships": "relationId string, attachmentId string, revision bigint",
    "resources": "resourceId string, sourceId string",
    "discovery_edges": "fromSource string, toSource string",
    "schemas": "relationId string, field string, type string, nullable boolean",
    "capabilities": "id string, version string",
    "issues": "code string, detail string",
    "constraints": "id string, code string",
    "repair_candidates": "constraintId string, rowKey string",
}


def system_relations(spark: SparkSession, relations: dict[str, list[RelationInput]], functions: dict | None = None, issues: list[tuple[str, str]] = (), constraints: list[dict] = (), edges: list[tuple[str, str]] = (), revision: int = 0, repairs: list[tuple[str, str]] = ()) -> dict[str, list[RelationInput]]:
    """The ten catalogue relations as inputs, named ``system.<name>``. They hold what the driver knows of a session, one row a source, field or issue.

    repairs: (constraint, key of the row) of what the caller could mend.
    """
    flat = [(r, i, x) for r, own in sorted(relations.items()) for i, x in enumerate(own)]
    rows = {
        "sources": sorted({(x.source, json.dumps(x.basis)) for _, _, x in flat if x.source}),
        "attachments": [(x.attachment or f"{r}:{i}", x.source, r) for r, i, x in flat],
        "memberships": [(r, x.attachment or f"{r}:{i}", revision) for r, i, x in flat],
        "resources": sorted({(x.source, x.source) for _, _, x in flat if x.source}),
        "discovery_edges": sorted(edges),
        "schemas": [(r, f.name, f.dataType.simpleString(), f.nullable) for r, i, x in flat if i == 0 for f in x.df.schema.fields],
        "capabilities": sorted(functions or {}),
        "issues": list(issues),
        "constraints": [(c["id"], c["code"]) for c in constraints],
        "repair_candidates": sorted(repairs),
    }
    return {f"system.{n}": [RelationInput(spark.createDataFrame(rows[n], schema))] for n, schema in _TABLES.items()}


def discover(start: list[str], links: Callable[[str], DataFrame], most: int = 1000) -> tuple[list[str], list[tuple[str, str]]]:
    """Sources reachable from ``start``, in the order found, and the edges between them. links(source) has one row a link, its target first.

    Breadth first, each source once; more than ``most`` sources raise ValueError. A link query returns the sources that one source names, not data.
    """
    found, edges, frontier = list(dict.fromkeys(start)), [], list(dict.fromkeys(start))
    while frontier:
        later = []
        for s in frontier:
            for row in links(s).distinct().limit(most + 1).collect():
                edges.append((s, row[0]))
                if row[0] not in found:
                    found.append(row[0])
                    later.append(row[0])
                    if len(found) > most:
                        raise ValueError("discovery.budget_exceeded")
        frontier = later
    return found, edges
