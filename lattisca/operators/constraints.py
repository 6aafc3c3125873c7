"""Constraints as violation queries, and referential actions as fixed points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.operators.writes import WriteError
from lattisca.plans.engine import evaluate
from lattisca.sources.relations import RelationInput
from lattisca.sources.shared import spool


@dataclass(frozen=True)
class Verdict:
    """state: satisfied, violated or indeterminate (an input was incomplete); rows: the violations."""

    code: str
    state: str
    rows: DataFrame | None


def check(spark: SparkSession, constraints: list[dict], relations: dict[str, list[RelationInput]]) -> list[Verdict]:
    """Runs each constraint's violationQuery: {id, code, violationQuery}."""
    if len({c["id"] for c in constraints}) != len(constraints):
        raise WriteError("constraint.id_duplicate")
    out = []
    for c in constraints:
        r = evaluate(spark, c["violationQuery"], relations)
        out.append(Verdict(c["code"], "indeterminate" if r.df is None or r.completeness != "exact" else "satisfied" if r.df.isEmpty() else "violated", r.df))
    return out


def _fields(named: str | list[str]) -> list[str]:
    return [named] if isinstance(named, str) else list(named)


def _referring(df: DataFrame, fields: list[str], parents: DataFrame, how: str) -> DataFrame:
    """df joined to keys of parents (their first columns) by its fields, in order; a null in any of them refers to nothing."""
    own = parents.toDF(*[f"#parent/{i}" for i in range(len(fields))], *parents.columns[len(fields) :])
    test = F.lit(True)
    for i, f in enumerate(fields):
        test = test & (F.col(_quoted(f)) == F.col(f"`#parent/{i}`"))
    return df.join(own, test, how)


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def delete_with_references(
    tables: dict[str, DataFrame], keys: dict[str, str | list[str]], references: list[dict], relation: str, gone: DataFrame, most_rounds: int = 1000, most_rows: int | None = None
) -> dict[str, DataFrame]:
    """Tables after the rows of ``gone`` (key values, in the key's order) leave a relation, with the actions of references carried out.

    references: {from, field, to, action}, field being one name or a list as long as the key of ``to``: restrict refuses, cascade
    deletes the referring rows, set-null empties their fields. A null key in ``gone`` names no row. Rounds of semi-joins run until
    no further row goes; each is written out. More than most_rows rows deleted by cascades or emptied raise
    ``constraint.referential_budget_exceeded``; None sets no limit, as no round is held on the driver.
    """
    key = {t: _fields(k) for t, k in keys.items()}
    for r in references:
        if not _fields(r["field"]) or len(_fields(r["field"])) != len(key[r["to"]]):
            raise WriteError("constraint.referential_action_invalid")
    doomed: dict[str, DataFrame] = {relation: spool(gone.select(*map(_quoted, gone.columns[: len(key[relation])])).toDF(*key[relation]).distinct(), "doomed")}
    fresh, emptied, made = dict(doomed), {}, 0
    for _ in range(most_rounds):
        following: dict[str, DataFrame] = {}
        for r in references:
            if r["to"] not in fresh:
                continue
            child, fields = r["from"], _fields(r["field"])
            out = _referring(tables[child], fields, fresh[r["to"]], "left_semi")
            if r["action"] == "restrict":
                if not out.isEmpty():  # rows that go anyway refuse as well
                    raise WriteError("constraint.reference_restricted")
            elif r["action"] == "cascade":
                more = out.select(*map(_quoted, key[child]))
                if child in doomed:
                    more = more.join(doomed[child], key[child], "left_anti")
                more = more.distinct()
                following[child] = following[child].unionByName(more).distinct() if child in following else more
            else:
                place = child, tuple(fields)
                emptied[place] = emptied[place].union(fresh[r["to"]]) if place in emptied else fresh[r["to"]]
                made += out.count() if most_rows is not None else 0
        fresh = {t: d for t, df in following.items() if not (d := spool(df, "doomed")).isEmpty()}
        if most_rows is not None:
            made += sum(df.count() for df in fresh.values())
            if made > most_rows:
                raise WriteError("constraint.referential_budget_exceeded")
        if not fresh:
            break
        for t, df in fresh.items():
            doomed[t] = doomed[t].unionByName(df) if t in doomed else df
    else:
        raise WriteError("constraint.budget_exceeded")
    out = dict(tables)
    for t in {child for child, _ in emptied}:
        own, empty = tables[t], {}
        for k, (fields, parents) in enumerate((fs, p) for (child, fs), p in emptied.items() if child == t):
            own = _referring(own, list(fields), parents.distinct().withColumn(f"#hit/{k}", F.lit(True)), "left").drop(*[f"#parent/{i}" for i in range(len(fields))])
            for f in fields:
                empty[f] = empty.get(f, F.lit(False)) | F.coalesce(F.col(f"`#hit/{k}`"), F.lit(False))
        out[t] = own.select(*[F.when(~empty[c], F.col(_quoted(c))).alias(c) if c in empty else F.col(_quoted(c)) for c in tables[t].columns])
    return {t: df.join(doomed[t], key[t], "left_anti").select(*map(_quoted, df.columns)) if t in doomed else df for t, df in out.items()}
