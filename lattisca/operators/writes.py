"""Relational writes as rewrites of versioned DataFrames, with guards and a compare-and-set commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattisca.plans.engine import Engine, evaluate
from lattisca.plans.nodes import scan
from lattisca.sources.relations import RelationInput
from lattisca.sources.shared import spool


class WriteError(Exception):
    pass


def _on(df: DataFrame, other: DataFrame, key: list[str]) -> Column:
    test = None
    for k in key:
        t = df[f"`{k}`"] == other[f"`{k}`"]
        test = t if test is None else test & t
    return test


def _unique(df: DataFrame, key: list[str], code: str) -> None:
    if any_null := [F.col(f"`{k}`").isNull() for k in key]:
        test = any_null[0]
        for t in any_null[1:]:
            test = test | t
        if not df.filter(test).isEmpty():
            raise WriteError("write.key_missing")
    if not df.groupBy(*key).count().filter("count > 1").isEmpty():
        raise WriteError(code)


def insert(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with new keys are appended; a key that is there, or twice among the rows, is refused."""
    _unique(rows, key, "write.key_ambiguous")
    if not rows.join(df, _on(rows, df, key), "left_semi").isEmpty():
        raise WriteError("write.key_exists")
    return df.unionByName(rows, allowMissingColumns=True)


def upsert(df: DataFrame, rows: DataFrame, key: list[str], on_conflict: str = "replace") -> DataFrame:
    """on_conflict: reject, keep-existing or replace."""
    _unique(rows, key, "write.key_ambiguous")
    if on_conflict == "reject":
        return insert(df, rows, key)
    if on_conflict == "keep-existing":
        return df.unionByName(rows.join(df, _on(rows, df, key), "left_anti"), allowMissingColumns=True)
    return df.join(rows, _on(df, rows, key), "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_all(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    _unique(rows, key, "write.key_ambiguous")
    return rows.select(*df.columns)


def keyed_delta(df: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes: the columns of df and ``change`` (insert, update or delete); each key once. Updates and deletes need their row, inserts its absence."""
    _unique(changes, key, "write.key_ambiguous")
    there = changes.join(df.select(*key).withColumn("__there", F.lit(True)), key, "left")
    if not there.filter(F.col("__there").isNotNull() == (F.col("change") == "insert")).isEmpty():
        raise WriteError("write.target_mismatch")
    return df.join(changes, _on(df, changes, key), "left_anti").unionByName(changes.filter("change != 'delete'").drop("change"))


def update_where(df: DataFrame, when: Column, edits: dict[str, dict]) -> DataFrame:
    """Edits of the rows where ``when`` is true: {replace: value}, {increment: n}, {text: [start, delete, insert]} (in UTF-16 units), {list: [start, delete, items]}."""

    def edited(c: str, e: dict) -> Column:
        v = F.col(f"`{c}`")
        if "replace" in e:
            return e["replace"] if isinstance(e["replace"], Column) else F.lit(e["replace"])
        if "increment" in e:
            return v + e["increment"]
        start, gone, new = next(iter(e.values()))
        if "list" in e:
            return F.concat(F.slice(v, 1, start), F.array(*map(F.lit, new)).cast(df.schema[c].dataType), F.slice(v, start + gone + 1, F.greatest(F.size(v) - start - gone, F.lit(0))))
        wide = F.hex(F.encode(v, "UTF-16BE"))
        cut = lambda a, b: F.decode(F.unhex(F.substr(wide, a, b)), "UTF-16BE")
        return F.concat(cut(F.lit(1), F.lit(4 * start)), F.lit(new), cut(F.lit(4 * (start + gone) + 1), F.length(wide)))

    hit = F.coalesce(when, F.lit(False))
    return df.select(*[F.when(hit, edited(c, edits[c])).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) if c in edits else F.col(f"`{c}`") for c in df.columns])


def delete_where(df: DataFrame, when: Column) -> DataFrame:
    """Only rows where ``when`` is true go."""
    return df.filter(~F.coalesce(when, F.lit(False)))


class Ledger:
    """What became of the operations of an epoch, so that one which is sent again isn't done again.

    It is held by the driver and promises nothing after a restart. Entries of the current epoch are never evicted: beyond ``most`` of them
    new operations are refused until rotate() begins another epoch, whose name must be new.
    """

    def __init__(self, epoch: str = "0", most: int = 65_536):
        self.epoch, self.most, self.retired = epoch, most, set()
        self.entries: dict[str, tuple[str, dict]] = {}

    def known(self, operation: str, command: str = "", epoch: str | None = None) -> dict | None:
        """The receipt of an operation that was done; None if it wasn't seen. The same name with another command is refused."""
        if epoch not in (None, self.epoch):
            raise WriteError("operation.expired")
        if operation not in self.entries:
            if len(self.entries) >= self.most:
                raise WriteError("operation.ledger_full")
            return None
        said, receipt = self.entries[operation]
        if said != command:
            raise WriteError("operation.ambiguous")
        return receipt

    def record(self, operation: str, command: str, receipt: dict) -> None:
        self.entries[operation] = command, receipt

    def rotate(self, epoch: str) -> None:
        if not epoch or epoch == self.epoch or epoch in self.retired:
            raise WriteError("operation.epoch_reused")
        self.retired.add(self.epoch)
        self.epoch, self.entries = epoch, {}


@dataclass
class Store:
    """Versioned relations. A commit names the version it was made from; another one in between refuses it."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    keys: dict[str, list[str]]
    version: int = 0
    receipts: list[dict] = field(default_factory=list)
    ledger: Ledger = field(default_factory=Ledger)
    subscribers: list[Callable[[int], None]] = field(default_factory=list)

    def subscribe(self, hear: Callable[[int], None]) -> Callable[[], None]:
        """Calls hear with each new version; the function returned ends it."""
        self.subscribers.append(hear)
        return lambda: self.subscribers.remove(hear)

    def inputs(self, tables: dict[str, DataFrame] | None = None) -> dict[str, list[RelationInput]]:
        return {t: [RelationInput(df, tuple(self.keys[t]), basis=self.version)] for t, df in (tables or self.tables).items()}

    def commit(self, tables: dict[str, DataFrame], expected: int, label: str = "") -> int:
        if expected != self.version:
            raise WriteError("write.basis_stale")
        self.tables, self.version = tables, self.version + 1
        self.receipts.append({"version": self.version, "label": label})
        for hear in list(self.subscribers):
            hear(self.version)
        return self.version


def predicate(engine: Engine, df: DataFrame, relation: str, test: dict) -> tuple[DataFrame, Column]:
    """A plan predicate over a relation's rows (alias: the relation's name) as a column of them."""
    frame = engine.lower(scan(relation))
    x = engine.expressions(frame)(test)
    return frame.df, x.value


def transact(store: Store, statements: list[Callable | dict], guards: list[dict] | None = None, returning: dict[str, dict] | None = None, simulate: bool = False, attempts: int = 16, operation: str | None = None, command: str = "", epoch: str | None = None) -> dict:
    """Statements on a snapshot, checked by guards, then published at once.

    A statement is {kind, relation, ...}: insert, upsert (onConflict), replace-all and keyed-delta take rows (a DataFrame);
    insert-from-query takes root; insert-generated-key takes rows without the key, which is numbered on from the largest; update takes
    when (a function of the DataFrame) and edits; delete takes when. Guards: {kind: count, statement, of: inserted, deleted or
    changed, op: eq, gte or lte, value} and {kind: query, root, expect: exists or empty}. returning: named plans over the new
    state. simulate leaves the store alone. A stale basis is tried again from the new version. Where every statement is a
    replace-all by equal rows, nothing is published and the version stays.

    operation names the transaction in the store's ledger: sent again under the same name, with the same command (a text that
    stands for what it does) and epoch, it isn't done again, and ``replayed`` marks the first receipt, {version}.
    """
    if operation is not None and not simulate and (receipt := store.ledger.known(operation, command, epoch)) is not None:
        return {**receipt, "replayed": True}
    from lattisca.streaming.maintenance import snapshot_diff

    for _ in range(attempts):
        version, tables, counts = store.version, dict(store.tables), []
        for s in statements:
            relation, kind = s["relation"], s["kind"]
            key, before = store.keys[relation], tables[relation]
            if kind == "insert":
                after = insert(before, s["rows"], key)
            elif kind == "insert-generated-key":
                top = before.agg(F.max(key[0])).first()[0] or 0
                numbered = _numbered(s["rows"])
                after = before.unionByName(numbered.select((F.col("__n") + 1 + top).cast(before.schema[key[0]].dataType).alias(key[0]), *s["rows"].columns), allowMissingColumns=True)
            elif kind == "insert-from-query":
                made = evaluate(store.spark, s["root"], store.inputs(tables))
                if made.completeness != "exact":
                    raise WriteError("write.query_incomplete")
                after = insert(before, made.df, key)
            elif kind == "upsert":
                after = upsert(before, s["rows"], key, s.get("onConflict", "replace"))
            elif kind == "replace-all":
                after = replace_all(before, s["rows"], key)
            elif kind == "keyed-delta":
                after = keyed_delta(before, s["rows"], key)
            elif kind == "update":
                after = update_where(before, s["when"](before), s["edits"])
            elif kind == "delete":
                after = delete_where(before, s["when"](before))
            else:
                raise WriteError("write.capability_unavailable")
            same = kind == "replace-all" and snapshot_diff(before, after, key).isEmpty()
            tables[relation] = before if same else spool(after, "staged")
            counts.append((relation, before, tables[relation], key))
        for g in guards or []:
            if g["kind"] == "query":
                r = evaluate(store.spark, g["root"], store.inputs(tables))
                if r.df is None or r.df.isEmpty() != (g["expect"] == "empty"):
                    raise WriteError("write.guard_failed")
                continue
            _, before, after, key = counts[g["statement"]]
            kinds = {"inserted": ["insert"], "deleted": ["delete"], "changed": ["insert", "delete", "update"]}[g["of"]]
            n = snapshot_diff(before, after, key).filter(F.col("change").isin(kinds)).count()
            if not {"eq": n == g["value"], "gte": n >= g["value"], "lte": n <= g["value"]}[g["op"]]:
                raise WriteError("write.guard_failed")
        shown = {k: evaluate(store.spark, root, store.inputs(tables)).df for k, root in (returning or {}).items()}
        if simulate:
            return {"version": version, "tables": tables, "returning": shown}
        try:
            unchanged = version == store.version and all(tables[t] is df for t, df in store.tables.items())
            receipt = {"version": version if unchanged else store.commit(tables, version)}
            if operation is not None:
                store.ledger.record(operation, command, receipt)
            return {**receipt, "tables": tables, "returning": shown}
        except WriteError as e:
            if "stale" not in str(e):
                raise
    raise WriteError("write.basis_stale")


def sequence(store: Store, transactions: list[list[dict]], stop: bool = True) -> list[dict]:
    """Transactions one after another, each on its own: a receipt {version} or {error} for each. stop: none is tried after one that fails; otherwise all are."""
    out: list[dict] = []
    for statements in transactions:
        try:
            out.append({"version": transact(store, statements)["version"]})
        except WriteError as e:
            out.append({"error": str(e)})
            if stop:
                break
    return out


def batch(steps: list[dict], stop: bool = True, cancelled: Callable[[], bool] = lambda: False) -> dict:
    """Transactions on one or several stores, one after another and without a common rollback.

    A step is {id, store, statements} and what else transact() takes. The receipt: outcome (complete, partial, failed or unknown), for each step
    its outcome (applied, failed, unattempted or unknown) with the version or the error, and issues. A step that fails for another reason than a
    refusal has an unknown outcome. stop: none is tried after one that wasn't applied. cancelled is asked before each step. Two steps of one id: none is tried.
    """
    done, issues, halted = [], [], False
    if len({s["id"] for s in steps}) != len(steps):
        return {"outcome": "failed", "steps": [{"id": s["id"], "outcome": "unattempted"} for s in steps], "issues": ["transaction.batch_step_id_duplicate"]}
    for s in steps:
        if not halted and cancelled():
            halted = True
            issues.append("transaction.cancelled")
        if halted:
            done.append({"id": s["id"], "outcome": "unattempted"})
            continue
        try:
            made = transact(s["store"], s["statements"], **{k: v for k, v in s.items() if k not in ("id", "store", "statements")})
            done.append({"id": s["id"], "outcome": "applied", "version": made["version"]})
        except WriteError as e:
            done.append({"id": s["id"], "outcome": "failed", "error": str(e)})
        except Exception as e:
            done.append({"id": s["id"], "outcome": "unknown", "error": type(e).__name__})
            issues.append("transaction.outcome_unavailable")
        halted = stop and done[-1]["outcome"] != "applied"
    found = {s["outcome"] for s in done}
    return {"outcome": "unknown" if "unknown" in found else "complete" if found <= {"applied"} else "partial" if "applied" in found else "failed", "steps": done, "issues": issues}


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with ``__n``, distinct numbers from 0. Counts of partitions make them gapless without ordering rows in one task."""
    at = spool(rows, "numbered").withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id() % (1 << 33)})
    starts = at.groupBy("__p").agg(F.count(F.lit(1)).alias("__k")).withColumn("__s", F.sum("__k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    return at.join(starts, "__p").withColumn("__n", F.coalesce("__s", F.lit(0)) + F.col("__i")).select(*rows.columns, "__n")
