"""Maintenance, observers, mappings, lenses, schemas, constraints, writes and system relations."""

import random

import pytest
from pyspark.sql import functions as F

from lattisca.functions.expressions import QueryError
from lattisca.operators.constraints import check, delete_with_references
from lattisca.operators.writes import Store, WriteError, batch, sequence, transact, update_where
from lattisca.plans import nodes as n
from lattisca.plans.prepare import fits, prepare
from lattisca.sources import lens, mapping, schema, system
from lattisca.sources.relations import RelationInput
from lattisca.streaming.maintenance import Change, ChangeError, Pool, Session, StaleBasis, bag_minus, change_between, keyed, snapshot_diff
from lattisca.streaming.observer import Observer, restored
from lattisca.streaming.session import Member, QuerySession, Source

f, lit = n.field, n.literal
ITEM = "id int, g int, score int"
GROUP = "g int, label string"


def _plans():
    i, g = n.scan("item"), n.scan("grp")
    on = n.eq(f("item", "g"), f("grp", "g"))
    return {
        "filter": n.pipe(i, n.where(n.compare("gt", f("item", "score"), lit(3))), n.select("r", id=f("item", "id"), s=f("item", "score"))),
        "join": n.pipe(i, n.join(g, "inner", on), n.select("r", id=f("item", "id"), label=f("grp", "label"))),
        "semi": n.pipe(i, n.join(g, "semi", on), n.select("r", id=f("item", "id"))),
        "anti": n.pipe(i, n.join(g, "anti", on), n.select("r", id=f("item", "id"))),
        "left": n.pipe(i, n.join(g, "left", on), n.select("r", id=f("item", "id"), label=f("grp", "label"), alone=n.is_missing(f("grp", "label")))),
        "join_aggregate": n.pipe(i, n.join(g, "inner", on), n.aggregate("a", {"label": f("grp", "label")}, n=n.measure("count"), high=n.measure("maximum", f("item", "score")), mean=n.measure("average", f("item", "score")))),
        "aggregate_join": n.pipe(i, n.aggregate("a", {"g": f("item", "g")}, n=n.measure("count")), n.join(g, "left", n.eq(f("a", "g"), f("grp", "g"))), n.select("r", n=f("a", "n"), label=f("grp", "label"))),
        "three": n.pipe(i, n.join(g, "inner", on), n.join(n.scan("item", "j"), "inner", n.eq(f("item", "id"), f("j", "id"))), n.select("r", id=f("j", "id"), label=f("grp", "label"))),
        "join_window": n.pipe(i, n.join(g, "inner", on), n.window("item", nth=n.over("row-number", [n.by(f("item", "score"))], [f("item", "g")])), n.select("r", id=f("item", "id"), nth=f("item", "nth"))),
        "sorted": n.pipe(i, n.order(n.by(f("item", "score"), "desc"), n.by(f("item", "id"))), n.select("r", id=f("item", "id"))),
        "kleene": n.pipe(i, n.aggregate("a", {"g": f("item", "g")}, any=n.measure("any", n.compare("gt", f("item", "score"), lit(5))), every=n.measure("every", n.compare("gt", f("item", "score"), f("item", "g"))), low=n.measure("minimum", f("item", "g")))),
        "aggregate": n.pipe(i, n.aggregate("a", {"g": f("item", "g")}, n=n.measure("count"), low=n.measure("minimum", f("item", "score")), first=n.measure("first", f("item", "score"), [n.by(f("item", "id"))]))),
        "total": n.pipe(i, n.aggregate("a", {}, n=n.measure("count"), s=n.measure("sum", f("item", "score")))),
        "extremes": n.pipe(i, n.aggregate("a", {"g": f("item", "g")}, n=n.measure("count"), low=n.measure("minimum", f("item", "score")), high=n.measure("maximum", f("item", "score")))),
        "extremes_all": n.pipe(i, n.aggregate("a", {}, n=n.measure("count"), low=n.measure("minimum", f("item", "score")), high=n.measure("maximum", f("item", "score")))),
        "distinct": n.pipe(i, n.select("r", g=f("item", "g")), n.distinct()),
        "window": n.pipe(i, n.window("item", nth=n.over("row-number", [n.by(f("item", "score")), n.by(f("item", "id"))], [f("item", "g")])), n.select("r", id=f("item", "id"), nth=f("item", "nth"))),
        "union": n.pipe(n.pipe(i, n.select("r", g=f("item", "g"))), n.combine("union-all", n.pipe(g, n.select("r", g=f("grp", "g"))))),
        "top": n.pipe(i, n.order(n.by(f("item", "score"), "desc"), n.by(f("item", "id"))), n.cut(limit=3), n.select("r", id=f("item", "id"))),
    }


@pytest.mark.parametrize("name", sorted(_plans()))
def test_maintained_rows_equal_recomputed_rows(spark, name):
    rng, plan = random.Random(name), _plans()[name]
    items = {k: (k, rng.choice([1, 2, 3, None]), rng.randrange(8)) for k in range(12)}
    groups = {k: (k, f"g{k}") for k in (1, 2, 4)}
    make = lambda: {"item": [RelationInput(spark.createDataFrame(list(items.values()), ITEM), ("id",))], "grp": [RelationInput(spark.createDataFrame(list(groups.values()), GROUP), ("g",))]}
    session = Session(spark, plan, make())
    for basis in range(2):
        gone = [items.pop(k) for k in rng.sample(sorted(items), 3)]
        new = [(100 * basis + 50 + k, rng.choice([1, 2, None]), rng.randrange(8)) for k in range(3)] + [(gone[0][0], 3, 7)]
        items |= {r[0]: r for r in new}
        out, into = [groups.pop(2 if basis == 0 else 1)], [(3 if basis == 0 else 2, "new")]
        groups |= {r[0]: r for r in into}
        changes = {"item": Change(spark.createDataFrame(gone, ITEM), spark.createDataFrame(new, ITEM)), "grp": Change(spark.createDataFrame(out, GROUP), spark.createDataFrame(into, GROUP))}
        before = sorted(map(str, session.rows.collect()))
        removed, added = session.update(changes, basis, basis + 1)
        fresh = Session(spark, plan, make())
        now = sorted(map(str, session.rows.collect()))
        assert now == sorted(map(str, fresh.rows.collect()))
        minus, plus = [str(r) for r in removed.collect()], [str(r) for r in added.collect()]
        for r in minus:
            before.remove(r)
        assert sorted(before + plus) == now
    with pytest.raises(StaleBasis):
        session.update({}, 0, 9)
    assert bool(session.counts["fallback"]) == (name == "top") != bool(session.counts["selective"])


@pytest.mark.parametrize("name", sorted(set(_plans()) - {"top", "union"}))
def test_added_rows_alone_are_folded(spark, name):
    rng, plan = random.Random(name), _plans()[name]
    items, groups = [(k, rng.choice([1, 2, 3, None]), rng.choice([None, 1, 6, 9])) for k in range(20)], [(1, "one"), (2, "two")]
    relations = lambda k: {"item": [RelationInput(spark.createDataFrame(items[:k], ITEM), ("id",))], "grp": [RelationInput(spark.createDataFrame(groups, GROUP), ("g",))]}
    session = Session(spark, plan, relations(10))
    none = spark.createDataFrame([], ITEM)
    for basis, k in enumerate((11, 14, 20)):
        session.update({"item": Change(none, spark.createDataFrame(items[10 if not basis else (11, 14)[basis - 1] : k], ITEM))}, basis, basis + 1)
        want, got = ([str(r) for r in df.collect()] for df in (Session(spark, plan, relations(k)).rows, session.rows))
        assert got == want if name == "sorted" else sorted(got) == sorted(want)
    assert not session.counts["fallback"] and (name not in ("kleene", "join_aggregate", "total", "distinct") or session.reasons["groups folded"] and not session.reasons["groups read anew"])


@pytest.mark.parametrize("name", ["extremes", "extremes_all", "distinct"])
def test_removed_rows_are_folded_where_extremes_stay(spark, name):
    rng, plan = random.Random(name), _plans()[name]
    items = [(k, k % 2, s) for k, s in enumerate((5, 4, 1, 9, 9, 3, 5, None))]
    given = lambda rows: {"item": [RelationInput(spark.createDataFrame(rows, ITEM), ("id",))]}
    session, keys = Session(spark, plan, given(items), keys=True), rng.sample(range(len(items)), len(items))
    for basis, k in enumerate(keys):
        gone, items = [r for r in items if r[0] == k], [r for r in items if r[0] != k]
        new = [(50, 0, 6)] if basis == 2 else []
        items += new
        session.update({"item": Change(spark.createDataFrame(gone, ITEM), spark.createDataFrame(new, ITEM))}, basis, basis + 1)
        assert sorted(map(str, session.rows.collect())) == sorted(map(str, Session(spark, plan, given(items), keys=True).rows.collect())), basis
    assert session.reasons["groups folded"] and session.reasons["groups read anew"]


def test_changes_must_fit_their_relation(spark):
    make = lambda: {"item": [RelationInput(spark.createDataFrame([(1, 1, 1), (2, 1, 1)], ITEM), ("id",))]}
    rows = lambda *r: spark.createDataFrame(list(r), ITEM)
    for removed, added in ((rows(), rows((1, 2, 2))), (rows((7, 1, 1)), rows()), (rows(), rows((5, 1, 1), (5, 1, 2)))):
        session = Session(spark, n.scan("item"), make())
        with pytest.raises(ChangeError):
            session.update({"item": Change(removed, added)}, 0, 1)
        assert session.basis == 0 and session.rows.count() == 2


def test_many_rows_go_to_the_shared_folder(spark):
    """Changes and results beyond what the driver holds, and keys that come and go."""
    make = spark.range(5000).selectExpr("CAST(id AS INT) AS id", "CAST(id % 7 AS INT) AS g", "CAST(id % 11 AS INT) AS score")
    plans = {k: _plans()[k] for k in ("filter", "distinct", "aggregate", "window")}
    pool, now = Pool(spark, {"item": [RelationInput(make, ("id",))]}), make
    names = {k: pool.attach(p) for k, p in plans.items()}
    for basis, (gone, new) in enumerate((("id % 3 = 0", "id % 2 = 0"), ("id = 6000", "id = 4"), ("id = 10004", "id < 0"))):
        removed = now.filter(gone)
        added = make.filter(new).selectExpr(f"CAST(id + {10000 * (basis + 1)} AS INT) AS id", "g", "score + 1 AS score")
        removed = now.filter(gone)
        pool.update({"item": Change(removed, added)}, basis, basis + 1)
        now = now.filter(f"NOT ({gone})").unionByName(added)
        for k, p in plans.items():
            assert sorted(map(str, pool.rows(names[k]).collect())) == sorted(map(str, Session(spark, p, {"item": [RelationInput(now, ("id",))]}).rows.collect())), k


def test_sessions_validate_and_know_their_completeness(spark):
    df = spark.createDataFrame([(1, 1, 1)], ITEM)
    with pytest.raises(QueryError):
        Session(spark, n.pipe(n.scan("item"), n.where(n.eq(f("nowhere", "x"), lit(1)))), {"item": [RelationInput(df, ("id",))]})
    count = n.pipe(n.scan("item"), n.aggregate("a", {}, n=n.measure("count")))
    for known, plan, want in (("unknown", n.scan("item"), "unknown"), ("lower-bound", count, "unknown"), ("lower-bound", n.scan("item"), "lower-bound")):
        session = Session(spark, plan, {"item": [RelationInput(df, ("id",), completeness=known)]})
        assert session.completeness == want and (session.rows is None) == (want == "unknown")
        assert (session.update({"item": Change(df.limit(0), spark.createDataFrame([(2, 2, 2)], ITEM))}, 0, 1) is None) == (want == "unknown")


def test_changes_by_result_key(spark):
    plan = n.pipe(n.scan("item"), n.aggregate("a", {"g": f("item", "g")}, n=n.measure("count")))
    session = Session(spark, plan, {"item": [RelationInput(spark.createDataFrame([(1, 1, 1), (2, 2, 1)], ITEM), ("id",))]}, keys=True)
    got = keyed(*session.update({"item": Change(spark.createDataFrame([(2, 2, 1)], ITEM), spark.createDataFrame([(3, 1, 1), (4, 9, 1)], ITEM))}, 0, 1)).collect()
    assert sorted((r.change, r.before and r.before.n, r.after and r.after.n) for r in got) == [("added", None, 1), ("removed", 1, None), ("updated", 1, 2)]


def test_unread_relations_cost_nothing_and_pools_share(spark):
    rel = {"item": [RelationInput(spark.createDataFrame([(1, 1, 1)], ITEM), ("id",))]}
    session = Session(spark, n.scan("item"), rel)
    session.update({"other": Change(spark.range(1), spark.range(1))}, 0, 1)
    assert session.counts == {"unaffected": 1} and session.basis == 1
    pool = Pool(spark, rel)
    count = n.pipe(n.scan("item"), n.aggregate("a", {"g": f("item", "g")}, n=n.measure("count")))
    one, two, three = pool.attach(n.scan("item")), pool.attach(n.scan("item")), pool.attach(count)
    four = pool.attach(n.pipe(count, n.where(n.compare("gt", f("a", "n"), lit(1)))))
    assert one == two != three and len(pool.graph.groups) == 1
    changed = pool.update({"item": Change(spark.createDataFrame([], ITEM), spark.createDataFrame([(2, 1, 5)], ITEM))}, 0, 1)
    assert [r.n for r in pool.rows(three).collect()] == [r.n for r in pool.rows(four).collect()] == [2] and pool.rows(one).count() == 2
    assert [len(r.collect()) for r in changed[three]] == [1, 1] and [len(r.collect()) for r in changed[four]] == [0, 1]
    assert pool.graph.counts["selective"] == 2  # the scan and its groups, once for all queries
    pool.detach(one)
    assert len(pool.graph.roots) == 3
    for key in (two, three, four):
        pool.detach(key)
    assert not pool.graph.roots and not pool.graph.groups


def test_snapshot_diff(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "id int, v string")
    assert sorted(map(tuple, snapshot_diff(a, b, ["id"]).collect())) == [(2, "update"), (3, "delete"), (4, "insert")]


def test_observer_follows_a_stream(spark, tmp_path):
    heard, path = [], str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 5), (2, 1, 6)], ITEM).write.parquet(path)
    session = Session(spark, n.pipe(n.scan("item"), n.aggregate("a", {}, n=n.measure("count"))), {"item": [RelationInput(spark.createDataFrame([], ITEM), ("id",))]})
    observer = Observer(session)
    leave = observer.subscribe(lambda e: heard.append(e[0]))
    observer.follow(spark.readStream.schema(ITEM).parquet(path), "item", str(tmp_path / "ck")).awaitTermination()
    assert observer.snapshot().first().n == 2 and heard == ["reset", "diff"]
    with pytest.raises(StaleBasis):
        observer.update({}, -1, 5)
    assert heard[-1] == "invalidation"
    leave()
    assert not observer.subscribers


def test_followed_relations_outlive_the_driver(spark, tmp_path):
    path, log, check = (str(tmp_path / p) for p in ("in", "log", "ck"))
    count = n.pipe(n.scan("item"), n.aggregate("a", {}, n=n.measure("count"), top=n.measure("maximum", f("item", "score"))))
    base = RelationInput(spark.createDataFrame([(1, 1, 5), (2, 1, 6)], ITEM), ("id",))
    assert restored(spark, log, base) == (base, 0)

    def go(own, basis, rows):
        spark.createDataFrame(rows, ITEM + ", off boolean").write.mode("append").parquet(path)
        o = Observer(Session(spark, count, {"item": [own]}, basis))
        o.follow(spark.readStream.schema(ITEM + ", off boolean").parquet(path), "item", check, "off", log).awaitTermination()
        return tuple(o.snapshot().first()), o.session.basis

    assert go(base, 0, [(1, 1, 5, True), (1, 1, 9, False), (3, 1, 1, None)]) == ((3, 9), 1)
    again, basis = restored(spark, log, base)
    assert basis == 1 and sorted(map(tuple, again.df.collect())) == [(1, 1, 9), (2, 1, 6), (3, 1, 1)]
    assert go(again, basis, [(1, 1, 9, True)]) == ((2, 6), 2)
    bag, basis = restored(spark, log, RelationInput(base.df))
    assert basis == 2 and sorted(map(tuple, bag.df.collect())) == [(2, 1, 6), (3, 1, 1)]
    with pytest.raises(Exception, match="the session at 0"):
        go(base, 0, [(7, 1, 1, False)])


def test_mappings(spark):
    docs = spark.createDataFrame([(1, '{"m": {"b": {"id": "b", "v": 1}, "a": {"id": "zz", "v": 2}}, "one": {"v": 3}}'), (2, "{}")], "d int, body string")
    c = lambda kind, path, **k: {"kind": kind, "path": path, "absent": "empty"} | k
    good, bad = mapping.project(docs, "body", {"collection": c("object-map", ["m"]), "keys": {"k": {"kind": "map-key", "mirror": ["id"]}}, "fields": {"v": {"path": ["v"], "type": "int"}}}, ["d"])
    assert list(map(tuple, good.collect())) == [(1, "b", 1)] and bad.count() == 1
    good, bad = mapping.project(docs, "body", {"collection": c("singleton", ["one"], absent="invalid"), "keys": {"k": {"kind": "literal", "value": "x"}}, "fields": {"v": {"path": ["v"], "type": "int"}, "no": {"kind": "absent"}}}, ["d"])
    assert list(map(tuple, good.collect())) == [(1, "x", 3, None)] and [r.d for r in bad.collect()] == [2]
    deep = spark.createDataFrame([(1, '[{"id": 1, "kids": [{"id": 2}]}]')], "d int, body string")
    how = {"collection": c("recursive-array", [], descendants=["kids"], maxDepth=0), "keys": {"id": {"path": ["id"]}}, "fields": {}}
    with pytest.raises(Exception, match="traversal_budget"):
        mapping.project(deep, "body", how, ["d"])[0].collect()


def test_lenses(spark):
    steps = [{"kind": "lens.field", "from": "slug", "to": "id", "write": "invertible"}, {"kind": "lens.value-map", "from": "state", "to": "st", "cases": [{"from": "o", "to": "open", "writeBack": "to-from"}, {"from": "d", "to": "done", "writeBack": "to-from"}, {"from": "x", "to": "done", "writeBack": "reject"}], "unmapped": "reject"}]
    good, bad = lens.view(spark.createDataFrame([("a", "o"), ("b", "?")], "slug string, state string"), steps)
    assert [tuple(r) for r in good.collect()] == [("a", "open")] and [r._reason for r in bad.collect()] == ["state: unmapped"]
    assert lens.translate({"id": "z", "st": "open"}, steps) == {"slug": "z", "state": "o"}
    with pytest.raises(lens.LensError):
        lens.translate({"st": "done"}, steps)
    graph = [("l1", "v1", "v2"), ("l2", "v2", "v3"), ("l3", "v1", "v3")]
    assert lens.path(graph[:2], "v1", "v3") == ["l1", "l2"]
    for g, end in ((graph, "v3"), (graph, "v9")):
        with pytest.raises(lens.LensError):
            lens.path(g, "v1", end)


def test_schemas(spark):
    kind = lambda k, **more: {"type": {"kind": k} | more}
    customer = {"relationId": "c", "key": ["custkey"], "fields": {"custkey": kind("integer"), "segment": kind("string", values=["BUILDING", "MACHINERY"]), "balance": kind("decimal") | {"nullable": True}, "since": kind("instant") | {"optional": True}}}
    orders = {"relationId": "o", "key": ["orderkey"], "fields": {"orderkey": kind("integer"), "customer": kind("ref", target={"relationId": "c"})}}
    declared = {"relations": {"customer": customer, "orders": orders}}
    assert schema.check_schema(declared) == []
    assert schema.struct_of(orders, declared).simpleString() == "struct<orderkey:bigint,customer:array<bigint>>"
    at = "1996-02-29T00:00:00.000000000Z"
    rows = [(1, "BUILDING", "-0.5", at), (2, "MACHINERY", None, None), (3, "AUTOMOBILE", "1", at), (None, "BUILDING", "1", at), (4, "BUILDING", "1.50", at), (5, "BUILDING", "-0", at), (2**53, "BUILDING", "1", at), (6, None, "1", at), (7, "BUILDING", "1", at[:-1])]
    good, bad = schema.parse_rows(spark.createDataFrame(rows, "custkey bigint, segment string, balance string, since string"), customer)
    assert sorted(r.custkey for r in good.collect()) == [1, 2] and bad.count() == 7
    customer["key"], orders["fields"]["customer"]["type"]["target"] = [], {"relationId": "gone"}
    assert sorted(schema.check_schema(declared)) == ["customer: key_invalid", "orders.customer: ref_target_missing"]


def _store(spark):
    return Store(spark, {"t": spark.createDataFrame([(1, "a😀b", 1, ["x", "y"]), (2, "b", 2, [])], "id int, name string, n int, l array<string>")}, {"t": ["id"]})


def test_writes(spark):
    store = _store(spark)
    row = lambda *ids: spark.createDataFrame([(i, "new", 9, []) for i in ids], store.tables["t"].schema)
    for bad in ({"kind": "insert", "rows": row(1)}, {"kind": "insert", "rows": row(5, 5)}, {"kind": "upsert", "rows": row(1), "onConflict": "reject"}, {"kind": "rekey"}):
        with pytest.raises(WriteError):
            transact(store, [bad | {"relation": "t"}])
    assert store.version == 0
    transact(store, [{"kind": "insert-generated-key", "relation": "t", "rows": row(0, 0).drop("id")}], [{"kind": "count", "statement": 0, "of": "inserted", "op": "eq", "value": 2}])
    assert sorted(r.id for r in store.tables["t"].collect()) == [1, 2, 3, 4] and store.version == 1
    with pytest.raises(WriteError, match="guard"):
        transact(store, [{"kind": "delete", "relation": "t", "when": lambda df: df["n"] > 1}], [{"kind": "query", "root": n.pipe(n.scan("t"), n.where(n.compare("gt", f("t", "n"), lit(1)))), "expect": "exists"}])
    dry = transact(store, [{"kind": "delete", "relation": "t", "when": lambda df: df["n"] > 1}], simulate=True, returning={"left": n.scan("t")})
    assert dry["returning"]["left"].count() == 1 and store.tables["t"].count() == 4
    with pytest.raises(WriteError, match="stale"):
        store.commit({}, 0)


def test_sequences_and_subscriptions(spark):
    store, heard = _store(spark), []
    leave = store.subscribe(heard.append)
    gone = lambda k: [{"kind": "delete", "relation": "t", "when": lambda df: df["id"] == k}]
    bad = [{"kind": "move", "relation": "t"}]
    assert sequence(store, [gone(1), bad, gone(2)]) == [{"version": 1}, {"error": "write.capability_unavailable"}]
    assert sequence(store, [bad, gone(2)], stop=False)[1] == {"version": 2} and heard == [1, 2] and store.tables["t"].count() == 0
    leave()
    assert not store.subscribers and [r["version"] for r in store.receipts] == [1, 2]


def test_prepared_plans_and_parameters(spark):
    root = n.pipe(n.values("v", [{"x": 1}, {"x": 2}]), n.where(n.eq(f("v", "x"), n.parameter("k"))))
    plan = prepare(root, set(), {"k": {"kind": "integer"}})
    root["kind"] = "broken"
    assert plan.evaluate(spark, {}, {"k": 2}).df.count() == 1
    for bad in ({}, {"k": 1.5}, {"k": 1, "z": 1}):
        with pytest.raises(QueryError, match="parameter_invalid"):
            plan.evaluate(spark, {}, bad)
    with pytest.raises(QueryError, match="parameter_undeclared"):
        prepare(plan.root, set(), {})
    record = {"kind": "record", "fields": {"a": {"kind": "tuple", "items": [{"kind": "string", "values": ["x"]}, {"kind": "union", "alternatives": [{"kind": "null"}, {"kind": "decimal"}]}]}, "b": {"kind": "boolean"}}, "optional": ["b"]}
    assert fits(record, {"a": ["x", None]}) and fits(record, {"a": ["x", "1.5"], "b": True})
    assert not fits(record, {"a": ["y", None]}) and not fits(record, {"a": ["x", "01"]}) and not fits(record, {"a": ["x", None], "c": 1})


def test_changes_between_snapshots(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string"), spark.createDataFrame([(1, "x"), (2, "q"), (4, "w")], "id int, v string")
    c = change_between(a, b, ["id"])
    assert sorted(map(tuple, c.removed.collect())) == [(2, "y"), (3, "z")] and sorted(map(tuple, c.added.collect())) == [(2, "q"), (4, "w")]


def test_bags_lose_as_many_rows_as_are_removed(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "id int, v string")
    got = bag_minus(rows, spark.createDataFrame([(1, None), (1, None), (3, "q")], "id int, v string")).collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, None)", "(2, 'a')"]


def test_edits_count_utf16_units(spark):
    got = update_where(_store(spark).tables["t"], F.col("id") == 1, {"name": {"text": [3, 1, "Z"]}, "n": {"increment": 2}, "l": {"list": [1, 1, ["q", "r"]]}}).orderBy("id").collect()
    assert tuple(got[0]) == (1, "a😀Z", 3, ["x", "q", "r"]) and tuple(got[1]) == (2, "b", 2, [])


def test_constraints_and_references(spark):
    tables = {"a": spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id int, parent int"), "b": spark.createDataFrame([(10, 3), (11, 4)], "id int, a int")}
    keys, up = {"a": "id", "b": "id"}, {"from": "a", "field": "parent", "to": "a", "action": "cascade"}
    gone = spark.createDataFrame([(1,)], "id int")
    after = delete_with_references(tables, keys, [up, {"from": "b", "field": "a", "to": "a", "action": "set-null"}], "a", gone)
    assert [r.id for r in after["a"].collect()] == [4] and sorted(map(str, (tuple(r) for r in after["b"].collect()))) == ["(10, None)", "(11, 4)"]
    with pytest.raises(WriteError, match="restricted"):
        delete_with_references(tables, keys, [up, {"from": "b", "field": "a", "to": "a", "action": "restrict"}], "a", gone)
    lower = {"a": [RelationInput(tables["a"], completeness="unknown")]}
    assert check(spark, [{"id": "c", "code": "x", "violationQuery": n.scan("a")}], lower)[0].state == "indeterminate"


def test_references_of_several_fields(spark):
    tables = {
        "a": spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "x int, y int"),
        "b": spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, None), (4, 2, 1)], "id int, x int, y int"),
        "c": spark.createDataFrame([(1, 1, 1, 4), (2, 2, 1, 1), (3, None, None, 1), (4, 2, 1, 4)], "id int, x int, y int, b int"),
    }
    keys = {"a": ["x", "y"], "b": "id", "c": "id"}
    refs = [{"from": "b", "field": ["x", "y"], "to": "a", "action": "cascade"}, {"from": "c", "field": ["x", "y"], "to": "a", "action": "set-null"}, {"from": "c", "field": "b", "to": "b", "action": "set-null"}]
    gone = spark.createDataFrame([(1, 1)], "x int, y int")
    after = delete_with_references(tables, keys, refs, "a", gone)
    rows = {t: sorted(map(str, map(tuple, df.collect()))) for t, df in after.items()}
    assert rows["a"] == ["(1, 2)", "(2, 1)"] and rows["b"] == ["(2, 1, 2)", "(3, 1, None)", "(4, 2, 1)"]
    assert rows["c"] == ["(1, None, None, 4)", "(2, 2, 1, None)", "(3, None, None, None)", "(4, 2, 1, 4)"]
    assert delete_with_references(tables, keys, refs, "a", gone, most_rows=4)["a"].count() == 2
    with pytest.raises(WriteError, match="budget"):
        delete_with_references(tables, keys, refs, "a", gone, most_rows=3)
    with pytest.raises(WriteError, match="invalid"):
        delete_with_references(tables, keys, [{"from": "b", "field": "x", "to": "a", "action": "cascade"}], "a", gone)


def test_operations_are_done_once(spark):
    store = _store(spark)
    gone = [{"kind": "delete", "relation": "t", "when": lambda df: df["id"] == 1}]
    assert transact(store, gone, operation="o", command="delete 1")["version"] == 1
    assert transact(store, gone, operation="o", command="delete 1") == {"version": 1, "replayed": True} and store.version == 1
    with pytest.raises(WriteError, match="ambiguous"):
        transact(store, gone, operation="o", command="delete 2")
    store.ledger.most = 1
    with pytest.raises(WriteError, match="full"):
        transact(store, gone, operation="p")
    store.ledger.rotate("1")
    with pytest.raises(WriteError, match="expired"):
        transact(store, gone, operation="o", epoch="0")
    with pytest.raises(WriteError, match="reused"):
        store.ledger.rotate("0")
    same = [{"kind": "replace-all", "relation": "t", "rows": store.tables["t"]}]
    assert transact(store, same)["version"] == 1 and store.version == 1
    assert transact(store, [{**same[0], "rows": store.tables["t"].limit(0)}])["version"] == 2


def test_batches_over_stores(spark):
    one, two = _store(spark), _store(spark)
    gone = lambda k: [{"kind": "delete", "relation": "t", "when": lambda df: df["id"] == k}]
    bad, broken = [{"kind": "text", "relation": "t"}], [{"kind": "delete", "relation": "t", "when": lambda df: df["absent"] == 1}]
    step = lambda i, store, s: {"id": i, "store": store, "statements": s}
    got = batch([step("a", one, gone(1)), step("b", two, bad), step("c", two, gone(2))])
    assert got["outcome"] == "partial" and [s["outcome"] for s in got["steps"]] == ["applied", "failed", "unattempted"] and (one.version, two.version) == (1, 0)
    got = batch([step("a", one, broken), step("b", two, gone(2))], stop=False)
    assert got["outcome"] == "unknown" and [s["outcome"] for s in got["steps"]] == ["unknown", "applied"] and two.version == 1
    assert batch([step("a", one, gone(2)), step("a", two, gone(1))])["issues"] == ["transaction.batch_step_id_duplicate"] and one.version == 1
    assert batch([step("a", one, gone(2))], cancelled=lambda: True) == {"outcome": "failed", "steps": [{"id": "a", "outcome": "unattempted"}], "issues": ["transaction.cancelled"]}
    assert batch([]) == {"outcome": "complete", "steps": [], "issues": []}


def test_mapped_metadata_and_completeness(spark):
    docs = spark.createDataFrame([(1, '{"l": [{"v": 1}, {"v": 2}], "t": [{"id": "p", "kids": [{"id": "q"}]}, {"id": "r"}]}'), (2, "{}")], "d int, body string")
    meta = lambda v: {"kind": "source-metadata", "value": v}
    how = {"collection": {"kind": "array", "path": ["l"], "absent": "creatable"}, "keys": {"k": meta("collection-element-identity")}, "fields": {"at": meta("collection-position"), "v": {"path": ["v"], "type": "int"}, "up": meta("recursive-parent-element-identity")}}
    own = mapping.relation(docs, "body", how, ["d"])
    assert own.completeness == "exact" and sorted(map(tuple, own.df.collect())) == [(1, '["1","0"]', 0, 1, None), (1, '["1","1"]', 1, 2, None)]
    tree = {"collection": {"kind": "recursive-array", "path": ["t"], "absent": "empty", "descendants": ["kids"]}, "keys": {"id": {"path": ["id"]}}, "fields": {"me": meta("collection-element-identity"), "up": meta("recursive-parent-element-identity")}}
    assert sorted(map(tuple, mapping.project(docs, "body", tree, ["d"])[0].collect())) == [(1, "p", '["1","0"]', None), (1, "q", '["1","1"]', '["1","0"]'), (1, "r", '["1","2"]', None)]
    assert mapping.relation(docs, "body", how | {"collection": how["collection"] | {"absent": "invalid"}}, ["d"]).completeness == "unknown"
    with pytest.raises(ValueError):
        mapping.project(docs, "body", {"collection": {"kind": "singleton", "path": ["l"], "absent": "creatable"}, "keys": {}, "fields": {}}, ["d"])


def test_lossy_cases_are_warned_of(spark):
    steps = [{"kind": "lens.value-map", "from": "s", "to": "state", "cases": [{"from": "o", "to": "open", "writeBack": "to-from"}, {"from": "p", "to": "open", "writeBack": "reject"}, {"from": "x", "to": "shut", "writeBack": "reject"}]}]
    rows = spark.createDataFrame([("o",), ("p",), ("p",), (None,)], "s string")
    assert list(map(tuple, lens.lossy(rows, steps).collect())) == [("state", "open", 2)]
    assert lens.lossy(rows, []).count() == 0


def _part(spark, name, rows, authority="", links=()):
    closed = []
    own = {"item": RelationInput(spark.createDataFrame(rows, "id int, v int"), ("id",)), "link": RelationInput(spark.createDataFrame(list(links), "target string, expectation string"), ("target",))}
    return Source(name, own, authority, lambda: closed.append(name)), closed


COUNT = n.pipe(n.scan("item"), n.aggregate("a", {}, n=n.measure("count")))


def test_sessions_follow_members(spark):
    (a, shut_a), (b, shut_b) = _part(spark, "a", [(1, 1), (2, 2)]), _part(spark, "b", [(1, 5)], authority="other")
    s, heard = QuerySession(spark, COUNT, [Member("a", a), Member("b", None)]), []
    assert s.completeness == "unknown" and s.rows is None and s.issues[0] == "dataset.member_unresolved: b"
    s.subscribe(lambda e: heard.append(e[0]))
    s.resolve("b", b)
    assert s.completeness == "unknown"  # it may not be read
    s.detach("b")
    assert shut_b == ["b"] and s.rows.first().n == 2 and s.session is not None
    none = a.relations["item"].df.limit(0)
    assert s.update("a", {"item": Change(none, spark.createDataFrame([(3, 3)], "id int, v int"))}, 0) == 1
    assert s.rows.first().n == 3 and s.session.counts["fallback"] == 0 and heard == ["reset"] * 3 + ["diff"]
    with pytest.raises(StaleBasis):
        s.update("a", {}, 0)
    with pytest.raises(ChangeError):
        s.update("a", {"item": Change(none, spark.createDataFrame([(3, 3)], "id int, v int"))}, 1)
    assert heard[-1] == "invalidation" and s.members["a"].basis == 1 and s.rows.first().n == 3
    s.attach(Member("c", _part(spark, "c", [(1, 1)])[0], "optional"))
    assert s.rows.first().n == 4 and s.completeness == "exact"
    s.update("c", {"item": Change(none, spark.createDataFrame([(9, 9)], "id int, v int"))}, 0)
    assert s.rows.first().n == 5
    s.close()
    assert shut_a == ["a"]
    with pytest.raises(ValueError):
        s.detach("a")


def test_sessions_of_part_of_the_members(spark):
    a, _ = _part(spark, "a", [(1, 1), (2, 2)])
    keep = n.pipe(n.scan("item"), n.where(n.compare("gt", f("item", "v"), lit(1))))
    s = QuerySession(spark, keep, [Member("a", a), Member("b")], partial=True)
    assert s.completeness == "lower-bound" and s.rows.count() == 1
    assert QuerySession(spark, COUNT, [Member("a", a), Member("b")], partial=True).completeness == "unknown"
    assert QuerySession(spark, COUNT, [Member("a", a), Member("b", None, "optional")]).rows.first().n == 2
    assert QuerySession(spark, COUNT, []).completeness == "unknown"
    with pytest.raises(ValueError):
        QuerySession(spark, COUNT, [Member("a", a), Member("a")])


def test_sessions_follow_links(spark):
    made, shut = {}, []
    links = {"b": [("c", None), ("a", None)], "c": [("b", None), ("x", "optional")]}

    def opened(name):
        if name == "x":
            return None
        made[name], own = _part(spark, name, [(1, 1)], links=links[name])
        shut.append(own)
        return made[name]

    a, _ = _part(spark, "a", [(1, 1)], links=[("b", None)])
    s = QuerySession(spark, COUNT, [Member("a", a)], links=n.scan("link"), open_source=opened)
    assert sorted(s.members) == ["a", "b", "c", "x"] and s.settled and s.rows.first().n == 3 and s.members["x"].expectation == "optional"
    link = a.relations["link"].df
    s.update("a", {"link": Change(link, link.limit(0))}, 0)
    assert sorted(s.members) == ["a"] and sorted(sum(shut, [])) == ["b", "c"] and s.rows.first().n == 1
    with pytest.raises(ValueError, match="budget"):
        QuerySession(spark, COUNT, [Member("a", a)], links=n.scan("link"), open_source=opened, most=1)


def test_system_relations_and_discovery(spark):
    own = system.system_relations(spark, {"t": [RelationInput(spark.range(1), source="s")]}, {("fn", "1"): None}, [("code", "d")], repairs=[("c", "1")])
    assert tuple(own["system.repair_candidates"][0].df.first()) == ("c", "1")
    assert len(own) == 10 and own["system.schemas"][0].df.first().relationId == "t" and own["system.sources"][0].df.count() == 1
    links = {"a": ["b", "c"], "b": ["a"], "c": ["d"], "d": []}
    found, edges = system.discover(["a"], lambda s: spark.createDataFrame([(x,) for x in links[s]], "to string"))
    assert sorted(found) == ["a", "b", "c", "d"] and len(edges) == 4
    with pytest.raises(ValueError):
        system.discover(["a"], lambda s: spark.createDataFrame([(x,) for x in links[s]], "to string"), most=2)
