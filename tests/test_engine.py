"""Operators of the relational engine on small rows, with the rules for missing, null and unknown values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattisca.functions.expressions import QueryError
from lattisca.plans import nodes as n
from lattisca.plans.engine import evaluate
from lattisca.sources.relations import RelationInput

f, lit = n.field, n.literal


@pytest.fixture(scope="module")
def run(spark):
    def go(plan, relations=None, **options):
        made = {}
        for name, rows in (relations or {}).items():
            made[name] = rows if isinstance(rows, list) and rows and isinstance(rows[0], RelationInput) else [RelationInput(rows, (rows.columns[0],))]
        return evaluate(spark, plan, made, **options)

    return go


def rows_of(result):
    return [r.asDict(recursive=True) for r in result.df.collect()]


def one(run, **exprs):
    return rows_of(run(n.pipe(n.values("v", [{"x": 1}]), n.select("r", **exprs)), keep_status=True))[0]


def test_comparisons_of_null_missing_and_unlike_kinds(run):
    got = one(run, a=n.eq(lit(None), lit(None)), b=n.eq(lit("1"), lit(1)), c=n.compare("ne", lit("1"), lit(1)), d=n.compare("lt", lit("1"), lit(1)), e=n.eq(n.array(lit(None)), n.array(lit(None))), g=n.eq(f("v", "gone"), lit(1)))
    assert got["a"] is None and got["b"] is False and got["c"] is True and got["d"] is None and got["e"] is True and got["g"] is None
    assert got["a?unknown"] and got["d?unknown"] and got["g?unknown"]


def test_null_and_missing_tests(run):
    got = one(run, a=n.is_null(lit(None)), b=n.is_null(f("v", "gone")), c=n.is_missing(f("v", "gone")), d=n.is_missing(lit(None)), e=n.is_null(n.eq(lit(None), lit(1))), g=n.is_missing(n.parameter("unset")))
    assert (got["a"], got["b"], got["c"], got["d"], got["e"], got["g"]) == (True, False, True, False, None, True)


@pytest.mark.parametrize("op,a,b,want", [("and", False, None, False), ("and", True, None, None), ("or", True, None, True), ("or", False, None, None), ("and", True, True, True), ("or", False, False, False)])
def test_kleene_connectives(run, op, a, b, want):
    make = n.all_of if op == "and" else n.any_of
    assert one(run, r=make(lit(a), n.eq(lit(b), lit(True)) if b is None else lit(b)))["r"] is want


def test_arithmetic_has_no_infinities_and_no_errors(run):
    a = n.arithmetic
    got = one(run, zero=a("divide", lit(1), lit(0)), rest=a("modulo", lit(1), lit(0)), big=a("multiply", lit(1e308), lit(10)), sign=a("modulo", lit(-5.5), lit(2)), text=a("add", lit("1"), lit(1)), fine=a("subtract", lit(3), lit(1)))
    assert [got[k] for k in ("zero", "rest", "big", "sign", "text", "fine")] == [None, None, None, -1.5, None, 2.0]
    assert got["zero?unknown"] and got["big?unknown"] and not got["fine?unknown"]


def test_strings_arrays_records_and_choices(run):
    got = one(
        run, n=n.text("length", lit("a😀")), u=n.text("upper", lit("ß")), c=n.text("concat", lit("a"), lit(1)), arr=n.array(lit(1), lit(None)), bad=n.array(lit(1.0), n.arithmetic("divide", lit(1), lit(0))), rec=n.record(b=lit(1), a=lit("x")),
        case=n.case([(lit(None), lit(1)), (n.eq(f("v", "gone"), lit(1)), lit(2))], lit(3)), first=n.coalesce(f("v", "gone"), lit(None), lit(7)), stop=n.coalesce(n.arithmetic("divide", lit(1), lit(0)), lit(7.0)), none=n.coalesce(f("v", "gone")),
    )
    assert (got["n"], got["u"], got["c"], got["arr"], got["rec"], got["case"], got["first"], got["stop"], got["none"]) == (2, "SS", None, [1, None], {"a": "x", "b": 1}, 3, 7, None, None)
    assert got["bad"] is None and got["stop?unknown"]


def test_projection_nodes(run):
    src = n.values("v", [{"a": 1, "b": "x"}, {"a": 2}])
    assert rows_of(run(n.pipe(src, n.with_fields("v", a=f("v", "gone"), c=f("v", "a"))))) == [{"a": 1, "b": "x", "c": 1}, {"a": 2, "b": None, "c": 2}]
    assert rows_of(run(n.pipe(src, n.rename("v", a="b", b="a")))) == [{"b": 1, "a": "x"}, {"b": 2, "a": None}]
    assert rows_of(run(n.pipe(src, n.omit("v", "b", "zz")))) == [{"a": 1}, {"a": 2}]
    got = rows_of(run(n.pipe(n.values("v", [{"k": 1, "xs": [1, None]}, {"k": 2, "xs": []}, {"k": 3, "xs": None}]), n.unnest(f("v", "xs"), "u", "x"), n.select("r", k=f("v", "k"), x=f("u", "x")))))
    assert got == [{"k": 1, "x": 1}, {"k": 1, "x": None}]
    assert rows_of(run(n.pipe(src, n.where(n.is_missing(f("v", "b"))), n.select("r", a=f("v", "a"))))) == [{"a": 2}]


def test_joins(run):
    left, right = n.values("l", [{"id": 1}, {"id": 2}, {"id": None}]), n.values("r", [{"of": 1, "v": "x"}, {"of": 1, "v": "y"}, {"of": None, "v": "z"}])
    on = n.eq(f("l", "id"), f("r", "of"))
    flat = n.select("o", id=f("l", "id"), v=f("r", "v"), alone=n.is_missing(f("r", "v")), null=n.is_null(f("r", "v")))
    got = lambda how: sorted(map(str, (tuple(r.values()) for r in rows_of(run(n.pipe(left, n.join(right, how, on), flat))))))
    assert got("inner") == ["(1, 'x', False, False)", "(1, 'y', False, False)"]
    assert got("left") == ["(1, 'x', False, False)", "(1, 'y', False, False)", "(2, None, True, False)", "(None, None, True, False)"]
    ids = lambda how: sorted(str(r["id"]) for r in rows_of(run(n.pipe(left, n.join(right, how, on)))))
    assert ids("semi") == ["1"] and ids("anti") == ["2", "None"]
    assert run(n.pipe(left, n.join(right, "cross"))).df.count() == 9
    pair = lambda a: n.array(f(a, "id" if a == "l" else "of"), lit(1))
    assert run(n.pipe(left, n.join(right, "inner", n.eq(pair("l"), pair("r"))))).df.count() == 3  # a null member of a tuple matches
    assert set(run(n.pipe(left, n.join(right, "inner", on))).df.columns) == {"l", "r"}


def test_aggregates_with_nulls_and_missing(run):
    src = n.values("i", [{"k": 1, "s": None}, {"k": 2, "s": 2}, {"k": 3}])
    m, s = n.measure, f("i", "s")
    by_k = [n.by(f("i", "k"))]
    plan = n.pipe(src, n.aggregate("g", {}, all=m("count"), known=m("count", s), kinds=m("count-distinct", s), total=m("sum", s), low=m("minimum", s), high=m("maximum", s), list=m("collect", s, by_k), first=m("first", s, by_k), last=m("last", s, by_k), back=m("collect", f("i", "k"), [n.by(f("i", "k"), "desc")])))
    assert rows_of(run(plan)) == [{"all": 3, "known": 1, "kinds": 1, "total": 2.0, "low": None, "high": 2, "list": [None, 2], "first": None, "last": 2, "back": [3, 2, 1]}]
    groups = rows_of(run(n.pipe(src, n.aggregate("g", {"s": s}, n=m("count"))), keep_status=True))
    assert sorted((str(g["s"]), g["s?missing"], g["n"]) for g in groups) == [("2", False, 1), ("None", False, 1), ("None", True, 1)]


def test_any_and_every_are_kleene(run):
    def of(values, op):
        return rows_of(run(n.pipe(n.values("v", [{"b": b} for b in values]), n.aggregate("g", {}, r=n.measure(op, f("v", "b"))))))[0]["r"]

    assert of([False, None], "any") is None and of([True, None], "any") is True and of([False], "any") is False
    assert of([True, None], "every") is None and of([False, None], "every") is False and of([True], "every") is True


def test_empty_global_aggregate(run):
    empty = n.pipe(n.values("v", [{"x": 1, "b": True}]), n.where(lit(False)))
    got = rows_of(run(n.pipe(empty, n.aggregate("g", {}, n=n.measure("count"), s=n.measure("sum", f("v", "x")), a=n.measure("any", f("v", "b")), e=n.measure("every", f("v", "b")), c=n.measure("collect", f("v", "x"))))))
    assert got == [{"n": 0, "s": None, "a": False, "e": True, "c": []}]


def test_sets_and_distinct(run):
    a, b = n.values("v", [{"x": 1}, {"x": 1}, {"x": None}]), n.values("v", [{"x": None}, {"x": 2}])
    got = lambda op: sorted(str(r["x"]) for r in rows_of(run(n.pipe(a, n.combine(op, b)))))
    assert got("union") == ["1", "2", "None"] and got("union-all") == ["1", "1", "2", "None", "None"] and got("intersect") == ["None"] and got("except") == ["1"]
    holes = n.values("v", [{"x": None, "k": 1}, {"k": 1}, {"k": 1}])
    assert run(n.pipe(holes, n.distinct())).df.count() == 2  # null and missing differ


def test_order_puts_null_then_missing_last_both_ways(run):
    src = n.values("v", [{"id": 1}, {"id": 2, "x": None}, {"id": 3, "x": 5}, {"id": 4, "x": 7}])
    ids = lambda *t: [r["id"] for r in rows_of(run(n.pipe(src, n.order(n.by(f("v", "x"), *t)))))]
    assert ids("asc") == [3, 4, 2, 1] and ids("desc") == [4, 3, 2, 1] and ids("asc", "first") == [2, 1, 3, 4]


def test_ties_break_by_result_key_and_keys_are_length_prefixed(run, spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "id string, x int")
    result = run(n.pipe(n.scan("t"), n.order(n.by(f("t", "x")))), {"t": [RelationInput(df, ("id",), source="src")]}, keys=True)
    assert [(r["id"], r["_key"]) for r in rows_of(result)] == [("c", "1:t10:3:src3:t:c"), ("a", "1:t10:3:src3:t:a"), ("b", "1:t10:3:src3:t:b")]


def test_seek_pages_cover_all_rows_once(run):
    src = n.values("v", [{"id": i, "x": i % 3 if i % 4 else None} for i in range(12)])
    terms = [n.by(f("v", "x"), "desc")]
    whole = rows_of(run(n.pipe(src, n.order(*terms)), keys=True))
    seen, after = whole[:3], whole[2]
    while True:
        page = rows_of(run(n.pipe(src, n.seek(terms, {"order": [after["x"]], "resultKey": after["_key"], "basis": 4, "membershipRevision": 0}), n.cut(limit=4)), keys=True, basis=4))
        if not page:
            break
        seen, after = seen + page, page[-1]
    assert seen == whole
    stale = run(n.pipe(src, n.seek(terms, {"order": [1], "resultKey": "", "basis": 3})), basis=4)
    assert stale.df is None and stale.issues == ("query.cursor_stale",)


@pytest.mark.parametrize("direction,nulls", [("asc", "last"), ("desc", "last"), ("asc", "first"), ("desc", "first")])
def test_seek_passes_from_null_to_missing(run, direction, nulls):
    src = n.values("v", [{"id": 0}, {"id": 1, "x": None}, {"id": 2, "x": 5}, {"id": 3, "x": 7}])
    terms = [n.by(f("v", "x"), direction, nulls)]
    whole = rows_of(run(n.pipe(src, n.order(*terms)), keys=True))
    for k, r in enumerate(whole):
        if r["id"]:
            page = rows_of(run(n.pipe(src, n.seek(terms, {"order": [r["x"]], "resultKey": r["_key"], "basis": 4, "membershipRevision": 0})), keys=True, basis=4))
            assert page == whole[k + 1 :]


def test_nested_values_compare_by_kind_and_field(run):
    arr, rec, c = n.array, n.record, n.compare
    got = one(
        run, fields=n.eq(rec(a=lit(1)), rec(b=lit(1))), more=n.eq(rec(a=lit(1)), rec(a=lit(1), b=lit(2))), kinds=n.eq(arr(lit("a")), arr(lit(1))), null=n.eq(arr(lit(None)), arr(lit(1))), deep=n.eq(rec(a=arr(rec(x=lit(1)))), rec(a=arr(rec(x=lit(1.0))))),
        shorter=c("lt", arr(lit("a")), arr(lit(None), lit(1))), string_first=c("lt", arr(lit("z")), arr(lit(1))), array_first=c("gt", rec(a=lit(1)), arr(lit(1))), by_name=c("lt", rec(a=lit(9)), rec(b=lit(1))), scalar=c("lt", lit("a"), arr(lit(1))),
    )
    assert [got[k] for k in ("fields", "more", "kinds", "null", "deep", "shorter", "string_first", "array_first", "by_name", "scalar")] == [False, False, False, False, True, False, True, True, True, None]


def test_groups_of_null_and_missing_have_keys_of_their_own(run):
    src = n.values("i", [{"s": None}, {"s": 2}, {}])
    keys = [r["_key"] for r in rows_of(run(n.pipe(src, n.aggregate("g", {"s": f("i", "s")}, n=n.measure("count"))), keys=True))]
    assert len(set(keys)) == 3 and any('{"s":null}' in k for k in keys) and any("{}" in k for k in keys)


def test_rows_without_keys_are_known_by_content(run, spark):
    df = spark.createDataFrame([(3, 1), (1, 1), (2, 1)], "id int, x int")
    order = lambda d: [r["id"] for r in rows_of(run(n.pipe(n.scan("t"), n.order(n.by(f("t", "x")))), {"t": [RelationInput(d)]}))]
    assert order(df) == order(df.repartition(3)) == order(df.coalesce(1))


def test_windows(run):
    src = n.values("p", [{"who": w, "pts": p} for w, p in (("Ada", 12), ("Bob", 8), ("Cy", 8), ("Dee", 3))])
    down = [n.by(f("p", "pts"), "desc")]
    got = rows_of(run(n.pipe(src, n.window("p", nth=n.over("row-number", down), rank=n.over("rank", down), before=n.over("lag", down, value=f("p", "pts")), again=n.over("lag", [n.by(f("p", "nth"))], value=f("p", "nth"))))))
    assert sorted((r["who"], r["nth"], r["rank"], r["before"], r["again"]) for r in got) == [("Ada", 1, 1, None, None), ("Bob", 2, 2, 12, 1), ("Cy", 3, 2, 8, 2), ("Dee", 4, 4, 8, 3)]


def test_subqueries(run):
    people, pets = n.values("p", [{"id": 1}, {"id": 2}]), n.values("t", [{"own": 1, "x": 5}, {"own": 1, "x": 6}])
    own = n.pipe(pets, n.where(n.eq(f("t", "own"), f("p", "id"))))
    plan = n.pipe(people, n.select("r", id=f("p", "id"), any=n.exists(own), n=n.scalar(n.pipe(own, n.aggregate("g", {}, n=n.measure("count")))), x=n.scalar(n.pipe(own, n.select("k", x=f("t", "x"))))))
    got = sorted(((r["id"], r["any"], r["n"], r["x"], r["x?unknown"]) for r in rows_of(run(plan, keep_status=True))))
    assert got == [(1, True, 2, None, True), (2, False, 0, None, True)]


def test_recursion_with_a_cycle_and_budgets(run):
    edges = n.values("e", [{"a": a, "b": b} for a, b in ((1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (9, 8))])
    step = n.pipe(n.again("r"), n.join(edges, "inner", n.eq(f("x", "n"), f("e", "a"))), n.select("x", n=f("e", "b")))
    plan = lambda **o: n.recursive("r", n.values("x", [{"n": 1}]), step, [f("x", "n")], **o)
    assert sorted(r["n"] for r in rows_of(run(plan()))) == [1, 2, 3, 4, 5]
    for o in ({"max_iterations": 2}, {"max_rows": 3}):
        got = run(plan(**o))
        assert got.completeness == "unknown" and got.issues == ("query.recursion_budget_exceeded",)


def test_functions_see_nulls_but_not_missing(run):
    fns = {("tag", "1"): (lambda x: F.coalesce(x.cast("string"), F.lit("null")), T.StringType())}
    src = n.values("v", [{"id": 1, "x": 3}, {"id": 2, "x": None}, {"id": 3}])
    got = rows_of(run(n.pipe(src, n.select("r", id=f("v", "id"), t=n.call("tag", f("v", "x")))), functions=fns, keep_status=True))
    assert [(r["id"], r["t"], r["t?unknown"]) for r in got] == [(1, "3", False), (2, "null", False), (3, None, True)]
    assert run(n.pipe(src, n.select("r", t=n.call("none", f("v", "x"))))).issues == ("query.capability_missing",)


def test_completeness(run, spark):
    df = spark.createDataFrame([(1,)], "id int")
    part = {"t": [RelationInput(df, completeness="lower-bound")], "u": [RelationInput(df)]}
    t, u, on = n.scan("t"), n.scan("u"), n.eq(f("t", "id"), f("u", "id"))
    assert run(n.pipe(t, n.where(lit(True))), part).completeness == "lower-bound"
    assert run(n.pipe(t, n.join(u, "left", on)), part).completeness == "lower-bound"
    for bad in (n.pipe(u, n.join(t, "anti", on)), n.pipe(t, n.aggregate("g", {}, n=n.measure("count"))), n.pipe(t, n.order(n.by(f("t", "id"))))):
        assert run(bad, part).completeness == "unknown"
    assert run(t, {"t": [RelationInput(df, completeness="unknown")]}).issues == ("query.relation_incomplete",)


def test_several_inputs_and_sources(run, spark):
    parts = {"t": [RelationInput(spark.createDataFrame([(1,)], "id int"), source="a"), RelationInput(spark.createDataFrame([(2, "x")], "id int, extra string"), source="b")]}
    got = rows_of(run(n.pipe(n.scan("t"), n.select("r", id=f("t", "id"), src=n.source_of("t"), key=n.key_of("t"), gap=n.is_missing(f("t", "extra")))), parts))
    assert sorted(map(tuple, (r.values() for r in got))) == [(1, "a", 1, True), (2, "b", 2, False)]


def test_validation(run):
    v = n.values("v", [{"x": 1}])
    bad = [
        n.pipe(v, n.where(n.eq(f("w", "x"), lit(1)))), n.pipe(v, n.join(v, "cross")), n.pipe(v, n.join(n.values("w", [{}]), "inner")), n.pipe(v, n.combine("union", n.values("w", [{"x": 1}]))), n.pipe(v, n.rename("v", x="a", y="a")), n.pipe(v, n.cut(-1)), n.pipe(v, n.order()),
        n.pipe(v, n.aggregate("g", {"n": f("v", "x")}, n=n.measure("count"))), n.pipe(v, n.window("v", a=n.over("lag", [n.by(f("v", "x"))]))), n.again("nowhere"), n.pipe(v, n.where(n.all_of())), n.recursive("r", v, n.pipe(n.again("r"), n.distinct()), [f("v", "x")]), n.pipe(v, n.unnest(f("v", "x"), "v", "y")),
    ]
    for plan in bad:
        with pytest.raises(QueryError, match="query.plan_invalid"):
            run(plan)
    assert n.plan_id(v) == n.plan_id(n.values("v", [{"x": 1}])) and n.relations_of(n.pipe(v, n.where(n.exists(n.scan("q"))))) == {"q"}


def test_plans_push_filters_and_prune_columns(run, spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).selectExpr("id", "id * 2 AS x", "id AS unused").write.parquet(path)
    result = run(n.pipe(n.scan("t"), n.where(n.compare("gt", f("t", "id"), lit(3))), n.select("r", x=f("t", "x"))), {"t": [RelationInput(spark.read.parquet(path))]})
    plan = result.df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(id,3)" in plan and "unused" not in plan.split("ReadSchema")[1].split("\n")[0]
