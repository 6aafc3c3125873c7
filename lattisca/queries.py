"""The registered queries: one or more for each operator, each with the SQL that an independent engine answers it by.

No table holds a null, so queries about nulls, missing and unknown values make their own, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattisca.plans import nodes as n
from lattisca.plans.engine import evaluate
from lattisca.sources.relations import catalog

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}
FUNCTIONS = {("discounted", "1"): (lambda price, size: F.round(price * (1 - size / 100.0), 4), T.DoubleType())}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, plan: dict, **options) -> DataFrame:
    result = evaluate(spark, plan, catalog(spark, sf_dir, sorted(n.relations_of(plan)), KEYS), functions=FUNCTIONS, **options)
    if result.df is None:
        raise ValueError(f"{result.completeness}: {result.issues}")
    return result.df


def plan(sql: str, **options):
    """Registers a function that makes a plan, under its name, with its SQL."""

    def keep(make):
        QUERIES[make.__name__] = lambda spark, sf_dir, make=make: run(spark, sf_dir, make(), **options)
        ORACLES[make.__name__] = sql
        return make

    return keep


def query(sql: str | None):
    """Registers a function of (spark, sf_dir)."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def f(alias: str, name: str) -> dict:
    return n.field(alias, name)


def lit(v) -> dict:
    return n.literal(v)


def maybe(alias: str, test: str, bound, name: str) -> dict:
    """The field, or null where another exceeds a bound."""
    return n.case([(n.compare("gt", f(alias, test), lit(bound)), lit(None))], f(alias, name))


# Sources, projection and filters.


@plan("SELECT * FROM region")
def scan_from():
    return n.scan("region")


@plan("SELECT * FROM (VALUES (1, 'a', 1.5), (2, 'b', 2.5), (3, NULL, NULL)) t(id, name, score)".replace("1.5", "1.5::DOUBLE").replace("(1,", "(1::BIGINT,"))
def values_literal():
    return n.values("v", [{"id": 1, "name": "a", "score": 1.5}, {"id": 2, "name": "b", "score": 2.5}, {"id": 3, "name": None}])


for _op, _sql in {"eq": "=", "ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}.items():
    QUERIES[f"filter_compare_{_op}"] = lambda spark, sf_dir, op=_op: run(spark, sf_dir, n.pipe(n.scan("lineitem", "l"), n.where(n.compare(op, f("l", "l_quantity"), lit(25.0))), n.select("o", l_orderkey=f("l", "l_orderkey"), l_linenumber=f("l", "l_linenumber"), l_quantity=f("l", "l_quantity"))))
    ORACLES[f"filter_compare_{_op}"] = f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sql} 25.0"


@plan("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_orderpriority = '1-URGENT')")
def filter_bool():
    o = lambda x: f("o", x)
    return n.pipe(n.scan("orders", "o"), n.where(n.all_of(n.any_of(n.eq(o("o_orderstatus"), lit("F")), n.compare("gt", o("o_totalprice"), lit(200000))), n.negate(n.eq(o("o_orderpriority"), lit("1-URGENT"))))), n.select("r", o_orderkey=o("o_orderkey"), o_totalprice=o("o_totalprice")))


@plan("SELECT c_custkey FROM customer WHERE (CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END) < 1000 OR c_mktsegment = 'BUILDING'")
def filter_null_logic():
    bal = maybe("c", "c_acctbal", 5000, "c_acctbal")
    return n.pipe(n.scan("customer", "c"), n.where(n.any_of(n.compare("lt", bal, lit(1000)), n.eq(f("c", "c_mktsegment"), lit("BUILDING")))), n.select("r", c_custkey=f("c", "c_custkey")))


@plan("SELECT n_nationkey, FALSE AS same, TRUE AS other, NULL::BOOLEAN AS less FROM nation")
def compare_unlike_kinds():
    return n.pipe(n.scan("nation", "x"), n.select("r", n_nationkey=f("x", "n_nationkey"), same=n.eq(f("x", "n_name"), f("x", "n_nationkey")), other=n.compare("ne", f("x", "n_name"), f("x", "n_nationkey")), less=n.compare("lt", f("x", "n_name"), f("x", "n_nationkey"))))


@plan("SELECT c_custkey, c_acctbal > 5000 AS nothing, FALSE AS gone, TRUE AS absent FROM customer")
def null_and_missing():
    c = maybe("c", "c_acctbal", 5000, "c_name")
    return n.pipe(n.scan("customer", "c"), n.select("r", c_custkey=f("c", "c_custkey"), nothing=n.is_null(c), gone=n.is_null(f("c", "no_such")), absent=n.is_missing(f("c", "no_such"))))


@plan("""SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0 - l_discount) AS net, l_quantity / NULLIF(l_linenumber - 1, 0) AS per_line, l_extendedprice - l_quantity AS less, fmod(l_extendedprice, 7.0) AS rest, l_tax + l_discount AS both_rates FROM lineitem""")
def select_arith():
    x = lambda a: f("l", a)
    return n.pipe(n.scan("lineitem", "l"), n.select("r", l_orderkey=x("l_orderkey"), l_linenumber=x("l_linenumber"), net=n.arithmetic("multiply", x("l_extendedprice"), n.arithmetic("subtract", lit(1.0), x("l_discount"))), per_line=n.arithmetic("divide", x("l_quantity"), n.arithmetic("subtract", x("l_linenumber"), lit(1))), less=n.arithmetic("subtract", x("l_extendedprice"), x("l_quantity")), rest=n.arithmetic("modulo", x("l_extendedprice"), lit(7.0)), both_rates=n.arithmetic("add", x("l_tax"), x("l_discount"))))


@plan("SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_type)::BIGINT AS size, p_brand || ' / ' || p_type AS label FROM part")
def select_string():
    p = lambda a: f("p", a)
    return n.pipe(n.scan("part", "p"), n.select("r", p_partkey=p("p_partkey"), up=n.text("upper", p("p_name")), low=n.text("lower", p("p_brand")), size=n.text("length", p("p_type")), label=n.text("concat", p("p_brand"), lit(" / "), p("p_type"))))


@plan("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS tier, coalesce(CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_name END, c_mktsegment) AS label FROM customer")
def case_coalesce():
    b = f("c", "c_acctbal")
    return n.pipe(n.scan("customer", "c"), n.select("r", c_custkey=f("c", "c_custkey"), tier=n.case([(n.compare("lt", b, lit(0)), lit("debt")), (n.compare("lt", b, lit(5000)), lit("some"))], lit("rich")), label=n.coalesce(f("c", "no_such"), maybe("c", "c_acctbal", 5000, "c_name"), f("c", "c_mktsegment"))))


@plan("SELECT n_nationkey, list_value(n_nationkey, n_regionkey) = list_value(n_regionkey, n_nationkey) AS mirrored, n_nationkey > n_regionkey AS after_pair FROM nation")
def array_record():
    a, b = f("x", "n_nationkey"), f("x", "n_regionkey")
    return n.pipe(n.scan("nation", "x"), n.select("r", n_nationkey=a, mirrored=n.eq(n.array(a, b), n.array(b, a)), after_pair=n.compare("gt", n.record(k=a), n.record(k=b))))


@plan("SELECT n_nationkey, FALSE AS other_field, n_nationkey = n_regionkey AS same_field, FALSE AS other_item, n_nationkey < n_regionkey AS less, TRUE AS ahead FROM nation")
def compare_nested():
    """Records of other fields and arrays of other kinds differ; arrays come before records."""
    a, b, s = f("x", "n_nationkey"), f("x", "n_regionkey"), f("x", "n_name")
    return n.pipe(n.scan("nation", "x"), n.select("r", n_nationkey=a, other_field=n.eq(n.record(a=a), n.record(b=a)), same_field=n.eq(n.record(a=a, s=n.array(s)), n.record(a=b, s=n.array(s))), other_item=n.eq(n.array(a), n.array(s)), less=n.compare("lt", n.array(a), n.array(b)), ahead=n.compare("lt", n.array(a), n.record(k=s))))


@plan("SELECT s_suppkey, s_acctbal AS s_nationkey, s_nationkey::DOUBLE + 1 AS s_acctbal, s_name FROM supplier")
def with_fields():
    return n.pipe(n.scan("supplier", "s"), n.with_fields("s", s_nationkey=f("s", "s_acctbal"), s_acctbal=n.arithmetic("add", f("s", "s_nationkey"), lit(1))))


@plan("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def with_fields_missing():
    return n.pipe(n.scan("supplier", "s"), n.with_fields("s", s_name=f("s", "no_such")))


@plan("SELECT s_suppkey AS id, s_nationkey AS s_name, s_name AS s_nationkey, s_acctbal FROM supplier")
def rename():
    return n.pipe(n.scan("supplier", "s"), n.rename("s", s_suppkey="id", s_name="s_nationkey", s_nationkey="s_name"))


@plan("SELECT s_suppkey, s_nationkey FROM supplier")
def omit():
    return n.pipe(n.scan("supplier", "s"), n.omit("s", "s_name", "s_acctbal", "no_such"))


@plan("SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def unnest_embedding():
    return n.pipe(n.scan("embeddings", "e"), n.unnest(f("e", "embedding"), "u", "x"), n.select("r", vec_id=f("e", "vec_id"), x=n.arithmetic("add", f("u", "x"), lit(0))))


# Joins.


@plan("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner():
    return n.pipe(n.scan("orders", "o"), n.join(n.scan("customer", "c"), "inner", n.eq(f("o", "o_custkey"), f("c", "c_custkey"))), n.select("r", o_orderkey=f("o", "o_orderkey"), c_name=f("c", "c_name"), c_mktsegment=f("c", "c_mktsegment")))


@plan("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_name < b.n_name")
def join_theta():
    a, b = (lambda x: f("a", x)), (lambda x: f("b", x))
    return n.pipe(n.scan("nation", "a"), n.join(n.scan("nation", "b"), "inner", n.all_of(n.compare("lt", a("n_regionkey"), b("n_regionkey")), n.compare("lt", a("n_name"), b("n_name")))), n.select("r", low=a("n_name"), high=b("n_name")))


@plan("SELECT r_name, n_name FROM region, nation")
def join_cross():
    return n.pipe(n.scan("region", "r"), n.join(n.scan("nation", "x"), "cross"), n.select("o", r_name=f("r", "r_name"), n_name=f("x", "n_name")))


@plan("SELECT c_custkey, o_orderkey, o_orderkey IS NULL AS alone FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000")
def join_left():
    on = n.all_of(n.eq(f("o", "o_custkey"), f("c", "c_custkey")), n.compare("gt", f("o", "o_totalprice"), lit(100000)))
    return n.pipe(n.scan("customer", "c"), n.join(n.scan("orders", "o"), "left", on), n.select("r", c_custkey=f("c", "c_custkey"), o_orderkey=f("o", "o_orderkey"), alone=n.is_missing(f("o", "o_orderkey"))))


@plan("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi():
    on = n.all_of(n.eq(f("o", "o_custkey"), f("c", "c_custkey")), n.eq(f("o", "o_orderstatus"), lit("F")))
    return n.pipe(n.scan("customer", "c"), n.join(n.scan("orders", "o"), "semi", on), n.select("r", c_custkey=f("c", "c_custkey"), c_name=f("c", "c_name")))


@plan("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti():
    on = n.all_of(n.eq(f("o", "o_custkey"), f("c", "c_custkey")), n.compare("gt", f("o", "o_totalprice"), lit(200000)))
    return n.pipe(n.scan("customer", "c"), n.join(n.scan("orders", "o"), "anti", on), n.select("r", c_custkey=f("c", "c_custkey")))


@plan("SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self():
    on = n.all_of(n.eq(f("a", "s_nationkey"), f("b", "s_nationkey")), n.compare("lt", f("a", "s_suppkey"), f("b", "s_suppkey")))
    return n.pipe(n.scan("supplier", "a"), n.join(n.scan("supplier", "b"), "inner", on), n.select("r", one=f("a", "s_suppkey"), two=f("b", "s_suppkey")))


@plan("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND (CASE WHEN s_acctbal > 5000 THEN NULL ELSE 1 END) IS NOT DISTINCT FROM (CASE WHEN c_acctbal > 9000 THEN NULL ELSE 1 END)")
def join_tuple():
    one = lambda a, x, top: n.array(f(a, f"{x}_nationkey"), n.case([(n.compare("gt", f(a, f"{x}_acctbal"), lit(top)), lit(None))], lit(1)))
    return n.pipe(n.scan("supplier", "s"), n.join(n.scan("customer", "c"), "inner", n.eq(one("s", "s", 5000), one("c", "c", 9000))), n.select("r", s_suppkey=f("s", "s_suppkey"), c_custkey=f("c", "c_custkey")))


# Aggregates.


@plan("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def _pricing():
    return {}


del QUERIES["_pricing"]
ORACLES["agg_pricing_summary"] = ORACLES.pop("_pricing")


def agg_pricing_summary(spark, sf_dir):
    x = lambda a: f("l", a)
    made = n.pipe(
        n.scan("lineitem", "l"),
        n.where(n.call("until", x("l_shipdate"), lit("1998-09-02"))),
        n.aggregate("g", {"l_returnflag": x("l_returnflag"), "l_linestatus": x("l_linestatus")}, sum_qty=n.measure("sum", x("l_quantity")), sum_base=n.measure("sum", x("l_extendedprice")), sum_disc=n.measure("sum", n.arithmetic("multiply", x("l_extendedprice"), n.arithmetic("subtract", lit(1), x("l_discount")))), avg_qty=n.measure("average", x("l_quantity")), n=n.measure("count")),
        n.order(n.by(f("g", "l_returnflag")), n.by(f("g", "l_linestatus"))),
    )
    df = evaluate(spark, made, catalog(spark, sf_dir, ["lineitem"], KEYS), functions={("until", "1"): (lambda d, day: d <= day.cast("timestamp_ntz"), T.BooleanType())}).df
    return df.select("l_returnflag", "l_linestatus", *[F.round(c, 6 if c == "avg_qty" else 2).alias(c) for c in ("sum_qty", "sum_base", "sum_disc", "avg_qty")], "n")


QUERIES["agg_pricing_summary"] = agg_pricing_summary


def _grouped(**measures):
    return n.pipe(n.scan("orders", "o"), n.aggregate("g", {"o_orderpriority": f("o", "o_orderpriority")}, **measures))


_PRICE = maybe("o", "o_totalprice", 250000, "o_totalprice")
_PRICE_SQL = "CASE WHEN o_totalprice > 250000 THEN NULL ELSE o_totalprice END"
_TEST = n.case([(n.compare("gt", f("o", "o_totalprice"), lit(250000)), lit(None))], n.compare("lt", f("o", "o_totalprice"), lit(1000)))
_TEST_SQL = "CASE WHEN o_totalprice > 250000 THEN NULL ELSE o_totalprice < 1000 END"


@plan(f"SELECT o_orderpriority, count(*) AS n, count({_PRICE_SQL}) AS known FROM orders GROUP BY 1")
def agg_count():
    return _grouped(n=n.measure("count"), known=n.measure("count", _PRICE))


@plan("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_count_distinct():
    return _grouped(customers=n.measure("count-distinct", f("o", "o_custkey")))


@query(f"SELECT o_orderpriority, round(sum({_PRICE_SQL}), 1) AS total, NULL::DOUBLE AS none, round(avg({_PRICE_SQL}), 4) AS mean FROM orders GROUP BY 1")
def agg_sum_average(spark, sf_dir):
    df = run(spark, sf_dir, _grouped(total=n.measure("sum", _PRICE), none=n.measure("sum", f("o", "o_orderstatus")), mean=n.measure("average", _PRICE)))
    return df.select("o_orderpriority", F.round("total", 1).alias("total"), "none", F.round("mean", 4).alias("mean"))


@plan(f"SELECT o_orderpriority, CASE WHEN count(*) > count({_PRICE_SQL}) THEN NULL ELSE min({_PRICE_SQL}) END AS low, max({_PRICE_SQL}) AS high, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def agg_minimum_maximum():
    return _grouped(low=n.measure("minimum", _PRICE), high=n.measure("maximum", _PRICE), first_key=n.measure("minimum", f("o", "o_orderkey")))


@plan(f"""SELECT o_orderpriority, CASE WHEN coalesce(bool_or({_TEST_SQL}), FALSE) THEN TRUE WHEN count(*) > count({_TEST_SQL}) THEN NULL ELSE FALSE END AS some_cheap,
CASE WHEN NOT coalesce(bool_and({_TEST_SQL}), TRUE) THEN FALSE WHEN count(*) > count({_TEST_SQL}) THEN NULL ELSE TRUE END AS all_cheap FROM orders GROUP BY 1""")
def agg_any_every():
    return _grouped(some_cheap=n.measure("any", _TEST), all_cheap=n.measure("every", _TEST))


@query("SELECT o_custkey, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_totalprice DESC, o_orderkey), ',') AS orders_by_price FROM orders GROUP BY 1")
def agg_collect(spark, sf_dir):
    df = run(spark, sf_dir, n.pipe(n.scan("orders", "o"), n.aggregate("g", {"o_custkey": f("o", "o_custkey")}, ks=n.measure("collect", f("o", "o_orderkey"), [n.by(f("o", "o_totalprice"), "desc"), n.by(f("o", "o_orderkey"))]))))
    return df.select("o_custkey", F.array_join(F.transform("ks", lambda k: k.cast("string")), ",").alias("orders_by_price"))


@plan(f"SELECT o_custkey, first({_PRICE_SQL} ORDER BY o_orderkey) AS oldest, last({_PRICE_SQL} ORDER BY o_orderkey) AS newest FROM orders GROUP BY 1")
def agg_first_last():
    order = [n.by(f("o", "o_orderkey"))]
    return n.pipe(n.scan("orders", "o"), n.aggregate("g", {"o_custkey": f("o", "o_custkey")}, oldest=n.measure("first", _PRICE, order), newest=n.measure("last", _PRICE, order)))


@plan("SELECT 0::BIGINT AS n, NULL::DOUBLE AS total, NULL::DOUBLE AS mean, NULL::DOUBLE AS low, NULL::DOUBLE AS high, FALSE AS some, TRUE AS every")
def agg_global_empty():
    x = f("o", "o_totalprice")
    test = n.compare("lt", x, lit(0))
    return n.pipe(n.scan("orders", "o"), n.where(test), n.aggregate("g", {}, n=n.measure("count"), total=n.measure("sum", x), mean=n.measure("average", x), low=n.measure("minimum", x), high=n.measure("maximum", x), some=n.measure("any", test), every=n.measure("every", test)))


@plan("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having():
    return n.pipe(n.scan("orders", "o"), n.aggregate("g", {"o_custkey": f("o", "o_custkey")}, n=n.measure("count")), n.where(n.compare("gt", f("g", "n"), lit(12))))


@plan(f"SELECT {_PRICE_SQL} IS NULL AS absent, count(*) AS n FROM orders GROUP BY {_PRICE_SQL} IS NULL")
def agg_null_groups():
    return n.pipe(n.scan("orders", "o"), n.aggregate("g", {"absent": n.is_null(_PRICE)}, n=n.measure("count")))


# Distinct and sets.


def _nations(table: str, x: str):
    return n.pipe(n.scan(table), n.select("r", nation=f(table, f"{x}_nationkey")))


@plan("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct():
    return n.pipe(n.scan("customer", "c"), n.select("r", c_nationkey=f("c", "c_nationkey"), c_mktsegment=f("c", "c_mktsegment")), n.distinct())


def _segments(low: float, high: float):
    return n.pipe(n.scan("customer", "c"), n.where(n.all_of(n.compare("gte", f("c", "c_acctbal"), lit(low)), n.compare("lt", f("c", "c_acctbal"), lit(high)))), n.select("r", segment=f("c", "c_mktsegment"), nation=maybe("c", "c_nationkey", 20, "c_nationkey")))


_SEG = "SELECT c_mktsegment AS segment, CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END AS nation FROM customer WHERE c_acctbal >= {} AND c_acctbal < {}"
for _op, _word in {"union": "UNION", "union-all": "UNION ALL", "intersect": "INTERSECT", "except": "EXCEPT"}.items():
    _key = "set_" + _op.replace("-", "_")
    QUERIES[_key] = lambda spark, sf_dir, op=_op: run(spark, sf_dir, n.pipe(_segments(0, 4000), n.combine(op, _segments(3000, 3200))))
    ORACLES[_key] = f"{_SEG.format(0, 4000)} {_word} {_SEG.format(3000, 3200)}"


@plan("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def union_all_fields_differ():
    return n.pipe(n.scan("supplier", "s"), n.select("r", id=f("s", "s_suppkey"), name=f("s", "s_name")), n.combine("union-all", n.pipe(n.scan("customer", "c"), n.select("r", id=f("c", "c_custkey"), segment=f("c", "c_mktsegment")))))


# Order, slices, pages and windows.


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def order_slice():
    return n.pipe(n.scan("orders", "o"), n.order(n.by(f("o", "o_totalprice"), "desc"), n.by(f("o", "o_orderkey"))), n.cut(10, 25), n.select("r", o_orderkey=f("o", "o_orderkey"), o_totalprice=f("o", "o_totalprice")))


@plan("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def topk():
    x = lambda a: f("l", a)
    return n.pipe(n.scan("lineitem", "l"), n.select("r", l_orderkey=x("l_orderkey"), l_linenumber=x("l_linenumber"), l_extendedprice=x("l_extendedprice")), n.order(n.by(f("r", "l_extendedprice"), "desc"), n.by(f("r", "l_orderkey")), n.by(f("r", "l_linenumber"))), n.cut(limit=100))


@plan("SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN NULL ELSE o_totalprice END AS price FROM orders) ORDER BY price DESC NULLS FIRST, o_orderkey LIMIT 400")
def order_nulls():
    return n.pipe(n.scan("orders", "o"), n.select("r", o_orderkey=f("o", "o_orderkey"), price=_PRICE), n.order(n.by(f("r", "price"), "desc", "first"), n.by(f("r", "o_orderkey"))), n.cut(limit=400))


@plan("SELECT c_custkey, c_nationkey FROM customer WHERE (c_nationkey, c_custkey) > (7, 600) ORDER BY c_nationkey, c_custkey LIMIT 50")
def seek_page():
    terms = [n.by(f("c", "c_nationkey")), n.by(f("c", "c_custkey"))]
    return n.pipe(n.scan("customer", "c"), n.seek(terms, {"order": [7, 600], "resultKey": "~", "basis": None, "membershipRevision": 0}), n.cut(limit=50), n.select("r", c_custkey=f("c", "c_custkey"), c_nationkey=f("c", "c_nationkey")))


@plan("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS nth FROM orders")
def window_row_number():
    return n.pipe(n.scan("orders", "o"), n.window("o", nth=n.over("row-number", [n.by(f("o", "o_totalprice"), "desc"), n.by(f("o", "o_orderkey"))], [f("o", "o_custkey")])), n.select("r", o_orderkey=f("o", "o_orderkey"), nth=f("o", "nth")))


@plan("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC)::INTEGER AS place FROM lineitem")
def window_rank():
    return n.pipe(n.scan("lineitem", "l"), n.window("l", place=n.over("rank", [n.by(f("l", "l_quantity"), "desc")], [f("l", "l_suppkey")])), n.select("r", l_orderkey=f("l", "l_orderkey"), l_linenumber=f("l", "l_linenumber"), place=f("l", "place")))


@plan("SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def window_lag():
    return n.pipe(n.scan("events", "e"), n.window("e", before=n.over("lag", [n.by(f("e", "ts")), n.by(f("e", "event_id"))], [f("e", "user_id")], f("e", "value"), 2)), n.select("r", event_id=f("e", "event_id"), before=f("e", "before")))


@plan("SELECT event_id, nth, lag(nth) OVER (PARTITION BY user_id ORDER BY nth) AS previous FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS nth FROM events)")
def window_sequential():
    return n.pipe(n.scan("events", "e"), n.window("e", nth=n.over("row-number", [n.by(f("e", "ts")), n.by(f("e", "event_id"))], [f("e", "user_id")]), previous=n.over("lag", [n.by(f("e", "nth"))], [f("e", "user_id")], f("e", "nth"))), n.select("r", event_id=f("e", "event_id"), nth=f("e", "nth"), previous=f("e", "previous")))


# Subqueries, functions and recursion.


def _own_orders(*more):
    return n.pipe(n.scan("orders", "o"), n.where(n.all_of(n.eq(f("o", "o_custkey"), f("c", "c_custkey")), *more)))


@plan("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) OR c_acctbal < 0")
def exists_correlated():
    return n.pipe(n.scan("customer", "c"), n.where(n.any_of(n.exists(_own_orders(n.compare("gt", f("o", "o_totalprice"), lit(200000)))), n.compare("lt", f("c", "c_acctbal"), lit(0)))), n.select("r", c_custkey=f("c", "c_custkey")))


@plan("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def scalar_correlated():
    inner = lambda **m: n.scalar(n.pipe(_own_orders(), n.aggregate("g", {}, **m)))
    return n.pipe(n.scan("customer", "c"), n.select("r", c_custkey=f("c", "c_custkey"), n=inner(n=n.measure("count")), top=inner(top=n.measure("maximum", f("o", "o_totalprice")))))


@plan("SELECT c_custkey, CASE WHEN k = 1 THEN only_key END AS only_order FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k, min(o_orderkey) AS only_key FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def scalar_cardinality():
    return n.pipe(n.scan("customer", "c"), n.select("r", c_custkey=f("c", "c_custkey"), only_order=n.scalar(n.pipe(_own_orders(), n.select("k", key=f("o", "o_orderkey"))))))


@plan("SELECT p_partkey, round(p_retailprice * (1 - p_size / 100.0), 4) AS price FROM part")
def function_call():
    return n.pipe(n.scan("part", "p"), n.select("r", p_partkey=f("p", "p_partkey"), price=n.call("discounted", f("p", "p_retailprice"), f("p", "p_size"))))


@plan("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000", parameters={"segment": "BUILDING", "least": 9000})
def parameters():
    return n.pipe(n.scan("customer", "c"), n.where(n.all_of(n.eq(f("c", "c_mktsegment"), n.parameter("segment")), n.compare("gt", f("c", "c_acctbal"), n.parameter("least")))), n.select("r", c_custkey=f("c", "c_custkey")))


@plan("SELECT i::BIGINT AS value FROM range(1, 13) t(i)")
def recursive_numbers():
    step = n.pipe(n.again("up"), n.where(n.compare("lt", f("x", "value"), lit(12))), n.select("x", value=n.call("next", f("x", "value"))))
    return n.recursive("up", n.values("x", [{"value": 1}]), step, [f("x", "value")])


FUNCTIONS["next", "1"] = (lambda v: v + 1, T.LongType())


@plan("""WITH RECURSIVE r AS (SELECT 1::BIGINT AS node UNION SELECT l_partkey FROM r JOIN lineitem ON l_suppkey = node WHERE l_quantity > 45) SELECT node FROM r""")
def recursive_reach():
    step = n.pipe(n.again("reach"), n.join(n.scan("lineitem", "l"), "inner", n.eq(f("l", "l_suppkey"), f("x", "node"))), n.where(n.compare("gt", f("l", "l_quantity"), lit(45))), n.select("x", node=f("l", "l_partkey")))
    return n.recursive("reach", n.values("x", [{"node": 1}]), step, [f("x", "node")], max_iterations=None, max_rows=None)


@plan("SELECT c_custkey, c_nationkey AS id_of, NULL::VARCHAR AS origin FROM customer")
def key_and_source():
    return n.pipe(n.scan("customer", "c"), n.with_fields("c", id=f("c", "c_nationkey")), n.select("r", c_custkey=f("c", "c_custkey"), id_of=n.key_of("c"), origin=n.source_of("c")))


# Maintenance, mappings, lenses, constraints and writes.


def _session(spark, sf_dir, root, table, changed, added):
    from lattisca.streaming.maintenance import Change, Session

    session = Session(spark, root, catalog(spark, sf_dir, sorted(n.relations_of(root)), KEYS), functions=FUNCTIONS)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    session.update({table: Change(rows.filter(changed), added(rows))}, 0, 1)
    return session.rows


def _without_and_new(name: str):
    """The final state of events or orders after the change that the ivm queries make."""
    if name == "events":
        return "(SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE NOT (event_id % 97 = 3) UNION ALL SELECT event_id + 10000000, ts, user_id, event_type, value + 1, props FROM events WHERE event_id % 89 = 5)"
    return "(SELECT * FROM orders WHERE NOT (o_orderkey % 101 = 7) UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice * 2, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 103 = 9)"


_ON = n.all_of(n.eq(f("orders", "o_custkey"), f("customer", "c_custkey")), n.compare("gt", f("orders", "o_totalprice"), lit(150000)))


def _new_events(rows):
    return rows.filter("event_id % 89 = 5").withColumns({"event_id": F.col("event_id") + 10000000, "value": F.col("value") + 1})


def _new_orders(rows):
    return rows.filter("o_orderkey % 103 = 9").withColumns({"o_orderkey": F.col("o_orderkey") + 100000000, "o_totalprice": F.col("o_totalprice") * 2})


@query(f"SELECT event_id, value FROM {_without_and_new('events')} WHERE value > 50")
def ivm_filter(spark, sf_dir):
    root = n.pipe(n.scan("events"), n.where(n.compare("gt", f("events", "value"), lit(50))), n.select("r", event_id=f("events", "event_id"), value=f("events", "value")))
    return _session(spark, sf_dir, root, "events", "event_id % 97 = 3", _new_events)


@query(f"SELECT user_id, count(*) AS n, min(value) AS low, max(value) AS high FROM {_without_and_new('events')} GROUP BY 1")
def ivm_aggregate(spark, sf_dir):
    x = f("events", "value")
    root = n.pipe(n.scan("events"), n.aggregate("g", {"user_id": f("events", "user_id")}, n=n.measure("count"), low=n.measure("minimum", x), high=n.measure("maximum", x)))
    return _session(spark, sf_dir, root, "events", "event_id % 97 = 3", _new_events)


@query(f"SELECT o_orderkey, c_name FROM {_without_and_new('orders')} JOIN customer ON o_custkey = c_custkey")
def ivm_join(spark, sf_dir):
    root = n.pipe(n.scan("orders"), n.join(n.scan("customer"), "inner", n.eq(f("orders", "o_custkey"), f("customer", "c_custkey"))), n.select("r", o_orderkey=f("orders", "o_orderkey"), c_name=f("customer", "c_name")))
    return _session(spark, sf_dir, root, "orders", "o_orderkey % 101 = 7", _new_orders)


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_without_and_new('orders')} ON o_custkey = c_custkey AND o_totalprice > 150000")
def ivm_left(spark, sf_dir):
    return _session(spark, sf_dir, n.pipe(n.scan("customer"), n.join(n.scan("orders"), "left", _ON), n.select("r", c_custkey=f("customer", "c_custkey"), o_orderkey=f("orders", "o_orderkey"))), "orders", "o_orderkey % 101 = 7", _new_orders)


@query(f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {_without_and_new('orders')} WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def ivm_semi(spark, sf_dir):
    return _session(spark, sf_dir, n.pipe(n.scan("customer"), n.join(n.scan("orders"), "semi", _ON), n.select("r", c_custkey=f("customer", "c_custkey"))), "orders", "o_orderkey % 101 = 7", _new_orders)


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_without_and_new('orders')} WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def ivm_anti(spark, sf_dir):
    return _session(spark, sf_dir, n.pipe(n.scan("customer"), n.join(n.scan("orders"), "anti", _ON), n.select("r", c_custkey=f("customer", "c_custkey"))), "orders", "o_orderkey % 101 = 7", _new_orders)


@query(f"SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS high FROM {_without_and_new('orders')} JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def ivm_join_aggregate(spark, sf_dir):
    root = n.pipe(n.scan("orders"), n.join(n.scan("customer"), "inner", n.eq(f("orders", "o_custkey"), f("customer", "c_custkey"))), n.aggregate("g", {"c_mktsegment": f("customer", "c_mktsegment")}, n=n.measure("count"), high=n.measure("maximum", f("orders", "o_totalprice"))))
    return _session(spark, sf_dir, root, "orders", "o_orderkey % 101 = 7", _new_orders)


@query(f"SELECT event_id, value FROM {_without_and_new('events')}")
def ivm_sorted(spark, sf_dir):
    root = n.pipe(n.scan("events"), n.order(n.by(f("events", "value"), "desc")), n.select("r", event_id=f("events", "event_id"), value=f("events", "value")))
    return _session(spark, sf_dir, root, "events", "event_id % 97 = 3", _new_events)


@query(f"SELECT 'count' AS plan, count(*)::DOUBLE AS x FROM {_without_and_new('events')} UNION ALL SELECT 'mean', round(avg(value), 6) FROM {_without_and_new('events')} UNION ALL SELECT 'types', count(DISTINCT event_type) FROM {_without_and_new('events')}")
def ivm_pool(spark, sf_dir):
    """Three queries of one pool, after one update of all."""
    from lattisca.streaming.maintenance import Change, Pool

    pool, rows = Pool(spark, catalog(spark, sf_dir, ["events"], KEYS)), spark.read.parquet(f"{sf_dir}/events.parquet")
    scan, x = n.scan("events"), f("events", "value")
    names = [pool.attach(p) for p in (n.pipe(scan, n.aggregate("g", {}, x=n.measure("count"))), n.pipe(scan, n.aggregate("g", {}, x=n.measure("average", x))), n.pipe(scan, n.select("r", t=f("events", "event_type")), n.distinct(), n.aggregate("g", {}, x=n.measure("count"))))]
    pool.update({"events": Change(rows.filter("event_id % 97 = 3"), _new_events(rows))}, 0, 1)
    out = [pool.rows(k).selectExpr(f"'{label}' AS plan", "round(CAST(x AS DOUBLE), 6) AS x") for k, label in zip(names, ("count", "mean", "types"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"SELECT event_type, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'updated' END AS change, a.n AS before, b.n AS after FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM {_without_and_new('events')} GROUP BY 1) b USING (event_type) WHERE a.n IS DISTINCT FROM b.n")
def ivm_delta_by_key(spark, sf_dir):
    from lattisca.streaming.maintenance import Change, Session, keyed

    root = n.pipe(n.scan("events"), n.aggregate("g", {"event_type": f("events", "event_type")}, n=n.measure("count")))
    session, rows = Session(spark, root, catalog(spark, sf_dir, ["events"], KEYS), keys=True), spark.read.parquet(f"{sf_dir}/events.parquet")
    delta = keyed(*session.update({"events": Change(rows.filter("event_id % 97 = 3"), _new_events(rows))}, 0, 1))
    return delta.selectExpr("coalesce(before.event_type, after.event_type) AS event_type", "change", "before.n AS before", "after.n AS after")


@query(f"SELECT DISTINCT user_id, event_type FROM {_without_and_new('events')}")
def ivm_distinct(spark, sf_dir):
    root = n.pipe(n.scan("events"), n.select("r", user_id=f("events", "user_id"), event_type=f("events", "event_type")), n.distinct())
    return _session(spark, sf_dir, root, "events", "event_id % 97 = 3", _new_events)


@query(f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS nth FROM {_without_and_new('events')}")
def ivm_window(spark, sf_dir):
    root = n.pipe(n.scan("events"), n.window("events", nth=n.over("row-number", [n.by(f("events", "ts")), n.by(f("events", "event_id"))], [f("events", "user_id")])), n.select("r", event_id=f("events", "event_id"), nth=f("events", "nth")))
    return _session(spark, sf_dir, root, "events", "event_id % 97 = 3", _new_events)


@query(f"SELECT event_id, value FROM {_without_and_new('events')} ORDER BY value DESC, event_id LIMIT 40")
def ivm_fallback_top(spark, sf_dir):
    root = n.pipe(n.scan("events"), n.order(n.by(f("events", "value"), "desc"), n.by(f("events", "event_id"))), n.cut(limit=40), n.select("r", event_id=f("events", "event_id"), value=f("events", "value")))
    return _session(spark, sf_dir, root, "events", "event_id % 97 = 3", _new_events)


@query("""SELECT event_id, CASE WHEN event_id % 97 = 3 AND event_id % 89 = 5 THEN 'update' WHEN event_id % 97 = 3 THEN 'delete' ELSE 'update' END AS change FROM events WHERE event_id % 97 = 3 OR event_id % 89 = 5""")
def ivm_snapshot_diff(spark, sf_dir):
    from lattisca.streaming.maintenance import snapshot_diff

    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    after = rows.filter("NOT (event_id % 97 = 3) OR event_id % 89 = 5").withColumn("value", F.when(F.expr("event_id % 89 = 5"), F.col("value") + 1).otherwise(F.col("value")))
    return snapshot_diff(rows, after, ["event_id"])


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def stream_observed(spark, sf_dir):
    """The observer fed by a file stream: the maintained result after all batches."""
    import uuid

    from lattisca.sources.relations import RelationInput
    from lattisca.sources.shared import shared_dir
    from lattisca.streaming.maintenance import Session
    from lattisca.streaming.observer import Observer

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    root = n.pipe(n.scan("events"), n.where(n.compare("gt", f("events", "value"), lit(10))), n.aggregate("g", {"event_type": f("events", "event_type")}, n=n.measure("count")))
    session = Session(spark, root, {"events": [RelationInput(table.limit(0), ("event_id",))]})
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    Observer(session).follow(stream, "events", f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}").awaitTermination()
    return session.rows


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE props->>'k' IS NOT NULL")
def mapping_singleton(spark, sf_dir):
    from lattisca.sources.mapping import project

    how = {"collection": {"kind": "singleton", "path": [], "absent": "empty"}, "keys": {"k": {"path": ["k"], "type": "bigint"}}, "fields": {}}
    return project(spark.read.parquet(f"{sf_dir}/events.parquet"), "props", how, ["event_id"])[0]


@query("SELECT s_suppkey, i - 1 AS position, 'p' || (s_suppkey * 10 + i) AS name FROM supplier, range(1, 4) t(i)")
def mapping_array(spark, sf_dir):
    from lattisca.sources.mapping import project

    docs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.concat(F.lit("p"), F.col("s_suppkey") * 10 + i).alias("name"))).alias("parts"))).alias("body"))
    how = {"collection": {"kind": "array", "path": ["parts"], "absent": "empty"}, "keys": {"name": {"path": ["name"]}}, "fields": {"position": {"kind": "position"}}}
    return project(docs, "body", how, ["s_suppkey"])[0]


@query("SELECT n_nationkey, k, k || '!' AS v FROM nation, (VALUES ('a'), ('b')) t(k)")
def mapping_object_map(spark, sf_dir):
    from lattisca.sources.mapping import project

    docs = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.lit('{"m": {"b": {"v": "b!"}, "a": {"v": "a!"}}}').alias("body"))
    how = {"collection": {"kind": "object-map", "path": ["m"], "absent": "empty"}, "keys": {"k": {"kind": "map-key"}}, "fields": {"v": {"path": ["v"]}}}
    return project(docs, "body", how, ["n_nationkey"])[0]


@query("SELECT r_regionkey, id, parent, position FROM region, (VALUES ('1', NULL, 0::BIGINT), ('2', '1', 1), ('3', '2', 2), ('4', '1', 3), ('5', NULL, 4)) t(id, parent, position)")
def mapping_recursive_array(spark, sf_dir):
    from lattisca.sources.mapping import project

    tree = '[{"id": 1, "children": [{"id": 2, "children": [{"id": 3}]}, {"id": 4}]}, {"id": 5, "children": []}]'
    docs = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.lit(tree).alias("body"))
    how = {"collection": {"kind": "recursive-array", "path": [], "descendants": ["children"], "absent": "empty"}, "keys": {"id": {"path": ["id"]}}, "fields": {"parent": {"kind": "parent"}, "position": {"kind": "position"}}}
    return project(docs, "body", how, ["r_regionkey"])[0]


_STEPS = [
    {"kind": "lens.field", "from": "o_orderkey", "to": "id", "write": "invertible"},
    {"kind": "lens.value-map", "from": "o_orderstatus", "to": "state", "cases": [{"from": "F", "to": "finished", "writeBack": "to-from"}, {"from": "O", "to": "open", "writeBack": "to-from"}], "unmapped": "reject"},
    {"kind": "lens.default", "to": "region", "value": "all", "write": "preserve"},
    {"kind": "lens.lookup", "from": "o_custkey", "to": "customer", "through": "customer", "sourceFields": ["c_custkey"], "resultFields": ["c_name"], "onMissing": "reject", "onAmbiguous": "reject", "write": "read-only"},
]
_SEEN = "o_orderstatus IN ('F', 'O') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)"


def _lens(spark, sf_dir):
    from lattisca.sources.lens import view

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer")}
    return view(tables["orders"], _STEPS, tables)


@query(f"SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'open' END AS state, 'all' AS region, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS customer FROM orders WHERE {_SEEN}")
def lens_view(spark, sf_dir):
    return _lens(spark, sf_dir)[0]


@query(f"SELECT o_orderkey FROM orders WHERE NOT ({_SEEN})")
def lens_rejected(spark, sf_dir):
    return _lens(spark, sf_dir)[1].select("o_orderkey")


@query("SELECT 'orders.customer' AS code, 'satisfied' AS state, 0::BIGINT AS rows UNION ALL SELECT 'orders.cheap', CASE WHEN count(*) > 0 THEN 'violated' ELSE 'satisfied' END, count(*) FROM orders WHERE o_totalprice < 2000")
def constraint_check(spark, sf_dir):
    from lattisca.operators.constraints import check

    orphan = n.pipe(n.scan("orders"), n.join(n.scan("customer"), "anti", n.eq(f("orders", "o_custkey"), f("customer", "c_custkey"))))
    cheap = n.pipe(n.scan("orders"), n.where(n.compare("lt", f("orders", "o_totalprice"), lit(2000))))
    found = check(spark, [{"id": "a", "code": "orders.customer", "violationQuery": orphan}, {"id": "b", "code": "orders.cheap", "violationQuery": cheap}], catalog(spark, sf_dir, ["orders", "customer"], KEYS))
    return spark.createDataFrame([(v.code, v.state, v.rows.count()) for v in found], "code string, state string, rows bigint")


@query("SELECT 'customer' AS relation, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def referential_cascade(spark, sf_dir):
    from lattisca.operators.constraints import delete_with_references

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders")}
    tables["lineitem"] = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    refs = [{"from": "orders", "field": "o_custkey", "to": "customer", "action": "cascade"}, {"from": "lineitem", "field": "l_orderkey", "to": "orders", "action": "cascade"}]
    after = delete_with_references(tables, {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_key"}, refs, "customer", tables["customer"].filter("c_custkey % 10 = 0").select("c_custkey"))
    out = None
    for t, df in after.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _store(spark, sf_dir):
    from lattisca.operators.writes import Store

    return Store(spark, {"supplier": spark.read.parquet(f"{sf_dir}/supplier.parquet")}, {"supplier": ["s_suppkey"]})


def _new_suppliers(rows, low=50):
    return rows.filter(F.col("s_suppkey") >= low).withColumns({"s_suppkey": F.col("s_suppkey") + 25, "s_name": F.concat(F.lit("new "), "s_name")})


for _mode, _text in {"replace": "SELECT * FROM supplier s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n", "keep-existing": "SELECT * FROM supplier UNION ALL SELECT * FROM n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)"}.items():

    def _upsert(spark, sf_dir, mode=_mode):
        from lattisca.operators.writes import transact

        store = _store(spark, sf_dir)
        transact(store, [{"kind": "upsert", "relation": "supplier", "rows": _new_suppliers(store.tables["supplier"]), "onConflict": mode}])
        return store.tables["supplier"]

    QUERIES[f"tx_upsert_{_mode.replace('-', '_')}"] = _upsert
    ORACLES[f"tx_upsert_{_mode.replace('-', '_')}"] = f"WITH n AS (SELECT s_suppkey + 25 AS s_suppkey, 'new ' || s_name AS s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey >= 50) {_text}"


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'No' || s_name[3:] ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3")
def tx_update_delete(spark, sf_dir):
    from lattisca.operators.writes import transact

    store = _store(spark, sf_dir)
    transact(
        store,
        [{"kind": "update", "relation": "supplier", "when": lambda df: df["s_acctbal"] < 0, "edits": {"s_acctbal": {"increment": 100}, "s_name": {"text": [0, 2, "No"]}}}, {"kind": "delete", "relation": "supplier", "when": lambda df: df["s_nationkey"] == 3}],
        [{"kind": "query", "root": n.scan("supplier"), "expect": "exists"}],
    )
    return store.tables["supplier"]


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 7 = 1 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 2 UNION ALL SELECT s_suppkey + 100000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 7 = 3")
def tx_keyed_delta(spark, sf_dir):
    from lattisca.operators.writes import transact

    store, rows = _store(spark, sf_dir), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    changes = rows.filter("s_suppkey % 7 = 1").withColumns({"s_acctbal": F.col("s_acctbal") + 1, "change": F.lit("update")}).unionByName(rows.filter("s_suppkey % 7 = 2").withColumn("change", F.lit("delete"))).unionByName(rows.filter("s_suppkey % 7 = 3").withColumns({"s_suppkey": F.col("s_suppkey") + 100000, "change": F.lit("insert")}))
    transact(store, [{"kind": "keyed-delta", "relation": "supplier", "rows": changes}])
    return store.tables["supplier"]


@query("SELECT * FROM supplier UNION ALL SELECT s_suppkey + 500000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 9000")
def tx_insert_from_query(spark, sf_dir):
    from lattisca.operators.writes import transact

    x = lambda a: f("supplier", a)
    store = _store(spark, sf_dir)
    rich = n.pipe(n.scan("supplier"), n.where(n.compare("gt", x("s_acctbal"), lit(9000))), n.with_fields("supplier", s_suppkey=n.call("shifted", x("s_suppkey"))))
    rows = evaluate(spark, rich, store.inputs(), functions={("shifted", "1"): (lambda k: k + 500000, T.LongType())}).df
    transact(store, [{"kind": "insert", "relation": "supplier", "rows": rows}])
    return store.tables["supplier"]


@query("SELECT 'supplier' AS relationId, name AS field FROM (VALUES ('s_suppkey'), ('s_name'), ('s_nationkey'), ('s_acctbal')) t(name)")
def system_schemas(spark, sf_dir):
    from lattisca.sources.system import system_relations

    own = system_relations(spark, catalog(spark, sf_dir, ["supplier"], KEYS))
    return evaluate(spark, n.pipe(n.scan("system.schemas", "s"), n.select("r", relationId=f("s", "relationId"), field=f("s", "field"))), own).df


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0")
def schema_parsed(spark, sf_dir):
    from lattisca.sources.schema import parse_rows

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("s_name", F.when(F.col("s_acctbal") >= 0, F.col("s_name")))
    relation = {"relationId": "supplier", "key": ["s_suppkey"], "fields": {"s_suppkey": {"type": {"kind": "integer"}}, "s_name": {"type": {"kind": "string"}}}}
    return parse_rows(rows, relation)[0].select("s_suppkey")


# Operators that until here only tests of their own reached.


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def join_reference(spark, sf_dir):
    """A join along a declared reference, from its fields to the key of its target."""
    reference = {"fields": ["n_regionkey"], "target": {"relation": "region", "fields": ["r_regionkey"]}}
    to = reference["target"]
    on = [n.eq(f("n", a), f("r", b)) for a, b in zip(reference["fields"], to["fields"])]
    return run(spark, sf_dir, n.pipe(n.scan("nation", "n"), n.join(n.scan(to["relation"], "r"), "inner", on[0]), n.select("x", n_name=f("n", "n_name"), r_name=f("r", "r_name"))))


@plan("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS k FROM customer) t WHERE k <= 40")
def order_ties_by_key():
    """Equal terms are ordered by the rows' key."""
    return n.pipe(n.scan("customer", "c"), n.order(n.by(f("c", "c_nationkey"))), n.cut(limit=40), n.select("r", c_nationkey=f("c", "c_nationkey"), c_custkey=f("c", "c_custkey")))


@query("SELECT * FROM (VALUES ('absent alias', 'alias_missing'), ('name of a group and a measure', 'name_clash'), ('one alias twice', 'alias_overlap'), ('slice below zero', 'slice_bounds')) t(plan, code)")
def plans_refused(spark, sf_dir):
    """Plans that the static checks refuse, with what they say."""
    from lattisca.plans.validate import validate

    rows, s = n.scan("supplier", "s"), f("s", "s_nationkey")
    plans = {
        "absent alias": n.pipe(rows, n.where(n.eq(f("t", "s_nationkey"), lit(1)))),
        "name of a group and a measure": n.pipe(rows, n.aggregate("g", {"k": s}, k=n.measure("count"))),
        "one alias twice": n.pipe(rows, n.join(rows, "inner", n.eq(s, s))),
        "slice below zero": n.pipe(rows, n.cut(limit=-1)),
    }
    return spark.createDataFrame([(name, code) for name, p in plans.items() for _, code in validate(p, {"supplier"}, set())], "plan string, code string")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY s_suppkey), 'copy', s_nationkey, 0.0 FROM supplier WHERE s_nationkey = 3")
def tx_generated_key(spark, sf_dir):
    """Rows without keys are numbered on from the largest key, without gaps; they are alike, so their order doesn't show."""
    from lattisca.operators.writes import transact

    store = _store(spark, sf_dir)
    rows = store.tables["supplier"].filter("s_nationkey = 3").select(F.lit("copy").alias("s_name"), "s_nationkey", F.lit(0.0).alias("s_acctbal"))
    transact(store, [{"kind": "insert-generated-key", "relation": "supplier", "rows": rows}])
    return store.tables["supplier"]


@query("SELECT * FROM supplier UNION ALL SELECT s_suppkey + 500000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 9000")
def tx_insert_by_plan(spark, sf_dir):
    """insert-from-query itself: the plan runs over the transaction's own state."""
    from lattisca.operators.writes import transact

    x = lambda a: f("supplier", a)
    store = _store(spark, sf_dir)
    rich = n.pipe(n.scan("supplier"), n.where(n.compare("gt", x("s_acctbal"), lit(9000))), n.select("supplier", s_suppkey=n.arithmetic("add", x("s_suppkey"), lit(500000)), s_name=x("s_name"), s_nationkey=x("s_nationkey"), s_acctbal=x("s_acctbal")))
    transact(store, [{"kind": "insert-from-query", "relation": "supplier", "root": rich}])
    return store.tables["supplier"]


@query("SELECT * REPLACE (s_acctbal * 2 AS s_acctbal) FROM supplier WHERE s_acctbal > 0")
def tx_replace_all(spark, sf_dir):
    from lattisca.operators.writes import transact

    store = _store(spark, sf_dir)
    rows = store.tables["supplier"].filter("s_acctbal > 0").withColumn("s_acctbal", F.col("s_acctbal") * 2)
    transact(store, [{"kind": "replace-all", "relation": "supplier", "rows": rows}])
    return store.tables["supplier"]


@query("SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey")
def tx_returning(spark, sf_dir):
    """A named plan over the state after the write."""
    from lattisca.operators.writes import transact

    grouped = n.pipe(n.scan("supplier"), n.aggregate("g", {"s_nationkey": f("supplier", "s_nationkey")}, n=n.measure("count")))
    return transact(_store(spark, sf_dir), [{"kind": "delete", "relation": "supplier", "when": lambda df: df["s_acctbal"] < 0}], returning={"left": grouped})["returning"]["left"]


@query("SELECT 'simulated' AS state, count(*) AS n FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'kept', count(*) FROM supplier")
def tx_simulate(spark, sf_dir):
    """A simulated write shows its state and leaves the store as it is."""
    from lattisca.operators.writes import transact

    store = _store(spark, sf_dir)
    tried = transact(store, [{"kind": "delete", "relation": "supplier", "when": lambda df: df["s_acctbal"] < 0}], simulate=True)["tables"]["supplier"]
    count = lambda df, state: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(state).alias("state"), "n")
    return count(tried, "simulated").unionByName(count(store.tables["supplier"], "kept"))


@query("SELECT * FROM (VALUES (0, 'version 1'), (1, 'write.key_exists'), (2, 'version 2')) t(place, outcome)")
def tx_sequence(spark, sf_dir):
    """Transactions one after another; one that is refused leaves those after it alone."""
    from lattisca.operators.writes import sequence

    store = _store(spark, sf_dir)
    rows = store.tables["supplier"]
    new = rows.withColumn("s_suppkey", F.col("s_suppkey") + 100000)
    delete = {"kind": "delete", "relation": "supplier", "when": lambda df: df["s_acctbal"] < 0}
    got = sequence(store, [[{"kind": "insert", "relation": "supplier", "rows": new}], [{"kind": "insert", "relation": "supplier", "rows": new}], [delete]], stop=False)
    return spark.createDataFrame([(k, r.get("error") or f"version {r['version']}") for k, r in enumerate(got)], "place int, outcome string")


@query("SELECT s_suppkey, s_nationkey AS place FROM supplier")
def lens_hide(spark, sf_dir):
    from lattisca.sources.lens import view

    steps = [{"kind": "lens.field", "from": "s_suppkey", "to": "s_suppkey"}, {"kind": "lens.field", "from": "s_acctbal", "to": "s_acctbal"}, {"kind": "lens.field", "from": "s_nationkey", "to": "place"}, {"kind": "lens.hide", "from": "s_acctbal"}]
    return view(spark.read.parquet(f"{sf_dir}/supplier.parquet"), steps)[0]


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 1 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier")
def lens_edit(spark, sf_dir):
    """An edit of a view's fields, translated back and written to the stored relation."""
    from lattisca.operators.writes import transact
    from lattisca.sources.lens import translate

    store = _store(spark, sf_dir)
    steps = [{"kind": "lens.value-map", "from": "s_nationkey", "to": "place", "cases": [{"from": 1, "to": "one", "writeBack": "to-from"}, {"from": 2, "to": "two", "writeBack": "to-from"}]}]
    stored = translate({"place": "one"}, steps)
    transact(store, [{"kind": "update", "relation": "supplier", "when": lambda df: df["s_acctbal"] < 0, "edits": {k: {"replace": v} for k, v in stored.items()}}])
    return store.tables["supplier"]


@query("SELECT s_suppkey, s_nationkey AS nation FROM supplier")
def lens_path(spark, sf_dir):
    """The lenses that lead from one version of a schema to another, applied one after another."""
    from lattisca.sources.lens import path, view

    same = {"kind": "lens.field", "from": "s_suppkey", "to": "s_suppkey"}
    steps = {"a": [same, {"kind": "lens.field", "from": "s_nationkey", "to": "place"}], "b": [same, {"kind": "lens.field", "from": "place", "to": "nation"}], "c": [same]}
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    for i in path([("a", "1", "2"), ("b", "2", "3"), ("c", "1", "4")], "1", "3"):
        rows = view(rows, steps[i])[0]
    return rows


@query("SELECT event_id, user_id::VARCHAR AS u FROM events WHERE event_type = 'click'")
def mapping_rejected(spark, sf_dir):
    """Candidates of a mapping that lack their key are reported, not projected."""
    from lattisca.sources.mapping import project

    text = F.when(F.col("event_type") == "click", F.format_string('[{"u": %s}]', F.col("user_id").cast("string"))).otherwise('[{"k": 1}]')
    docs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("doc"))
    mapping = {"collection": {"kind": "array", "path": [], "absent": "empty"}, "keys": {"k": {"path": ["k"]}}, "fields": {"u": {"path": ["u"]}}}
    return project(docs, "doc", mapping, ["event_id"])[1].select("event_id", F.get_json_object("_item", "$.u").alias("u"))


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def mapping_absent(spark, sf_dir):
    """Documents without the collection, where its absence is invalid."""
    from lattisca.sources.mapping import project

    text = F.when(F.col("event_type") == "click", F.lit("{}")).otherwise('{"items": [{"k": 1}]}')
    docs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("doc"))
    mapping = {"collection": {"kind": "array", "path": ["items"], "absent": "invalid"}, "keys": {"k": {"path": ["k"]}}, "fields": {}}
    return project(docs, "doc", mapping, ["event_id"])[1].select("event_id")


@query("WITH RECURSIVE r AS (SELECT 0::BIGINT AS node UNION SELECT n_nationkey + 5 FROM r JOIN nation ON n_nationkey = node) SELECT DISTINCT 'n' || node AS source FROM r")
def linked_sources(spark, sf_dir):
    """Sources found by following links, each nation linking to the fifth after it."""
    from lattisca.sources.system import discover

    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("at"), F.concat(F.lit("n"), (F.col("n_nationkey") + 5).cast("string")).alias("to"))
    found, _ = discover(["n0"], lambda s: rows.filter(F.col("at") == s).select("to"))
    return spark.createDataFrame([(s,) for s in found], "source string")


@query("SELECT relationId, attachmentId FROM (VALUES ('nation', 'nation:0'), ('supplier', 'supplier:0')) t(relationId, attachmentId)")
def system_memberships(spark, sf_dir):
    from lattisca.sources.system import system_relations

    own = system_relations(spark, catalog(spark, sf_dir, ["nation", "supplier"], KEYS))
    return evaluate(spark, n.pipe(n.scan("system.memberships", "m"), n.select("r", relationId=f("m", "relationId"), attachmentId=f("m", "attachmentId"))), own).df


@query("SELECT * FROM (VALUES ('id', 'orders.cheap')) t(id, code)")
def system_constraints(spark, sf_dir):
    from lattisca.sources.system import system_relations

    own = system_relations(spark, catalog(spark, sf_dir, ["orders"], KEYS), constraints=[{"id": "id", "code": "orders.cheap"}])
    return evaluate(spark, n.pipe(n.scan("system.constraints", "c"), n.select("r", id=f("c", "id"), code=f("c", "code"))), own).df


@query("SELECT l_partkey % 2 = 0 AND l_suppkey % 10 = 0 AS emptied, count(*) AS n, count(l_partkey) FILTER (l_partkey % 2 <> 0 OR l_suppkey % 10 <> 0) AS referring FROM lineitem GROUP BY 1")
def referential_fields(spark, sf_dir):
    """References of two fields, emptied where their parent leaves."""
    from lattisca.operators.constraints import delete_with_references

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    offers = lines.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct()
    gone = offers.filter("part % 2 = 0 AND supplier % 10 = 0")
    refs = [{"from": "lineitem", "field": ["l_partkey", "l_suppkey"], "to": "offers", "action": "set-null"}]
    after = delete_with_references({"lineitem": lines, "offers": offers}, {"lineitem": ["l_orderkey", "l_linenumber"], "offers": ["part", "supplier"]}, refs, "offers", gone)
    return after["lineitem"].groupBy((F.col("l_partkey").isNull() & F.col("l_suppkey").isNull()).alias("emptied")).agg(F.count(F.lit(1)).alias("n"), F.count("l_partkey").alias("referring"))


@query("SELECT * FROM (VALUES ('a', 'applied'), ('b', 'failed'), ('c', 'unattempted'), ('all', 'partial')) t(step, outcome)")
def tx_batch(spark, sf_dir):
    """Transactions on two stores without a common rollback: one is applied, one refused, and none tried after it."""
    from lattisca.operators.writes import batch

    one, two = _store(spark, sf_dir), _store(spark, sf_dir)
    delete = {"kind": "delete", "relation": "supplier", "when": lambda df: df["s_acctbal"] < 0}
    clash = {"kind": "insert", "relation": "supplier", "rows": two.tables["supplier"]}
    got = batch([{"id": "a", "store": one, "statements": [delete]}, {"id": "b", "store": two, "statements": [clash]}, {"id": "c", "store": two, "statements": [delete]}])
    return spark.createDataFrame([(s["id"], s["outcome"]) for s in got["steps"]] + [("all", got["outcome"])], "step string, outcome string")


@query("SELECT 1 AS version, count(*) AS n, max(s_acctbal + 1) AS highest FROM supplier")
def tx_replay(spark, sf_dir):
    """An operation that is sent twice is done once."""
    from lattisca.operators.writes import transact

    store = _store(spark, sf_dir)
    more = [{"kind": "update", "relation": "supplier", "when": lambda df: F.lit(True), "edits": {"s_acctbal": {"increment": 1}}}]
    for _ in range(2):
        version = transact(store, more, operation="raise", command="increment s_acctbal by 1")["version"]
    return store.tables["supplier"].agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("n"), F.max("s_acctbal").alias("highest"))


@query("SELECT s_suppkey, '[\"' || s_suppkey || '\",\"' || i || '\"]' AS item, i AS place, 'p' || (s_suppkey * 10 + i + 1) AS name FROM supplier, range(3) t(i)")
def mapping_metadata(spark, sf_dir):
    """Items of an array known by their place in their document."""
    from lattisca.sources.mapping import relation

    parts = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.concat(F.lit("p"), F.col("s_suppkey") * 10 + i).alias("name")))
    docs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.to_json(F.struct(parts.alias("parts"))).alias("body"))
    meta = lambda v: {"kind": "source-metadata", "value": v}
    how = {"collection": {"kind": "array", "path": ["parts"], "absent": "creatable"}, "keys": {"item": meta("collection-element-identity")}, "fields": {"place": meta("collection-position"), "name": {"path": ["name"]}}}
    own = relation(docs, "body", how, ["s_suppkey"])
    if own.completeness != "exact":
        raise ValueError(own.completeness)
    return own.df


@query("SELECT 'state' AS field, 'open' AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0")
def lens_lossy(spark, sf_dir):
    """Rows seen through a case that can't be written back."""
    from lattisca.sources.lens import lossy

    cases = [{"from": a, "to": b, "writeBack": w} for a, b, w in (("O", "open", "to-from"), ("F", "done", "to-from"), ("P", "open", "reject"))]
    return lossy(spark.read.parquet(f"{sf_dir}/orders.parquet"), [{"kind": "lens.value-map", "from": "o_orderstatus", "to": "state", "cases": cases}])


def _regions(spark, sf_dir, more=lambda r: {}):
    """A source for each region, of its nations."""
    from lattisca.sources.relations import RelationInput
    from lattisca.streaming.session import Source

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return [Source(f"r{r}", {"nation": RelationInput(nations.filter(F.col("n_regionkey") == r), KEYS["nation"])} | more(r)) for r in range(5)]


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_regionkey <> 3 AND NOT (n_regionkey = 1 AND n_nationkey % 2 = 0) GROUP BY 1")
def session_members(spark, sf_dir):
    """A session over a source for each region: one that comes later, one that leaves, and rows that leave another."""
    from lattisca.streaming.maintenance import Change
    from lattisca.streaming.session import Member, QuerySession

    parts = _regions(spark, sf_dir)
    session = QuerySession(spark, n.pipe(n.scan("nation"), n.aggregate("a", {"region": n.field("nation", "n_regionkey")}, n=n.measure("count"))), [Member(p.id, p) for p in parts[:4]] + [Member("r4")])
    if session.completeness != "unknown":
        raise ValueError(session.completeness)
    session.resolve("r4", parts[4])
    session.detach("r3")
    rows = parts[1].relations["nation"].df
    session.update("r1", {"nation": Change(rows.filter("n_nationkey % 2 = 0"), rows.limit(0))}, 0)
    return session.rows


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_regionkey <= 3 GROUP BY 1")
def session_links(spark, sf_dir):
    """A session that starts from one source and follows links, each to the source of the next region, up to the fourth."""
    from lattisca.sources.relations import RelationInput
    from lattisca.streaming.session import Member, QuerySession

    links = lambda r: {"link": RelationInput(spark.createDataFrame([(f"r{r + 1}",)] if r < 3 else [], "target string"), ("target",))}
    parts = {p.id: p for p in _regions(spark, sf_dir, links)}
    count = n.pipe(n.scan("nation"), n.aggregate("a", {"region": n.field("nation", "n_regionkey")}, n=n.measure("count")))
    return QuerySession(spark, count, [Member("r0", parts["r0"])], links=n.scan("link"), open_source=parts.get).rows
