"""Plans whose rows or pairs outgrow what one driver or one task holds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lattisca.operators import joins, recursion
from lattisca.plans import nodes as n
from lattisca.plans.engine import evaluate
from lattisca.queries import ORACLES, QUERIES
from lattisca.sources.relations import RelationInput

f, lit = n.field, n.literal


def test_reach_has_no_limit_of_rows(spark, tmp_path):
    rows = spark.range(110_000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "1L AS l_suppkey", "id + 2 AS l_partkey", "50D AS l_quantity")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["recursive_reach"](spark, str(tmp_path))
    assert got.count() == got.distinct().count() == 110_001


def test_rows_of_many_rounds_leave_the_driver(spark, monkeypatch):
    monkeypatch.setattr(recursion, "SMALL", 2)
    monkeypatch.setattr(recursion, "TABLES", 2)
    packed, sizes = recursion._packed, []

    def seen(spark, rows):
        out = packed(spark, rows)
        sizes.append((sum(k for h, k in out if h.table is not None), sum(h.table is None for h, _ in out)))
        return out

    monkeypatch.setattr(recursion, "_packed", seen)
    edges = n.values("e", [{"a": a, "b": b} for a in range(12) for b in (a + 1, a // 2)])
    step = n.pipe(n.again("r"), n.join(edges, "inner", n.eq(f("x", "n"), f("e", "a"))), n.select("x", n=f("e", "b")))
    plan = n.recursive("r", n.values("x", [{"n": 0}]), step, [f("x", "n")], max_iterations=None, max_rows=None)
    assert sorted(r["n"] for r in evaluate(spark, plan, {}).df.collect()) == list(range(13))
    assert max(k for k, _ in sizes) <= 2 and max(t for _, t in sizes) <= 2


def _blocked(spark, tmp_path, name):
    spark.range(400).selectExpr("id AS s_suppkey", "CAST(id % 4 = 3 AS INT) AS s_nationkey", "IF(id % 2 = 0, 9000D, 1D) AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(600).selectExpr("id AS c_custkey", "CAST(id % 5 = 4 AS INT) AS c_nationkey", "IF(id % 3 = 0, 9500D, 1D) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES[name]).fetchall())
    return sizes


@pytest.mark.parametrize("name", ["join_tuple", "join_self"])
def test_pairs_of_few_keys_are_dealt_out(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(joins, "PAIRS", 2000)
    monkeypatch.setattr(joins, "SIDE", 16)
    monkeypatch.setattr(joins, "REPEATS", 8)
    sizes = _blocked(spark, tmp_path, name)
    assert len(sizes) > 20 and max(sizes) < 0.15 * sum(sizes)


def test_pairs_are_counted_only_where_keys_repeat(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 10)
    seen = []
    monkeypatch.setattr(joins, "_bytes", lambda df: seen.append(df) or 0)
    rows = {r: [RelationInput(spark.range(9).selectExpr("id", "id % 2 AS g"), ("id",))] for r in "ab"}
    join = lambda one, two: evaluate(spark, n.pipe(n.scan("a"), n.join(n.scan("b"), "inner", n.eq(f("a", one), f("b", two)))), rows).df.count()
    assert join("g", "id") == 9 and join("id", "g") == 9 and not seen
    assert join("g", "g") == 41 and seen
    one = n.pipe(n.scan("a"), n.join(n.scan("b"), "inner", n.all_of(n.eq(f("a", "g"), f("b", "g")), n.compare("lt", f("a", "id"), f("b", "id")))))
    plain = sorted(evaluate(spark, one, rows, keys=True).df.select("_key").collect())
    monkeypatch.setattr(joins, "_bytes", lambda df: 1 << 40)
    monkeypatch.setattr(joins, "GROWTH", 0)
    monkeypatch.setattr(joins, "SIDE", 2)
    dealt = evaluate(spark, one, rows, keys=True).df
    assert dealt.rdd.getNumPartitions() == 5 and sorted(dealt.select("_key").collect()) == plain
