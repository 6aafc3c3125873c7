"""Declared schemas: value declarations as Spark types, row parsing, and checks of a schema itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE = 2**53 - 1
#: Fixed values, the patterns of canonical texts: decimals without needless zeros, instants of nine digits in UTC, unpadded base64url.
DECIMAL = r"^(0|-?([1-9][0-9]*|(0|[1-9][0-9]*)\.[0-9]*[1-9]))$"
INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{9}Z$"
BYTES = r"^[A-Za-z0-9_-]*$"
_PLAIN = {"string": T.StringType(), "boolean": T.BooleanType(), "number": T.DoubleType(), "integer": T.LongType(), "decimal": T.StringType(), "instant": T.StringType(), "bytes": T.StringType(), "json": T.StringType(), "custom": T.StringType(), "null": T.NullType()}


def spark_type(declared: dict, schema: dict | None = None) -> T.DataType:
    """The column type of a value declaration; decimals, nanosecond instants and bytes stay the texts that they compare as."""
    kind = declared["kind"]
    if kind == "ref":
        target = next(r for r in (schema or {"relations": {}})["relations"].values() if r["relationId"] == declared["target"]["relationId"])
        return T.ArrayType(spark_type(target["fields"][target["key"][0]]["type"], schema))
    if kind == "array":
        return T.ArrayType(spark_type(declared["items"], schema))
    if kind == "tuple":
        return T.StructType([T.StructField(f"_{i}", spark_type(d, schema)) for i, d in enumerate(declared["items"])])
    if kind == "record":
        return T.StructType([T.StructField(k, spark_type(d, schema)) for k, d in sorted(declared["fields"].items())])
    if kind == "union":
        return T.StructType([T.StructField(f"_{i}", spark_type(d, schema)) for i, d in enumerate(declared["alternatives"])])
    return _PLAIN[kind]


def struct_of(relation: dict, schema: dict | None = None) -> T.StructType:
    return T.StructType([T.StructField(f, spark_type(d["type"], schema), bool(d.get("nullable") or d.get("optional"))) for f, d in relation["fields"].items()])


def valid(declared: dict, value: Column) -> Column:
    """True where a value keeps its declaration; null where it is null."""
    kind = declared["kind"]
    if kind == "string" and "values" in declared:
        return value.isin(*declared["values"])
    if kind == "integer":
        return value.between(-SAFE, SAFE)
    if kind == "number":
        return (value < float("inf")) & (value > float("-inf"))
    if kind in ("decimal", "bytes"):
        return value.rlike(DECIMAL if kind == "decimal" else BYTES)
    if kind == "instant":
        zeros = {"ms": 6, "us": 3, "ns": 0}[declared.get("precision", "ns")]
        return value.rlike(INSTANT) & (value.endswith("0" * zeros + "Z") if zeros else F.lit(True))
    if kind == "array":
        inside = F.forall(value, lambda v: F.coalesce(valid(declared["items"], v), F.lit(False)))
        return inside & (F.size(value) <= declared["maxItems"]) if "maxItems" in declared else inside
    if kind == "record":
        out = F.lit(True)
        for k, d in declared["fields"].items():
            v = value.getField(k)
            out = out & (F.coalesce(valid(d, v), F.lit(False)) | (v.isNull() & F.lit(k in declared.get("optional", []))))
        return out
    return F.when(value.isNotNull(), F.lit(True))


def parse_rows(df: DataFrame, relation: dict) -> tuple[DataFrame, DataFrame]:
    """Rows that keep a relation's declaration, with its fields alone, and rejected rows with ``_issues``.

    An absent required column, a null where none is allowed and a value outside its declaration are issues. One rejected
    row makes the relation's completeness unknown, which is the caller's to pass on.
    """
    issues = []
    for f, d in relation["fields"].items():
        if f not in df.columns:
            if not d.get("optional"):
                issues.append(F.lit(f"{f}: schema.field_missing"))
            continue
        v = F.col(f"`{f}`")
        if not (d.get("nullable") or d.get("optional")):
            issues.append(F.when(v.isNull(), F.lit(f"{f}: schema.field_null")))
        issues.append(F.when(v.isNotNull() & ~F.coalesce(valid(d["type"], v), F.lit(False)), F.lit(f"{f}: schema.value_invalid")))
    marked = df.withColumn("_issues", F.filter(F.array(*issues), lambda i: i.isNotNull()) if issues else F.array().cast("array<string>"))
    fields = [F.col(f"`{f}`") for f in relation["fields"] if f in df.columns]
    return marked.filter(F.size("_issues") == 0).select(*fields), marked.filter(F.size("_issues") > 0)


def check_schema(schema: dict) -> list[str]:
    """Issues of a schema: relation ids, keys and the targets of references."""
    issues, seen = [], set()
    ids = {r["relationId"] for r in schema["relations"].values()}
    for n, r in schema["relations"].items():
        if r["relationId"] in seen:
            issues.append(f"{n}: relation_id_duplicate")
        seen.add(r["relationId"])
        if not r["key"] or len(set(r["key"])) != len(r["key"]):
            issues.append(f"{n}: key_invalid")
        for k in r["key"]:
            d = r["fields"].get(k)
            if d is None or d.get("optional") or d.get("nullable") or d["type"]["kind"] in ("json", "array", "tuple", "record", "union"):
                issues.append(f"{n}.{k}: key_field_invalid")
        issues += [f"{n}.{f}: ref_target_missing" for f, d in r["fields"].items() if d["type"]["kind"] == "ref" and d["type"]["target"]["relationId"] not in ids]
    return issues
