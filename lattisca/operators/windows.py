"""Ranking and lag windows. Fields are computed in their order, so a later one may read an earlier one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattisca.functions.expressions import Lowered


def window(engine, frame, node: dict, outer):
    """row-number and lag break ties by result key; rank leaves them, and null and missing tie. lag gives null where there is no row, and for missing and unknown values."""
    for f, w in node["fields"].items():
        lower = engine.expressions(frame, outer)
        by = engine.sort_columns(w["orderBy"], lower, collapse=True)
        spec = Window.partitionBy(*[lower(e).value for e in w.get("partitionBy", [])])
        if w["op"] == "rank":
            x = Lowered(F.rank().over(spec.orderBy(*by)), T.IntegerType())
        else:
            spec = spec.orderBy(*by, frame.identity().asc())
            if w["op"] == "row-number":
                x = Lowered(F.row_number().over(spec), T.IntegerType())
            else:
                v = lower(w["value"])
                x = Lowered(F.lag(v.value, w.get("offset", 1)).over(spec), v.type)
        frame = engine.overlay(frame, node["alias"], {f: x})
    return frame
