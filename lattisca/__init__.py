"""A Spark-first relational engine: portable query plans lowered to DataFrames."""
