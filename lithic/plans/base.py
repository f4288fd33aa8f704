"""How queries are registered: a plan on the Spark side, and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` is DuckDB text with the same columns, where SQL can state it."""

    def put(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql:
            ORACLE[name] = sql
        return plan

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str, name: str, width: int = 10_000) -> DataFrame:
    """``df`` with dense numbers from 0 in the order of an integer key, counted a range of keys at a time."""
    placed = df.withColumn("range_", F.floor(F.col(key) / width))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = placed.groupBy("range_").agg(F.count("*").alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    within = F.row_number().over(Window.partitionBy("range_").orderBy(key)) - 1
    return placed.withColumn(name, within.cast("long")).join(offsets, "range_").withColumn(name, F.col(name) + F.col("before_")).drop("range_", "before_")
