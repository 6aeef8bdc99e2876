"""How queries are registered, and the small tables that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function and the SQL that it is held against."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int) -> Column:
    """Decimals as DuckDB's round() gives them (the product with a power of ten, halves away from zero), and no negative zero. Spark's
    own rounding goes by the shortest decimals of a number instead, which differs at ties, and makes a BigDecimal of each."""
    v, by = c.cast("double"), 10.0**digits
    y = v * by
    whole = F.rint(y)
    to = F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole)
    return F.when(F.abs(v) < 1e300, to / by + F.lit(0.0)).otherwise(v)


def r6(c: Column) -> Column:
    return rounded(c, 6)


def lon_of(k: Column) -> Column:
    return 360.0 * (((k * 7919 + 13) % 10007) / 10007.0) - 180.0


def lat_of(k: Column) -> Column:
    return F.degrees(F.asin(2.0 * (((k * 104729 + 7) % 10009) / 10009.0) - 1.0))


def located(df: DataFrame, key: str) -> DataFrame:
    """Adds the points rule's lon and lat of an integer key."""
    k = F.col(key).cast("bigint")
    return df.withColumns({"lon": lon_of(k), "lat": lat_of(k)})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, lon, lat of each customer."""
    return located(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("point_id")), "point_id")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), "ts", "user_id", "value", "event_type"), "point_id")


def sql_points(name: str = "pts", source: str = "customer", key: str = "c_custkey", more: str = "") -> str:
    """The same as a common table expression."""
    return f"""{name} AS (SELECT CAST({key} AS BIGINT) AS point_id{more},
      360.0 * (((CAST({key} AS BIGINT) * 7919 + 13) % 10007) / 10007.0) - 180.0 AS lon,
      degrees(asin(2.0 * (((CAST({key} AS BIGINT) * 104729 + 7) % 10009) / 10009.0) - 1.0)) AS lat FROM {source})"""


def entries(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """A vector column as rows: keys, i, value (six decimals)."""
    return df.select(*keys, F.posexplode(vector).alias("i", "value")).withColumn("value", r6(F.col("value")))


def sql_entries(vector: str, source: str, keys: str = "point_id") -> str:
    return f"SELECT {keys}, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i, round(unnest(v), 6) + 0.0 AS value FROM (SELECT {keys}, {vector} AS v FROM {source})"
