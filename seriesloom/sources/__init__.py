"""Series read from tables: the panels that queries use, and CSV files of series."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, y): order value by priority and month from 1995 to July 2001, in units of 1,234,577, a prime (cents are then no rounding ties)."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("2001-08-01").cast("timestamp_ntz"))
    t = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), t.alias("t")).agg((F.sum("o_totalprice") / 1234577.0).alias("y"))


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, y): order value in thousands by customer and month from 1995 on, a series of 79 months for each customer with orders; 0 in months without."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("2001-08-01").cast("timestamp_ntz"))
    t = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int")
    sums = o.groupBy(F.col("o_custkey").cast("string").alias("series_id"), t.alias("t")).agg((F.sum("o_totalprice") / 1000.0).alias("y"))
    months = F.sequence(F.lit(0), F.lit(78))
    known = sums.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "y"))).alias("known"))
    return known.select("series_id", F.posexplode(F.transform(months, lambda m: F.coalesce(F.try_element_at("known", m), F.lit(0.0)))).alias("t", "y"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ds, t, y): events by type and day."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ds")).agg(F.count("*").cast("double").alias("y"))
    return e.withColumn("t", F.date_diff("ds", F.lit("2024-01-01").cast("date")))


def read_series_csv(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """A file with the header t,y; rows without a value are dropped."""
    return spark.read.csv(path, header=True, schema="t int, y double").filter(F.col("y").isNotNull() & ~F.isnan("y")).select(F.lit(series_id).alias("series_id"), "t", "y")


# Name, number of values and period of the classic series that loaders know.
CLASSICS = {
    "airpassengers": (144, 12),
    "wineind": (176, 12),
    "austres": (89, 4),
    "lynx": (114, 1),
    "woolyrnq": (119, 4),
    "wwwusage": (100, 1),
    "co2": (468, 12),
    "sunspots": (2820, 12),
    "ausbeer": (211, 4),
    "ausbeer_long": (218, 4),
    "gasoline": (745, 52),
    "gasoline_long": (1355, 52),
    "heartrate": (150, 1),
    "taylor": (4032, 48),
}


def load_classic(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A classic series from its file folder/name.csv; raises if it isn't known, wasn't fetched, or hasn't the right number of values."""
    if name not in CLASSICS:
        raise ValueError(f"unknown series {name}")
    try:
        out = read_series_csv(spark, f"{folder}/{name}.csv", name)
        n = out.count()
    except AnalysisException as e:
        raise FileNotFoundError(f"{name} was not fetched into {folder}") from e
    if n != CLASSICS[name][0]:
        raise ValueError(f"{name} has {n} values, not {CLASSICS[name][0]}")
    return out


def check_shape(df: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """(series_id, n, low, high, fits): whether each series has n values within the bounds."""
    out = df.groupBy("series_id").agg(F.count("y").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))
    return out.withColumn("fits", (F.col("n") == n) & (F.col("low") >= low) & (F.col("high") <= high))
