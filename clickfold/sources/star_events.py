"""Product events derived from the star-schema test tables.

``events`` carries ids only. The lookups are left to the caller: reports aggregate to
the product id first and look names up for the few rows left, so the event table is
never shuffled against a table that grows with the data. No join is hinted; Spark
broadcasts a lookup only when its size is under the broadcast threshold and otherwise
shuffles, splitting hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.schemas import CLICK_TOPIC, MAIN_TOPIC, PRICE


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def bare_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events whose product names and locations are still null."""
    unknown = F.lit(None).cast("string")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.upper("event_type").alias("event_type"),
        F.get_json_object("props", "$.k").cast("int").alias("product_id"),
        unknown.alias("product_name"),
        unknown.alias("product_category"),
        F.col("value").cast(PRICE).alias("product_price"),
        "user_id",
        unknown.alias("location"),
        unknown.alias("session_id"),
        F.col("ts").alias("created_at"),
    )


def with_products(
    df: DataFrame, spark: SparkSession, sf_dir: str, category: str = "product_category"
) -> DataFrame:
    """Look up product name and category by ``product_id``."""
    products = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias(category),
    )
    return df.drop("product_name", category).join(products, "product_id", "left")


def with_locations(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up the user's region as ``location``."""
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_nationkey"
    )
    nations = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    places = nations.select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.concat_ws(", ", "n_name", "r_name").alias("location"),
    )
    placed = df.drop("location").join(customers, "user_id", "left")
    return placed.join(places, "c_nationkey", "left").drop("c_nationkey")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fully denormalised events, as a producer would send them."""
    return with_locations(
        with_products(bare_events(spark, sf_dir), spark, sf_dir), spark, sf_dir
    )


def log_position(messages: DataFrame) -> DataFrame:
    """Place routed messages in a log. The event id is unique and rises with time, so it
    serves as offset without a global numbering of the rows."""
    spread = F.pmod(F.coalesce(F.col("key").cast("int"), F.lit(0)), F.lit(3))
    three_way = F.col("topic").isin(MAIN_TOPIC, CLICK_TOPIC)
    return messages.withColumns(
        {
            "partition": F.when(three_way, spread).otherwise(F.lit(0)).cast("int"),
            "offset": F.col("event_id").cast("long"),
        }
    )
