"""A vote table made from the line items and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.schema import VoteLayout

ORDER = ("l_orderkey", "l_linenumber", "l_partkey")
LAYOUT = VoteLayout(
    keys=("event_id", "classroom_id", "identifier"),
    value="value",
    role="role",
    order=ORDER,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes with blank, NULL and unlisted ratings and roles among them."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    role = (
        F.when(priority == "1-URGENT", "el coach")
        .when(priority == "2-HIGH", "school coach")
        .when(priority == "3-MEDIUM", "teacher")
        .when(priority == "4-NOT SPECIFIED", "other")
        .otherwise("el admin")
    )
    flag = F.col("l_returnflag")
    value = (
        F.when(F.col("l_discount") == 0, "")
        .when(F.col("l_discount") == 0.01, F.lit(None))
        .when(F.col("l_tax") == 0.08, "Maybe")
        .when(flag == "A", "Evident")
        .when(flag == "N", "Somewhat Evident")
        .when(flag == "R", "Not Evident")
    )
    month = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    # Ratings and months are shorter than what they come from, so they go to the join.
    rated = items.select(
        F.col("l_suppkey").alias("event_id"),
        month.cast("int").alias("classroom_id"),
        F.col("l_linestatus").alias("identifier"),
        value.alias("value"),
        *ORDER,
    )
    return rated.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *LAYOUT.keys, role.alias("role"), "value", *ORDER
    )
