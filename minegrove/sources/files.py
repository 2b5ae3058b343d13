"""Readers of the file formats that come with review data. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEWS = "user_id string, business_id string, stars double, date string"
BUSINESSES = "business_id string, city string, stars double, review_count bigint"
USERS = "user_id string, review_count bigint, average_stars double"
PAIRS = "user_id string, business_id string"
RATINGS = "user_id string, business_id string, stars double"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line; fields that are missing are null."""
    return spark.read.schema(schema).json(path)


def headed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line in each file, which is dropped; no quotes or escapes."""
    return spark.read.csv(path, schema=schema, header=True, quote="")


def quoted_transactions(spark: SparkSession, path: str) -> DataFrame:
    """``(basket, item)`` from quoted CSV with date, customer and product in columns 0, 1 and 5.

    The basket is ``date-customer``; the product a number, so leading zeros vanish.
    """
    schema = ", ".join(f"c{i} string" for i in range(6))
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', mode="PERMISSIVE", enforceSchema=True)
    return rows.select(F.concat_ws("-", "c0", "c1").alias("basket"), F.trim("c5").cast("bigint").alias("item"))


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: one id a line."""
    return spark.read.text(path)


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label, features)`` from headless CSV: id, true label, coordinates."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(
        F.trim(parts[0]).cast("bigint").alias("id"),
        F.trim(parts[1]).cast("int").alias("label"),
        F.transform(F.slice(parts, F.lit(3), F.size(parts)), lambda x: F.trim(x).cast("double")).alias("features"),
    )


def sampled_batches(lines: DataFrame, batches: int, size: int, seed: int = 0) -> DataFrame:
    """A stream ``(batch, seq, value)`` of ``batches`` draws of ``size`` lines, with replacement.

    Which line is drawn is a hash of the position and ``seed``, so the same on any
    cluster. Lines are numbered in the order of their text; null lines are left out.
    """
    from pyspark.sql import Window as W

    from ..operators.sketches import draw

    named = lines.where(F.col("value").isNotNull()).select("value")
    # dense numbers without one task sorting all: by the bucket of a hash, then within it
    keyed = named.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(4096)))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_base", F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))  # 4096 rows
    numbered = keyed.join(F.broadcast(before), "_b").withColumn(
        "_n", F.coalesce("_base", F.lit(0)) + F.row_number().over(W.partitionBy("_b").orderBy("value")) - 1
    )
    total = named.agg(F.count("*").alias("_t"))
    spark = lines.sparkSession
    drawn = spark.range(1, batches * size + 1).select(F.col("id").alias("seq")).crossJoin(F.broadcast(total))  # one row
    chosen = drawn.where("_t > 0").withColumn("_n", F.pmod(draw(F.col("seq"), 7 + seed), F.col("_t")))
    return chosen.join(numbered.select("_n", "value"), "_n").select(
        (F.floor((F.col("seq") - 1) / size) + 1).cast("bigint").alias("batch"), "seq", "value"
    )
