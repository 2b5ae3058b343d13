"""Exploration of review-style tables: counts, top-k, join and average, partition profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def count_distinct_with_null(column: str) -> Column:
    """Distinct values of a column, null counting as one of them."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("bigint"))


def review_summary(reviews: DataFrame, *, user: str, item: str, date: str, year: str) -> DataFrame:
    """One row: reviews, reviews of ``year`` (by the first four characters), distinct users and items.

    Null counts as a value. An empty table gives zeros.
    """
    return reviews.agg(
        F.count("*").alias("n_review"),
        F.count_if(F.substring(date, 1, 4) == year).alias("n_review_year"),
        F.coalesce(count_distinct_with_null(user), F.lit(0)).alias("n_user"),
        F.coalesce(count_distinct_with_null(item), F.lit(0)).alias("n_business"),
    )


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """``(key, n)``: the ``k`` most frequent keys, of equals the lesser; null is a key and comes first among equals.

    Counts are combined before the shuffle, and only ``k`` rows of a task go on.
    """
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def average_by_group(facts: DataFrame, groups: DataFrame, *, key: str, value: str, group: str) -> DataFrame:
    """Average of ``value`` over the facts of each ``group``, descending, then by group.

    The ratio of sums over facts, not the mean of means; several rows of a key in
    ``groups`` count its facts several times. Null values don't count, a null group is
    the empty string. Facts are added up by key before they are joined, so that a key
    holding most of them is one row.
    """
    sums = (
        facts.where(F.col(value).isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    )
    named = groups.select(key, F.coalesce(F.col(group), F.lit("")).alias(group))
    return (
        sums.join(named, key)
        .groupBy(group)
        .agg((F.sum("_s") / F.sum("_n")).alias(value))
        .orderBy(F.desc(value), F.asc(group))
    )


def partition_rows(df: DataFrame, partitions: int) -> DataFrame:
    """``(partition, n)``: rows in each physical partition, empty ones with 0."""
    counted = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition"))
    return every.join(counted, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """``(value, index)``: the distinct values of a column in order, numbered from 0; a null is no value.

    Sorted by ranges, so no task has all values: each is numbered within its partition,
    and partitions are shifted by how many values lie before them, a row a partition.
    """
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    # materialised, so that partitions are the same ones when they are counted and numbered
    placed = cut_lineage(values.orderBy("value").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counted = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counted.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(shifts), "_part").select("value", (own + F.col("_shift")).alias("index"))


def first_letter_bucket(key: str, buckets: int) -> Column:
    """The bucket a key goes to by the code of its first character; null keys to bucket 0."""
    return F.coalesce(F.pmod(F.ascii(key), F.lit(buckets)), F.lit(0))


def repartition_by_first_letter(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows placed so that partition i holds exactly the keys of bucket i."""
    return df.repartitionById(buckets, first_letter_bucket(key, buckets))


def known_rows(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is known (membership as a semi-join; null keys are not)."""
    return df.join(keys, list(on), "left_semi")


def cold_rows(df: DataFrame, users: DataFrame, items: DataFrame, *, user: str, item: str) -> DataFrame:
    """Rows whose user or item is unknown, with flags ``user_known`` and ``item_known``."""
    u = users.select(user).distinct().withColumn("_u", F.lit(True))
    i = items.select(item).distinct().withColumn("_i", F.lit(True))
    flagged = df.join(u, user, "left").join(i, item, "left")
    return (
        flagged.withColumn("user_known", F.col("_u").isNotNull())
        .withColumn("item_known", F.col("_i").isNotNull())
        .where(~(F.col("user_known") & F.col("item_known")))
        .drop("_u", "_i")
    )


def lookup(df: DataFrame, names: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Adds columns of ``names`` by key, with a default where the key or the value is missing."""
    joined = df.join(names.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def error_report(predictions: DataFrame, truth: DataFrame, on: Sequence[str], *, predicted: str, actual: str) -> DataFrame:
    """One row: pairs, RMSE, and absolute errors in [0,1) [1,2) [2,3) [3,4) [4,∞). Joined by key; no pairs, null RMSE."""
    own = predictions.select(*on, F.col(predicted).alias("_p"))
    pairs = own.join(truth.select(*on, F.col(actual).alias("_a")), list(on))
    error = F.abs(F.col("_p") - F.col("_a"))
    buckets = [F.count_if((error >= i) & (error < i + 1)).alias(f"from_{i}") for i in range(4)]
    return pairs.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), *buckets, F.count_if(error >= 4).alias("from_4")
    )
