"""The tables as the mining operators want them, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.ids import clean_id
from ..operators.recommend import mean_ratings
from ..operators.similarity import distinct_pairs
from ..sources import table


def sql_id(column: str) -> str:
    return f"nullif(trim({column}, E' \\t\\r\\n'), '')"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Rows of review as delivered, ids without blanks."""
    return table(spark, d, "review").withColumns({c: clean_id(c) for c in ("user_id", "business_id")})


def train_ratings(spark: SparkSession, d: str) -> DataFrame:
    """``(user, item, stars)``, one a pair."""
    rows = table(spark, d, "yelp_train").select(clean_id("user_id").alias("user"), clean_id("business_id").alias("item"), "stars")
    return mean_ratings(rows)


def targets(spark: SparkSession, d: str) -> DataFrame:
    """``(user, item, stars)`` to be predicted, one a pair."""
    rows = table(spark, d, "yelp_val").select(clean_id("user_id").alias("user"), clean_id("business_id").alias("item"), "stars")
    return mean_ratings(rows)


def users_of_items(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ``(id, token)``: businesses and their users."""
    rows = table(spark, d, "yelp_train").select(clean_id("business_id").alias("id"), clean_id("user_id").alias("token"))
    return distinct_pairs(rows, "id", "token")


def items_of_users(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ``(id, token)``: users and their businesses."""
    rows = table(spark, d, "yelp_train").select(clean_id("user_id").alias("id"), clean_id("business_id").alias("token"))
    return distinct_pairs(rows, "id", "token")


REVIEWS = f"reviews as (select {sql_id('user_id')} as u, {sql_id('business_id')} as b, stars, date from review)"
TRAIN = f"""ratings as (
  select {sql_id('user_id')} as u, {sql_id('business_id')} as b, avg(stars) as s from yelp_train
  where {sql_id('user_id')} is not null and {sql_id('business_id')} is not null and stars is not null group by 1, 2)"""
TARGETS = f"""targets as (
  select {sql_id('user_id')} as u, {sql_id('business_id')} as b, avg(stars) as s from yelp_val
  where {sql_id('user_id')} is not null and {sql_id('business_id')} is not null and stars is not null group by 1, 2)"""
EDGES = f"""e as (
  select distinct {sql_id('user_id')} as u, {sql_id('business_id')} as b from yelp_train
  where {sql_id('user_id')} is not null and {sql_id('business_id')} is not null)"""
