"""Queries that explore the tables: counts, top-k, averages, partitions, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators import relational as R
from ..sources import table
from . import views as V

BUCKETS = 13


def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Reviews, reviews of 2018, distinct users and businesses (null counts as one)."""
    return R.review_summary(V.reviews(spark, d), user="user_id", item="business_id", date="date", year="2018")


def top10_users(spark: SparkSession, d: str) -> DataFrame:
    """The ten users with most reviews."""
    return R.top_k(V.reviews(spark, d).where("user_id is not null"), "user_id", 10)


def top10_businesses(spark: SparkSession, d: str) -> DataFrame:
    """The ten businesses with most reviews."""
    return R.top_k(V.reviews(spark, d).where("business_id is not null"), "business_id", 10)


def city_avg_stars(spark: SparkSession, d: str) -> DataFrame:
    """Average stars of a city's reviews, best first."""
    places = table(spark, d, "business").select(clean_id("business_id").alias("business_id"), "city")
    averages = R.average_by_group(V.reviews(spark, d), places, key="business_id", value="stars", group="city")
    return averages.select("city", F.round("stars", 6).alias("stars"))


def partition_profile(spark: SparkSession, d: str) -> DataFrame:
    """Reviews by the bucket that the first letter of the business id gives."""
    return V.reviews(spark, d).groupBy(R.first_letter_bucket("business_id", BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))


def partition_layout(spark: SparkSession, d: str) -> DataFrame:
    """Rows in each physical partition after placing reviews by first letter, empty partitions included."""
    placed = R.repartition_by_first_letter(V.reviews(spark, d).select("business_id"), "business_id", BUCKETS)
    return R.partition_rows(placed, BUCKETS)


def semi_join_features(spark: SparkSession, d: str) -> DataFrame:
    """Users that occur in the ratings, with their features."""
    users = table(spark, d, "yelp_user").select(clean_id("user_id").alias("user_id"), "review_count", "average_stars")
    rated = table(spark, d, "yelp_train").select(clean_id("user_id").alias("user_id"))
    return R.known_rows(users, rated, ["user_id"])


def cold_start_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to be predicted whose user or business has no rating."""
    train = V.train_ratings(spark, d)
    return R.cold_rows(V.targets(spark, d).select("user", "item"), train, train, user="user", item="item")


def default_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to be predicted with the business's stars and reviews, 2.5 and 0 where unknown."""
    places = (
        table(spark, d, "business")
        .select(clean_id("business_id").alias("item"), "stars", "review_count")
        .groupBy("item")
        .agg(F.max("stars").alias("place_stars"), F.max("review_count").alias("place_reviews"))
    )
    pairs = V.targets(spark, d).select("user", "item")
    return R.lookup(pairs, places, "item", {"place_stars": 2.5, "place_reviews": 0})


def dense_index(spark: SparkSession, d: str) -> DataFrame:
    """The users of yelp_train in order, numbered from 0."""
    users = table(spark, d, "yelp_train").select(clean_id("user_id").alias("user_id"))
    return R.dense_index(users, "user_id").select(F.col("value").alias("user_id"), "index")


QUERIES = {
    f.__name__: f
    for f in (
        review_summary,
        top10_users,
        top10_businesses,
        city_avg_stars,
        partition_profile,
        partition_layout,
        semi_join_features,
        cold_start_anti,
        default_lookup,
        dense_index,
    )
}

_BUCKET = f"coalesce(ascii(b) % {BUCKETS}, 0)"
_PLACE = V.sql_id("business_id")
SQL = {
    "review_summary": f"""with {V.REVIEWS} select count(*) as n_review,
count(*) filter (where substr(date, 1, 4) = '2018') as n_review_year,
count(distinct u) + coalesce(max(case when u is null then 1 else 0 end), 0) as n_user,
count(distinct b) + coalesce(max(case when b is null then 1 else 0 end), 0) as n_business from reviews""",
    "top10_users": f"with {V.REVIEWS} select u as user_id, count(*) as n from reviews where u is not null group by u order by n desc, u limit 10",
    "top10_businesses": f"with {V.REVIEWS} select b as business_id, count(*) as n from reviews where b is not null group by b order by n desc, b limit 10",
    "city_avg_stars": f"""with {V.REVIEWS}, places as (select {_PLACE} as b, coalesce(city, '') as city from business)
select city, round(avg(stars), 6) as stars from reviews join places using (b) where stars is not null group by city order by stars desc, city""",
    "partition_profile": f"with {V.REVIEWS} select {_BUCKET} as bucket, count(*) as n from reviews group by 1",
    "partition_layout": f"""with {V.REVIEWS}, c as (select {_BUCKET} as p, count(*) as n from reviews group by 1)
select cast(r.range as int) as partition, coalesce(n, 0) as n from range({BUCKETS}) r left join c on c.p = r.range""",
    "semi_join_features": f"""with users as (select {V.sql_id('user_id')} as user_id, review_count, average_stars from yelp_user)
select * from users where user_id in (select {V.sql_id('user_id')} from yelp_train where {V.sql_id('user_id')} is not null)""",
    "cold_start_anti": f"""with {V.TRAIN}, {V.TARGETS}, flagged as (
select u as user, b as item, u in (select u from ratings) as user_known, b in (select b from ratings) as item_known from targets)
select * from flagged where not (user_known and item_known)""",
    "default_lookup": f"""with {V.TARGETS}, places as (
select {_PLACE} as b, max(stars) as st, max(review_count) as rc from business group by 1)
select u as user, b as item, coalesce(st, 2.5) as place_stars, coalesce(rc, 0) as place_reviews from targets left join places using (b)""",
    "dense_index": f"""select user_id, row_number() over (order by user_id) - 1 as index from (
select distinct {V.sql_id('user_id')} as user_id from yelp_train) where user_id is not null""",
}
