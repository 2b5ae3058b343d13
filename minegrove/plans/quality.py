"""Queries on references and on skewed keys (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id, leading_year, month_of
from ..operators.references import Reference, orphan_references, why_orphaned
from ..operators.skew import eager_join_aggregate, once_per_id, shares_of_groups, unpivot_keys
from ..sources import table

#: Years are four digits, so there are at most this many; times two fields.
YEARS = 10_000


def _rating_references(spark: SparkSession, d: str) -> tuple[DataFrame, list[Reference]]:
    ratings = table(spark, d, "yelp_val").select(
        "val_id", clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id"), "rated_at"
    )
    refs = []
    for name, column in (("yelp_user", "user_id"), ("business", "business_id")):
        target = table(spark, d, name).select(clean_id(column).alias("_id"), "created_at", "deleted_at")
        refs.append(Reference(name, target, {column: "_id"}, "partial", "created_at", "deleted_at"))
    return ratings, refs


def _orphans(spark: SparkSession, d: str, explain: bool) -> DataFrame:
    ratings, refs = _rating_references(spark, d)
    parts = []
    for ref in refs:
        (column,) = ref.keys
        rows = ratings.select("val_id", column, "rated_at")
        found = orphan_references(rows, ref, row_id="val_id", at="rated_at")
        if explain:
            found = why_orphaned(found, ref, at="rated_at")
        period = F.coalesce(month_of("rated_at"), F.lit("unknown")).alias("period")
        parts.append(found.select("val_id", "ref_table", period, *(["kind"] if explain else [])).distinct())
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Ratings and the table in which their user or business does not exist at the time."""
    return _orphans(spark, d, explain=False)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted by table, month and what became of the record."""
    return (
        _orphans(spark, d, explain=True)
        .groupBy("ref_table", "period", "kind")
        .agg(F.count_distinct("val_id").alias("ratings"))
    )


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Each review once: its user, business, stars and year; reviews without a year left out."""
    rows = table(spark, d, "review").select(
        "review_id",
        clean_id("user_id").alias("user_id"),
        clean_id("business_id").alias("business_id"),
        "stars",
        leading_year("date").alias("year"),
    )
    return rows


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Users and businesses that hold at least 5 % of a year's reviews."""
    reviews = once_per_id(_reviews(spark, d).drop("stars").where(F.col("year").isNotNull()), "review_id")
    keyed = unpivot_keys(reviews, ("business_id", "user_id"), keep=("year",))
    shares = shares_of_groups(keyed, ("field", "year"), ("key_value",), on_bound=2 * YEARS)
    return shares.where(F.col("n_pairs") * 20 >= F.col("n_all_pairs")).select("field", "key_value", "year")


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Reviews and stars of every user and business in every year, and the share of the year's reviews."""
    reviews = once_per_id(_reviews(spark, d).where(F.col("year").isNotNull()), "review_id")
    keyed = unpivot_keys(reviews, ("business_id", "user_id"), keep=("year", "stars"))
    shares = shares_of_groups(keyed, ("field", "year"), ("key_value",), measures=("stars",), on_bound=2 * YEARS)
    return shares.select(
        "field",
        "key_value",
        "year",
        F.col("n_rows").alias("reviews"),
        F.col("sum_stars"),
        (F.col("n_pairs").cast("double") / F.col("n_all_pairs").cast("double")).alias("share"),
    )


def p4_city_year(spark: SparkSession, d: str) -> DataFrame:
    """Reviews and average stars by city and year; every row of a business counts, as in a plain join."""
    reviews = once_per_id(_reviews(spark, d).where(F.col("year").isNotNull()), "review_id")
    places = table(spark, d, "business").select(clean_id("business_id").alias("business_id"), "city")
    out = eager_join_aggregate(
        reviews, places, ("business_id",), left_groups=("year",), right_groups=("city",), left_measures=("stars",)
    )
    return out.select(
        "city",
        "year",
        F.col("n_rows").cast("bigint").alias("reviews"),
        F.round(F.try_divide("sum_stars", F.col("count_stars").cast("double")), 6).alias("avg_stars"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p4_found": p4_found,
    "p4_keys": p4_keys,
    "p4_city_year": p4_city_year,
}

_ID = "nullif(trim({0}, E' \\t\\r\\n'), '')"


def _id(column: str) -> str:
    return _ID.format(column)


_RATINGS = f"""
ratings as (
  select distinct val_id, {_id('user_id')} as u, {_id('business_id')} as b, rated_at as t from yelp_val),
users as (select {_id('user_id')} as k, created_at as f, deleted_at as e from yelp_user),
places as (select {_id('business_id')} as k, created_at as f, deleted_at as e from business)"""

_ORPHANS = """
select distinct val_id, '{name}' as ref_table, coalesce(strftime(t, '%Y-%m'), 'unknown') as period{more}
from ratings r where {key} is not null and not exists (
  select 1 from {target} x where x.k = r.{key}
    and (t is null or ((f is null or f <= t) and (e is null or t < e))))"""

_KIND = """, case when not exists (select 1 from {target} x where x.k = r.{key}) then 'missing'
  when not exists (select 1 from {target} x where x.k = r.{key} and (f is null or f <= t)) then 'later'
  else 'deleted' end as kind"""


def _orphan_sql(kind: bool) -> str:
    parts = []
    for name, target, key in (("yelp_user", "users", "u"), ("business", "places", "b")):
        more = _KIND.format(target=target, key=key) if kind else ""
        parts.append(_ORPHANS.format(name=name, target=target, key=key, more=more))
    return " union all ".join(parts)


_REVIEWS = f"""
reviews as (
  select review_id, min(u) as u, min(b) as b, min(stars) as stars, min(y) as year from (
    select review_id, {_id('user_id')} as u, {_id('business_id')} as b, stars,
      case when regexp_matches(substr(date, 1, 4), '^[0-9]{{4}}$') then cast(substr(date, 1, 4) as bigint) end as y
    from review) where y is not null group by review_id),
keyed as (
  select 'business_id' as field, b as key_value, year, stars from reviews where b is not null
  union all select 'user_id', u, year, stars from reviews where u is not null),
shares as (
  select field, key_value, year, count(*) as n, sum(stars) as sum_stars,
    sum(count(*)) over (partition by field, year) as total
  from keyed group by field, key_value, year)"""

SQL = {
    "p1_found": f"with {_RATINGS} {_orphan_sql(False)}",
    "p1_report": f"with {_RATINGS}, o as ({_orphan_sql(True)}) "
    "select ref_table, period, kind, count(distinct val_id) as ratings from o group by all",
    "p4_found": f"with {_REVIEWS} select field, key_value, year from shares where n * 20 >= total",
    "p4_keys": f"with {_REVIEWS} select field, key_value, year, n as reviews, sum_stars, "
    "n / cast(total as double) as share from shares",
    "p4_city_year": f"""with {_REVIEWS}, places as (select {_id('business_id')} as b, city from business)
select city, year, count(*) as reviews, round(avg(stars), 6) as avg_stars
from reviews join places using (b) group by city, year""",
}
