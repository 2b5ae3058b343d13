"""Queries on baskets, itemsets, similar sets and recommendations."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators import itemsets as I
from ..operators import recommend as C
from ..operators import similarity as S
from ..operators.relational import error_report
from ..sources import table
from . import views as V

FAMILY = S.HashFamily()
BANDS = 10
HALF = Fraction(1, 2)
LEAST_USERS = 5
CORATED = 5
SUPPORT_PERCENT = 5
BASKETS_A_PART = 1000


def baskets_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Users of more than five businesses, with each business."""
    rows = table(spark, d, "yelp_train").select(clean_id("user_id").alias("u"), clean_id("business_id").alias("b"))
    return I.baskets(rows, "u", "b", more_than=5)


def transaction_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Parts a customer ordered on a day, of days with more than eight."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    rows = lines.join(orders, "o_orderkey").select(
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day"), F.col("o_custkey").cast("string").alias("c"), "l_partkey"
    )
    return I.transactions(rows, "day", "c", "l_partkey", more_than=8)


def _small_baskets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "small2").select(clean_id("user_id").alias("u"), clean_id("business_id").alias("b"))
    return I.baskets(rows, "u", "b")


def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of any number of businesses in at least 5 % of the baskets."""
    pairs = _small_baskets(spark, d)
    support = max(1, ceil(pairs.select("basket").distinct().count() * SUPPORT_PERCENT / 100))
    return I.frequent_itemsets(pairs, support)


def son_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Itemsets of any size frequent in some part of the baskets by scaled support."""
    pairs = _small_baskets(spark, d)
    total = pairs.select("basket").distinct().count()
    return I.son_candidates(pairs, max(1, ceil(total * SUPPORT_PERCENT / 100)), total, per_part=BASKETS_A_PART)


def _large_sets(spark: SparkSession, d: str) -> DataFrame:
    pairs = V.users_of_items(spark, d)
    large = pairs.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_USERS)
    return pairs.join(large.select("id"), "id", "left_semi")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Businesses of five users or more that share at least half of them, by exact overlap."""
    pairs = _large_sets(spark, d)
    least = ceil(HALF * 2 * LEAST_USERS / (1 + HALF))
    return S.similar_overlaps(S.overlap_pairs(pairs, least), pairs, HALF).withColumn("similarity", F.round("similarity", 6))


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    """The twenty least hashes of each business's users."""
    return S.minhash_signatures(V.users_of_items(spark, d), FAMILY)


def _candidates(pairs: DataFrame) -> DataFrame:
    return S.lsh_candidates(S.minhash_signatures(pairs, FAMILY), BANDS, S.band_rows(FAMILY.size, BANDS))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Businesses of five users or more that agree on a band of their signatures."""
    return _candidates(_large_sets(spark, d))


def lsh_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that really are similar."""
    pairs = _large_sets(spark, d)
    return S.verify_jaccard(_candidates(pairs), pairs, HALF).withColumn("similarity", F.round("similarity", 6))


def corated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of businesses that five users or more rated both."""
    return C.corated_items(V.train_ratings(spark, d), CORATED)


def _weights(ratings: DataFrame) -> DataFrame:
    return C.pearson(ratings, C.corated_items(ratings, CORATED))


def pearson_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Their correlation over those users."""
    return _weights(V.train_ratings(spark, d)).withColumn("weight", F.round(F.col("weight") + 0.0, 6))


def _by_items(spark: SparkSession, d: str) -> DataFrame:
    ratings = V.train_ratings(spark, d)
    return C.predict_by_items(ratings, V.targets(spark, d), _weights(ratings), default=2.5)


def cf_predict(spark: SparkSession, d: str) -> DataFrame:
    """Stars predicted from similar businesses."""
    return _by_items(spark, d).withColumn("prediction", F.round("prediction", 6))


def rmse_error_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How far those predictions are off."""
    report = error_report(
        _by_items(spark, d), V.targets(spark, d), ["user", "item"], predicted="prediction", actual="stars"
    )
    return report.withColumn("rmse", F.round("rmse", 6))


def _features(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    users = table(spark, d, "yelp_user").select(
        clean_id("user_id").alias("user"), F.col("review_count").alias("reviews"), F.col("average_stars").alias("stars")
    )
    items = table(spark, d, "business").select(clean_id("business_id").alias("item"), F.col("review_count").alias("reviews"), "stars")
    return C.rating_features(pairs, users, items)


def gbt_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the pairs to be predicted."""
    rounded = {c: F.round(c, 6) for c in ("user_stars", "item_stars")}
    return _features(spark, d, V.targets(spark, d).select("user", "item")).withColumns(rounded)


def _by_trees(spark: SparkSession, d: str) -> DataFrame:
    train = _features(spark, d, V.train_ratings(spark, d))
    test = _features(spark, d, V.targets(spark, d).select("user", "item"))
    return C.predict_by_trees(train, test, depth=5, trees=10)


def gbt_predict(spark: SparkSession, d: str) -> DataFrame:
    """Stars predicted by boosted trees."""
    return _by_trees(spark, d).select("user", "item", "prediction")


def hybrid_predict(spark: SparkSession, d: str) -> DataFrame:
    """Both predictions blended by how much the user has rated."""
    return C.blend(_by_items(spark, d), _by_trees(spark, d))


def hybrid_formula(spark: SparkSession, d: str) -> DataFrame:
    """The blend with the mean of all ratings in the model's place."""
    mean = V.train_ratings(spark, d).agg(F.avg("stars").alias("prediction"))
    flat = V.targets(spark, d).select("user", "item").crossJoin(F.broadcast(mean))  # one row
    return C.blend(_by_items(spark, d), flat).withColumn("prediction", F.round("prediction", 6))


QUERIES = {
    f.__name__: f
    for f in (
        baskets_filtered,
        transaction_baskets,
        frequent_itemsets,
        son_candidates,
        jaccard_pairs,
        minhash_signature,
        lsh_candidates,
        lsh_similar_pairs,
        corated_pairs,
        pearson_similarity,
        cf_predict,
        rmse_error_histogram,
        gbt_features,
        gbt_predict,
        hybrid_predict,
        hybrid_formula,
    )
}

_BASKETS = f"""p as (
  select distinct {V.sql_id('user_id')} as u, {V.sql_id('business_id')} as b from small2
  where {V.sql_id('user_id')} is not null and {V.sql_id('business_id')} is not null),
s as (select count(distinct u) as total, cast(greatest(1, ceil(count(distinct u) * {SUPPORT_PERCENT} / 100.0)) as bigint) as support from p)"""
# occurrences of the sets that are frequent in their part of e (part, u, b, least), each grown by a later item, until a level is empty
_GROWN = """o as (
  select part, u, [b] as items from (select *, count(*) over (partition by part, b) as n from e) where n >= least
  union all
  select part, u, items from (
    select o.part, o.u, list_append(o.items, e.b) as items, e.least, count(*) over (partition by o.part, list_append(o.items, e.b)) as n
    from o join e on e.part = o.part and e.u = o.u and e.b > o.items[-1]) where n >= least)"""
_LARGE = f"""{V.EDGES}, n as (select b, count(*) as n from e group by b having count(*) >= {LEAST_USERS}),
t as (select e.b, e.u, n from e join n using (b))"""
_JACCARD = """o as (select x.b as b1, y.b as b2, x.n as n1, y.n as n2, count(*) as o from t x join t y on x.u = y.u and x.b < y.b group by all),
j as (select b1 as id_1, b2 as id_2, round(o / (n1 + n2 - o)::double, 6) as similarity from o where 2 * o >= n1 + n2 - o)"""
_X = "cast(('0x' || substr(md5(u), 1, 12)) as bigint) % " + str(S.PRIME)


def _signature(source: str) -> str:
    least = ", ".join(f"min(((x * {a} + {b}) % {S.PRIME}) % {FAMILY.modulus})" for a, b in FAMILY.coefficients)
    return f"h as (select b, {_X} as x from {source}), g as (select b as id, [{least}] as signature from h group by b)"


_ROWS = S.band_rows(FAMILY.size, BANDS)
_BANDED = f"""{_LARGE}, {_signature('t')},
r as (select id, i, signature[i * {_ROWS} + 1 : i * {_ROWS} + {_ROWS}] as key from g, range({BANDS}) w(i)),
c as (select distinct p.id as id_1, q.id as id_2 from r p join r q on p.i = q.i and p.key = q.key and p.id < q.id)"""
_PEARSON = f"""{V.TRAIN},
m as (select x.b as i1, y.b as i2, avg(x.s) as mx, avg(y.s) as my, count(*) as n
  from ratings x join ratings y on x.u = y.u and x.b < y.b group by all having count(*) >= {CORATED}),
v as (select i1, i2, n, sum((x.s - mx) * (y.s - my)) as sxy, sum((x.s - mx) ** 2) as sxx, sum((y.s - my) ** 2) as syy
  from m join ratings x on x.b = i1 join ratings y on y.b = i2 and y.u = x.u group by i1, i2, n),
w as (select i1, i2, n, case when sxx < 1e-12 or syy < 1e-12 then 0.0 else sxy / sqrt(sxx * syy) end as w from v)"""
_PREDICT = f"""{_PEARSON}, {V.TARGETS},
um as (select u, avg(s) as us, count(*) as rated from ratings group by u),
im as (select b, avg(s) as bs from ratings group by b),
both_ as (select i1 as b, i2 as o, w from w where w > 1e-9 union all select i2, i1, w from w where w > 1e-9),
near as (select t.u, t.b, w, r.s, row_number() over (partition by t.u, t.b order by w desc, o) as k
  from targets t join both_ x on x.b = t.b join ratings r on r.u = t.u and r.b = o),
p as (select u, b, sum(w * s) / sum(w) as p from near where k <= 50 group by u, b),
cf as (select t.u as u, t.b as b, t.s as s, coalesce(rated, 0) as rated,
  case when us is not null and bs is not null then coalesce(p, bs) else coalesce(us, bs, 2.5) end as prediction
  from targets t left join p on p.u = t.u and p.b = t.b left join um on um.u = t.u left join im on im.b = t.b)"""
_FEATURES = f"""uf as (select {V.sql_id('user_id')} as u, max(review_count) as ur, avg(average_stars) as us from yelp_user group by 1),
bf as (select {V.sql_id('business_id')} as b, max(review_count) as br, avg(stars) as bs from business group by 1)"""
_E = "abs(prediction - s)"

SQL = {
    "baskets_filtered": f"""with {V.EDGES}
select u as basket, b as item from e where u in (select u from e group by u having count(*) > 5)""",
    "transaction_baskets": """with e as (
select distinct strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey as basket, l_partkey as item from orders join lineitem on l_orderkey = o_orderkey)
select basket, item from e where basket in (select basket from e group by basket having count(*) > 8)""",
    "frequent_itemsets": f"""with recursive {_BASKETS}, e as (select 0 as part, u, b, support as least from p, s), {_GROWN}
select items, cast(len(items) as int) as size, count(*) as n from o group by items""",
    "son_candidates": f"""with recursive {_BASKETS},
w as (select total, support, greatest(1, least(total // {BASKETS_A_PART}, support // {I.LEAST_SCALED})) as parts from s),
q as (select cast(('0x' || substr(md5(u), 1, 12)) as bigint) % parts as part, u, b, support, total from p, w),
l as (select part, greatest(1, ceil(any_value(support) * count(distinct u) / any_value(total)::double - 1e-9)) as least from q group by part),
e as (select q.part, u, b, least from q join l using (part)), {_GROWN}
select distinct items, cast(len(items) as int) as size from o""",
    "jaccard_pairs": f"with {_LARGE}, {_JACCARD} select * from j",
    "minhash_signature": f"with {V.EDGES}, {_signature('e')} select id, signature from g",
    "lsh_candidates": f"with {_BANDED} select * from c",
    "lsh_similar_pairs": f"with {_BANDED}, {_JACCARD} select j.* from j join c using (id_1, id_2)",
    "corated_pairs": f"""with {V.TRAIN} select x.b as item_1, y.b as item_2, count(*) as n
from ratings x join ratings y on x.u = y.u and x.b < y.b group by all having count(*) >= {CORATED}""",
    "pearson_similarity": f"with {_PEARSON} select i1 as item_1, i2 as item_2, n, round(w + 0.0, 6) as weight from w",
    "cf_predict": f"with {_PREDICT} select u as user, b as item, round(prediction, 6) as prediction, rated from cf",
    "rmse_error_histogram": f"""with {_PREDICT} select count(*) as n, round(sqrt(avg({_E} * {_E})), 6) as rmse,
{', '.join(f'count(*) filter (where {_E} >= {i} and {_E} < {i + 1}) as from_{i}' for i in range(4))},
count(*) filter (where {_E} >= 4) as from_4 from cf""",
    "gbt_features": f"""with {V.TARGETS}, {_FEATURES} select u as user, b as item, coalesce(ur, 0) as user_reviews,
round(coalesce(us, 2.5), 6) as user_stars, coalesce(br, 0) as item_reviews, round(coalesce(bs, 2.5), 6) as item_stars
from targets left join uf using (u) left join bf using (b)""",
    "hybrid_formula": f"""with {_PREDICT}, g as (select avg(s) as m from ratings), top as (select greatest(max(rated), 1) as t from cf)
select u as user, b as item, round(rated / t::double * prediction + (1 - rated / t::double) * m, 6) as prediction from cf, g, top""",
}
