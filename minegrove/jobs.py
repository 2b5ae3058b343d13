"""Whole jobs from files to reports; ``python -m minegrove JOB --help`` runs them.

Each reads its inputs with stated schemas, declares one plan and writes its report
from the executors. Reports that are lists for people are written as one file.
"""

from __future__ import annotations

import json
import time
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.ids import clean_id
from .operators import cluster, graph, itemsets, recommend, relational, similarity, sketches
from .session import cut_lineage
from .sources import files


def _reviews(spark: SparkSession, path: str) -> DataFrame:
    return files.json_lines(spark, path, files.REVIEWS)


def _ratings(spark: SparkSession, path: str) -> DataFrame:
    rows = files.headed_csv(spark, path, files.RATINGS)
    return recommend.mean_ratings(
        rows.select(clean_id("user_id").alias("user"), clean_id("business_id").alias("item"), "stars")
    )


def explore(spark: SparkSession, reviews: str, out: str, *, year: str = "2018", k: int = 10) -> None:
    """Counts, distinct users and businesses, and the top ten of both, as one JSON object."""
    rows = _reviews(spark, reviews)
    summary = relational.review_summary(rows, user="user_id", item="business_id", date="date", year=year)
    parts = {c: summary.select(c) for c in summary.columns}
    parts |= {
        "top_users": relational.top_k(rows, "user_id", k),
        "top_businesses": relational.top_k(rows, "business_id", k),
    }
    sinks.write_lines(sinks.json_report(**parts), out, one_file=True)


def partitions(spark: SparkSession, reviews: str, out: str, *, buckets: int = 10) -> None:
    """Rows of each partition and the time of a top-k, as read and after placing by first letter; one JSON object."""
    rows = _reviews(spark, reviews).select("business_id")

    def profile(df: DataFrame, n: int) -> dict:
        items = [r["n"] for r in relational.partition_rows(df, n).orderBy("partition").collect()]
        begun = time.perf_counter()
        relational.top_k(df, "business_id", 10).collect()
        return {"n_partition": n, "n_items": items, "seconds": round(time.perf_counter() - begun, 3)}

    placed = relational.repartition_by_first_letter(rows, "business_id", buckets)
    report = {"default": profile(rows, rows.rdd.getNumPartitions()), "customized": profile(placed, buckets)}
    sinks.write_lines(spark.createDataFrame([(json.dumps(report),)], "value string"), out, one_file=True)


def cities(spark: SparkSession, reviews: str, businesses: str, out: str) -> None:
    """``city,stars`` by falling average."""
    places = files.json_lines(spark, businesses, files.BUSINESSES)
    averages = relational.average_by_group(_reviews(spark, reviews), places, key="business_id", value="stars", group="city")
    sinks.write_csv(averages.select("city", "stars"), out, line_end="\r", one_file=True)


def city_timings(spark: SparkSession, reviews: str, businesses: str, out: str, *, k: int = 10) -> None:
    """Seconds to the best cities by sorting on the driver (m1) and by a distributed top-k (m2); one JSON object.

    Sorting on the driver brings all averages there, one a city; the top-k brings ``k`` of each task.
    """
    places = files.json_lines(spark, businesses, files.BUSINESSES)
    averages = relational.average_by_group(_reviews(spark, reviews), places, key="business_id", value="stars", group="city")
    begun = time.perf_counter()
    one = sorted(averages.collect(), key=lambda r: (-r["stars"], r["city"]))[:k]
    between = time.perf_counter()
    two = averages.limit(k).collect()
    report = {"m1": between - begun, "m2": time.perf_counter() - between, "same": one == two}
    sinks.write_lines(spark.createDataFrame([(json.dumps(report),)], "value string"), out, one_file=True)


def _itemset_report(pairs: DataFrame, support: int, out: str) -> None:
    pairs = cut_lineage(pairs)
    candidates = itemsets.son_candidates(pairs, support, pairs.select("basket").distinct().count())
    sinks.write_lines(sinks.itemset_report(candidates, itemsets.frequent_itemsets(pairs, support)), out, one_file=True)


def frequent(spark: SparkSession, pairs: str, out: str, *, support: int, case: int = 1) -> None:
    """Candidate and frequent itemsets of users' businesses (case 1) or businesses' users (case 2), a line a size."""
    rows = files.headed_csv(spark, pairs, files.PAIRS)
    basket, item = ("user_id", "business_id") if case == 1 else ("business_id", "user_id")
    _itemset_report(itemsets.baskets(rows, basket, item), support, out)


def frequent_products(spark: SparkSession, transactions: str, out: str, *, support: int, more_than: int = 0) -> None:
    """Candidate and frequent sets of products in a customer's day, of days with more than so many products."""
    rows = files.quoted_transactions(spark, transactions)
    _itemset_report(itemsets.baskets(rows, "basket", "item", more_than=more_than), support, out)


def similar(spark: SparkSession, ratings: str, out: str, *, threshold: str = "1/2") -> None:
    """``business_id_1,business_id_2,similarity`` of businesses with similar users, found by MinHash and verified."""
    rows = files.headed_csv(spark, ratings, files.RATINGS)
    pairs = similarity.distinct_pairs(rows, "business_id", "user_id")
    family = similarity.HashFamily()
    candidates = similarity.lsh_candidates(similarity.minhash_signatures(pairs, family), 10, similarity.band_rows(family.size, 10))
    found = similarity.verify_jaccard(candidates, pairs, Fraction(threshold))
    named = found.select(F.col("id_1").alias("business_id_1"), F.col("id_2").alias("business_id_2"), "similarity")
    sinks.write_csv(named.orderBy("business_id_1", "business_id_2"), out)


def _predictions(df: DataFrame, out: str) -> None:
    named = df.select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), "prediction")
    sinks.write_csv(named, out)


def _by_items(train: DataFrame, test: DataFrame, corated: int, default: float) -> DataFrame:
    weights = recommend.pearson(train, recommend.corated_items(train, corated))
    return recommend.predict_by_items(train, test, weights, default=default)


def _by_model(spark: SparkSession, train: DataFrame, test: DataFrame, users: str, businesses: str, trees: int, depth: int) -> DataFrame:
    u = files.json_lines(spark, users, files.USERS).select(
        F.col("user_id").alias("user"), F.col("review_count").alias("reviews"), F.col("average_stars").alias("stars")
    )
    b = files.json_lines(spark, businesses, files.BUSINESSES).select(F.col("business_id").alias("item"), F.col("review_count").alias("reviews"), "stars")
    made = recommend.rating_features(train, u, b), recommend.rating_features(test.select("user", "item"), u, b)
    return recommend.predict_by_trees(*made, trees=trees, depth=depth)


def predict_items(spark: SparkSession, train: str, test: str, out: str, *, corated: int = 300, default: float = 0.0) -> None:
    """``user_id,business_id,prediction`` from similar businesses."""
    wanted = files.headed_csv(spark, test, files.PAIRS).select(F.col("user_id").alias("user"), F.col("business_id").alias("item"))
    _predictions(_by_items(_ratings(spark, train), wanted, corated, default), out)


def predict_model(spark: SparkSession, train: str, test: str, users: str, businesses: str, out: str, *, trees: int = 100, depth: int = 10) -> None:
    """``user_id,business_id,prediction`` by boosted trees."""
    wanted = files.headed_csv(spark, test, files.PAIRS).select(F.col("user_id").alias("user"), F.col("business_id").alias("item"))
    _predictions(_by_model(spark, _ratings(spark, train), wanted.distinct(), users, businesses, trees, depth), out)


def predict_both(
    spark: SparkSession, train: str, test: str, users: str, businesses: str, out: str, *, corated: int = 200, trees: int = 100, depth: int = 10
) -> None:
    """``user_id,business_id,prediction``: both blended."""
    rated = _ratings(spark, train)
    wanted = files.headed_csv(spark, test, files.PAIRS).select(F.col("user_id").alias("user"), F.col("business_id").alias("item"))
    model = _by_model(spark, rated, wanted.distinct(), users, businesses, trees, depth)
    _predictions(recommend.blend(_by_items(rated, wanted, corated, 2.5), model), out)


def evaluate(spark: SparkSession, predictions: str, truth: str, out: str) -> None:
    """RMSE and histogram of absolute errors, as one JSON object."""
    p = spark.read.csv(predictions, header=True, schema="user_id string, business_id string, prediction double")
    t = files.headed_csv(spark, truth, files.RATINGS)
    report = relational.error_report(p, t, ["user_id", "business_id"], predicted="prediction", actual="stars")
    sinks.write_lines(report.select(F.to_json(F.struct(*report.columns)).alias("value")), out, one_file=True)


def _user_graph(spark: SparkSession, pairs: str, least: int) -> DataFrame:
    rows = files.headed_csv(spark, pairs, files.PAIRS)
    return graph.cooccurrence_graph(similarity.distinct_pairs(rows, "user_id", "business_id"), least)


def propagate(spark: SparkSession, pairs: str, out: str, *, least: int, rounds: int = 5) -> None:
    """Communities by label propagation, a line each."""
    labels = graph.label_propagation(_user_graph(spark, pairs, least), rounds)
    sinks.write_lines(sinks.community_lines(graph.communities(labels)), out, one_file=True)


def betweenness(spark: SparkSession, pairs: str, out: str, communities: str, *, least: int) -> None:
    """Edges by falling betweenness, and the communities of highest modularity."""
    edges = _user_graph(spark, pairs, least)
    sinks.write_lines(sinks.betweenness_lines(graph.edge_betweenness(edges)), out, one_file=True)
    labels, _, _ = graph.girvan_newman(edges)
    sinks.write_lines(sinks.community_lines(graph.communities(labels)), communities, one_file=True)


def bloom(spark: SparkSession, ids: str, out: str, *, batches: int = 30, size: int = 100, seed: int = 0) -> None:
    """``Time,FPR`` of a Bloom filter over drawn batches, from 0."""
    stream = files.sampled_batches(files.id_lines(spark, ids), batches, size, seed)
    rates = sketches.bloom_rates(stream).orderBy("batch")
    sinks.write_csv(rates.select((F.col("batch") - 1).alias("Time"), F.col("fpr").alias("FPR")), out, one_file=True)


def distinct(spark: SparkSession, ids: str, out: str, *, batches: int = 30, size: int = 300, seed: int = 0) -> None:
    """``Time,Ground Truth,Estimation`` of distinct ids in drawn batches, from 0."""
    stream = files.sampled_batches(files.id_lines(spark, ids), batches, size, seed)
    made = sketches.distinct_estimates(stream).orderBy("batch")
    named = made.select((F.col("batch") - 1).alias("Time"), F.col("truth").alias("Ground Truth"), F.col("estimate").alias("Estimation"))
    sinks.write_csv(named, out, one_file=True)


def reservoir(spark: SparkSession, ids: str, out: str, *, batches: int = 30, size: int = 100, slots: int = 100, seed: int = 0) -> None:
    """``seqnum,0_id,20_id,…`` of a reservoir after each drawn batch."""
    stream = files.sampled_batches(files.id_lines(spark, ids), batches, size, seed)
    sinks.write_csv(sinks.reservoir_lines(sketches.reservoir(stream, slots)), out, one_file=True)


def bfr(spark: SparkSession, points: str, rounds: str, out: str, *, clusters: int) -> None:
    """Counters of each round, and ``id,cluster`` of each point."""
    made = cluster.bfr(files.points_csv(spark, points), clusters)
    sinks.write_csv(made.rounds.orderBy("round"), rounds, one_file=True)
    sinks.write_csv(made.assignments.orderBy("id"), out)


JOBS = {
    f.__name__.replace("_", "-"): f
    for f in (
        explore,
        partitions,
        cities,
        city_timings,
        frequent,
        frequent_products,
        similar,
        predict_items,
        predict_model,
        predict_both,
        evaluate,
        propagate,
        betweenness,
        bloom,
        distinct,
        reservoir,
        bfr,
    )
}
