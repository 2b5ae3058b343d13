"""Rating prediction: item-based filtering, boosted trees, and their blend."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .similarity import overlap_pairs


def mean_ratings(df: DataFrame) -> DataFrame:
    """One rating for each ``(user, item)``, the mean; rows lacking any of the three don't count."""
    whole = df.where(F.col("user").isNotNull() & F.col("item").isNotNull() & F.col("stars").isNotNull())
    return whole.groupBy("user", "item").agg(F.avg("stars").alias("stars"))


def corated_items(ratings: DataFrame, least: int) -> DataFrame:
    """``(item_1 < item_2, n)`` for pairs of items that ``least`` or more users rated both."""
    pairs = ratings.select(F.col("item").alias("id"), F.col("user").alias("token"))
    return overlap_pairs(pairs, least).select(
        F.col("id_1").alias("item_1"), F.col("id_2").alias("item_2"), F.col("overlap").alias("n")
    )


def pearson(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(item_1, item_2, n, weight)``: correlation over users who rated both, each item centred on them.

    0 where either item has no variance among those users. Means come first and
    products are centred, so nothing cancels.
    """
    one = ratings.select(F.col("item").alias("item_1"), "user", F.col("stars").alias("x"))
    two = ratings.select(F.col("item").alias("item_2"), "user", F.col("stars").alias("y"))
    both = pairs.select("item_1", "item_2").join(one, "item_1").join(two, ["item_2", "user"])
    means = both.groupBy("item_1", "item_2").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = (
        both.join(means, ["item_1", "item_2"])
        .groupBy("item_1", "item_2", "n")
        .agg(F.sum(dx * dy).alias("sxy"), F.sum(dx * dx).alias("sxx"), F.sum(dy * dy).alias("syy"))
    )
    flat = (F.col("sxx") < 1e-12) | (F.col("syy") < 1e-12)
    return sums.select(
        "item_1", "item_2", "n", F.when(flat, 0.0).otherwise(F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("weight")
    )


def predict_by_items(
    ratings: DataFrame, targets: DataFrame, weights: DataFrame, *, neighbours: int = 50, default: float = 0.0
) -> DataFrame:
    """``(user, item, prediction, rated)`` for distinct targets.

    The user's ratings of the ``neighbours`` items most like the target (weight above 0;
    of equals the lesser item), averaged by weight; without such items the item's
    average. An unknown item takes the user's average, an unknown user the item's, and
    where both are unknown ``default``. ``rated``: how many ratings the user has.
    """
    wanted = targets.select("user", "item").distinct()
    users = ratings.groupBy("user").agg(F.avg("stars").alias("user_mean"), F.count("*").alias("rated"))
    items = ratings.groupBy("item").agg(F.avg("stars").alias("item_mean"))
    positive = weights.where(F.col("weight") > 1e-9)
    both_ways = positive.select(F.col("item_1").alias("item"), F.col("item_2").alias("other"), "weight").unionByName(
        positive.select(F.col("item_2").alias("item"), F.col("item_1").alias("other"), "weight")
    )
    rated = ratings.select("user", F.col("item").alias("other"), "stars")
    near = wanted.join(both_ways, "item").join(rated, ["user", "other"])
    order = W.partitionBy("user", "item").orderBy(F.desc("weight"), F.asc("other"))
    summed = (
        near.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= neighbours)
        .groupBy("user", "item")
        .agg((F.sum(F.col("weight") * F.col("stars")) / F.sum("weight")).alias("weighted"))
    )
    joined = (
        wanted.join(summed, ["user", "item"], "left").join(users, "user", "left").join(items, "item", "left")
    )
    known = F.when(
        F.col("user_mean").isNotNull() & F.col("item_mean").isNotNull(), F.coalesce("weighted", "item_mean")
    ).otherwise(F.coalesce("user_mean", "item_mean", F.lit(default)))
    return joined.select("user", "item", known.alias("prediction"), F.coalesce("rated", F.lit(0)).alias("rated"))


def rating_features(pairs: DataFrame, users: DataFrame, items: DataFrame, *, missing_stars: float = 2.5) -> DataFrame:
    """``pairs`` with user_reviews, user_stars, item_reviews, item_stars; unknown ones are 0 and ``missing_stars``.

    A user or item with several rows is taken once: the most reviews, the mean of its stars.
    """
    u = users.groupBy("user").agg(F.max("reviews").alias("user_reviews"), F.avg("stars").alias("user_stars"))
    i = items.groupBy("item").agg(F.max("reviews").alias("item_reviews"), F.avg("stars").alias("item_stars"))
    joined = pairs.join(u, "user", "left").join(i, "item", "left")
    return joined.withColumns(
        {
            "user_reviews": F.coalesce("user_reviews", F.lit(0)),
            "user_stars": F.coalesce("user_stars", F.lit(missing_stars)),
            "item_reviews": F.coalesce("item_reviews", F.lit(0)),
            "item_stars": F.coalesce("item_stars", F.lit(missing_stars)),
        }
    )


FEATURES = ("user_reviews", "user_stars", "item_reviews", "item_stars")


def predict_by_trees(
    train: DataFrame, test: DataFrame, *, depth: int = 10, trees: int = 100, rate: float = 0.1, seed: int = 7
) -> DataFrame:
    """``test`` with ``prediction``, by gradient-boosted trees over the rating features. Fitted on all of ``train``.

    The lineage of the residuals, which grows by a tree, is cut every ten in the shared folder.
    """
    ensure_checkpoint_dir(train.sparkSession)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    learner = GBTRegressor(
        featuresCol="features", labelCol="stars", maxDepth=depth, maxIter=trees, stepSize=rate, seed=seed, cacheNodeIds=True, checkpointInterval=10
    )
    model = learner.fit(assemble.transform(train))
    return model.transform(assemble.transform(test)).drop("features")


def blend(by_items: DataFrame, by_model: DataFrame) -> DataFrame:
    """``(user, item, prediction)``: the item-based prediction weighs rated / max(rated), the model's the rest."""
    top = by_items.agg(F.greatest(F.max("rated"), F.lit(1)).alias("_top"))
    one = by_items.select("user", "item", F.col("prediction").alias("_a"), "rated")
    two = by_model.select("user", "item", F.col("prediction").alias("_b"))
    alpha = F.col("rated") / F.col("_top")
    return (
        one.join(two, ["user", "item"])
        .crossJoin(F.broadcast(top))  # one row
        .select("user", "item", (alpha * F.col("_a") + (1 - alpha) * F.col("_b")).alias("prediction"))
    )
