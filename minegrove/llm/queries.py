"""Queries p2, p3, p5, p6, p7 and p8 over the test tables, and their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..sources import table
from .bpe import DEFAULT_VOCABULARY, encode_texts
from .cooccur import pair_counts
from .heavy import frequent_values
from .leaks import find_leaks
from .sentences import learn_names, split_sentences
from .setjoin import SimilarSets
from .sql import SQL

__all__ = ["QUERIES", "SQL"]


def _pairs_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select(
        clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id")
    )


def _business_sets(spark: SparkSession, d: str) -> SimilarSets:
    return SimilarSets(
        _pairs_table(spark, d, "yelp_train"), "business_id", "user_id", threshold=Fraction(1, 2), min_size=5
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of businesses that share at least half of their users."""
    return (
        _business_sets(spark, d)
        .pairs()
        .select(F.col("id_1").alias("business_id_1"), F.col("id_2").alias("business_id_2"))
    )


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every business of five users or more: its class of equal sets, and the links of that class."""
    made = _business_sets(spark, d)
    ends = made.links().select(F.explode(F.array("id_1", "id_2")).alias("class_id"))
    counted = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    return (
        made.classes()
        .join(counted, "class_id", "left")
        .select(
            F.col("id").alias("business_id"),
            "class_id",
            F.col("size").alias("users"),
            F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        )
    )


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return pair_counts(
        _pairs_table(spark, d, "small2"),
        "user_id",
        "business_id",
        min_count=5,
        min_share=Fraction(5, 1000),
        min_lift=Fraction(5, 2),
    ).withColumnsRenamed({"item_1": "business_id_1", "item_2": "business_id_2"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of businesses in many baskets together, far more than by chance."""
    return _scored(spark, d).select("business_id_1", "business_id_2")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their counts, lift and conviction."""
    return _scored(spark, d).select(
        "business_id_1",
        "business_id_2",
        "n1",
        "n2",
        "n12",
        "baskets",
        F.round("lift", 6).alias("lift"),
        F.round("conviction", 6).alias("conviction"),
    )


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    return frequent_values(_pairs_table(spark, d, "review"), ("business_id", "user_id"), share=(1, 100))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Users and businesses with at least 1 % of the rows of review that have the field."""
    return _frequent(spark, d).select("field", "key_value")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same with exact counts, and whether the first pass's bounds held them."""
    return _frequent(spark, d).select(
        "field", "key_value", "n", "total", F.col("n").between(F.col("lower"), F.col("upper")).alias("within_bounds")
    )


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, d, "documents"), vocabulary=DEFAULT_VOCABULARY)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), length=50)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the held-out items of which they hold a passage."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """The longest leaked passage of each, and where it lies in the document's own text."""
    return _leaks(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document."""
    documents = table(spark, d, "documents")
    return split_sentences(documents, learned=learn_names(documents))


QUERIES = {
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p8_found": p8_found,
}
