"""Reports in the formats that readers of review-mining results expect.

Each is a DataFrame of finished lines or columns, written by executors; a small
report may be coalesced to one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(column: str) -> Column:
    return F.concat(F.lit("'"), F.col(column), F.lit("'"))


def json_report(**parts: DataFrame) -> DataFrame:
    """One row ``value``: a JSON object. A one-row part with one column is a scalar, another a list of arrays.

    For reports: each part, such as a top-k list, must be small.
    """
    out = None
    for name, df in parts.items():
        if len(df.columns) == 1:
            cell = df.agg(F.first(df.columns[0]).alias(name))
        else:
            row = F.array(*[F.col(c).cast("string") for c in df.columns])
            numbered = df.withColumn("_i", F.monotonically_increasing_id())
            cell = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", row.alias("r")))), lambda x: x["r"]).alias(name))
        out = cell if out is None else out.crossJoin(F.broadcast(cell))  # one row each
    return out.select(F.to_json(F.struct(*parts)).alias("value"))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """``(size, line)`` of an itemset report: singles as ``('x')``, members and sets ordered as strings."""
    member = F.array_sort(F.transform("items", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))))
    text = F.concat(F.lit("("), F.array_join(member, ", "), F.lit(")"))
    return (
        itemsets.select("size", text.alias("_t"))
        .groupBy("size")
        .agg(F.array_join(F.array_sort(F.collect_list("_t")), ",").alias("line"))
        .orderBy("size")
    )


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``line``: the candidates of the first pass and the frequent itemsets, each under its heading, a line a size."""
    spark, made = candidates.sparkSession, None
    for section, (heading, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        head = spark.createDataFrame([(section, 0, heading)], "section int, size int, line string")
        lines = head.unionByName(itemset_lines(sets).select(F.lit(section).alias("section"), "size", "line"))
        made = lines if made is None else made.unionByName(lines)
    return made.orderBy("section", "size").select("line")


def community_lines(communities: DataFrame) -> DataFrame:
    """``line``: a community a line, members quoted; input ordered by size and members."""
    member = F.transform("members", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'")))
    return communities.orderBy("size", "members").select(F.array_join(member, ", ").alias("line"))


def betweenness_lines(betweenness: DataFrame) -> DataFrame:
    """``line``: ``('a', 'b'), score``, by falling score, then pair."""
    pair = F.concat(F.lit("("), quoted("src"), F.lit(", "), quoted("dst"), F.lit("), "), F.col("betweenness").cast("string"))
    return betweenness.orderBy(F.desc("betweenness"), "src", "dst").select(pair.alias("line"))


def reservoir_lines(reservoir: DataFrame, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """``(seqnum, 0_id, 20_id, …)`` after each batch."""
    picked = reservoir.where(F.col("slot").isin(*slots)).groupBy("batch", "n")
    held = [F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"{s}_id") for s in slots]
    return picked.agg(*held).orderBy("n").select(F.col("n").alias("seqnum"), *[f"{s}_id" for s in slots])


def write_csv(df: DataFrame, path: str, *, line_end: str = "\n", one_file: bool = False) -> None:
    """CSV with a header, unquoted unless a value needs it."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, lineSep=line_end)


def write_lines(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").text(path)
