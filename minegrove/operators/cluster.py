"""Clustering by summaries: BFR over chunks of points.

Points are ``(id, features array<double>)``. A cluster is kept as count, sum and sum of
squares of each dimension, never as points.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def summaries(points: DataFrame, label: str | list[str], features: str = "features") -> DataFrame:
    """``(label, n, sum, sumsq)``: one summary a label; points without label or features don't count, null components add nothing.

    Vectors are added up whole, on the map side first, so a huge cluster is one row a task.
    """
    labels = [label] if isinstance(label, str) else label
    named = [F.col(c).alias("label" if len(labels) == 1 else c) for c in labels]
    vector = array_to_vector(F.transform(F.col(features).cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0))))
    rows = points.where(F.col(features).isNotNull()).select(*named, vector.alias("_v"))
    keys = [c for c in rows.columns if c != "_v"]
    rows = rows.dropna(subset=keys)
    made = rows.groupBy(*keys).agg(Summarizer.metrics("count", "sum", "normL2").summary(F.col("_v")).alias("_m"))
    squares = F.transform(vector_to_array("_m.normL2"), lambda x: x * x)
    return made.select(*keys, F.col("_m.count").alias("n"), vector_to_array("_m.sum").alias("sum"), squares.alias("sumsq"))


@dataclass
class Cluster:
    """Count, sum and sum of squares."""

    n: int
    sum: np.ndarray
    sumsq: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return self.sum / self.n

    @property
    def variance(self) -> np.ndarray:
        return np.maximum(self.sumsq / self.n - self.centre**2, 0.0)

    def plus(self, other: Cluster) -> Cluster:
        return Cluster(self.n + other.n, self.sum + other.sum, self.sumsq + other.sumsq)


def distances(points: np.ndarray, cluster: Cluster, by_variance: bool = False) -> np.ndarray:
    """Normalised distance of points to a cluster.

    A dimension without variance adds nothing to points that agree there, and makes
    others infinitely far. ``by_variance`` divides by the variance, not its root.
    """
    spread = cluster.variance if by_variance else np.sqrt(cluster.variance)
    difference = points - cluster.centre
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(difference == 0, 0.0, difference / spread)
    return np.sqrt((scaled**2).sum(axis=1))


@dataclass
class BfrResult:
    """Rows of ``rounds`` and ``assignments`` (id, cluster; -1 for points in no cluster)."""

    rounds: DataFrame
    assignments: DataFrame
    discarded: list[Cluster] = field(default_factory=list)


def read_summaries(df: DataFrame) -> dict[int, Cluster]:
    """Summaries of a few clusters, brought to the driver."""
    return {r["label"]: Cluster(r["n"], np.array(r["sum"]), np.array(r["sumsq"])) for r in df.collect()}


def _kmeans(points: DataFrame, k: int, seed: int, rounds: int = 20) -> DataFrame:
    """Points with ``label`` by k-means from random centres; materialised. The cache is let go when that is done."""
    vectors = points.withColumn("_v", array_to_vector("features")).persist()
    model = KMeans(k=k, seed=seed, initMode="random", featuresCol="_v", predictionCol="label", maxIter=rounds).fit(vectors)
    made = cut_lineage(model.transform(vectors).drop("_v"))
    vectors.unpersist()
    return made


def _choose(x: np.ndarray, clusters: dict[int, Cluster], limit: float, by_variance: bool) -> np.ndarray:
    """The nearest cluster of each point within ``limit``, else -1; of equally near ones the lesser name."""
    names = sorted(clusters)
    if not names or not len(x):
        return np.full(len(x), -1)
    d = np.stack([distances(x, clusters[c], by_variance) for c in names], axis=1)
    best = d.argmin(axis=1)
    return np.where(d[np.arange(len(x)), best] < limit, np.array(names)[best], -1)


def nearest(points: DataFrame, clusters: dict[int, Cluster], limit: float, by_variance: bool = False) -> DataFrame:
    """Points with ``label``, the nearest cluster within ``limit``, else null. The clusters are few and sent to all tasks."""
    placed = placed_by_summaries(points, clusters, {}, limit, by_variance)
    return placed.select(*points.columns, F.when(F.col("kind") == "ds", F.col("label")).alias("label"))


def placed_by_summaries(
    points: DataFrame, discard: dict[int, Cluster], compressed: dict[int, Cluster], limit: float, by_variance: bool = False
) -> DataFrame:
    """Points with ``kind`` and ``label``: the nearest discard cluster (``ds``) within ``limit``, else compressed one (``cs``), else ``rs`` and -1."""

    @F.pandas_udf("kind string, label int")
    def place(features: pd.Series) -> pd.DataFrame:
        x = np.stack(features.to_numpy()).astype(float) if len(features) else np.zeros((0, 0))
        label = _choose(x, discard, limit, by_variance)
        kind = np.where(label >= 0, "ds", "rs")
        rest = np.flatnonzero(label < 0)
        label[rest] = _choose(x[rest], compressed, limit, by_variance)
        kind[rest[label[rest] >= 0]] = "cs"
        return pd.DataFrame({"kind": kind, "label": label.astype("int32")})

    made = points.withColumn("_p", place("features"))
    return made.select(*points.columns, F.col("_p.kind").alias("kind"), F.col("_p.label").alias("label"))


class _Mergers:
    """Compressed clusters that lie within the limit of each other become one, the nearest two first; distances are kept."""

    def __init__(self, limit: float, by_variance: bool) -> None:
        self.limit, self.by_variance = limit, by_variance
        self.between: dict[tuple[int, int], float] = {}
        self.known: set[int] = set()

    def _add(self, name: int, clusters: dict[int, Cluster]) -> None:
        """Distances of a cluster to those known: the lesser of both directions."""
        others = sorted(self.known)
        if others:
            own = clusters[name]
            to_own = distances(np.stack([clusters[o].centre for o in others]), own, self.by_variance)
            for o, there in zip(others, to_own.tolist(), strict=True):
                d = min(there, distances(own.centre[None], clusters[o], self.by_variance)[0])
                if d < self.limit:
                    self.between[min(o, name), max(o, name)] = d
        self.known.add(name)

    def _forget(self, name: int) -> None:
        self.known.discard(name)
        self.between = {pair: d for pair, d in self.between.items() if name not in pair}

    def merge(self, clusters: dict[int, Cluster], changed: set[int], fresh: int) -> tuple[dict[int, int], int]:
        """What was merged into what, and the next fresh name. ``changed``: clusters whose summaries are new."""
        became: dict[int, int] = {}
        for name in sorted((self.known - set(clusters)) | changed):
            self._forget(name)
        for name in sorted(set(clusters) - self.known):
            self._add(name, clusters)
        while self.between:
            _, a, b = min((d, *pair) for pair, d in self.between.items())
            joined = clusters.pop(a).plus(clusters.pop(b))
            self._forget(a)
            self._forget(b)
            clusters[fresh] = joined
            self._add(fresh, clusters)
            became[a] = became[b] = fresh
            fresh += 1
        return became, fresh


def bfr(
    points: DataFrame,
    k: int,
    *,
    chunks: int = 5,
    seed: int = 7,
    first_factor: int = 5,
    least: int = 20,
    by_variance: bool = False,
) -> BfrResult:
    """BFR clustering into ``k`` clusters over ``chunks`` parts of the points, dealt by a hash of the id.

    Of the first part, members of small clusters (below ``least``, of ``first_factor`` * k)
    are set aside; k-means of the rest gives the discard set. What was set aside is
    clustered too: groups form the compression set, single points the retained set. Then
    each part is assigned by the summaries at its start: to the nearest discard cluster
    within 2 √d, else the nearest compressed one, else retained and clustered again.
    Compressed clusters within 2 √d of each other are merged, at the end into discard
    clusters too. Only summaries, at most a few hundred, come to the driver.

    Points without features are left out; repeated ids are points of their own. Fewer
    points than clusters give fewer clusters; an empty table gives none.
    """
    whole = points.select("id", F.col("features").cast("array<double>").alias("features")).where(F.col("features").isNotNull())
    dealt = cut_lineage(whole.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")))
    spark = points.sparkSession
    head = dealt.first()
    if head is None:
        return BfrResult(spark.range(0).selectExpr("cast(id as int) as round", "id as ds_points", "cast(id as int) as cs_clusters", "id as cs_points", "id as rs_points"), dealt.select("id", F.lit(-1).alias("cluster")))
    limit = 2 * float(np.sqrt(len(head["features"])))

    discard: dict[int, Cluster] = {}
    compressed: dict[int, Cluster] = {}
    became: dict[int, int] = {}  # compressed cluster -> the one it was merged into
    ended: dict[int, int] = {}  # compressed cluster -> discard cluster
    fresh = 0
    placed: list[DataFrame] = []  # (id, kind, label)
    rounds: list[tuple] = []
    retained, left = dealt.limit(0).select("id", "features"), 0

    mergers = _Mergers(limit, by_variance)
    changed: set[int] = set()

    def compress(rest: DataFrame, n: int) -> tuple[DataFrame, int]:
        """Groups of the ``n`` retained points become compressed clusters; the single ones come back."""
        nonlocal fresh
        if n < 3:
            return rest, n
        grouped = _kmeans(rest, min(first_factor * k, n - 1), seed, rounds=5)
        made = read_summaries(summaries(grouped, "label"))
        several = {c: fresh + i for i, c in enumerate(sorted(c for c, m in made.items() if m.n > 1))}
        if not several:
            return rest, n
        fresh += len(several)
        compressed.update({to: made[c] for c, to in several.items()})
        renamed = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])[F.col("label")]
        placed.append(grouped.select("id", F.lit("cs").alias("kind"), renamed.cast("int").alias("label")).where("label is not null"))
        single = grouped.where(~F.col("label").isin(*several)).select("id", "features")
        return single, sum(m.n for c, m in made.items() if c not in several)

    for chunk in range(chunks):
        part = dealt.where(F.col("chunk") == chunk).select("id", "features")
        if not discard:
            n = part.count()
            if not n:
                continue
            first = _kmeans(part, min(first_factor * k, n), seed) if n > 1 else part.withColumn("label", F.lit(0))
            sizes = {r["label"]: r["n"] for r in first.groupBy("label").agg(F.count("*").alias("n")).collect()}
            large = [c for c, m in sizes.items() if m >= least]
            rest, aside = (df.select("id", "features") for df in (first.where(F.col("label").isin(*large)), first.where(~F.col("label").isin(*large))))
            m = sum(sizes[c] for c in large)
            if m < k:  # too few points to tell outliers
                rest, aside, m = part, part.limit(0), n
            labelled = _kmeans(rest, min(k, m), seed) if m > 1 else rest.withColumn("label", F.lit(0))
            discard.update(read_summaries(summaries(labelled, "label")))
            placed.append(labelled.select("id", F.lit("ds").alias("kind"), "label"))
            retained, left = compress(aside, n - m)
        else:
            tried = cut_lineage(placed_by_summaries(part, discard, compressed, limit, by_variance))
            for r in summaries(tried.where("label >= 0"), ["kind", "label"]).collect():
                own = Cluster(r["n"], np.array(r["sum"]), np.array(r["sumsq"]))
                kept = discard if r["kind"] == "ds" else compressed
                kept[r["label"]] = kept[r["label"]].plus(own)
                if r["kind"] == "cs":
                    changed.add(r["label"])
            placed.append(tried.where("label >= 0").select("id", "kind", "label"))
            both = cut_lineage(retained.unionByName(tried.where("label < 0").select("id", "features")))
            retained, left = compress(both, both.count())
        merged, fresh = mergers.merge(compressed, changed, fresh)
        became.update(merged)
        changed.clear()
        if chunk == chunks - 1:
            for c in sorted(compressed):
                far = {d: distances(compressed[c].centre[None], discard[d], by_variance)[0] for d in discard}
                best = min(far, key=lambda d: (far[d], d))
                if far[best] < limit:
                    discard[best] = discard[best].plus(compressed[c])
                    ended[c] = best
            for c in ended:
                del compressed[c]
        rounds.append((chunk + 1, sum(c.n for c in discard.values()), len(compressed), sum(c.n for c in compressed.values()), left))

    def final(c: int) -> int:
        while c in became:
            c = became[c]
        return ended.get(c, -1)

    ends = spark.createDataFrame([("cs", c, final(c)) for c in range(fresh)] or [("cs", -1, -1)], "kind string, label int, cluster int")
    named = reduce(DataFrame.unionByName, placed).join(F.broadcast(ends), ["kind", "label"], "left")
    out = named.select("id", F.when(F.col("kind") == "ds", F.col("label")).otherwise(F.col("cluster")).alias("cluster"))
    out = out.unionByName(retained.select("id", F.lit(-1).alias("cluster")))
    table = spark.createDataFrame(
        [(a, int(b), c, int(d), int(e)) for a, b, c, d, e in rounds],
        "round int, ds_points bigint, cs_clusters int, cs_points bigint, rs_points bigint",
    )
    return BfrResult(table, out, [discard[c] for c in sorted(discard)])
