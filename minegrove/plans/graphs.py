"""Queries on the graph of users that went to the same businesses, and on clusters of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as B
from ..operators import graph as G
from ..session import cut_lineage
from ..sources import table
from . import views as V

SHARED = 5
CLOSELY = 6
ROUNDS = 5


def _graph(spark: SparkSession, d: str, least: int = SHARED) -> DataFrame:
    return G.cooccurrence_graph(V.items_of_users(spark, d), least)


def cooccurrence_graph(spark: SparkSession, d: str) -> DataFrame:
    """Users with five businesses or more in common."""
    return _graph(spark, d)


def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Communities of that graph after five rounds."""
    return G.label_propagation(_graph(spark, d), ROUNDS)


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Its components, named by their least user."""
    return G.connected_components(_graph(spark, d))


def modularity(spark: SparkSession, d: str) -> DataFrame:
    """The modularity of its components."""
    edges = cut_lineage(_graph(spark, d))
    labels = G.connected_components(edges).withColumnRenamed("component", "label")
    return G.modularity(edges, labels).select(F.round("q", 9).alias("q"))


def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness of edges between users with six businesses or more in common."""
    return G.edge_betweenness(_graph(spark, d, CLOSELY)).withColumn("betweenness", F.round("betweenness", 6))


def girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    """Communities of highest modularity of that graph."""
    return G.girvan_newman(_graph(spark, d, CLOSELY))[0]


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("features"))


def bfr_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Count, sums and sums of squares of the embeddings of each label."""
    made = B.summaries(_points(spark, d), "label")
    rounded = {c: F.transform(c, lambda x: F.round(x, 4)) for c in ("sum", "sumsq")}
    return made.withColumns(rounded)


def bfr_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The label whose embeddings' summary is nearest to each embedding, within twice the root of the dimensions."""
    points = _points(spark, d)
    clusters = B.read_summaries(B.summaries(points, "label"))  # one a label
    dimensions = len(next(iter(clusters.values())).sum) if clusters else 0
    return B.nearest(points.drop("label").where("features is not null"), clusters, 2 * dimensions**0.5).select("id", "label")


def bfr_rounds(spark: SparkSession, d: str) -> DataFrame:
    """How clustering the embeddings by summaries went, chunk by chunk."""
    return B.bfr(_points(spark, d), 10, least=5).rounds


def bfr_assignments(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of each embedding; -1 for outliers."""
    return B.bfr(_points(spark, d), 10, least=5).assignments


QUERIES = {
    f.__name__: f
    for f in (
        cooccurrence_graph,
        label_propagation,
        connected_components,
        modularity,
        edge_betweenness,
        girvan_newman,
        bfr_summaries,
        bfr_nearest,
        bfr_rounds,
        bfr_assignments,
    )
}



def _graph_sql(least: int) -> str:
    return f"""{V.EDGES},
g as (select x.u as src, y.u as dst from e x join e y on x.b = y.b and x.u < y.u group by all having count(*) >= {least}),
l as (select src as a, dst as b from g union all select dst, src from g)"""


_GRAPH = _graph_sql(SHARED)


def _propagation() -> str:
    steps = ["p0 as (select distinct a as id, a as label from l)"]
    for i in range(1, ROUNDS + 1):
        steps.append(
            f"""p{i} as (select id, label from (select l.b as id, label,
row_number() over (partition by l.b order by count(*) desc, label) as k from l join p{i - 1} p on p.id = l.a group by l.b, label) where k = 1)"""
        )
    return ", ".join(steps)


_COMPONENTS = """r as (select distinct a as id, a as component from l union select l.b, r.component from r join l on l.a = r.id),
c as (select id, min(component) as component from r group by id)"""

SQL = {
    "cooccurrence_graph": f"with {_GRAPH} select src, dst from g",
    "label_propagation": f"with {_GRAPH}, {_propagation()} select id, label from p{ROUNDS}",
    "connected_components": f"with recursive {_GRAPH}, {_COMPONENTS} select id, component from c",
    "modularity": f"""with recursive {_GRAPH}, {_COMPONENTS},
k as (select a as id, count(*)::double as k from l group by a), m as (select count(*)::double as m from g),
s as (select component, sum(k) as sk, sum(k * k) as skk from k join c using (id) group by component),
i as (select component, count(*) as e from g join c on c.id = src group by component)
select coalesce(round(sum((2 * coalesce(e, 0) - (sk * sk - skk) / (2 * m)) / (2 * m)), 9), 0.0) as q from s left join i using (component), m""",
    # of all shortest paths from s to t, those over the edge a - b
    "edge_betweenness": f"""with recursive {_graph_sql(CLOSELY)},
w as (select distinct a as s, a as v, 0 as d from l union select s, l.b, d + 1 from w join l on l.a = w.v where d < 40),
t as (select s, v, min(d) as d from w group by s, v),
p as (select s, v, d, 1.0::double as n from t where d = 0
  union all select t.s, t.v, t.d, sum(p.n) from p join l on l.a = p.v join t on t.s = p.s and t.v = l.b and t.d = p.d + 1 group by t.s, t.v, t.d),
x as (select least(l.a, l.b) as src, greatest(l.a, l.b) as dst, i.n * o.n / w.n as part
  from l join p i on i.v = l.a join p o on o.s = l.b join p w on w.s = i.s and w.v = o.v and w.d = i.d + 1 + o.d)
select src, dst, round(sum(part) / 2, 6) as betweenness from x group by src, dst""",
    "bfr_nearest": """with f as (select vec_id as id, label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
c as (select label, i, avg(x) as m, sqrt(greatest(sum(x * x) / count(*) - (sum(x) / count(*)) ** 2, 0)) as sd from f where label is not null group by label, i),
d as (select id, c.label, count(*) as dims, sqrt(sum(case when x = m then 0 else ((x - m) / sd) ** 2 end)) as far from f join c using (i) group by id, c.label),
k as (select *, row_number() over (partition by id order by far, label) as k from d)
select id, case when far < 2 * sqrt(dims) then cast(label as int) end as label from k where k = 1""",
    "bfr_summaries": """with f as (select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
d as (select label, i, count(*) as n, sum(x) as s, sum(x * x) as q from f group by label, i)
select label, any_value(n) as n, list(round(s, 4) order by i) as sum, list(round(q, 4) order by i) as sumsq from d group by label""",
}
