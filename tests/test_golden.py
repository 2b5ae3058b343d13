"""Published results, where their files are at hand: their paths come from the environment."""

import ast
import csv
import os
from collections import Counter, defaultdict

import pytest

from minegrove.operators import graph as G
from minegrove.operators import itemsets as I


def lines_of(variable):
    path = os.environ.get(variable)
    if not path:
        pytest.skip(f"{variable} is not set")
    with open(path, encoding="utf-8") as file:
        return file.read().splitlines()


@pytest.fixture(scope="module")
def scored(spark):
    """Edges with their published betweenness: lines ``('a', 'b'), score``."""
    scores = dict(ast.literal_eval(line) for line in lines_of("GOLDEN_BETWEENNESS"))
    return scores, spark.createDataFrame(sorted(scores), "src string, dst string")


def test_published_betweenness(scored):
    scores, edges = scored
    got = {(r["src"], r["dst"]): r["betweenness"] for r in G.edge_betweenness(edges).collect()}
    assert got == pytest.approx(scores, rel=1e-9)


def test_published_components(scored):
    """Lines of quoted members."""
    want = sorted(sorted(ast.literal_eval(f"[{line}]")) for line in lines_of("GOLDEN_COMPONENTS"))
    _, edges = scored
    got = defaultdict(list)
    for r in G.connected_components(edges).collect():
        got[r["component"]].append(r["id"])
    assert sorted(map(sorted, got.values())) == want


def test_communities_of_the_published_graph(scored):
    """The modularity told is that of the communities told, and above that of the components."""
    _, edges = scored
    labels, q, _ = G.girvan_newman(edges)
    assert G.modularity(edges, labels).first()["q"] == pytest.approx(q)
    components = G.connected_components(edges).withColumnRenamed("component", "label")
    assert q > G.modularity(edges, components).first()["q"]


def test_itemsets_of_published_pairs(spark):
    """A headed CSV of pairs, and ``case:support:n1,n2,...`` with the numbers of itemsets by size."""
    rows = list(csv.reader(lines_of("GOLDEN_PAIRS")))[1:]
    df = spark.createDataFrame([tuple(r[:2]) for r in rows], "user string, item string")
    for told in lines_of("GOLDEN_PAIRS_COUNTS"):
        case, support, counts = told.split(":")
        basket, item = ("user", "item") if case == "1" else ("item", "user")
        found = I.frequent_itemsets(I.baskets(df, basket, item), int(support)).collect()
        want = {i + 1: int(n) for i, n in enumerate(counts.split(",")) if int(n)}
        assert dict(Counter(r["size"] for r in found)) == want
