"""Graph operators against plain algorithms on small graphs."""

import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from minegrove.operators import graph as G


def random_graph(seed, n=14, m=20):
    rng = random.Random(seed)
    every = list(combinations([f"v{i:02d}" for i in range(n)], 2))
    return sorted(rng.sample(every, m))


GRAPHS = {
    "random": random_graph(1),
    "sparse": random_graph(2, 20, 14),
    "chain": [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(17)],
    "two cliques": list(combinations("abcde", 2)) + list(combinations("vwxyz", 2)) + [("e", "v")],
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def components(edges, everyone=()):
    near = G.adjacency(edges)
    out, seen = [], set()
    for v in sorted(set(near) | set(everyone)):
        if v in seen:
            continue
        piece, waiting = {v}, [v]
        while waiting:
            for w in near[waiting.pop()]:
                if w not in piece:
                    piece.add(w)
                    waiting.append(w)
        seen |= piece
        out.append(piece)
    return out


def paths_betweenness(edges):
    """By listing all shortest paths of all pairs."""
    near = G.adjacency(edges)
    total = Counter({e: 0.0 for e in edges})
    for s, t in combinations(sorted(near), 2):
        paths, found = [[s]], []
        seen = {s}
        while paths and not found:
            longer = [[*p, w] for p in paths for w in near[p[-1]] if w not in seen]
            found = [p for p in longer if p[-1] == t]
            seen |= {p[-1] for p in longer}
            paths = longer
        for p in found:
            for a, b in zip(p, p[1:]):
                total[min(a, b), max(a, b)] += 1 / len(found)
    return dict(total)


def q_of(edges, parts):
    m, k = len(edges), Counter(v for e in edges for v in e)
    linked = set(edges)
    total = 0.0
    for part in parts:
        for a in part:
            for b in part:
                if a != b:
                    total += ((min(a, b), max(a, b)) in linked) - k[a] * k[b] / (2 * m)
    return total / (2 * m)


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    want = components(GRAPHS[name])
    for one_task in (1000, 1):
        got = defaultdict(set)
        for r in G.connected_components(frame(spark, GRAPHS[name]), one_task=one_task).collect():
            got[r["component"]].add(r["id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
        assert all(c == min(m) for c, m in got.items())


@pytest.mark.parametrize("name", GRAPHS)
def test_betweenness_both_ways(spark, name):
    want = paths_betweenness(GRAPHS[name])
    for limit in (10_000, 1):
        got = {(r["src"], r["dst"]): r["betweenness"] for r in G.edge_betweenness(frame(spark, GRAPHS[name]), broadcast_edges=limit).collect()}
        assert got == pytest.approx(want)


def textbook(edges):
    """Cut all edges of highest betweenness in the whole graph until none is left; the first best partition."""
    everyone = {v for e in edges for v in e}
    alive, best, best_q = list(edges), components(edges), q_of(edges, components(edges))
    while alive:
        between = paths_betweenness(alive)
        top = max(between.values())
        alive = [e for e in alive if between[e] < top - G.TIE]
        parts = components(alive, everyone)
        q = q_of(edges, parts)
        if q > best_q + 1e-12:
            best, best_q = parts, q
    return best, best_q


@pytest.mark.parametrize("name", ["random", "sparse", "two cliques"])
def test_girvan_newman(spark, name):
    labels, q, _ = G.girvan_newman(frame(spark, GRAPHS[name]))
    got = defaultdict(set)
    for r in labels.collect():
        got[r["label"]].add(r["id"])
    want, want_q = textbook(GRAPHS[name])
    assert q == pytest.approx(want_q)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    measured = G.modularity(frame(spark, GRAPHS[name]), labels).first()["q"]
    assert measured == pytest.approx(want_q)


def cut_in_the_whole(edges):
    """Each round's highest betweenness and the edges tied at it, the whole graph searched again."""
    alive, course = list(edges), []
    while alive:
        between = paths_betweenness(alive)
        top = max(between.values())
        course.append((top, sorted(e for e in alive if between[e] >= top - G.TIE)))
        alive = [e for e in alive if between[e] < top - G.TIE]
    return course


@pytest.mark.parametrize("small, flat", [(G.SMALL, G.FLAT), (0, G.FLAT), (0, 30)])
@pytest.mark.parametrize("seed", range(8))
def test_cuts_by_blocks_are_those_of_the_whole(monkeypatch, seed, small, flat):
    """Dense and sparse components, with path shares kept, without them, and searched from few sources at a time."""
    monkeypatch.setattr(G, "SMALL", small)
    monkeypatch.setattr(G, "FLAT", flat)
    graph = random_graph(seed, 12, 12 + 2 * seed)
    for piece in components(graph):
        own = [e for e in graph if e[0] in piece]
        course = G.component_cuts(own, len(graph))
        assert course[0][2] == []
        want = cut_in_the_whole(own)
        assert [cut for _, _, cut in course[1:]] == [cut for _, cut in want]
        assert [top for top, _, _ in course[1:]] == pytest.approx([top for top, _ in want])
        # the last part is that of single vertices, as nothing else holds together
        assert course[-1][1] == pytest.approx(0)


def test_arms_of_a_hub_are_cut_in_time():
    """Arms of 1 to 60 edges hang on a vertex: they go one by one, the longest first, and the rest is not searched again each time."""
    edges = []
    for length in range(1, 61):
        arm = [f"a{length:02d}-{i:02d}" for i in range(length)]
        edges += [(arm[0], "hub"), *zip(arm, arm[1:])]
    begun = time.process_time()
    course = G.component_cuts(edges, len(edges))
    assert time.process_time() - begun < 20
    assert [cut for _, _, cut in course[1:31]] == [[(f"a{60 - i:02d}-00", "hub")] for i in range(30)]
    assert [top for top, _, _ in course[1:4]] == [60 * 1771, 59 * 1712, 58 * 1654]
    assert sorted(e for _, _, cut in course for e in cut) == sorted(edges)


def test_components_are_dealt_to_several_tasks(spark):
    """Each component's course is work of its own, however few bytes they are."""
    from pyspark import TaskContext

    edges = [(f"{c}{i}", f"{c}{i + 1}") for c in "abcdefghijkl" for i in range(3)]
    plain = G.component_cuts
    task = spark.sparkContext.accumulator(0)
    seen = spark.sparkContext.accumulator(0)

    def noted(own, total):
        seen.add(1)
        task.add(1 << (8 * TaskContext.get().partitionId()))
        return plain(own, total)

    G.component_cuts = noted
    try:
        G.girvan_newman(frame(spark, edges))
    finally:
        G.component_cuts = plain
    made = [x for x in task.value.to_bytes(64, "little") if x]
    assert seen.value == 12 and len(made) > 1


@pytest.mark.parametrize("least", [1, 2, 3, 6])
@pytest.mark.parametrize("seed", range(3))
def test_cooccurrence_graph(spark, seed, least):
    """Against brute force, with an id and tokens that most rows have."""
    rng = random.Random(seed)
    sets = {f"u{i:02d}": {"t0"} | {f"t{int(12 * rng.random() ** 2)}" for _ in range(rng.randrange(0, 10))} for i in range(25)}
    sets["all"] = {f"t{i}" for i in range(12)} | {f"own{i}" for i in range(40)}
    pairs = spark.createDataFrame([(u, t) for u, own in sets.items() for t in sorted(own)], "id string, token string")
    got = [(r["src"], r["dst"]) for r in G.cooccurrence_graph(pairs, least).collect()]
    assert sorted(got) == [e for e in combinations(sorted(sets), 2) if len(sets[e[0]] & sets[e[1]]) >= least]


def test_a_large_component_is_refused(spark):
    with pytest.raises(ValueError):
        G.girvan_newman(frame(spark, GRAPHS["chain"]), component_edges=3)


def test_empty_graph(spark):
    empty = frame(spark, [])
    assert G.connected_components(empty).count() == 0
    assert G.label_propagation(empty, 2).count() == 0
    assert G.girvan_newman(empty)[0].count() == 0
    assert G.modularity(empty, empty.selectExpr("src as id", "dst as label")).first()["q"] == 0


def test_label_propagation(spark):
    edges = GRAPHS["two cliques"]
    near, labels = G.adjacency(edges), {v: v for e in edges for v in e}
    for _ in range(3):
        votes = {v: Counter(labels[w] for w in near[v]) for v in near}
        labels = {v: min(c, key=lambda x: (-c[x], x)) for v, c in votes.items()}
    for one_task in (1000, 1):
        got = {r["id"]: r["label"] for r in G.label_propagation(frame(spark, edges), 3, one_task=one_task).collect()}
        assert got == labels


def test_modularity_with_the_diagonal(spark):
    edges = GRAPHS["two cliques"]
    labels = spark.createDataFrame([(v, "l" if v < "m" else "r") for v in "abcdevwxyz"], "id string, label string")
    without = G.modularity(frame(spark, edges), labels).first()["q"]
    with_it = G.modularity(frame(spark, edges), labels, diagonal=True).first()["q"]
    k = Counter(v for e in edges for v in e)
    assert without - with_it == pytest.approx(sum(x * x for x in k.values()) / (2 * len(edges)) ** 2)


def test_communities_are_ordered(spark):
    labels = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), ("d", 3)], "id string, label int")
    assert [(r[0], r[1]) for r in G.communities(labels).collect()] == [(1, ["c"]), (1, ["d"]), (2, ["a", "b"])]


def test_members_are_ordered_without_case(spark):
    labels = spark.createDataFrame([("b", 1), ("A", 1), ("a", 1), ("C", 1)], "id string, label int")
    assert G.communities(labels).first()["members"] == ["A", "a", "b", "C"]


@pytest.mark.parametrize("seed", range(40))
def test_turns_are_those_of_the_whole_graph(seed):
    """Always the highest next cut of all components; sorted keys give the same rounds."""
    rng = random.Random(seed)
    lists = [[float(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 7))] for _ in range(rng.randrange(1, 5))]
    at, want = [0] * len(lists), []
    while any(at[c] < len(own) for c, own in enumerate(lists)):
        top = max(own[at[c]] for c, own in enumerate(lists) if at[c] < len(own))
        now = [c for c, own in enumerate(lists) if at[c] < len(own) and own[at[c]] == top]
        want.append({(c, at[c]) for c in now})
        for c in now:
            at[c] += 1
    keyed = defaultdict(set)
    for c, own in enumerate(lists):
        for i, key in enumerate(G._turns(own)):
            keyed[tuple(key)].add((c, i))
    assert [keyed[k] for k in sorted(keyed)] == want
