"""Graphs: co-occurrence, label propagation, components, betweenness, modularity communities.

A graph is a DataFrame of edges ``(src < dst)``, each once. Loops cut their lineage in
the shared checkpoint folder.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..session import cut_lineage, shuffle_width

#: Betweenness within this of the highest is tied with it; where that is above 1000, within this part of a thousandth of it.
TIE = 1e-9
#: Blocks of no more vertices squared times edges keep their path shares; searches from several sources at once hold so many numbers.
SMALL, FLAT = 20_000, 2_000_000
#: A graph of no more edges is searched in one task, with the same result: rounds of joins would cost more than they share out.
ONE_TASK_EDGES = 200_000


def cooccurrence_graph(pairs: DataFrame, least: int) -> DataFrame:
    """Edges between ids that share at least ``least`` tokens; ids without an edge are no vertices.

    ``pairs``: distinct ``(id, token)``. With all tokens in one order by their frequency, the
    rarest of ``least`` shared tokens is not among the ``least`` - 1 most frequent ones of
    either id. So ids of fewer tokens are left out, the others meet on all but those
    tokens, and the pairs that met are counted whole, over the tokens of the lesser one.
    """
    sizes = pairs.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    sized = pairs.join(sizes, "id")
    frequency = sized.groupBy("token").agg(F.count("*").alias("_f"))
    large = cut_lineage(sized.join(frequency, "token").select("id", "token", "_n", "_f"))
    order = W.partitionBy("id").orderBy(F.desc("_f"), F.desc("token"))
    frequent = large.withColumn("_r", F.row_number().over(order)).where(F.col("_r") < least).select("id", "token")
    rare = cut_lineage(large.where("_f > 1").join(frequent, ["id", "token"], "left_anti").select("id", "token", "_n"))
    a = rare.select("token", F.col("id").alias("id_1"), F.col("_n").alias("_n1"))
    b = rare.select("token", F.col("id").alias("id_2"), F.col("_n").alias("_n2"))
    lesser = F.col("_n1") <= F.col("_n2")
    met = a.join(b, "token").where(F.col("id_1") < F.col("id_2"))
    ends = met.select(F.when(lesser, F.col("id_1")).otherwise(F.col("id_2")).alias("few"), F.when(lesser, F.col("id_2")).otherwise(F.col("id_1")).alias("many"))
    told = ends.distinct().join(large.select(F.col("id").alias("few"), "token"), "few")
    shared = told.join(large.select(F.col("id").alias("many"), "token"), ["many", "token"]).groupBy("few", "many").agg(F.count("*").alias("_o"))
    return shared.where(F.col("_o") >= least).select(F.least("few", "many").alias("src"), F.greatest("few", "many").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").unionByName(back)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _in_one_task(edges: DataFrame, found: Callable[[np.ndarray, np.ndarray, int], np.ndarray], name: str) -> DataFrame:
    """``(id, name)`` by a function of numbered ends and the number of vertices; numbers are in the order of the ids. Materialised."""
    kind = dict(edges.dtypes)["src"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        numbers, ids = pd.factorize(pd.concat([frame["src"], frame["dst"]], ignore_index=True), sort=True)
        labels = found(numbers[: len(frame)], numbers[len(frame) :], len(ids))
        return pd.DataFrame({"id": ids, name: np.asarray(ids)[labels]})

    return cut_lineage(edges.select("src", "dst", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, f"id {kind}, {name} {kind}"))


def _is_small(edges: DataFrame, bound: int) -> bool:
    return edges.limit(bound + 1).count() <= bound


def _propagated(src: np.ndarray, dst: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Labels after so many rounds, as numbers of vertices."""
    giver, taker = np.concatenate([src, dst]), np.concatenate([dst, src])
    labels = np.arange(n)
    for _ in range(rounds):
        votes, count = np.unique(taker * n + labels[giver], return_counts=True)
        who, label = np.divmod(votes, n)
        order = np.lexsort((label, -count, who))
        first = order[np.unique(who[order], return_index=True)[1]]
        labels = labels.copy()
        labels[who[first]] = label[first]
    return labels


def _least_reached(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each one's component, by hooking roots on lesser ones and halving paths."""
    parent = np.arange(n)
    while True:
        a, b = parent[src], parent[dst]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent != parent[parent]).any():
            parent = parent[parent]


def label_propagation(edges: DataFrame, rounds: int = 5, *, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(id, label)`` after so many synchronous rounds: the neighbours' most frequent label, of equals the least.

    Up to ``one_task`` edges in one task, else a join a round, with the vertices of more
    than a share of the links dealt to several tasks.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    if _is_small(edges, one_task):
        return _in_one_task(edges, lambda a, b, n: _propagated(a, b, n, rounds), "label")
    links = cut_lineage(both_ways(edges))
    degrees = cut_lineage(links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_n")))
    labels = vertices(edges).withColumn("label", F.col("id"))
    best = W.partitionBy("id").orderBy(F.desc("n"), F.asc("label"))
    ends = links.withColumnsRenamed({"src": "id"})
    for _ in range(rounds):
        told = salted_join(ends, labels, "id", how="inner", spread=F.col("dst"), counts=degrees)
        votes = told.groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        labels = cut_lineage(votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("id", "label"))
    return labels


def connected_components(edges: DataFrame, *, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(id, component)``: the least id that can be reached.

    Up to ``one_task`` edges in one task. Beyond, it alternates between hanging larger
    neighbours, then smaller ones, on the least of a neighbourhood, so the number of
    rounds grows with the logarithm of the diameter's order, not with the diameter; a
    long chain does not need a round for each vertex.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    if _is_small(edges, one_task):
        return _in_one_task(edges.where("src <> dst"), _least_reached, "component")
    links = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    before = None
    while True:
        # large star: every larger neighbour is hung on the least of the neighbourhood
        near = both_ways(links)
        least = near.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = near.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("m").alias("src"), "dst").distinct()
        # small star: every smaller neighbour, and the vertex, are hung on the least of the smaller ones
        down = large.select(F.col("dst").alias("v"), F.col("src").alias("u"))
        floor = down.groupBy("v").agg(F.min("u").alias("m"))
        hung = down.join(floor, "v").select(F.col("m").alias("src"), F.explode(F.array("u", "v")).alias("dst"))
        links = cut_lineage(hung.where("src <> dst").distinct())
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    members = links.select(F.col("dst").alias("id"), F.col("src").alias("component"))
    roots = links.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    return members.unionByName(roots)


def modularity(edges: DataFrame, labels: DataFrame, *, diagonal: bool = False) -> DataFrame:
    """``(community, modularity part)`` summed to one row ``q``: (1/2m) Σ (A_ij - k_i k_j / 2m) within communities.

    Without ``diagonal`` the terms i = j are left out. Degrees are those of ``edges``.
    """
    degree = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    total = edges.agg(F.count("*").cast("double").alias("m"))
    named = labels.select("id", "label")
    k = F.col("k").cast("double")
    by_label = degree.join(named, "id").groupBy("label").agg(F.sum(k).alias("sk"), F.sum(k * k).alias("skk"))
    a = named.withColumnsRenamed({"id": "src", "label": "la"})
    b = named.withColumnsRenamed({"id": "dst", "label": "lb"})
    inside = (
        edges.join(a, "src").join(b, "dst").where(F.col("la") == F.col("lb")).groupBy(F.col("la").alias("label")).agg(F.count("*").alias("e"))
    )
    parts = by_label.join(inside, "label", "left").crossJoin(F.broadcast(total))  # one row
    squares = F.col("sk") * F.col("sk") - (F.lit(0.0) if diagonal else F.col("skk"))
    part = (2 * F.coalesce("e", F.lit(0)) - squares / (2 * F.col("m"))) / (2 * F.col("m"))
    return parts.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("q"))


# ---------------------------------------------------------------------------
# Betweenness


def adjacency(edges: Iterable[tuple]) -> dict:
    near: dict = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    return near


def source_credits(near: dict, source: object) -> dict[tuple, float]:
    """Credit of each edge for shortest paths from one source."""
    distance, paths, order, parents = {source: 0}, {source: 1.0}, [], defaultdict(list)
    waiting = deque([source])
    while waiting:
        v = waiting.popleft()
        order.append(v)
        for w in near[v]:
            if w not in distance:
                distance[w], paths[w] = distance[v] + 1, 0.0
                waiting.append(w)
            if distance[w] == distance[v] + 1:
                paths[w] += paths[v]
                parents[w].append(v)
    credit = dict.fromkeys(order, 1.0)
    edges: dict[tuple, float] = {}
    for w in reversed(order):
        for v in parents[w]:
            share = credit[w] * paths[v] / paths[w]
            edges[(v, w) if v < w else (w, v)] = share
            credit[v] += share
    return edges


def local_betweenness(near: dict) -> dict[tuple, float]:
    total: dict[tuple, float] = defaultdict(float)
    for source in near:
        for edge, credit in source_credits(near, source).items():
            total[edge] += credit / 2
    return dict(total)


def edge_betweenness(edges: DataFrame, *, broadcast_edges: int = 200_000) -> DataFrame:
    """``(src, dst, betweenness)``: shortest paths over each edge, each pair of vertices once, ties in parts.

    Up to ``broadcast_edges`` edges the graph itself is sent to all tasks, which share out the
    sources and add up credits before they are shuffled. A larger graph is searched
    from all sources at once, level by level, as relations.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    if edges.limit(broadcast_edges + 1).count() <= broadcast_edges:
        return _betweenness_by_sources(edges)
    return _betweenness_by_levels(edges)


def _betweenness_by_sources(edges: DataFrame) -> DataFrame:
    near = edges.sparkSession.sparkContext.broadcast(adjacency((r[0], r[1]) for r in edges.collect()))
    kind = dict(edges.dtypes)["src"]

    def credits(frames):
        total: dict[tuple, float] = defaultdict(float)
        for frame in frames:
            for source in frame["id"]:
                for edge, credit in source_credits(near.value, source).items():
                    total[edge] += credit / 2
        yield pd.DataFrame([(a, b, c) for (a, b), c in total.items()], columns=["src", "dst", "credit"])

    spread = vertices(edges).repartition("id")
    return (
        spread.mapInPandas(credits, f"src {kind}, dst {kind}, credit double")
        .groupBy("src", "dst")
        .agg(F.sum("credit").alias("betweenness"))
    )


def _betweenness_by_levels(edges: DataFrame) -> DataFrame:
    near = cut_lineage(both_ways(edges).withColumnsRenamed({"src": "v", "dst": "w"}))
    frontier = cut_lineage(
        vertices(edges).select(F.col("id").alias("source"), F.col("id").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("paths"))
    )
    reached, level = frontier, 0
    while True:
        step = frontier.join(near, "v").groupBy("source", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        fresh = step.join(reached.select("source", "v"), ["source", "v"], "left_anti")
        level += 1
        frontier = cut_lineage(fresh.select("source", "v", F.lit(level).alias("level"), "paths"))
        if not frontier.take(1):
            break
        reached = cut_lineage(reached.unionByName(frontier))
    child = reached.select("source", F.col("v").alias("w"), F.col("level").alias("lw"), F.col("paths").alias("pw"))
    tree = reached.join(near, "v").join(child, ["source", "w"]).where(F.col("lw") == F.col("level") + 1)
    tree = cut_lineage(tree.select("source", "v", "w", "lw", (F.col("paths") / F.col("pw")).alias("part")))
    credit = reached.where(F.col("level") == level - 1).select("source", F.col("v").alias("w"), F.lit(1.0).alias("credit"))
    total = None
    for depth in range(level - 1, 0, -1):
        shares = cut_lineage(
            tree.where(F.col("lw") == depth).join(credit, ["source", "w"]).select("source", "v", "w", (F.col("part") * F.col("credit")).alias("share"))
        )
        total = shares if total is None else total.unionByName(shares)
        own = reached.where(F.col("level") == depth - 1).select("source", F.col("v").alias("w"))
        got = shares.groupBy("source", F.col("v").alias("w")).agg(F.sum("share").alias("more"))
        credit = own.join(got, ["source", "w"], "left").select("source", "w", (1 + F.coalesce("more", F.lit(0.0))).alias("credit"))
    return total.groupBy(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst")).agg(
        (F.sum("share") / 2).alias("betweenness")
    )


# ---------------------------------------------------------------------------
# Communities


def _blocks(near: dict, weight: dict, start: int) -> tuple[list, list[tuple[list[tuple], dict]]]:
    """The vertices reached from ``start``, and the blocks (parts that no single vertex parts) between them: edges and weights.

    A vertex weighs in a block as much as it and all that hangs on it outside of the block.
    Shortest paths pass from block to block at the same vertices, so with these weights
    the betweenness of a block's edges is found in the block alone.
    """
    place, low, hung = {start: 0}, {start: 0}, {start: weight[start]}
    path, waiting, stack, found = [start], [iter(near[start])], [], []
    while path:
        v, up = path[-1], path[-2] if len(path) > 1 else None
        for w in waiting[-1]:
            if w not in place:
                stack.append((v, w))
                place[w] = low[w] = len(place)
                hung[w] = weight[w]
                path.append(w)
                waiting.append(iter(near[w]))
                break
            if w != up and place[w] < place[v]:
                stack.append((v, w))
                low[v] = min(low[v], place[w])
        else:
            path.pop()
            waiting.pop()
            if up is None:
                break
            low[up] = min(low[up], low[v])
            if low[v] >= place[up]:
                own = [stack.pop()]
                while own[-1] != (up, v):
                    own.append(stack.pop())
                weights = {x: hung[x] for e in own for x in e if x != up}
                hung[up] += sum(weights.values())
                found.append((up, own, weights))
    for up, _, weights in found:
        weights[up] = hung[start] - sum(weights.values())
    return list(place), [(sorted((v, w) if v < w else (w, v) for v, w in own), weights) for _, own, weights in found]


def _path_shares(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each two vertices (a row) the share of their shortest paths that passes each edge; a row for both orders."""
    linked = np.zeros((n, n))
    linked[src, dst] = linked[dst, src] = 1.0
    distance, paths, front, level = np.where(np.eye(n) > 0, 0, -1), np.eye(n), np.eye(n), 0
    while True:
        front = np.where(distance < 0, front @ linked, 0.0)
        if not front.any():
            break
        level += 1
        distance[front > 0] = level
        paths += front
    out = np.zeros((n, n, len(src)))
    for a, b in ((src, dst), (dst, src)):
        passed = distance[:, a][:, None, :] + 1 + distance[b, :].T[None, :, :] == distance[:, :, None]
        out += np.where(passed, paths[:, a][:, None, :] * paths[b, :].T[None, :, :], 0.0)
    return (out / paths[:, :, None]).reshape(n * n, len(src))


def _weighted_betweenness(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Betweenness of each edge of a connected graph, a pair of vertices counting as the product of their weights.

    Searches from many sources at once, level by level; ``FLAT`` bounds what is held of them.
    """
    m = len(src)
    tail, head, edge = np.concatenate([src, dst]), np.concatenate([dst, src]), np.tile(np.arange(m), 2)
    order = np.argsort(tail, kind="stable")
    head, edge = head[order], edge[order]
    degree = np.bincount(tail, minlength=n)
    first = np.cumsum(degree) - degree
    total = np.zeros(m)
    step = max(1, FLAT // (n + 2 * m))
    for begin in range(0, n, step):
        sources = np.arange(begin, min(n, begin + step))
        reached = np.full(len(sources) * n, -1, dtype=np.int64)
        paths, mark = np.zeros(len(reached)), np.zeros(len(reached), dtype=np.int64)
        front = np.arange(len(sources)) * n + sources
        reached[front], paths[front] = 0, 1.0
        levels = []
        while len(front):
            v = front % n
            many = degree[v]
            arc = np.repeat(first[v] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            parent = np.repeat(front, many)
            child = np.repeat(front - v, many) + head[arc]
            fresh = reached[child] < 0
            parent, child, by = parent[fresh], child[fresh], edge[arc[fresh]]
            reached[child] = len(levels) + 1
            np.add.at(paths, child, paths[parent])
            mark[child] = np.arange(len(child))
            front = child[mark[child] == np.arange(len(child))]
            levels.append((parent, child, by))
        credit = (weight[sources][:, None] * weight[None, :]).reshape(-1)
        for parent, child, by in reversed(levels):
            share = credit[child] * (paths[parent] / paths[child])
            np.add.at(credit, parent, share)
            total += np.bincount(by, weights=share, minlength=m)
    return total / 2


class _Block:
    """A block with the betweenness of its edges; ``kept`` has the path shares of small blocks by their edges."""

    def __init__(self, edges: list[tuple], weights: dict, kept: dict):
        self.edges, self.weights = edges, weights
        if len(edges) == 1:
            self.values = [float(weights[edges[0][0]] * weights[edges[0][1]])]
        else:
            number = {v: i for i, v in enumerate(sorted(weights))}
            n, weight = len(number), np.array([weights[v] for v in number], dtype=float)
            src, dst = (np.array([number[e[i]] for e in edges]) for i in (0, 1))
            if n * n * len(edges) > SMALL:
                self.values = _weighted_betweenness(n, src, dst, weight).tolist()
            else:
                key = tuple(edges)
                if key not in kept:
                    kept[key] = _path_shares(n, src, dst)
                self.values = (np.outer(weight, weight).reshape(-1) @ kept[key] / 2).tolist()
        self.top = max(self.values)

    def without(self, gone: set, kept: dict) -> list[_Block] | None:
        """The blocks that are left of this one without some of its edges; none if they no longer hold together."""
        kept.pop(tuple(self.edges), None)
        left = [e for e in self.edges if e not in gone]
        if len(left) < len(self.weights) - 1:
            return None
        reached, made = _blocks(adjacency(left), self.weights, self.edges[0][0])
        return [_Block(*m, kept) for m in made] if len(reached) == len(self.weights) else None


def component_cuts(edges: list[tuple], total: int) -> list[tuple[float, float, list[tuple]]]:
    """The whole course of cutting one component: each time (highest betweenness, modularity part after the cut, edges cut).

    The first entry has infinite betweenness and no edges: the component as it is.
    Betweenness is computed again only in the block in which edges were cut, and, where
    its piece falls apart, in all blocks of that piece, as their weights change.
    """
    number = {v: i for i, v in enumerate(sorted({v for e in edges for v in e}))}
    named = {tuple(sorted((number[a], number[b]))): (a, b) for a, b in edges}
    whole: list[set] = [set() for _ in number]
    for a, b in named:
        whole[a].add(b)
        whole[b].add(a)
    near = [set(w) for w in whole]
    alone = [1] * len(near)
    kept: dict = {}
    settled: list[float] = []  # parts of pieces without edges

    def part(members: set) -> float:
        inside = sum(len(whole[v] & members) for v in members) // 2
        k = sum(len(whole[v]) for v in members)
        kk = sum(len(whole[v]) ** 2 for v in members)
        return (2 * inside - (k * k - kk) / (2 * total)) / (2 * total)

    def pieces(left: set) -> list[tuple[set, float, list[_Block], float]]:
        out = []
        while left:
            start = left.pop()
            reached, made = _blocks(near, alone, start)
            members = set(reached)
            left -= members
            if made:
                blocks = [_Block(*m, kept) for m in made]
                out.append((members, part(members), blocks, max(b.top for b in blocks)))
            else:
                settled.append(part(members))
        return out

    state = pieces(set(range(len(near))))
    course = [(float("inf"), sum(own for _, own, _, _ in state), [])]
    while state:
        top = max(highest for *_, highest in state)
        least = top - TIE * max(1.0, top / 1000)
        cut, following = [], []
        for members, own, blocks, highest in state:
            if highest < least:
                following.append((members, own, blocks, highest))
                continue
            after, whole_still = [], True
            for block in blocks:
                if block.top < least:
                    after.append(block)
                    continue
                tied = {e for e, b in zip(block.edges, block.values, strict=True) if b >= least}
                cut += [named[e] for e in tied]
                for a, b in tied:
                    near[a].discard(b)
                    near[b].discard(a)
                left = block.without(tied, kept) if whole_still else None
                whole_still = left is not None
                after += left or []
            if whole_still:
                following.append((members, own, after, max(b.top for b in after)))
            else:
                following += pieces(set(members))
        state = following
        course.append((top, sum(settled) + sum(own for _, own, _, _ in state), sorted(cut)))
    return course


def _turns(tops: list[float]) -> list[list[float]]:
    """For each cut of a component a key by which the cuts of all components, sorted, take turns as in the whole graph.

    In the whole graph the next cut is always one of the highest betweenness among the
    components' next ones. So a cut waits for the lowest of its component so far, and
    cuts above that follow it at once: the key is the rising sequence of lowest values,
    from the beginning, from the lowest on, and so on, each negated and with the number of
    times it has occurred. Equal keys are one round.
    """
    out: list[list[float]] = []
    path: list[list[float]] = []
    for top in tops:
        value = -round(top, 9)
        while path and path[-1][0] < value:
            path.pop()
        if path and path[-1][0] == value:
            path[-1][1] += 1.0
        else:
            path.append([value, 0.0])
        out.append([x for part in path for x in part])
    return out


def _pieces_of(frame: pd.DataFrame) -> pd.DataFrame:
    """Vertices of one component with the least vertex of their piece, over the edges that are not ``gone``."""
    near = adjacency(zip(frame["src"][~frame["gone"]], frame["dst"][~frame["gone"]], strict=True))
    label: dict = {}
    for start in sorted(set(frame["src"]) | set(frame["dst"])):
        if start in label:
            continue
        label[start], waiting = start, [start]
        while waiting:
            for w in near[waiting.pop()]:
                if w not in label:
                    label[w] = start
                    waiting.append(w)
    return pd.DataFrame(list(label.items()), columns=["id", "label"])


def girvan_newman(edges: DataFrame, *, component_edges: int = 20_000) -> tuple[DataFrame, float, int]:
    """Communities ``(id, label)`` of the highest modularity, that modularity, and the number of cuts made until then.

    Again and again all edges tied at the highest betweenness are cut; of all the
    partitions on the way into components the best is kept, of equals the first.
    Nothing that happens in one component changes another, so each component's course
    of cuts is found by itself, all in parallel; the courses take turns by the keys of
    ``_turns``, and modularity is a running sum of changes, a row a round. Only the best
    round comes to the driver. A component of more than ``component_edges`` edges is
    refused: one task would have to hold it, and the method takes time with the square
    of the edges.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    total = edges.count()
    if not total:
        return vertices(edges).withColumn("label", F.col("id")), 0.0, 0
    components = connected_components(edges)
    placed = cut_lineage(edges.join(components, edges["src"] == components["id"]).select("component", "src", "dst"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    if sizes.where(F.col("n") > component_edges).take(1):
        raise ValueError(f"a component has more than {component_edges} edges")
    kind = dict(edges.dtypes)["src"]

    def course(frame: pd.DataFrame) -> pd.DataFrame:
        made = component_cuts(list(zip(frame["src"], frame["dst"], strict=True)), total)
        turns = [[], *_turns([top for top, _, _ in made[1:]])]
        parts = [q for _, q, _ in made]
        change = [q - before for q, before in zip(parts, [0.0, *parts], strict=False)]
        rows = [(t, c, [{"a": a, "b": b} for a, b in cut]) for t, c, (_, _, cut) in zip(turns, change, made, strict=True)]
        return pd.DataFrame(rows, columns=["turn", "change", "cut"])

    schema = f"turn array<double>, change double, cut array<struct<a: {kind}, b: {kind}>>"
    # few rows and much work: a stated number of parts, or AQE would put all components into one task
    dealt = placed.repartition(shuffle_width(edges.sparkSession), "component")
    courses = cut_lineage(dealt.groupBy("component").applyInPandas(course, schema))
    # the first round is the graph as it is; one row a round, so the running sum may stand in one task
    rounds = courses.groupBy("turn").agg(F.sum("change").alias("change"))
    upto = W.orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = rounds.select("turn", F.sum("change").over(upto).alias("q"), (F.count("*").over(upto) - 1).alias("rounds"))
    best = running.orderBy(F.desc(F.round("q", 12)), "turn").first()
    last = F.lit(best["turn"]).cast("array<double>")
    gone = (
        courses.where(F.col("turn") <= last)
        .select(F.explode("cut").alias("e"))
        .select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), F.lit(True).alias("gone"))
    )
    marked = placed.join(gone, ["src", "dst"], "left").select("component", "src", "dst", F.coalesce("gone", F.lit(False)).alias("gone"))
    labels = marked.groupBy("component").applyInPandas(_pieces_of, f"id {kind}, label {kind}")
    return labels, best["q"], best["rounds"]


def communities(labels: DataFrame) -> DataFrame:
    """``(size, members)``, ordered by size and members; for reports, as a community stands in one row.

    Members are ordered without regard to case, those alike but for case by bytes.
    """
    named = F.array_sort(F.collect_list(F.struct(F.lower(F.col("id").cast("string")).alias("_l"), "id")))
    return (
        labels.groupBy("label")
        .agg(F.transform(named, lambda m: m["id"]).alias("members"))
        .select(F.size("members").alias("size"), "members")
        .orderBy("size", "members")
    )
