"""Graphs as edge tables. Undirected edges are (src, dst) once each; `both` lists them from either end."""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.io import saved


def both(edges: DataFrame) -> DataFrame:
    flipped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(flipped)


def simple(edges: DataFrame) -> DataFrame:
    """Without loops and repeated edges, src < dst."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and degree centrality of the nodes that have edges."""
    g = both(edges.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    n = g.agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(n)).withColumn("centrality", F.col("degree") / (F.col("n") - 1)).drop("n")  # one row on the right


def basic_stats(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), (F.sum("degree") / (F.count("*") * (F.count("*") - 1))).alias("density"), F.avg("degree").alias("mean_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles through each node. Edges point from the end of smaller degree, so no node has a long list."""
    d = degrees(edges).select("node", "degree")
    e = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = saved(e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b")), "oriented")
    wedge = out.alias("x").join(out.alias("y"), "a").select("a", F.col("x.b").alias("b"), F.col("y.b").alias("c")).where("b <> c")
    closed = wedge.join(out.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """Mean of the nodes' clustering coefficients; degree 1 counts as 0."""
    t = degrees(edges).join(triangles(edges), "node", "left")
    c = F.when(F.col("degree") > 1, 2 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return t.agg(F.avg(c).alias("clustering"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reached. Each round takes the neighbours' smallest label, then that label's own label."""
    links = saved(both(edges.select("src", "dst")), "links")
    labels = saved(links.select(F.col("src").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    for _ in range(rounds):
        near = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("m"))
        new = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = saved(new.join(jump, "mid").select("node", F.least("mid", "far").alias("comp"), "old"), "labels")
        labels = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return labels
    raise RuntimeError("the components didn't settle")


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank) on the undirected graph, dangling mass spread evenly (there is none), a fixed number of rounds."""
    d = degrees(edges).select("node", "degree")
    n = d.count()
    links = saved(both(edges.select("src", "dst")).join(d.withColumnRenamed("node", "src"), "src"), "links")
    rank = d.select("node", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        sent = links.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("in"))
        rank = sent.select("node", ((1 - alpha) / n + alpha * F.col("in")).alias("rank"))
        if i % 5 == 4:
            rank = saved(rank, "rank")
    return rank


def bfs(edges: DataFrame, source: int, rounds: int = 1000) -> DataFrame:
    """(node, level) of the nodes reached along src -> dst."""
    seen = saved(edges.sparkSession.createDataFrame([(source, 0)], "node long, level int"), "seen")
    for level in range(1, rounds):
        at = seen.where(F.col("level") == level - 1)
        new = edges.join(at.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level))
        new = saved(new, "frontier")
        if new.isEmpty():
            return seen
        seen = saved(seen.unionByName(new), "seen")
    raise RuntimeError(f"nodes are more than {rounds - 1} steps away")


def distances(edges: DataFrame, source: int, weight: str = "weight", rounds: int = 1000) -> DataFrame:
    """(node, dist, prev): cheapest cost from source; only nodes whose cost fell are relaxed again. Ties of prev: smallest node."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    arcs = saved(edges.groupBy("src", "dst").agg(F.min(w).alias("w")), "arcs")
    known = saved(edges.sparkSession.createDataFrame([(source, 0.0, None, True)], "node long, dist double, prev long, fresh boolean"), "known")
    for _ in range(rounds):
        if known.where("fresh").isEmpty():
            return known.drop("fresh")
        step = arcs.join(known.where("fresh").select(F.col("node").alias("src"), "dist"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("d"), F.col("src").alias("p"))).alias("n"))
        better = F.col("n").isNotNull() & (F.col("dist").isNull() | (F.col("n.d") < F.col("dist")))
        known = saved(known.join(step, "node", "full_outer").select("node", F.when(better, F.col("n.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("n.p")).otherwise(F.col("prev")).alias("prev"), F.coalesce(better, F.lit(False)).alias("fresh")), "known")
    raise RuntimeError("costs didn't settle")


def path_to(found: DataFrame, target: int, most: int = 10_000) -> tuple[list[int] | None, float]:
    """The path's nodes and its cost, from `distances`; (None, inf) if the target isn't reached."""
    end = found.where(F.col("node") == target).first()
    if end is None:
        return None, math.inf
    path, at = [target], end.prev
    while at is not None:
        if len(path) >= most:
            raise RuntimeError(f"the path has more than {most} nodes")
        path.append(at)
        at = found.where(F.col("node") == at).first().prev
    return path[::-1], end.dist


def multi_objective(edges: DataFrame, wl: float = 1.0, wt: float = 1.0, wc: float = 1.0, seed: int = 42, per_minute: float = 60.0) -> DataFrame:
    """Weight = wl km + wt minutes (of `per_minute` units of travel_time) + wc tolls; tolls of 1 to 5 on motorways and trunks, fixed by hash."""
    toll = F.when(F.col("highway").isin("motorway", "trunk"), 1 + 4 * F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1000)) / 1000).otherwise(0.0)
    return edges.withColumn("toll", toll).withColumn("weight", wl * F.col("length") / 1000 + wt * F.col("travel_time") / per_minute + wc * F.col("toll"))


def path_cost(paths: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(path_id, cost) recomputed over consecutive nodes of paths (path_id, path)."""
    steps = paths.select("path_id", F.posexplode("path").alias("i", "src"), "path").withColumn("dst", F.get("path", F.col("i") + 1)).where("dst is not null")
    return steps.join(edges.groupBy("src", "dst").agg(F.min(weight).alias("w")), ["src", "dst"], "left").groupBy("path_id").agg(F.sum(F.coalesce("w", F.lit(1.0))).alias("cost"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Q = sum over communities of (internal edges / m) - (degree sum / 2m)^2."""
    m = edges.agg(F.count("*").alias("m"))
    e = edges.join(members.select(F.col("node").alias("src"), F.col("comp").alias("cs")), "src").join(members.select(F.col("node").alias("dst"), F.col("comp").alias("cd")), "dst")
    inner = e.where("cs = cd").groupBy(F.col("cs").alias("comp")).agg(F.count("*").alias("inside"))
    deg = degrees(edges).join(members, "node").groupBy("comp").agg(F.sum("degree").alias("deg"))
    return deg.join(inner, "comp", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("modularity"))  # one row on the right


def community_report(edges: DataFrame, members: DataFrame, ranks: DataFrame) -> DataFrame:
    """comp, size, internal_edges, density, influencer (highest rank, ties: smallest node)."""
    e = edges.join(members.select(F.col("node").alias("src"), F.col("comp").alias("cs")), "src").join(members.select(F.col("node").alias("dst"), F.col("comp").alias("cd")), "dst")
    inner = e.where("cs = cd").groupBy(F.col("cs").alias("comp")).agg(F.count("*").alias("internal_edges"))
    g = members.join(ranks, "node").groupBy("comp").agg(F.count("*").alias("size"), F.min_by("node", F.struct((-F.col("rank")).alias("r"), "node")).alias("influencer"))
    n = F.col("size")
    return g.join(inner, "comp", "left").select("comp", "size", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), F.when(n > 1, 2 * F.coalesce("internal_edges", F.lit(0)) / (n * (n - 1))).otherwise(0.0).alias("density"), "influencer")


def closeness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, closeness) of the nodes of sources (node) within what each reaches, by one breadth-first search from all at once.
    It holds a row for each source and node that it reaches: for all nodes of a small graph, or some of a large one."""
    links = saved(both(edges.select("src", "dst")), "links")
    seen = saved(sources.select(F.col("node").alias("origin"), "node", F.lit(0).alias("level")).distinct(), "seen")
    level = 0
    while True:
        level += 1
        new = links.join(seen.where(F.col("level") == level - 1).select("origin", F.col("node").alias("src")), "src").select("origin", F.col("dst").alias("node")).distinct().join(seen, ["origin", "node"], "left_anti").withColumn("level", F.lit(level))
        new = saved(new, "frontier")
        if new.isEmpty():
            break
        seen = saved(seen.unionByName(new), "seen")
    return seen.groupBy(F.col("origin").alias("node")).agg(((F.count("*") - 1) / F.sum("level")).alias("closeness"))


#: Algorithms that go one step after another take a graph of at most so many edges to the driver.
SMALL = 200_000


def _adjacent(edges: DataFrame, weight: str | None = None, directed: bool = False) -> dict[int, dict[int, float]]:
    rows = edges.select("src", "dst", *([weight] if weight else [])).limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"more than {SMALL} edges: this algorithm is for small graphs")
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for r in sorted(rows):
        w = float(r[2]) if weight else 1.0
        near[r[0]][r[1]] = min(w, near[r[0]].get(r[1], math.inf))
        near[r[1]] = near[r[1]]
        if not directed:
            near[r[1]][r[0]] = near[r[0]][r[1]]
    return near


def a_star(edges: DataFrame, nodes: DataFrame, source: int, target: int, weight: str = "length", speed: float = 1.0) -> tuple[list[int] | None, float, int]:
    """(path, cost, explored). The heuristic is the great-circle distance in metres over `speed`, so it stays below travel times for speed >= the fastest edge."""
    near = _adjacent(edges, weight, directed=True)
    places = nodes.select("id", "x", "y").limit(SMALL + 1).collect()
    if len(places) > SMALL:
        raise ValueError(f"more than {SMALL} nodes: this algorithm is for small graphs")
    place = {r.id: (math.radians(r.y), math.radians(r.x)) for r in places}

    def guess(v: int) -> float:
        (a, b), (c, d) = place[v], place[target]
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) / speed

    cost, prev, done, heap = {source: 0.0}, {}, set(), [(guess(source), source)]
    while heap:
        _, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        if v == target:
            path = [v]
            while path[-1] in prev:
                path.append(prev[path[-1]])
            return path[::-1], cost[v], len(done)
        for u, w in near[v].items():
            if cost[v] + w < cost.get(u, math.inf):
                cost[u], prev[u] = cost[v] + w, v
                heapq.heappush(heap, (cost[u] + guess(u), u))
    return None, math.inf, len(done)


def dfs(edges: DataFrame, source: int) -> list[tuple[int, int]]:
    near, seen, out = _adjacent(edges), {source}, []
    stack = [(source, iter(sorted(near[source])))]
    while stack:
        v, rest = stack[-1]
        u = next((x for x in rest if x not in seen), None)
        if u is None:
            stack.pop()
        else:
            seen.add(u)
            out.append((v, u))
            stack.append((u, iter(sorted(near[u]))))
    return out


def betweenness(edges: DataFrame, sample: int = 100, seed: int = 42) -> DataFrame:
    """Betweenness estimated from `sample` sources (fixed by hash), each handled by one row of a distributed map."""
    near = {v: sorted(u) for v, u in _adjacent(edges).items()}
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(near)  # SMALL edges at most
    chosen = sorted(near, key=lambda v: hash((v * 2654435761 + seed) % (1 << 32)))[: min(sample, len(near))]
    n = len(near)

    def run(batches):
        import pandas as pd

        near = shared.value
        for b in batches:
            total: dict[int, float] = defaultdict(float)
            for s in b["id"]:
                order, paths, level, back = [], defaultdict(float, {s: 1.0}), {s: 0}, defaultdict(list)
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for u in near[v]:
                        if u not in level:
                            level[u] = level[v] + 1
                            queue.append(u)
                        if level[u] == level[v] + 1:
                            paths[u] += paths[v]
                            back[u].append(v)
                share: dict[int, float] = defaultdict(float)
                for v in reversed(order):
                    for u in back[v]:
                        share[u] += paths[u] / paths[v] * (1 + share[v])
                    if v != s:
                        total[v] += share[v]
            yield pd.DataFrame({"node": list(total), "b": list(total.values())})

    rows = spark.createDataFrame([(v,) for v in chosen], "id long").repartition(max(1, min(len(chosen), 64)))
    scale = n / len(chosen) / max(1, (n - 1) * (n - 2))
    return rows.mapInPandas(run, "node long, b double").groupBy("node").agg((F.sum("b") * scale).alias("betweenness"))


def minimum_spanning_tree(edges: DataFrame, weight: str = "weight", rounds: int = 40) -> DataFrame:
    """Boruvka: every component takes its cheapest outgoing edge (ties: smallest ends) until none is left."""
    rest = saved(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col(weight).cast("double").alias("w")).where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")), "rest")
    chosen: DataFrame | None = None
    labels = saved(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    for _ in range(rounds):
        e = rest.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb")
        pick = e.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("w", "a", "b").alias("x")).groupBy("c").agg(F.min("x").alias("x")).select("x.*").distinct()
        pick = saved(pick, "pick")
        if pick.isEmpty():
            break
        chosen = pick if chosen is None else saved(chosen.unionByName(pick).distinct(), "chosen")
        labels = components(chosen.select(F.col("a").alias("src"), F.col("b").alias("dst"))).unionByName(labels.join(chosen.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti").withColumn("comp", F.col("node")))
        labels = saved(labels, "labels")
    return (chosen if chosen is not None else rest.limit(0).select("w", "a", "b")).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"))


def louvain(edges: DataFrame, seed: int = 42) -> dict[int, int]:
    """Node -> community by greedy modularity moves and contraction; nodes in an order fixed by the seed. For small graphs."""
    near = {v: dict(u) for v, u in _adjacent(edges).items()}
    home = {v: v for v in near}
    while True:
        m2 = sum(w for u in near.values() for w in u.values())
        comm = {v: v for v in near}
        deg = {v: sum(u.values()) for v, u in near.items()}
        total = dict(deg)
        order = sorted(near)
        random.Random(seed).shuffle(order)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in order:
                links: dict[int, float] = defaultdict(float)
                for u, w in near[v].items():
                    if u != v:
                        links[comm[u]] += w
                old = comm[v]
                total[old] -= deg[v]
                best = max(sorted(links.keys() | {old}), key=lambda c: links[c] - total[c] * deg[v] / m2)
                if links[best] - total[best] * deg[v] / m2 <= links[old] - total[old] * deg[v] / m2 + 1e-12:
                    best = old
                total[best] += deg[v]
                if best != old:
                    comm[v], moved, moved_any = best, True, True
        home = {v: comm[c] for v, c in home.items()}
        if not moved_any:
            names = {c: min(v for v in home if home[v] == c) for c in set(home.values())}
            return {v: names[c] for v, c in home.items()}
        smaller: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for v, u in near.items():
            for x, w in u.items():
                smaller[comm[v]][comm[x]] += w
        near = {v: dict(u) for v, u in smaller.items()}


def girvan_newman(edges: DataFrame, k: int = 5, most_nodes: int = 1000) -> list[set[int]]:
    """The first partition into k or more communities when the edge of highest betweenness is removed again and again."""
    near = {v: set(u) for v, u in _adjacent(edges).items()}
    if len(near) >= most_nodes:
        raise ValueError(f"meant for fewer than {most_nodes} nodes")

    def parts() -> list[set[int]]:
        left, out = set(near), []
        while left:
            group, todo = set(), [min(left)]
            while todo:
                v = todo.pop()
                if v not in group:
                    group.add(v)
                    todo += near[v] - group
            out.append(group)
            left -= group
        return out

    while len(now := parts()) < k and any(near.values()):
        score: dict[tuple[int, int], float] = defaultdict(float)
        for s in near:
            order, paths, level, back, queue = [], defaultdict(float, {s: 1.0}), {s: 0}, defaultdict(list), deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for u in sorted(near[v]):
                    if u not in level:
                        level[u] = level[v] + 1
                        queue.append(u)
                    if level[u] == level[v] + 1:
                        paths[u] += paths[v]
                        back[u].append(v)
            share: dict[int, float] = defaultdict(float)
            for v in reversed(order):
                for u in back[v]:
                    c = paths[u] / paths[v] * (1 + share[v])
                    share[u] += c
                    score[min(u, v), max(u, v)] += c
        a, b = min(score, key=lambda e: (-round(score[e], 9), e))
        near[a].discard(b)
        near[b].discard(a)
    return now


def fit_complexity(points: DataFrame, n: str = "n", t: str = "t") -> DataFrame:
    """model, a, b, r2 of t = a f(n) + b for f linear, n log2 n and n squared."""
    def one(name: str, f: Column):
        return F.struct(F.lit(name).alias("model"), F.regr_slope(F.col(t), f).alias("a"), F.regr_intercept(F.col(t), f).alias("b"), F.regr_r2(F.col(t), f).alias("r2"))
    x = F.col(n).cast("double")
    return points.agg(F.array(one("linear", x), one("nlogn", x * F.log2(x)), one("quadratic", x * x)).alias("s")).select(F.inline("s"))


def route(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """path_id, i, x, y of each path's nodes, for a map."""
    return paths.select("path_id", F.posexplode("path").alias("i", "id")).join(nodes.select("id", "x", "y"), "id").select("path_id", "i", "x", "y")


def sample_pairs(nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k origin-destination pairs of distinct nodes, fixed by hash."""
    ordered = nodes.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(2 * k).withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed)), "id")) - 1)
    return ordered.groupBy(F.floor(F.col("n") / 2).alias("pair")).agg(F.min_by("id", "n").alias("origin"), F.max_by("id", "n").alias("destination")).where("origin <> destination")
