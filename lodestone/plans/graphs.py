"""Graph queries: trade between nations (small, weighted) and customers with their market cell."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.sources.io import saved
from lodestone.sources.io import table as T

from .registry import query

C = F.col
#: Nations trade when suppliers of one deliver to customers of the other; an edge is kept where it carries an above-average number of lines.
TRADE = """trade as (select s_nationkey a, c_nationkey b, count(*) n, round(avg(l_discount) * 1000, 3) weight from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
 where s_nationkey <> c_nationkey group by 1, 2), arcs as (select cast(a as bigint) src, cast(b as bigint) dst, weight from trade where n > (select avg(n) from trade)),
 e as (select distinct least(src, dst) src, greatest(src, dst) dst from arcs), d as (select node, count(*) degree from (select src node from e union all select dst from e) group by 1), both_ as (select src, dst from e union all select dst, src from e) """
W = "with " + TRADE


def arcs(s, d):
    li, o = T(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount"), T(s, d, "orders").select(C("o_orderkey").alias("l_orderkey"), C("o_custkey").alias("c_custkey"))
    c, u = T(s, d, "customer").select("c_custkey", "c_nationkey"), T(s, d, "supplier").select(C("s_suppkey").alias("l_suppkey"), "s_nationkey")
    t = li.join(o, "l_orderkey").join(c, "c_custkey").join(u, "l_suppkey").where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("l_discount") * 1000, 3).alias("weight"))
    t = saved(t, "trade")
    return t.crossJoin(F.broadcast(t.agg(F.avg("n").alias("m")))).where("n > m").select(C("s_nationkey").cast("long").alias("src"), C("c_nationkey").cast("long").alias("dst"), "weight")  # one row on the right


def edges(s, d):
    return saved(G.simple(arcs(s, d)), "graph")


def cells(s, d):
    """Each customer tied to its nation's market segment."""
    seg = F.dense_rank().over(Window.orderBy("c_mktsegment"))
    names = T(s, d, "customer").select("c_mktsegment").distinct().withColumn("k", seg)
    return T(s, d, "customer").join(F.broadcast(names), "c_mktsegment").select(C("c_custkey").alias("src"), (-(C("c_nationkey") * 100 + C("k"))).cast("long").alias("dst"))  # as many names as segments


CELLS = "cells as (select c_custkey src, -(c_nationkey * 100 + dense_rank() over (order by c_mktsegment)) dst from customer)"


@query("gra01_basic_stats", W + "select count(*) nodes, cast(sum(degree) / 2 as bigint) edges, round(sum(degree) / (count(*) * (count(*) - 1)), 6) density, round(avg(degree), 6) mean_degree, min(degree) min_degree, max(degree) max_degree from d")
def _(s, d):
    return G.basic_stats(edges(s, d)).withColumns({c: F.round(c, 6) for c in ("density", "mean_degree")})


@query("gra02_clustering", W + ", t as (select x.src node, count(*) / 2 t from both_ x join both_ y on x.src = y.src and x.dst <> y.dst join both_ z on z.src = x.dst and z.dst = y.dst group by 1) select round(avg(case when degree > 1 then 2 * coalesce(t, 0) / (degree * (degree - 1)) else 0 end), 6) clustering from d left join t using (node)")
def _(s, d):
    return G.clustering(edges(s, d)).select(F.round("clustering", 6).alias("clustering"))


@query("gra03_components", "with " + CELLS + ", m as (select dst, least(dst, min(src)) comp from cells group by 1) select src node, comp from cells join m using (dst) union all select dst, comp from m")
def _(s, d):
    return G.components(cells(s, d))


@query("gra04_11_degree", W + "select node, degree, round(degree / ((select count(*) from d) - 1), 6) centrality from d")
def _(s, d):
    return G.degrees(edges(s, d)).withColumn("centrality", F.round("centrality", 6))


_rank = ", k as (select count(*) n from d), r0 as (select node, 1.0 / n rank from d, k)" + "".join(f", r{i + 1} as (select b.dst node, 0.15 / any_value(k.n) + 0.85 * sum(r.rank / d.degree) rank from both_ b join r{i} r on r.node = b.src join d on d.node = b.src, k group by 1)" for i in range(10))


@query("gra06_pagerank", W + _rank + " select node, round(rank, 6) rank from r10")
def _(s, d):
    return G.pagerank(edges(s, d), rounds=10).select("node", F.round("rank", 6).alias("rank"))


_bfs = ", bfs as (select 0 as node, 0 as level union select b.dst, bfs.level + 1 from bfs join both_ b on b.src = bfs.node where bfs.level < 6) "


@query("gra17_bfs", "with recursive " + TRADE + _bfs + "select cast(node as bigint) node, min(level) level from bfs group by 1")
def _(s, d):
    return G.bfs(G.both(edges(s, d)), 0)


@query("gra07_closeness", "with recursive " + TRADE + ", w as (select node as origin, node, 0 as level from d union select w.origin, b.dst, w.level + 1 from w join both_ b on b.src = w.node where w.level < 6), l as (select origin, node, min(level) level from w group by 1, 2) select origin node, round((count(*) - 1) / sum(level), 6) closeness from l group by 1")
def _(s, d):
    e = edges(s, d)
    return G.closeness(e, G.degrees(e).select("node")).select("node", F.round("closeness", 6).alias("closeness"))


def members(s, d):
    return T(s, d, "nation").select(C("n_nationkey").cast("long").alias("node"), C("n_regionkey").cast("long").alias("comp"))


MEMBERS = ", mb as (select cast(n_nationkey as bigint) node, cast(n_regionkey as bigint) comp from nation), inn as (select a.comp, count(*) inside from e join mb a on a.node = e.src join mb b on b.node = e.dst where a.comp = b.comp group by 1)"


@query("gra08_modularity", W + MEMBERS + ", g as (select comp, sum(degree) deg from d join mb using (node) group by 1), m as (select count(*) m from e) select round(sum(coalesce(inside, 0) / m - (deg / (2 * m)) ** 2), 6) modularity from g left join inn using (comp), m")
def _(s, d):
    return G.modularity(edges(s, d), members(s, d)).select(F.round("modularity", 6).alias("modularity"))


@query("gra10_community_report", W + MEMBERS + " select comp, count(*) size, coalesce(any_value(inside), 0) internal_edges, round(case when count(*) > 1 then 2 * coalesce(any_value(inside), 0) / (count(*) * (count(*) - 1)) else 0 end, 6) density, first(node order by degree desc, node) influencer from mb join d using (node) left join inn using (comp) group by comp")
def _(s, d):
    e = edges(s, d)
    return G.community_report(e, members(s, d), G.degrees(e).select("node", C("degree").alias("rank"))).withColumn("density", F.round("density", 6))


_sp = ", sp as (select cast(0 as bigint) node, cast(0.0 as double) dist, 0 as hop union select a.dst, min(sp.dist + a.weight), sp.hop + 1 from sp join arcs a on a.src = sp.node where sp.hop < 8 group by a.dst, sp.hop) "


@query("gra13_18_shortest_paths", "with recursive " + TRADE + _sp + "select node, round(min(dist), 3) dist from sp group by 1")
def _(s, d):
    return G.distances(arcs(s, d), 0).select("node", F.round("dist", 3).alias("dist"))


@query("gra16_path_cost", "with " + TRADE + ", p as (select a.src x, a.dst y, b.dst z, a.weight + b.weight c from arcs a join arcs b on a.dst = b.src) select x || '-' || y || '-' || z path_id, round(c, 3) cost from p")
def _(s, d):
    a = saved(arcs(s, d), "arcs")
    p = a.select(C("src").alias("x"), C("dst").alias("y")).join(a.select(C("src").alias("y"), C("dst").alias("z")), "y")
    paths = p.select(F.concat_ws("-", "x", "y", "z").alias("path_id"), F.array("x", "y", "z").alias("path"))
    return G.path_cost(paths, a).select("path_id", F.round("cost", 3).alias("cost"))


@query("gra20_complexity_fit", "with p as (select count(*) n, sum(value) t from events group by user_id) select 'linear' model, round(regr_slope(t, n), 4) a, round(regr_intercept(t, n), 3) b, round(regr_r2(t, n), 6) r2 from p union all select 'nlogn', round(regr_slope(t, n * log2(n)), 4), round(regr_intercept(t, n * log2(n)), 3), round(regr_r2(t, n * log2(n)), 6) from p union all select 'quadratic', round(regr_slope(t, n * n), 4), round(regr_intercept(t, n * n), 3), round(regr_r2(t, n * n), 6) from p")
def _(s, d):
    p = T(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    return G.fit_complexity(p).select("model", F.round("a", 4).alias("a"), F.round("b", 3).alias("b"), F.round("r2", 6).alias("r2"))


@query("gra22_route", "select r_regionkey path_id, i, cast(n_nationkey % 5 as double) x, cast(n_nationkey % 7 as double) y from (select r_regionkey, n_nationkey, row_number() over (partition by r_regionkey order by n_nationkey) - 1 i from nation join region on r_regionkey = n_regionkey)")
def _(s, d):
    n = T(s, d, "nation")
    paths = n.groupBy(C("n_regionkey").alias("path_id")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("path"))
    return G.route(paths, n.select(C("n_nationkey").alias("id"), (C("n_nationkey") % 5).cast("double").alias("x"), (C("n_nationkey") % 7).cast("double").alias("y")))


@query("gra19_spanning_tree")
def _(s, d):
    return G.minimum_spanning_tree(arcs(s, d))


@query("gra05_betweenness")
def _(s, d):
    return G.betweenness(edges(s, d))


@query("gra08_louvain")
def _(s, d):
    found = G.louvain(edges(s, d))
    return s.createDataFrame(sorted(found.items()), "node long, comp long")


@query("gra09_girvan_newman")
def _(s, d):
    parts = G.girvan_newman(edges(s, d))
    return s.createDataFrame([(v, min(p)) for p in parts for v in sorted(p)], "node long, comp long")


@query("gra17_dfs")
def _(s, d):
    return s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(G.dfs(edges(s, d), 0))], "step int, src long, dst long")


@query("gra14_a_star")
def _(s, d):
    a = arcs(s, d)
    nodes = T(s, d, "nation").select(C("n_nationkey").cast("long").alias("id"), (C("n_nationkey") % 5 * 1e-6).alias("x"), (C("n_nationkey") % 7 * 1e-6).alias("y"))
    path, cost, explored = G.a_star(a, nodes, 0, 24, "weight", speed=1000.0)
    return s.createDataFrame([(path, cost if cost != math.inf else None, explored)], "path array<long>, cost double, explored int")
