"""Composite index and geostatistics queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import geo, indices
from lodestone.operators.relational import melt
from lodestone.sources.io import table as T

from .registry import query
from .tables import points

C = F.col
PANEL = """p as (select c_mktsegment unit, year(o_orderdate) y, sum(l_extendedprice * (1 - l_discount)) revenue, avg(l_discount) discount, cast(count(distinct o_orderkey) as double) orders
 from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by 1, 2)"""
IND = {"revenue": "POS", "discount": "NEG", "orders": "POS"}
BASE = 1995


def panel(s, d):
    li, o, c = T(s, d, "lineitem"), T(s, d, "orders"), T(s, d, "customer")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(C("c_mktsegment").alias("unit"), F.year("o_orderdate").alias("y")).agg(F.sum(C("l_extendedprice") * (1 - C("l_discount"))).alias("revenue"), F.avg("l_discount").alias("discount"), F.count_distinct("o_orderkey").cast("double").alias("orders"))


AMPI = f"with {PANEL}, g as (select median(revenue) a, median(discount) b, median(orders) c from p where y = {BASE}), e as (select (max(revenue) - min(revenue)) / 2 a, (max(discount) - min(discount)) / 2 b, (max(orders) - min(orders)) / 2 c from p), " + """
n as (select unit, y, 60 * (revenue - (g.a - e.a)) / (2 * e.a) + 70 n_revenue, 60 * ((g.b + e.b) - discount) / (2 * e.b) + 70 n_discount, 60 * (orders - (g.c - e.c)) / (2 * e.c) + 70 n_orders from p, g, e),
m as (select *, (n_revenue + n_discount + n_orders) / 3 mean from n), v as (select *, sqrt(((n_revenue - mean) ** 2 + (n_discount - mean) ** 2 + (n_orders - mean) ** 2) / 2) sd from m) """


@query("idx01_ampi_segments", AMPI + "select unit, y, round(mean - sd * sd / mean, 4) score from v")
def _(s, d):
    return indices.ampi(panel(s, d), "unit", "y", IND, BASE).select("unit", "y", F.round("score", 4).alias("score"))


@query("idx02_ampi_parts", AMPI + "select unit, y, round(n_revenue, 4) n_revenue, round(n_discount, 4) n_discount, round(n_orders, 4) n_orders, round(sd * sd / mean, 4) penalty, round(mean + sd * sd / mean, 4) score from v")
def _(s, d):
    x = indices.ampi(panel(s, d), "unit", "y", IND, BASE, penalty="NEG")
    return x.select("unit", "y", *[F.round(c, 4).alias(c) for c in ("n_revenue", "n_discount", "n_orders", "penalty", "score")])


@query("idx03_rsh01_weighted", f"with {PANEL} select unit, y, unnest(['orders', 'index']) variable, unnest([round(orders, 4), round(0.3 * orders + 0.8 * discount, 4)]) \"value\" from p")
def _(s, d):
    x = indices.weighted(panel(s, d), {"orders": 0.3, "discount": 0.8})
    return melt(x.select("unit", "y", F.round("orders", 4).alias("orders"), F.round("index", 4).alias("index")), ["unit", "y"], ["orders", "index"])


@query("idx04_prune_collinear", f"with {PANEL} select unit, y, discount from p where abs((select corr(revenue, orders) from p)) > 0.9")
def _(s, d):
    p = panel(s, d)
    left = indices.prune_collinear(p, ["revenue", "discount", "orders"], 0.9)
    return p.select("unit", "y", *left)


@query("idx08_factor_index", "with r as (select s_suppkey, 0.7 * s_acctbal + 0.4 * s_nationkey x from supplier), m as (select min(x) a, max(x) b from r) select s_suppkey, round((x - a) / (b - a), 6) \"index\" from r, m")
def _(s, d):
    load = np.array([[0.8, 0.3], [0.6, 0.5]])
    return indices.factor_index(T(s, d, "supplier"), ["s_acctbal", "s_nationkey"], load).select("s_suppkey", F.round("index", 6).alias("index"))


@query("idx05_eigenvalues")
def _(s, d):
    return indices.eigenvalues(T(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("idx06_factor_analysis")
def _(s, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    load, unique = indices.factor_analysis(indices.correlation_matrix(T(s, d, "lineitem"), cols), 1)
    return s.createDataFrame([(c, float(a[0]), float(u)) for c, a, u in zip(cols, load, unique, strict=True)], "variable string, loading double, uniqueness double")


@query("idx09_principal_axes")
def _(s, d):
    return indices.principal_axes(T(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])[0].groupBy("l_returnflag").agg(F.avg("axis_1").alias("axis_1"), F.avg("axis_2").alias("axis_2"))


@query("geo02_covariance", "with h as (select s_suppkey, s_suppkey % 100 / 30.0 h from supplier) select s_suppkey, round(2 * exp(-h), 6) e, round(case when h < 1 then 2 * (1 - 1.5 * h + 0.5 * h * h * h) else 0 end, 6) sph, round(2 * (1 + h) * exp(-h), 6) m from h")
def _(s, d):
    dist = (C("s_suppkey") % 100).cast("double")
    return T(s, d, "supplier").select("s_suppkey", *[F.round(geo.covariance(dist, m, 2.0, 30.0), 6).alias(n) for n, m in (("e", "exponential"), ("sph", "spherical"), ("m", "matern1.5"))])


@query("geo07_to_metres", "select s_suppkey id, cast(s_suppkey * 7 % 100 * 1000 as double) x from supplier")
def _(s, d):
    return geo.to_metres(points(s, d), ("x",)).select("id", "x")


PARAMS = {"model": "exponential", "sill": 1.0, "scale": 20.0, "nugget": 0.1, "kappa": 0.5, "order": 1}


def _spots(s, d):
    """One point per nation's suppliers: few enough for a dense system at any size."""
    return T(s, d, "supplier").groupBy("s_nationkey").agg((F.avg("s_acctbal") / 1000).alias("z")).select((C("s_nationkey") % 5 * 10).cast("double").alias("x"), (F.floor(C("s_nationkey") / 5) * 10).cast("double").alias("y"), "z")


@query("geo04_kriging")
def _(s, d):
    return geo.krige(_spots(s, d), geo.grid(s, (0, 40), (0, 40), 20), PARAMS)


@query("geo03_likelihood_fit")
def _(s, d):
    p = geo.fit(_spots(s, d), "exponential", (1.0, 10.0))
    return s.createDataFrame([(p["sill"], p["scale"], p["nugget"])], "sill double, scale double, nugget double")


@query("geo05_bayes_kriging")
def _(s, d):
    return geo.bayes_krige(_spots(s, d), geo.grid(s, (0, 40), (0, 40), 10), "exponential", [10.0, 20.0, 30.0], [0.05, 0.2, 0.5])


@query("geo06_cross_validation")
def _(s, d):
    return geo.cross_validate(_spots(s, d), PARAMS)
