"""Survey recoding and tabulation over customers as households."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import recode as R
from lodestone.operators import relational as O
from lodestone.sources.io import table as T

from .registry import query

C = F.col
#: Survey variables over customer, in expressions that either engine reads alike.
SURVEY = {
    "nquest": "c_custkey", "nord": "c_custkey % 2 + 1", "sex": "c_custkey % 3 % 2 + 1", "studio": "case when c_custkey % 11 = 0 then null else c_custkey % 8 end",
    "eta": "case when c_custkey % 37 = 0 then null else c_custkey * 7 % 100 end", "ylm": "case when c_custkey % 13 = 0 then null else c_acctbal * 5 end", "w": "1 + c_custkey % 5",
    **{f"s{i}": f"case c_custkey % {3 + i} when 0 then 1 when 1 then 2 else null end" for i in (1, 2, 3, 4)}, **{f"t{i}": f"case c_custkey % {5 + i} when 0 then 1 when 2 then 2 else null end" for i in (1, 2, 3, 4)},
    "change": "c_acctbal * 8 - 20000", "seg": "c_mktsegment", "nk": "c_nationkey",
}
SQL = "with v as (select " + ", ".join(f"{e} as {n}" for n, e in SURVEY.items()) + " from customer) "


def survey(s, d) -> DataFrame:
    return T(s, d, "customer").selectExpr(*[f"{e} as {n}" for n, e in SURVEY.items()])


ELICIT = [("s1 = 1", 20), ("s1 = 2 and s2 = 1", 10), ("s2 = 2 and s3 = 1", 5), ("s3 = 2 and s4 = 1", 2), ("s4 = 2", 0), ("t1 = 1", 20), ("t1 = 2 and t2 = 1", 10), ("t2 = 2 and t3 = 1", 5), ("t3 = 2 and t4 = 1", 2), ("t4 = 2", 0)]


@query("case01_elicitation", SQL + "select nquest, case " + " ".join(f"when {c} then {v}" for c, v in reversed(ELICIT)) + " end sconto from v")
def _(s, d):
    return survey(s, d).select("nquest", R.replace_all(None, [(F.expr(c), v) for c, v in ELICIT]).alias("sconto"))


@query("case02_bands", SQL + """select nquest, case when ylm <= 10000 then 1 when ylm <= 20000 then 2 when ylm <= 30000 then 3 else 4 end income,
 case when studio <= 2 then 1 when studio <= 5 then 2 else 3 end hstud, case when eta >= 90 or eta is null then 9 when eta >= 60 then 6 else 1 end age_class,
 case when coalesce(ylm > 20000 and studio > 4, false) then 1 else 0 end rich from v""")
def _(s, d):
    return survey(s, d).select("nquest", R.bands(C("ylm"), [10000, 20000, 30000]).alias("income"), R.bands(C("studio"), [2, 5]).alias("hstud"),
        R.replace_all(F.lit(1), [(C("eta") >= 60, 6), (R.at_least(C("eta"), 90), 9)]).alias("age_class"), R.flag((C("ylm") > 20000) & (C("studio") > 4)).alias("rich"))


@query("case03_recode", SQL + """select nquest, case when change is null then null when change <= -10000 then 1.0 when change >= -10000 and change <= -0.1 then 2.0 when change >= -0.1 and change <= 0.1 then 3.0
 when change >= 0.2 and change <= 25000 then 4.0 when change >= 25000 then 5.0 else change end code from v""")
def _(s, d):
    return survey(s, d).select("nquest", R.recode(C("change"), [(None, -10000, 1.0), (-10000, -0.1, 2.0), (-0.1, 0.1, 3.0), (0.2, 25000, 4.0), (25000, None, 5.0)]).alias("code"))


@query("case04_cut", SQL + "select nquest, case when eta >= 18 and eta < 30 then 18 when eta >= 30 and eta < 50 then 30 when eta >= 50 and eta < 90 then 50 end band from v")
def _(s, d):
    return survey(s, d).select("nquest", R.cut(C("eta"), [18, 30, 50, 90]).alias("band"))


@query("case05_fill", SQL + "select nquest, coalesce(ylm, 0) ylm, coalesce(studio, 1) studio from v")
def _(s, d):
    return survey(s, d).select("nquest", F.coalesce("ylm", F.lit(0)).alias("ylm"), F.coalesce("studio", F.lit(1)).alias("studio"))


@query("case06_any_of", SQL + "select nquest, coalesce(s1 in (1,2), false) or coalesce(s2 in (1,2), false) or coalesce(s3 in (1,2), false) first_arm from v")
def _(s, d):
    return survey(s, d).select("nquest", R.any_of([C("s1"), C("s2"), C("s3")], [1, 2]).alias("first_arm"))


@query("case07_lookup", SQL + "select nquest, case seg when 'BUILDING' then 'works' when 'MACHINERY' then 'works' when 'AUTOMOBILE' then 'cars' end grp from v")
def _(s, d):
    return survey(s, d).select("nquest", R.lookup(C("seg"), {"BUILDING": "works", "MACHINERY": "works", "AUTOMOBILE": "cars"}).alias("grp"))


@query("flt04_age_bands", SQL + "select case when eta < 30 then 1 when eta < 45 then 2 when eta < 65 then 3 when eta < 80 then 4 else 5 end band, count(*) n, sum(w) w from v group by 1")
def _(s, d):
    band = F.when(C("eta") < 30, 1).when(C("eta") < 45, 2).when(C("eta") < 65, 3).when(C("eta") < 80, 4).otherwise(5)
    return survey(s, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query("flt05_compound", SQL + "select nquest from v where (s1 = 1 or s2 = 1) and not (coalesce(studio, 0) > 5) and (ylm is null or ylm > 0)")
def _(s, d):
    return survey(s, d).where(((C("s1") == 1) | (C("s2") == 1)) & ~(F.coalesce("studio", F.lit(0)) > 5) & (C("ylm").isNull() | (C("ylm") > 0))).select("nquest")


@query("join01_joinby_chain", """select c.c_custkey, c.c_name, o.o_orderkey, l.l_linenumber, n.n_name from customer c join orders o on o.o_custkey = c.c_custkey join lineitem l on l.l_orderkey = o.o_orderkey
 join nation n on n.n_nationkey = c.c_nationkey where l.l_returnflag = 'R'""")
def _(s, d):
    orders = T(s, d, "orders").select(C("o_custkey").alias("c_custkey"), "o_orderkey", F.lit("right").alias("c_name"))
    lines = T(s, d, "lineitem").select(C("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    nations = T(s, d, "nation").select(C("n_nationkey").alias("c_nationkey"), "n_name")
    j = O.joinby(O.joinby(O.joinby(T(s, d, "customer"), orders, "c_custkey"), lines, "o_orderkey"), nations, "c_nationkey")
    return j.where(C("l_returnflag") == "R").select("c_custkey", "c_name", "o_orderkey", "l_linenumber", "n_name")


@query("agg03_one_way", SQL + "select studio, n, round(100.0 * n / sum(n) over (), 6) percent, round(100.0 * sum(n) over (order by studio) / sum(n) over (), 6) cumulative from (select studio, count(*) n from v where studio is not null group by 1)")
def _(s, d):
    return O.one_way(survey(s, d), "studio").select("studio", "n", F.round("percent", 6).alias("percent"), F.round("cumulative", 6).alias("cumulative"))


TWO = "select studio, sex, n, round(100.0 * n / sum(n) over (partition by studio), 6) row_percent, round(100.0 * n / sum(n) over (partition by sex), 6) column_percent from (select studio, sex, {} n from v where studio is not null and sex is not null group by 1, 2)"


@query("agg04_two_way", SQL + TWO.format("count(*)"))
def _(s, d):
    return O.two_way(survey(s, d), "studio", "sex").withColumns({c: F.round(c, 6) for c in ("row_percent", "column_percent")})


@query("agg05_weighted_tab", SQL + TWO.format("cast(sum(w) as bigint)"))
def _(s, d):
    return O.two_way(survey(s, d), "studio", "sex", "w").withColumns({c: F.round(c, 6) for c in ("row_percent", "column_percent")})


@query("rsh02_pivot", SQL + "select studio, count(*) filter (sex = 1) s1, count(*) filter (sex = 2) s2 from v group by 1")
def _(s, d):
    p = survey(s, d).groupBy("studio", "sex").agg(F.count("*").alias("n")).groupBy("studio").pivot("sex", [1, 2]).agg(F.sum("n"))
    return p.select("studio", F.coalesce("1", F.lit(0)).alias("s1"), F.coalesce("2", F.lit(0)).alias("s2"))


@query("mod05_ordered_probit")
def _(s, d):
    from lodestone.operators.models import ordered_probit

    v = survey(s, d).withColumn("income", R.bands(C("ylm"), [5000, 20000]))
    return ordered_probit(v.withColumn("age", C("eta") / 100), "income", ["age", "sex"], weight="w", cluster="nk")
