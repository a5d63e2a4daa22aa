"""Scans, projections, joins, aggregates, order and reshaping over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import columns as K
from lodestone.operators import relational as O
from lodestone.sources import io
from lodestone.sources.io import table as T

from .registry import query

C = F.col
r6 = lambda c, n=None: F.round(c, 6).alias(n or c)


@query("src01_csv_semicolon", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def _(s, d):
    at = io.work_folder(s, "csv")
    cols = T(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    io.write_csv(cols, at, sep=";")
    return io.read_csv(s, at, cols._jdf.schema().toDDL(), sep=";")


@query("src02_edge_list", "select distinct ps_source as source, target from (select l_partkey ps_source, l_suppkey target from lineitem)")
def _(s, d):
    at = io.work_folder(s, "edges")
    io.write_csv(T(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), at, header=False)
    return io.read_csv(s, at, "source long, target long", header=False)


@query("src06_json_documents", "select doc_id, lang, n_chars from documents")
def _(s, d):
    at = io.work_folder(s, "json")
    T(s, d, "documents").select("doc_id", "lang", "n_chars").write.json(at)
    return s.read.schema("doc_id long, lang string, n_chars long").json(at)


@query("src19_inline", "select * from (values ('a', 1), ('b', 2)) t(topic, code)")
def _(s, d):
    return s.createDataFrame([("a", 1), ("b", 2)], "topic string, code int")


@query("prj01_select_rename_derive", "select c_custkey as key, round(ln(1 + abs(c_acctbal)), 6) as log_balance, c_acctbal > 0 as positive, 'tag' as tag from customer")
def _(s, d):
    return T(s, d, "customer").drop("c_name").withColumnRenamed("c_custkey", "key").select("key", F.round(F.log1p(F.abs("c_acctbal")), 6).alias("log_balance"), (C("c_acctbal") > 0).alias("positive"), F.lit("tag").alias("tag"))


@query("prj03_numeric_only", "select c_custkey, c_nationkey, c_acctbal from customer")
def _(s, d):
    df = T(s, d, "customer")
    return df.select(*O.numeric_columns(df))


@query("flt01_equality_range", "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'A' and l_quantity < 10 and l_discount <= 0.05 and l_linestatus <> 'O'")
def _(s, d):
    return T(s, d, "lineitem").where((C("l_returnflag") == "A") & (C("l_quantity") < 10) & (C("l_discount") <= 0.05) & (C("l_linestatus") != "O")).select("l_orderkey", "l_linenumber")


@query("case08_traffic_factor", "select event_id, round(value * case when hour(ts) between 7 and 9 or hour(ts) between 17 and 19 then 2.0 when hour(ts) >= 22 or hour(ts) <= 6 then 0.8 else 1.0 end, 6) as t from events")
def _(s, d):
    return T(s, d, "events").select("event_id", F.round(C("value") * K.traffic_factor(C("ts")), 6).alias("t"))


@query("case09_colour_index", "with m as (select min(c_acctbal) a, max(c_acctbal) b from customer) select c_custkey, cast(round((c_acctbal - a) / (b - a) * 255) + 1 as int) colour from customer, m")
def _(s, d):
    df = T(s, d, "customer")
    m = df.agg(F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"))
    return df.crossJoin(F.broadcast(m)).select("c_custkey", K.colour_index(K.min_max(C("c_acctbal"), C("a"), C("b"))).alias("colour"))  # one row on the right


@query("join02_lookup", "select s_suppkey, n_name from supplier left join nation on n_nationkey = s_nationkey")
def _(s, d):
    return T(s, d, "supplier").join(T(s, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", "left").select("s_suppkey", "n_name")


@query("join03_ratio", "select a.y, round(a.v / b.v, 6) ratio from (select year(l_shipdate) y, sum(l_tax) v from lineitem where l_returnflag = 'R' group by 1) a join (select year(l_shipdate) y, sum(l_tax) v from lineitem group by 1) b using (y)")
def _(s, d):
    li = T(s, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    a, b = li.where("l_returnflag = 'R'").groupBy("y").agg(F.sum("l_tax").alias("a")), li.groupBy("y").agg(F.sum("l_tax").alias("b"))
    return a.join(b, "y").select("y", F.round(C("a") / C("b"), 6).alias("ratio"))


@query("join04_anti_join06_semi", "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) ordered from customer")
def _(s, d):
    c, o = T(s, d, "customer").select("c_custkey"), T(s, d, "orders").select(C("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("ordered", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("ordered", F.lit(False)))


@query("join05_fallback_key", "select page_id from pages where coalesce(nullif(case when page_id % 3 = 0 then '' else url end, ''), 'page-' || page_id) not in (select url from pages where page_id % 2 = 0)")
def _(s, d):
    p = T(s, d, "pages").select("page_id", F.when(C("page_id") % 3 == 0, "").otherwise(C("url")).alias("url"), F.concat(F.lit("page-"), C("page_id")).alias("pdf_url"))
    return O.not_loaded(p, T(s, d, "pages").where("page_id % 2 = 0").select("url"), "url", ["pdf_url"]).select("page_id")


@query("join09_near_pairs", "with p as (select s_suppkey id, s_suppkey * 7 % 100 * 1.0 x, s_suppkey * 13 % 100 * 1.0 y from supplier) select a.id a_id, b.id b_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) d from p a join p b on a.id < b.id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 20")
def _(s, d):
    return O.near_pairs(points(s, d).select("id", "x", "y"), 20.0, digits=6).select("a_id", "b_id", "d")


def points(s, d):
    return T(s, d, "supplier").selectExpr("s_suppkey id", "cast(s_suppkey * 7 % 100 as double) x", "cast(s_suppkey * 13 % 100 as double) y", "s_acctbal z")


@query("agg24_geo01_variogram", """with p as (select s_suppkey id, s_suppkey * 7 % 100 * 1.0 x, s_suppkey * 13 % 100 * 1.0 y, s_acctbal z from supplier),
 q as (select sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) d, (a.z-b.z)*(a.z-b.z)/2 g from p a join p b on a.id < b.id)
 select cast(floor(d / 5) as bigint) bin, count(*) n, round(avg(d), 6) distance, round(avg(g), 2) gamma from q where d < 30 group by 1""")
def _(s, d):
    from lodestone.operators.geo import variogram

    return variogram(points(s, d), 5.0, 30.0).select("bin", "n", r6("distance"), F.round("gamma", 2).alias("gamma"))


@query("join10_grid", "select a.n_nationkey, b.r_regionkey from nation a cross join region b")
def _(s, d):
    return T(s, d, "nation").select("n_nationkey").crossJoin(T(s, d, "region").select("r_regionkey"))  # a grid is the product of its two axes


@query("join12_fuzzy_lookup", """with m as (select p_type as name, n_name as word, 1 - levenshtein(p_type, n_name) * 1.0 / greatest(length(p_type), length(n_name)) s from (select distinct p_type from part), nation),
 r as (select *, row_number() over (partition by name order by s desc, word) k from m where s >= 0.3) select name, word, round(s, 6) similarity, k as rank from r where k <= 3""")
def _(s, d):
    names, words = T(s, d, "part").select(C("p_type").alias("name")).distinct(), T(s, d, "nation").select(C("n_name").alias("word"))
    return O.close_matches(names, words, 0.3).select("name", "word", r6("similarity"), "rank")


@query("agg01_02_group_stats", "select event_type, count(*) n, round(avg(value), 6) mean_v, round(stddev_pop(value), 6) std_v, min(value) min_v, max(value) max_v from events group by 1")
def _(s, d):
    return T(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_v"), F.round(F.stddev_pop("value"), 6).alias("std_v"), F.min("value").alias("min_v"), F.max("value").alias("max_v"))


@query("agg06_base_medians", "select round(median(l_quantity), 6) l_quantity, round(median(l_extendedprice), 6) l_extendedprice from lineitem where year(l_shipdate) = (select min(year(l_shipdate)) from lineitem)")
def _(s, d):
    li = T(s, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    base = li.agg(F.min("y").alias("y"))
    return li.join(F.broadcast(base), "y").agg(*[F.round(F.median(c), 6).alias(c) for c in ("l_quantity", "l_extendedprice")])  # one row on the right


@query("agg07_null_counts", "select * from (select 'a' as \"column\", count(*) filter (c_custkey % 7 = 0) as nulls from customer union all select 'c_name', count(*) - count(c_name) from customer)")
def _(s, d):
    return O.null_counts(T(s, d, "customer").select(F.when(C("c_custkey") % 7 != 0, C("c_custkey")).alias("a"), "c_name"))


@query("agg08_describe", "select 'l_quantity' as \"column\", min(l_quantity) \"min\", quantile_cont(l_quantity, 0.25) q1, median(l_quantity) \"median\", round(avg(l_quantity), 6) mean, quantile_cont(l_quantity, 0.75) q3, max(l_quantity) \"max\" from lineitem")
def _(s, d):
    return O.describe(T(s, d, "lineitem"), ["l_quantity"]).withColumn("mean", F.round("mean", 6))


@query("agg09_size_histogram", "select n, count(*) groups from (select o_custkey, count(*) n from orders group by 1) group by 1")
def _(s, d):
    return T(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


@query("agg13_correlations", " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r from lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")))
def _(s, d):
    return O.correlations(T(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@query("agg14_gram", "with m as (select avg(s_acctbal) a, stddev_samp(s_acctbal) sa, avg(s_nationkey) b, stddev_samp(s_nationkey) sb from supplier), z as (select (s_acctbal - a) / sa x, (s_nationkey - b) / sb y from supplier, m) select 's_acctbal' a, 's_acctbal' b, round(sum(x * x) / 1994, 6) s from z union all select 's_acctbal', 's_nationkey', round(sum(x * y) / 1994, 6) from z union all select 's_nationkey', 's_acctbal', round(sum(x * y) / 1994, 6) from z union all select 's_nationkey', 's_nationkey', round(sum(y * y) / 1994, 6) from z")
def _(s, d):
    return O.gram(T(s, d, "supplier"), ["s_acctbal", "s_nationkey"], 1994).withColumn("s", F.round("s", 6))


@query("agg15_explained_variance", "select round((var_samp(l_tax) + var_samp(l_discount)) / (var_samp(l_quantity) + var_samp(l_tax)), 9) ratio from lineitem")
def _(s, d):
    return O.explained(T(s, d, "lineitem"), ["l_tax", "l_discount"], ["l_quantity", "l_tax"]).select(F.round("ratio", 9).alias("ratio"))


@query("agg16_cronbach", "select round(1.5 * (1 - (var_samp(l_tax) + var_samp(l_discount) + var_samp(l_quantity)) / var_samp(l_tax + l_discount + l_quantity)), 6) alpha from lineitem")
def _(s, d):
    return O.cronbach(T(s, d, "lineitem"), ["l_tax", "l_discount", "l_quantity"]).select(r6("alpha"))


@query("agg17_draw_quantiles", "select user_id, round(avg(value), 6) m, round(quantile_cont(value, 0.025), 6) low, round(quantile_cont(value, 0.975), 6) high from events group by 1")
def _(s, d):
    return T(s, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("m"), F.round(F.percentile("value", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("value", F.lit(0.975)), 6).alias("high"))


@query("agg18_21_fit_quality", "select round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 4) rmse, round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) r2 from lineitem")
def _(s, d):
    df = T(s, d, "lineitem").withColumn("p", C("l_quantity") * 1500)
    a = df.agg(F.round(O.rmse(C("l_extendedprice"), C("p")), 4).alias("rmse"))
    return a.crossJoin(O.r_squared(df, "l_extendedprice", "p").select(r6("r2")))  # one row each


@query("agg19_interval_score", "select l_returnflag, round(avg((l_quantity * 0.2) + 40 * (greatest(0.9 * l_quantity - 25, 0) + greatest(25 - 1.1 * l_quantity, 0))), 4) score from lineitem group by 1")
def _(s, d):
    return T(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(O.interval_score(F.lit(25.0), 0.9 * C("l_quantity"), 1.1 * C("l_quantity"))), 4).alias("score"))


def _scored(s, d):
    return T(s, d, "lineitem").select((C("l_returnflag") == "R").cast("int").alias("y"), (C("l_quantity") > 25).cast("int").alias("p"), C("l_discount").alias("score"))


LAB = "with x as (select cast(l_returnflag = 'R' as int) y, cast(l_quantity > 25 as int) p, l_discount score from lineitem) "


@query("agg20_confusion", LAB + "select y, p, count(*) n from x group by 1, 2")
def _(s, d):
    return O.confusion(_scored(s, d), "y", "p")


@query("mod09_class_report", LAB + ", c as (select unnest([0, 1]) k), t as (select k, count(*) filter (y = k) s, count(*) filter (p = k) q, count(*) filter (y = k and p = k) h from x, c group by 1) select k as \"class\", round(h / q, 6) \"precision\", round(h / s, 6) recall, round(2 * (h / q) * (h / s) / ((h / q) + (h / s)), 6) f1, s support from t")
def _(s, d):
    return O.class_report(_scored(s, d), "y", "p").select("class", r6("precision"), r6("recall"), r6("f1"), "support")


@query("agg20_auc", LAB + ", g as (select score, sum(y) pos, count(*) n from x group by 1), r as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 k from g) select round((sum(k * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6) auc from r")
def _(s, d):
    return O.auc(_scored(s, d), "y", "score").select(r6("auc"))


@query("agg22_23_centroid_distinct", "select round(avg(c_acctbal), 4) centre, count(distinct c_nationkey) nations, count(*) n from customer")
def _(s, d):
    return T(s, d, "customer").agg(F.round(F.avg("c_acctbal"), 4).alias("centre"), F.count_distinct("c_nationkey").alias("nations"), F.count("*").alias("n"))


@query("win01_top_per_group", "select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) r from customer) where r = 1")
def _(s, d):
    return O.keep_first(T(s, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey")


@query("win02_first_n", "select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by c_custkey) r from customer) where r <= 20")
def _(s, d):
    return O.first_n(T(s, d, "customer"), ["c_mktsegment"], ["c_custkey"], 20).select("c_mktsegment", "c_custkey")


@query("win08_every_nth", "select doc_id from (select doc_id, row_number() over (partition by source order by doc_id) r from documents) where r % 5 = 0")
def _(s, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return T(s, d, "documents").select("doc_id", F.row_number().over(w).alias("r")).where("r % 5 = 0").select("doc_id")


@query("srt02_nlargest", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10")
def _(s, d):
    return O.top_k(T(s, d, "customer"), "c_acctbal", "c_custkey", 10).select("c_custkey", "c_acctbal")


@query("srt06_max_by", "select max_by(o_orderkey, o_totalprice) k, max(o_totalprice) v from orders")
def _(s, d):
    return T(s, d, "orders").agg(F.max_by("o_orderkey", "o_totalprice").alias("k"), F.max("o_totalprice").alias("v"))


@query("srt07_09_sorted_arrays", "select o_custkey, list_sort(list(o_orderkey)) v from orders group by 1")
def _(s, d):
    return T(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))


@query("set01_union_dedupe", "select key, origin from (select c_nationkey key, 'c' origin, 1 o from customer union all select s_nationkey, 's', 2 from supplier) qualify row_number() over (partition by key order by o) = 1")
def _(s, d):
    a = T(s, d, "customer").select(C("c_nationkey").alias("key"), F.lit("c").alias("origin"), F.lit(1).alias("o"))
    return O.keep_first(a.unionByName(T(s, d, "supplier").select(C("s_nationkey").alias("key"), F.lit("s").alias("origin"), F.lit(2).alias("o"))), ["key"], ["o"]).drop("o")


@query("set04_except", "select c_custkey k from customer except select o_custkey from orders")
def _(s, d):
    return T(s, d, "customer").select(C("c_custkey").alias("k")).subtract(T(s, d, "orders").select("o_custkey"))


@query("set05_distinct_union", "select n_name w from nation union select r_name from region")
def _(s, d):
    return T(s, d, "nation").select(C("n_name").alias("w")).union(T(s, d, "region").select("r_name")).distinct()


@query("rsh01_melt", "select l_orderkey, l_linenumber, unnest(['l_tax', 'l_discount']) variable, unnest([l_tax, l_discount]) \"value\" from lineitem")
def _(s, d):
    return O.melt(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@query("rsh05_split")
def _(s, d):
    return T(s, d, "customer").select("c_custkey", O.split(C("c_custkey"), {"train": 70, "test": 30}).alias("split"))


@query("strf1_normalize", r"select doc_id, lower(trim(regexp_replace(regexp_replace(text, '[‘’]', '''', 'g'), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))) t from documents")
def _(s, d):
    return T(s, d, "documents").select("doc_id", K.normalize_query(C("text")).alias("t"))


@query("strf2_safe_name", r"select doc_id, regexp_replace(substr(text, 1, 50), '[^\p{L}\p{N}\p{M}_\-.]', '_', 'g') t from documents")
def _(s, d):
    return T(s, d, "documents").select("doc_id", K.safe_name(C("text")).alias("t"))


@query("strf4_5_text_parts", "select doc_id, substr(text, 1, 100) a, case when length(text) > 100 then substr(text, 1, 99) else text end b, starts_with(text, 'T') c, contains(text, '. ') e, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x, ' ')), lambda x: x <> '') f from documents")
def _(s, d):
    t = C("text")
    return T(s, d, "documents").select("doc_id", K.truncate(t, 100).alias("a"), K.shorten(t).alias("b"), t.startswith("T").alias("c"), t.contains(". ").alias("e"), K.parts(t, r"\. ").alias("f"))


@query("strf6_7_price", "select p_partkey, round(p_retailprice * 1.1, 4) p, p_size as n, contains(p_name, 'oz') w from part where p_retailprice < 1500")
def _(s, d):
    df = T(s, d, "part").select("p_partkey", K.price(F.concat(F.lit("$"), C("p_retailprice").cast("string"))).alias("v"), K.token_int(F.concat(F.lit("In stock "), C("p_size").cast("string"))).alias("n"), "p_name")
    return df.where("v < 1500").select("p_partkey", F.round(C("v") * 1.1, 4).alias("p"), "n", C("p_name").contains("oz").alias("w"))


@query("urlf1_3_search_url", "select n_nationkey, 'https://x.org/s?q=' || replace(url_encode(lower(n_name)), '%20', '+') || '&page=' || (n_nationkey + 1) u, 'https://x.org/a?query=' || replace(url_encode(n_name), '%20', '+') || '&size=25&start=' || n_nationkey * 25 v from nation")
def _(s, d):
    return T(s, d, "nation").select("n_nationkey", K.search_url("https://x.org/s", C("n_name"), C("n_nationkey") + 1).alias("u"), K.offset_url("https://x.org/a", C("n_name"), C("n_nationkey"), 25).alias("v"))


@query("urlf2_add_page", "select page_id, case when regexp_matches(url, '[?&]page=[0-9]+') then regexp_replace(url, '([?&]page=)[0-9]+', '\\1' || page_id) when contains(url, '?') then url || '&page=' || page_id else url || '?page=' || page_id end u from pages")
def _(s, d):
    return T(s, d, "pages").select("page_id", K.with_page(C("url"), C("page_id")).alias("u"))


@query("datef1_2", "select o_orderkey, regexp_full_match(strftime(o_orderdate, '%d/%m/%Y'), '\\d{2}/\\d{2}/\\d{4}') ok, strftime(o_orderdate, '%d %m %Y') t from orders")
def _(s, d):
    return T(s, d, "orders").select("o_orderkey", K.looks_like_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("ok"), K.date_text(F.concat(F.lit("Submitted "), F.date_format("o_orderdate", "dd MM yyyy"), F.lit(", rest"))).alias("t"))


@query("mathf1_haversine", "with p as (select s_suppkey, radians(s_suppkey % 90) a, radians(s_suppkey % 180) b, radians(45.0) c, radians(7.0) e from supplier), h as (select *, sin((c-a)/2)**2 + cos(a)*cos(c)*sin((e-b)/2)**2 h from p) select s_suppkey, round(2*6371.0*atan2(sqrt(h), sqrt(1-h)), 4) km from h")
def _(s, d):
    return T(s, d, "supplier").select("s_suppkey", F.round(K.haversine((C("s_suppkey") % 90).cast("double"), (C("s_suppkey") % 180).cast("double"), F.lit(45.0), F.lit(7.0)), 4).alias("km"))


@query("mathf4_5_zscore_interval", "with m as (select avg(c_acctbal) m, stddev_samp(c_acctbal) s from customer) select c_custkey, round((c_acctbal - m) / s, 6) z, round(c_acctbal - 1.96 * sqrt(s * s), 4) low, round(2 * 1.96 * sqrt(s * s), 4) width from customer, m")
def _(s, d):
    df = T(s, d, "customer")
    m = df.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))
    low, _, width = K.interval(C("c_acctbal"), C("s") * C("s"))
    return df.crossJoin(F.broadcast(m)).select("c_custkey", F.round((C("c_acctbal") - C("m")) / C("s"), 6).alias("z"), F.round(low, 4).alias("low"), F.round(width, 4).alias("width"))  # one row on the right


@query("mathf7_mod10_argmax", "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) k from embeddings")
def _(s, d):
    return T(s, d, "embeddings").select("vec_id", K.argmax(C("embedding")).alias("k"))


@query("jsonf1_nested_get", "select event_id, coalesce(json_extract_string(props, '$.k'), 'N/A') k, coalesce(json_extract_string(props, '$.missing'), 'N/A') m from events")
def _(s, d):
    return T(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("N/A")).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("N/A")).alias("m"))


@query("arrf1_arrays", "select vec_id, len(embedding) n, list_sum(list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end)) pos, coalesce(list_max(embedding) > 0.2, false) any_big from embeddings")
def _(s, d):
    e = C("embedding")
    return T(s, d, "embeddings").select("vec_id", F.size(e).alias("n"), F.size(F.filter(e, lambda x: x > 0)).alias("pos"), F.exists(e, lambda x: x > 0.2).alias("any_big"))


@query("src15_16_generators")
def _(s, d):
    n = T(s, d, "nation").count()
    return io.erdos_renyi(s, 40 * n).select(C("src").alias("i"), C("weight").alias("v")).unionByName(io.arrays(s, 1000, "duplicates"))


@query("mod02_classifier")
def _(s, d):
    from lodestone.operators.models import train

    df = T(s, d, "lineitem").select((C("l_returnflag") == "N").cast("double").alias("label"), "l_quantity", "l_extendedprice", F.datediff("l_shipdate", F.lit("1990-01-01")).cast("double").alias("day"), "l_linestatus", "l_orderkey")
    part = O.split(C("l_orderkey"), {"train": 70, "test": 30}, seed=123)
    model = train(df.where(part == "train"), ["l_quantity", "l_extendedprice", "day"], ["l_linestatus"], "logistic", maxIter=20)
    return O.confusion(model.transform(df.where(part == "test")), "label", "prediction")
