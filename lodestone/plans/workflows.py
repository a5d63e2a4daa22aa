"""Reading and writing files of documents, loads, splits, networks and model selection."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from lodestone.functions import columns as K
from lodestone.operators import benchmarks, models
from lodestone.operators import geo
from lodestone.operators import graph as G
from lodestone.operators import relational as O
from lodestone.sources import io
from lodestone.sources.io import table as T
from lodestone.streaming import incremental as I

from . import documents
from .registry import ORACLE, QUERIES, query

C = F.col


def _json_folder(s, d):
    """Files of up to 100 documents each as a list, one of a single document, a manifest and a broken file."""
    at = io.work_folder(s, "documents")
    rows = T(s, d, "documents").select("doc_id", "lang", "n_chars").withColumn("g", F.floor(C("doc_id") / 100))
    rows.groupBy("g").agg(F.to_json(F.collect_list(F.struct("doc_id", "lang", "n_chars"))).alias("value")).write.partitionBy("g").text(at)
    system, base = fs.FileSystem.from_uri(at)
    for name, text in (("one.json", '{"doc_id": -1,\n "lang": "xx", "n_chars": 5}'), ("vector_db_manifest_1.json", '{"doc_id": -2}'), ("broken.json", '{"doc_id": ')):
        with system.open_output_stream(f"{base}/g=0/{name}", compression=None) as sink:
            sink.write(text.encode())
    return io.read_documents(s, at, "doc_id long, lang string, n_chars long")


@query("src06_read_documents", "select doc_id, lang, n_chars from documents union all select -1, 'xx', 5")
def _(s, d):
    return _json_folder(s, d).where("_corrupt is null").select("doc_id", "lang", "n_chars")


@query("src07_corrupt_files", "select 'broken.json' as file, 1 as n")
def _(s, d):
    return _json_folder(s, d).where("_corrupt is not null and doc_id is null").groupBy(C("_file").alias("file")).agg(F.count("*").cast("int").alias("n"))


@query("snk03_04_json_append", "select c_custkey, c_name, c_nationkey from customer")
def _(s, d):
    at, rows = io.work_folder(s, "json"), T(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    io.write_json(rows.where("c_nationkey < 12"), at, by="c_nationkey")
    io.write_json(rows.where("c_nationkey >= 12"), at, by="c_nationkey", mode="append")
    return s.read.schema("c_custkey long, c_name string, c_nationkey int").json(at)


@query("snk09_manifest_file", ORACLE["doc10_manifest"])
def _(s, d):
    found, at = QUERIES["doc10_manifest"](s, d), io.work_folder(s, "manifest")
    io.write_json(found, at)
    return s.read.schema(found.schema).json(at)


@query("flt07_jfif", "select page_id from pages where page_id % 3 = 0")
def _(s, d):
    head = F.when(C("page_id") % 3 == 0, F.unhex(F.lit("FFD8FFE000104A46494600"))).when(C("page_id") % 3 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("FFD8FFE1004A46494600")))
    return T(s, d, "pages").withColumn("content", head).where(io.is_jfif(C("content"))).select("page_id")


@query("src13_street_network", "select l_orderkey u, l_linenumber k, round(l_quantity * 100 / (case l_returnflag when 'A' then 110.0 when 'N' then 50.0 else 30.0 end / 3.6), 6) travel_time from lineitem")
def _(s, d):
    edges = T(s, d, "lineitem").select(C("l_orderkey").alias("u"), C("l_linenumber").alias("k"), (C("l_quantity") * 100).alias("length"), C("l_returnflag").alias("highway"))
    return io.street_network(edges.select("u"), edges, {"A": 110.0, "N": 50.0})[1].select("u", "k", F.round("travel_time", 6).alias("travel_time"))


@query("gra15_multi_objective", "select o_orderkey src, o_custkey dst, round(o_totalprice / 1000 + 2 * o_totalprice / 600, 4) weight from orders where o_orderstatus <> 'F'")
def _(s, d):
    edges = T(s, d, "orders").select(C("o_orderkey").alias("src"), C("o_custkey").alias("dst"), C("o_totalprice").alias("length"), C("o_totalprice").alias("travel_time"), F.when(C("o_orderstatus") == "F", "motorway").otherwise("street").alias("highway"))
    found = G.multi_objective(edges, 1.0, 2.0, 3.0, per_minute=600.0)  # travel times in tenths of seconds
    # rounded as SQL does, on the scaled double: F.round goes by the shortest decimal, and ties differ
    return found.where("toll = 0").select("src", "dst", (F.round(C("weight") * 10_000) / 10_000).alias("weight"))


@query("gra21_sort_benchmark")
def _(s, d):
    return benchmarks.sorting(s, (100, 2_000, 20_000), runs=3)


@query("gra23_sample_pairs")
def _(s, d):
    return G.sample_pairs(T(s, d, "customer").select(C("c_custkey").alias("id")), 20)


@query("prj07_features_target", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment as target from customer")
def _(s, d):
    features, target = O.features_target(T(s, d, "customer"))
    return T(s, d, "customer").select(*features, C(target).alias("target"))


@query("join12_close_words", """with w as (select distinct p_type from part), n as (select distinct replace(p_type, 'A', 'E') word from part),
m as (select p_type as name, word, 1 - levenshtein(p_type, word) * 1.0 / greatest(length(p_type), length(word)) s from w, n),
e as (select *, max(case when s = 1 then 1 else 0 end) over (partition by name) exact from m where s >= 0.6),
r as (select *, row_number() over (partition by name order by s desc, word) k from e)
select name, word, round(s, 6) similarity, k as rank from r where (exact = 1 and s = 1) or (exact = 0 and k <= 3)""")
def _(s, d):
    names = T(s, d, "part").select(C("p_type").alias("name")).distinct()
    return O.close_matches(names, names.select(F.replace("name", F.lit("A"), F.lit("E")).alias("word")).distinct(), 0.6).select("name", "word", F.round("similarity", 6).alias("similarity"), "rank")


_URGENT, _LOW = "select distinct o_custkey k from orders where o_orderpriority = '1-URGENT' and o_totalprice > 150000", "select distinct o_custkey k from orders where o_orderpriority = '5-LOW'"


def _customers(s, d, which):
    o = T(s, d, "orders")
    return o.where((C("o_orderpriority") == "1-URGENT") & (C("o_totalprice") > 150000) if which else C("o_orderpriority") == "5-LOW").select(C("o_custkey").alias("k"))


@query("set04_except_some", f"{_URGENT} except {_LOW}")
def _(s, d):
    return _customers(s, d, True).subtract(_customers(s, d, False))


@query("str03_both_changes", f"with a as ({_URGENT}), b as ({_LOW}) select k, 'removed' change from a where k not in (select k from b) union all select k, 'added' from b where k not in (select k from a)")
def _(s, d):
    return I.changes(_customers(s, d, True), _customers(s, d, False), "k")


@query("agg10_nested_totals", "select sum(case when doc_id % 4 <> 0 then n_chars end) chars, count(*) filter (doc_id % 4 <> 0 and n_chars is not null) n from documents")
def _(s, d):
    nested = T(s, d, "documents").select(F.when(C("doc_id") % 4 != 0, F.struct("n_chars")).alias("document_content"))
    return nested.agg(F.sum("document_content.n_chars").alias("chars"), F.count("document_content.n_chars").alias("n"))


@query("agg12_shape", "select count(*) n_rows, 8 n_columns from orders")
def _(s, d):
    return O.shape(T(s, d, "orders").select("*", F.lit(0).alias("a"), F.lit(1).alias("b")))


@query("srt05_capped_load", "select url, min(page_id) ordinal from pages where url not in (select url from pages where page_id < 20) group by 1 order by 2, 1 limit 15")
def _(s, d):
    pages = T(s, d, "pages").select("url", C("page_id").alias("ordinal"))
    return I.plan_load(pages, pages.where("ordinal < 20"), cap=15)


@query("rsh03_grid_matrix", "select c_nationkey, count(*) filter (c_mktsegment = 'BUILDING') as BUILDING, count(*) filter (c_mktsegment = 'MACHINERY') as MACHINERY from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1 having count(distinct c_mktsegment) = 2")
def _(s, d):
    cells = T(s, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return O.spread(cells, "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "n").dropna()


@query("rsh05_stratified", "select c_mktsegment, cast(ceil(0.7 * (count(*) - 1)) as bigint) n_train, count(*) - cast(ceil(0.7 * (count(*) - 1)) as bigint) n_test from customer group by 1")
def _(s, d):
    parts = O.stratified(T(s, d, "customer"), "c_custkey", "c_mktsegment", 0.7)
    return parts.groupBy("c_mktsegment").agg(F.count_if(C("split") == "train").alias("n_train"), F.count_if(C("split") == "test").alias("n_test"))


@query("rsh05_holdouts")
def _(s, d):
    rows = T(s, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("fold"))
    marked = rows.withColumn("at", F.pmod(F.xxhash64("c_custkey", "fold"), F.lit(100)))
    return marked.withColumn("split", F.when(C("at") < 90, "train").otherwise("test")).groupBy("fold", "split").agg(F.count("*").alias("n"))


@query("strf8_lookahead", "select p_partkey, p_name as product from part")
def _(s, d):
    text = F.concat(F.lit("Anno: 2020\nProdotto: "), C("p_name"), F.lit("\nEdizioni: x\n"))
    return T(s, d, "part").select("p_partkey", K.labelled(text, "Prodotto", "Edizioni").alias("product"))


@query("mathf8_rescale", "select event_id, round(least(greatest(value / 255, 0), 1), 6) v from events")
def _(s, d):
    return T(s, d, "events").select("event_id", F.round(K.noisy(C("value") / 255, 0.0, 1), 6).alias("v"))


@query("mod10_top_classes", "with p as (select o_orderkey, unnest([0, 1, 2]) c, unnest([o_totalprice / 500000, o_custkey / 150.0, o_orderkey / 1500.0]) v from orders), r as (select *, row_number() over (partition by o_orderkey order by v desc, c) k from p) select o_orderkey, list(c order by k) top from r where k <= 2 group by 1")
def _(s, d):
    return T(s, d, "orders").select("o_orderkey", K.top_classes(F.array(C("o_totalprice") / 500000, C("o_custkey") / 150.0, C("o_orderkey") / 1500.0), 2).alias("top"))


@query("src16_arrays", "select 'sorted' as kind, 999 ups, 1000 n union all select 'reversed', 0, 1000")
def _(s, d):
    ups = lambda kind: io.arrays(s, 1000, kind).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x")).select(F.lit(kind).alias("kind"), F.size(F.filter("x", lambda e, i: e["v"] < F.get("x", i + 1)["v"])).alias("ups"), F.size("x").alias("n"))
    return ups("sorted").unionByName(ups("reversed"))


@query("geo01_detrended")
def _(s, d):
    points = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", C("l_quantity").alias("x"), (C("l_discount") * 100).alias("y"), C("l_extendedprice").alias("z"))
    return geo.detrend(points, order=1).select("l_orderkey", "l_linenumber", F.round("r", 4).alias("r"))


def _labelled(s, d):
    return T(s, d, "lineitem").select((C("l_returnflag") == "N").cast("double").alias("label"), "l_quantity", "l_extendedprice", F.datediff("l_shipdate", F.lit("1990-01-01")).cast("double").alias("day"), "l_linestatus", "l_orderkey")


_NUMBERS = ["l_quantity", "l_extendedprice", "day"]


@query("mod02_forest_boosting")
def _(s, d):
    rows, part = _labelled(s, d), O.split(C("l_orderkey"), {"train": 70, "test": 30}, seed=123)
    kinds = {"forest": {"numTrees": 20, "maxDepth": 5}, "boosting": {"maxIter": 5, "maxDepth": 3}}
    found = models.trained(rows.where(part == "train"), _NUMBERS, ["l_linestatus"], [models.classifier(kind, **params) for kind, params in kinds.items()])
    out = [O.confusion(model.transform(rows.where(part == "test")), "label", "prediction").withColumn("kind", F.lit(kind)) for kind, model in zip(kinds, found, strict=True)]
    return out[0].unionByName(out[1])


@query("mod03_grid_search")
def _(s, d):
    _, best, every = models.grid_search(_labelled(s, d), _NUMBERS, ["l_linestatus"], "logistic", {"regParam": [0.0, 0.1], "elasticNetParam": [0.0]}, folds=3)
    return s.createDataFrame([(str(x), float(a), x == best) for x, a in every], "settings string, accuracy double, best boolean")


@query("mod04_network")
def _(s, d):
    rows, part = _labelled(s, d), O.split(C("l_orderkey"), {"train": 70, "test": 30}, seed=123)
    model = models.train(rows.where(part == "train"), _NUMBERS, [], "network", layers=[3, 8, 4, 2], maxIter=30)
    return O.confusion(model.transform(rows.where(part == "test")), "label", "prediction")


assert documents  # registers what the manifest's query uses
