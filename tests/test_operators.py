import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import documents as D
from lodestone.operators import geo, indices, models
from lodestone.operators import graph as G
from lodestone.operators import relational as O
from lodestone.sources import io
from lodestone.streaming import incremental as I


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def test_joinby_keeps_left(spark):
    a, b = spark.createDataFrame([(1, "l"), (1, "m")], "k int, v string"), spark.createDataFrame([(1, "r", i) for i in range(3)], "k int, v string, w int")
    got = O.joinby(a, b, "k").collect()
    assert len(got) == 6 and {r.v for r in got} == {"l", "m"}


def test_tables_and_figures_match_a_loop(spark):
    rng = random.Random(1)
    kinds = ["a | b", "--- | ---", "text", "", "# head", "Tabella 1", "![x](y)", "  # in"]
    texts = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    rows = D.lines(spark.createDataFrame(texts, "doc_id long, text string"))
    for flush in (False, True):
        expect = []
        for doc, text in texts:
            lines, at, no = text.split("\n"), 0, 0
            while at < len(lines):
                if "|" in lines[at] and "-" in lines[at]:
                    start = at
                    while at < len(lines) and "|" in lines[at]:
                        at += 1
                    if at < len(lines) or flush:
                        no += 1
                        cap = next((x.strip() for x in lines[max(0, start - 5) : start] if "Tabella" in x), "N/A")
                        expect.append((doc, no, start, at - start, cap))
                else:
                    at += 1
        got = sorted((r.doc_id, r.table_no, r.start, r.n_rows, r.caption) for r in D.tables(rows, flush).collect())
        assert got == sorted(expect)
    expect = []
    for doc, text in texts:
        lines = text.split("\n")
        for i in [i for i, x in enumerate(lines) if "![" in x]:
            expect.append((doc, i, next((x.strip() for x in lines[i + 1 : i + 5] if x.strip() and not x.strip().startswith("#")), "N/A")))
    assert sorted((r.doc_id, r.pos, r.caption) for r in D.figures(rows).collect()) == sorted(expect)


def test_ampi_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 9.0), ("b", 1, 3.0, 7.0), ("a", 2, 2.0, 8.0), ("b", 2, 4.0, 5.0)], "u string, t int, x double, y double")
    r = indices.ampi(df, "u", "t", {"x": "POS", "y": "NEG"}, 1).where("u = 'a' and t = 1").first()
    # medians 2 and 8; half ranges 1.5 and 2
    nx, ny = 60 * (1 - 0.5) / 3 + 70, 60 * (10 - 9) / 4 + 70
    m, s = (nx + ny) / 2, abs(nx - ny) / math.sqrt(2)
    assert (r.n_x, r.n_y) == (pytest.approx(nx), pytest.approx(ny)) and r.score == pytest.approx(m - s * s / m)


def test_graph_small(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (1, 2, 9.0), (5, 6, 1.0)])
    assert {r.node: r.comp for r in G.components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    d = G.distances(e, 1)
    assert G.path_to(d, 3) == ([1, 2, 3], 2.0) and G.path_to(d, 6) == (None, math.inf) and G.path_to(d, 1) == ([1], 0.0)
    s = G.simple(e)
    assert G.clustering(s).first()[0] == pytest.approx(3 / 5)
    assert sum(r["rank"] for r in G.pagerank(s).collect()) == pytest.approx(1)


def test_graph_agreement(spark):
    rng = random.Random(2)
    rows = [(a, b, float(rng.randint(1, 20))) for a in range(30) for b in range(30) if a != b and rng.random() < 0.12]
    e = edges(spark, rows)
    nodes = spark.createDataFrame([(i, 0.0, 0.0) for i in range(30)], "id long, x double, y double")
    d = G.distances(e, 0)
    for t in (7, 19, 29):
        assert G.a_star(e, nodes, 0, t, "weight")[1] == pytest.approx(G.path_to(d, t)[1], abs=0.01)
    both = {(min(a, b), max(a, b)): min(w for x, y, w in rows if {x, y} == {a, b}) for a, b, _ in rows}
    root, total = list(range(30)), 0.0
    find = lambda v: v if root[v] == v else find(root[v])
    for (a, b), w in sorted(both.items(), key=lambda x: x[1]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    assert G.minimum_spanning_tree(e).agg(F.sum("weight")).first()[0] == pytest.approx(total)


def test_communities(spark):
    cliques = [(a, b, 1.0) for g in (range(0, 6), range(6, 12)) for a in g for b in g if a < b] + [(5, 6, 1.0)]
    e = edges(spark, cliques)
    found = G.louvain(e)
    assert {frozenset(v for v in found if found[v] == c) for c in set(found.values())} == {frozenset(range(6)), frozenset(range(6, 12))}
    assert sorted(map(sorted, G.girvan_newman(e, 2))) == [list(range(6)), list(range(6, 12))]
    q = G.modularity(G.simple(e), spark.createDataFrame(list(found.items()), "node long, comp long")).first()[0]
    assert -0.5 <= q <= 1 and q > 0.4
    assert G.betweenness(G.simple(e)).orderBy(F.desc("betweenness")).first().node in (5, 6)


def test_kriging_is_exact_without_nugget(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 2.0), (0.0, 1.0, 4.0), (2.0, 2.0, 3.0)], "x double, y double, z double")
    p = {"model": "exponential", "sill": 1.0, "scale": 2.0, "nugget": 0.0, "kappa": 0.5, "order": 0}
    got = {(r.x, r.y): (r.prediction, r.variance) for r in geo.krige(pts, pts.select("x", "y"), p).collect()}
    assert got[1.0, 0.0][0] == pytest.approx(2.0, abs=1e-5) and got[1.0, 0.0][1] == pytest.approx(0, abs=1e-5)
    assert geo.cross_validate(pts, p).count() == 4
    assert geo.bessel_k(0.5, np.array([1.0]))[0] == pytest.approx(math.sqrt(math.pi / 2) * math.exp(-1), rel=1e-5)
    line = spark.createDataFrame([(i, float(i), 0.0, float(i * i)) for i in range(4)], "id int, x double, y double, z double")
    v = {r.bin: (r.n, r.gamma) for r in geo.variogram(line, 1.0, 4.0).collect()}
    assert v[1] == (3, pytest.approx((1 + 9 + 25) / 6)) and v[3] == (1, pytest.approx(81 / 2))


def test_ordered_probit_recovers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    y = np.digitize(0.8 * x + rng.normal(size=3000), [-0.5, 0.7])
    got = {r.term: r for r in models.ordered_probit(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x, strict=True)], "y int, x double"), "y", ["x"]).collect()}
    assert got["x"].estimate == pytest.approx(0.8, abs=0.1) and got["cut1"].estimate == pytest.approx(-0.5, abs=0.1) and got["cut2"].estimate == pytest.approx(0.7, abs=0.1)
    assert 0.01 < got["x"].se < 0.05


def test_incremental_stream(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    process = lambda df: df.withColumn("status", F.when(F.col("url") == "bad", "error").otherwise("success"))
    for batch in ([("a",), ("b",), ("bad",)], [("b",), ("c",), ("bad",)]):
        spark.createDataFrame(batch, "url string").write.mode("append").parquet(src)
        I.stream_load(spark, src, "url string", "url", process, sink, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(sink + "_failed").count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"u": "x"}, {"u": "y"}]')
    (tmp_path / "b.json").write_text('{"u": "z"}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "vector_db_manifest_1.json").write_text('{"u": "m"}')
    rows = io.read_documents(spark, str(tmp_path / "*.json"), "u string").collect()
    assert sorted(r.u for r in rows if r.u) == ["x", "y", "z"] and sum(r._corrupt is not None for r in rows) == 1
    assert io.barabasi_albert(spark, 50, 3).count() == 141
    listing = spark.createDataFrame([("l", i, n) for i, n in enumerate([5, 0, 3, 0, 0, 9])], "listing string, page int, n_found int")
    assert sorted(r.page for r in io.pages_until(listing).collect()) == [0, 1, 2, 3, 4]


def test_multi_objective_weights(spark):
    rows = [(i, i + 1, 1000.0 * i, 60.0 * i, "motorway" if i % 2 else "street") for i in range(20)]
    got = G.multi_objective(spark.createDataFrame(rows, "src long, dst long, length double, travel_time double, highway string"), 1, 2, 3).collect()
    assert all(r.weight == pytest.approx(r.src + 2 * r.src + 3 * r.toll) and (1 <= r.toll <= 5) == (r.src % 2 == 1) for r in got)
    assert len({r.toll for r in got}) > 5


def test_detrended_residuals_are_those_of_least_squares(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 200))
    z = 1 + 2 * x - y + 0.5 * x * y + rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))], "id long, x double, y double, z double")
    for order, terms in ((1, [np.ones(200), x, y]), (2, [np.ones(200), x, y, x * x, y * y, x * y])):
        a = np.column_stack(terms)
        want = z - a @ np.linalg.lstsq(a, z, rcond=None)[0]
        assert np.allclose([r.r for r in geo.detrend(df, order).orderBy("id").collect()], want, atol=1e-8)


def test_stata_files_and_image_folders(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"nquest": [1, 2, 3], "eta": [30.0, None, 50.0]}).to_stata(tmp_path / "q.dta", write_index=False)
    assert {(r.nquest, r.eta if r.eta == r.eta else None) for r in io.read_stata(spark, str(tmp_path / "q.dta")).collect()} == {(1, 30.0), (2, None), (3, 50.0)}
    for label, head in (("rose", b"\xff\xd8\xff\xe0\x00\x10JFIF\x00"), ("tulip", b"\x89PNG\r\n\x1a\n")):
        (tmp_path / "img" / label).mkdir(parents=True)
        for i in range(4):
            (tmp_path / "img" / label / f"{i}.jpg").write_bytes(head + bytes(i))
    got = io.images(spark, str(tmp_path / "img"))
    assert {r.label for r in got.where(io.is_jfif(F.col("content"))).collect()} == {"rose"} and got.count() == 8


def test_forest_boosting_and_grid_search_learn(spark):
    rng = random.Random(4)
    rows = [(float(i % 2), rng.gauss(2.0 * (i % 2), 0.6), rng.gauss(0, 1), "ab"[i % 2] if rng.random() < 0.7 else "c") for i in range(400)]
    df = spark.createDataFrame(rows, "label double, x double, y double, c string")
    for kind, params in (("forest", {"numTrees": 10}), ("boosting", {"maxIter": 5}), ("network", {"layers": [2, 4, 2], "maxIter": 60})):
        found = models.train(df, ["x", "y"], [] if kind == "network" else ["c"], kind, **params)
        assert found.transform(df).where("label = prediction").count() > 360
    _, best, every = models.grid_search(df, ["x", "y"], ["c"], "logistic", {"regParam": [0.0, 50.0]}, folds=3)
    assert len(every) == 2 and dict(best) == max(every, key=lambda e: e[1])[0]


def test_sampled_pairs_and_holdouts(spark):
    got = G.sample_pairs(spark.range(1000), 30).collect()
    assert len(got) == 30 and len({x for r in got for x in (r.origin, r.destination)}) == 60
    assert G.sample_pairs(spark.range(1000), 30).collect() == got


def test_graph_benchmark_reports_each_case(spark):
    from lodestone.operators import benchmarks

    got = benchmarks.graphs(spark, (30,), runs=1).collect()
    assert [(r.algorithm, r.size) for r in got] == [("bfs", 30), ("distances", 30), ("spanning tree", 30)] and all(0 < r.min_time <= r.mean_time <= r.max_time for r in got)


def test_paths_that_are_cut_are_errors(spark):
    line = G.distances(edges(spark, [(i, i + 1, 1.0) for i in range(6)]), 0)
    assert G.path_to(line, 6)[0] == list(range(7))
    with pytest.raises(RuntimeError):
        G.path_to(line, 6, most=3)
    with pytest.raises(RuntimeError):
        G.bfs(edges(spark, [(i, i + 1, 1.0) for i in range(6)]).select("src", "dst"), 0, rounds=3)


def test_near_pairs_match_a_loop(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(60) if i % 9 else None, rng.choice([rng.uniform(-40, 40), 3.0, 0.0]), rng.choice([rng.uniform(-40, 40), 5.0]), i) for i in range(150)]
    rows += [(70, float("nan"), 0.0, 150), (71, float("inf"), 0.0, 151), (72, float("inf"), 0.0, 152), (73, 1e300, 0.0, 153), (74, 1e300, 3.0, 154), (75, None, 0.0, 155), (76, -1e-20, 90.0, 156), (77, 20.0, 90.0, 157)]
    want = []
    for i, x, y, v in rows:
        for j, p, q, w in rows:
            if None not in (i, j, x, p) and i < j and (x - p) * (x - p) + (y - q) * (y - q) <= 400:
                want.append((i, x, y, v, j, p, q, w, math.sqrt((x - p) * (x - p) + (y - q) * (y - q))))
    df = spark.createDataFrame(rows, "id long, lon double, lat double, v int")
    for block in (7, 2000):
        monkeypatch.setattr(O, "BLOCK", block, raising=False)
        assert sorted(map(tuple, O.near_pairs(df, 20.0, x="lon", y="lat").collect())) == sorted(want)
    assert O.near_pairs(df.where("v < 0"), 20.0, x="lon", y="lat").count() == 0


def test_pairs_of_one_cell_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 50, raising=False)
    monkeypatch.setattr(O, "TASK_PAIRS", 20_000, raising=False)
    points = spark.range(1000).selectExpr("id", "cast(id % 4 as double) x", "cast(id % 3 as double) y")
    per = [r["count"] for r in O.near_pairs(points, 20.0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 1000 * 999 // 2 and max(per) < sum(per) / 8


def test_variogram_pairs_places_not_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randrange(150), float(rng.randrange(6)), rng.choice([0.0, 1.5, 40.0]), rng.choice([None, rng.uniform(-9, 9), 1e6])) for _ in range(200)] + [(None, 0.0, 0.0, 1.0), (900, None, 0.0, 1.0), (901, 500.0, 0.0, 1.0)]
    want = {}
    for i, (a, x, y, z) in enumerate(rows):
        for b, p, q, w in rows[:i]:
            if None not in (a, b, x, p) and a != b and (d := math.hypot(x - p, y - q)) < 4:
                want.setdefault(int(d / 0.7), []).append((d, None if None in (z, w) else (z - w) ** 2 / 2))
    sizes, pairs = [], geo.near_pairs
    monkeypatch.setattr(geo, "near_pairs", lambda points, *a: sizes.append(points.count()) or pairs(points, *a))
    got = {r.bin: r for r in geo.variogram(spark.createDataFrame(rows, "id long, x double, y double, z double"), 0.7, 4.0).collect()}
    assert sizes == [len({r[1:3] for r in rows if r[0] is not None and r[1] is not None})]
    assert {k: v.n for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        g = [y for _, y in v if y is not None]
        assert got[k].distance == pytest.approx(sum(d for d, _ in v) / len(v)) and got[k].gamma == pytest.approx(sum(g) / len(g))


def mixed_rows(spark, n=600):
    rng = random.Random(8)
    kinds = ["a", "it's", "b\\c", "c", None]
    return spark.createDataFrame([(float(i % 2), rng.gauss(0.8 * (i % 2), 1), rng.randint(0, 9), rng.choice(kinds[i % 2 :]), 3.5) for i in range(n)], "label double, x double, `n 1` int, c string, same double").repartition(3, "x").sortWithinPartitions("x").localCheckpoint()


def stock(numbers, categories):
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categories]
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_h" for c in categories])
    return [*index, hot, VectorAssembler(inputCols=numbers, outputCol="_numbers", handleInvalid="keep"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True), VectorAssembler(inputCols=["_scaled", *(f"{c}_h" for c in categories)], outputCol="features")]


def test_features_cost_one_function_a_row(spark):
    df = mixed_rows(spark)
    found = models.train(df, ["x", "n 1", "same"], ["c"], "logistic")
    plan = found.transform(df).select("features")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("UDF(") == 1


def test_features_and_models_are_those_of_the_stock_stages(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    df, numbers = mixed_rows(spark), ["x", "n 1", "same"]
    for kind, params in (("logistic", {}), ("forest", {"numTrees": 5}), ("boosting", {"maxIter": 3})):
        old, new = (m.transform(df).select("features", "prediction").collect() for m in (Pipeline(stages=[*stock(numbers, ["c"]), models.classifier(kind, **params)]).fit(df), models.train(df, numbers, ["c"], kind, **params)))
        assert np.allclose([r.features.toArray() for r in old], [r.features.toArray() for r in new], atol=1e-12)
        assert [r.prediction for r in old] == [r.prediction for r in new]
    model = models.classifier("logistic")
    maps = [{model.regParam: 0.0}, {model.regParam: 0.4, model.elasticNetParam: 0.5}]
    want = CrossValidator(estimator=Pipeline(stages=[*stock(numbers, ["c"]), model]), estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=3, seed=42).fit(df)
    _, best, got = models.grid_search(df, numbers, ["c"], "logistic", {"regParam": [0.0, 0.4], "elasticNetParam": [0.0, 0.5]})
    for m, mean in zip(maps, want.avgMetrics, strict=True):
        wanted = {"regParam": m[model.regParam], "elasticNetParam": m.get(model.elasticNetParam, 0.0)}
        assert [a for x, a in got if x == wanted] == [pytest.approx(mean, abs=1e-12)]
    assert dict(best) == max(got, key=lambda e: e[1])[0]


def test_forest_and_boosting_share_their_preprocessing(spark, monkeypatch):
    import os

    import lodestone.plans  # noqa: F401
    from lodestone.plans import registry

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables here")
    calls, own = [], models.preprocessing
    monkeypatch.setattr(models, "preprocessing", lambda *a, **k: calls.append(1) or own(*a, **k))
    assert {r.kind for r in registry.QUERIES["mod02_forest_boosting"](spark, at).collect()} == {"forest", "boosting"} and len(calls) == 1
