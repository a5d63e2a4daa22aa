from pyspark.sql import functions as F

from lodestone.functions import columns as K
from lodestone.functions import recode as R


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_missing_is_largest(spark):
    df = spark.createDataFrame([(None,), (5,), (10000,), (10001,), (30000,), (30001,)], "y int")
    got = [r[0] for r in df.select(R.bands(F.col("y"), [10000, 20000, 30000])).collect()]
    assert got == [4, 1, 1, 2, 3, 4]
    assert [r[0] for r in df.select(R.above(F.col("y"), 10000)).collect()] == [True, False, False, True, True, True]
    assert [r[0] for r in df.select(R.flag(F.col("y") > 10000)).collect()] == [0, 0, 0, 1, 1, 1]


def test_recode_first_rule_wins_and_gaps_stay(spark):
    df = spark.createDataFrame([(float(x),) for x in (-60000, -49999.5, -25000, -0.05, 0, 0.15, 24999.5, 25000)], "x double")
    rules = [(-200000, -49999, 1.0), (-50000, -24999, 2.0), (-24999, -0.1, 3.0), (-0.1, 0.1, 4.0), (0.2, 25000, 5.0), (25000, None, 6.0)]
    assert [r[0] for r in df.select(R.recode(F.col("x"), rules)).collect()] == [1, 1, 2, 4, 4, 0.15, 5, 5]


def test_last_statement_wins_and_cut(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 2)], "a int, b int")
    assert [r[0] for r in df.select(R.replace_all(None, [(F.col("a") == 1, 10), (F.col("b") == 2, 20)])).collect()] == [10, 20, 20]
    assert [r[0] for r in spark.createDataFrame([(17,), (18,), (30,), (90,), (None,)], "e int").select(R.cut(F.col("e"), [18, 30, 90])).collect()] == [None, 18, 30, None, None]


def test_text_and_urls(spark):
    r = one(
        spark, q=K.normalize_query(F.lit("  A’b  C ")), n=K.normalize_query(F.lit("ﬁX"), compose=True), s=K.safe_name(F.lit("Für a/b.c")), p=K.price(F.lit("$12.50")), bad=K.price(F.lit("n/a")), parts=K.parts(F.lit("a |  b || "), r"\|"),
        page=K.with_page(F.lit("http://x/y?page=3&z=1"), F.lit(7)), j=K.url_join(F.lit("http://x.org/a/b"), F.lit("/c")), k=K.url_join(F.lit("http://x.org/a/b"), F.lit("c")), u=K.search_url("http://x/s", F.lit("a b"), F.lit(1), F.lit("it")),
        d=K.looks_like_date(F.lit("31/02/2020")), dt=K.date_text(F.lit("Submitted 3 May, 2020")), h=K.heading_level(F.lit("## x")), top=K.top_classes(F.array(*map(F.lit, (0.1, 0.5, 0.4, 0.0)))), tag=K.first_tag(F.lit("<h1> </h1><p>A <b>b</b></p>"), "h1", "p"), none=K.first_tag(F.lit("x"), "h1"),
    )
    assert (r.q, r.n, r.s, r.p, r.bad, r.parts) == ("a'b c", "fix", "Für_a_b.c", 12.5, None, ["a", "b"])
    assert (r.page, r.j, r.k, r.u) == ("http://x/y?page=7&z=1", "http://x.org/c", "http://x.org/a/c", "http://x/s?q=a+b&page=1&lang=it")
    assert (r.d, r.dt, r.h, r.top, r.tag, r.none) == (True, "3 May", 2, [1, 2, 0], "A b", "N/A")


def test_traffic_hours(spark):
    df = spark.range(24).select(K.traffic_factor(F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.col("id").cast("int"), F.lit(0), F.lit(0))).alias("f"))
    got = [r.f for r in df.collect()]
    assert [h for h, f in enumerate(got) if f == 2.0] == [7, 8, 9, 17, 18, 19] and [h for h, f in enumerate(got) if f == 0.8] == [0, 1, 2, 3, 4, 5, 6, 22, 23]


def test_nfkc_is_that_of_python_without_python_workers(spark):
    import unicodedata

    known = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    texts = [*("".join(x) for x in zip(known[::7], known[::11], known[3::13])), "ﬁ ①\u00a0Å e\u0301\u0323 한 ㍍ \U0001f600", "plain", "", None]
    texts += ["".join(known[i : i + 50]) for i in range(0, len(known), 50)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", K.nfkc(F.col("t")).alias("t"))
    assert {r.i: r.t for r in got.collect()} == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    plan = spark.range(1).select(K.normalize_query(F.col("id").cast("string"), compose=True))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
