"""Joins, tabulations, summaries and reshaping as DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joinby(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner many-to-many join; of columns that both sides have, the left one stays."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != on]), on, "inner")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_n(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def top_k(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def not_loaded(new: DataFrame, loaded: DataFrame, key: str, fallbacks: Sequence[str] = ()) -> DataFrame:
    """Rows whose key (the first non-empty of key and fallbacks) was not loaded before; rows without any key stay."""
    value = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (key, *fallbacks)])
    old = loaded.select(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (key, *fallbacks) if c in loaded.columns]).alias("_key")).where("_key is not null").distinct()
    return new.withColumn("_key", value).join(old, "_key", "left_anti").drop("_key")


def one_way(df: DataFrame, c: str, weight: str | None = None) -> DataFrame:
    """value, n (or summed weight), percent, cumulative percent."""
    g = df.where(F.col(c).isNotNull()).groupBy(c).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    every = Window.partitionBy()  # as many rows as the variable has values
    return g.withColumn("percent", 100 * F.col("n") / F.sum("n").over(every)).withColumn("cumulative", 100 * F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(every))


def two_way(df: DataFrame, row: str, column: str, weight: str | None = None) -> DataFrame:
    """row, column, n, row_percent, column_percent; rows with a missing member are left out."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    if weight:
        known = known.where(F.col(weight).isNotNull())
    g = known.groupBy(row, column).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return g.withColumn("row_percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(row))).withColumn("column_percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(column)))


def null_counts(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "nulls")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, min, q1, median, mean, q3, max with linearly interpolated quantiles."""
    stats = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"), F.percentile(c, F.lit(0.25)).alias("q1"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.75)).alias("q3"), F.max(c).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for all pairs of columns, in one pass over the rows."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a in columns for b in columns]
    return df.agg(F.array(*pairs).alias("s")).select(F.inline("s"))


def gram(df: DataFrame, columns: Sequence[str], divisor: float) -> DataFrame:
    """a, b, s = sum of z(a) z(b) / divisor over rows, z-scores with n - 1."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = df.crossJoin(F.broadcast(stats)).select(*[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in columns])  # one row on the right
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.sum(F.col(a) * F.col(b)) / divisor).alias("s")) for a in columns for b in columns]
    return z.agg(F.array(*pairs).alias("s")).select(F.inline("s"))


def cronbach(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    k = len(columns)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    each = reduce(lambda a, b: a + b, [F.var_samp(c) for c in columns])
    return df.agg((k / (k - 1) * (1 - each / F.var_samp(total))).alias("alpha"))


def explained(df: DataFrame, scores: Sequence[str], data: Sequence[str]) -> DataFrame:
    add = lambda cs: reduce(lambda a, b: a + b, [F.var_samp(c) for c in cs])
    return df.agg((add(scores) / add(data)).alias("ratio"))


def interval_score(y: Column, low: Column, high: Column, alpha: float = 0.05, scale: float = 1.0) -> Column:
    zero = F.lit(0.0)
    return scale * (high - low) + 2 / alpha * (F.greatest(low - y, zero) + F.greatest(y - high, zero))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, 2)))


def r_squared(df: DataFrame, y: str, p: str) -> DataFrame:
    # sums only: SStot = sum y^2 - n mean^2
    return df.agg((1 - F.sum(F.pow(F.col(y) - F.col(p), 2)) / (F.var_pop(y) * F.count("*"))).alias("r2"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support; a class never predicted has precision 0."""
    marks = df.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    g = marks.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("said"), F.sum("hit").alias("hit"))
    precision, recall = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return g.select("class", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), "support")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by rank sums; equal scores share their mean rank. Ranks come from counts of distinct scores."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    r = g.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    return r.agg(((F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def split(key: Column, parts: dict[str, int], seed: int = 42) -> Column:
    """A reproducible split by hash: name of the part; parts' sizes in percent."""
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100))
    out, low = None, 0
    for name, size in parts.items():
        test = (at >= low) & (at < low + size)
        out = F.when(test, name) if out is None else out.when(test, name)
        low += size
    return out


def stratified(df: DataFrame, key: str, stratum: str, share: float, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("split", F.when(F.percent_rank().over(w) < share, "train").otherwise("test"))


def features_target(df: DataFrame) -> tuple[list[str], str]:
    """All columns but the last, and the last."""
    return df.columns[:-1], df.columns[-1]


def shape(df: DataFrame) -> DataFrame:
    """n_rows, n_columns."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def spread(df: DataFrame, rows: str, columns: str, names: Sequence[object], value: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns, list(names)).agg(F.first(value))


#: Rows of a cell that are compared as one block, and pairs of rows compared by one task.
BLOCK, TASK_PAIRS = 2000, 1 << 24


def near_pairs(points: DataFrame, limit: float, id_: str = "id", x: str = "x", y: str = "y", digits: int | None = None) -> DataFrame:
    """All pairs (a < b) of points at most `limit` apart with their distance d (rounded to `digits`, if given), by grid cells of that size.
    A cell's rows are cut into blocks in the order of x, y and the other columns; pairs of blocks are dealt over as many tasks as their pairs of rows ask for,
    so no task grows with a cell. Distances are taken once for each pair of places."""
    width = limit * (1 + 1e-9) if limit > 0 else 1.0  # the hair is for quotients that round
    cell = lambda c: F.floor(F.greatest(F.least(F.col(c).cast("double") / width, F.lit(1e15)), F.lit(-1e15)))
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    rows = points.where(finite(x) & finite(y) & F.col(id_).isNotNull()).withColumns({"_cx": cell(x), "_cy": cell(y)})
    after = F.array(*[F.struct((F.col("_cx") + i).alias("cx"), (F.col("_cy") + j).alias("cy")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    counts = rows.groupBy("_cx", "_cy").agg(F.count("*").alias("n"))
    near = counts.select(F.col("n").alias("m"), F.inline(after)).join(counts.select(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), "n"), ["cx", "cy"])
    tasks = max(1, math.ceil((near.agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0) / TASK_PAIRS))

    others = [c for c in points.columns if c not in (x, y)]
    order = [x, y, id_, *[c for c, kind in points.dtypes if c not in (x, y, id_) and "map<" not in kind and kind != "variant"]]  # both sides of the join cut alike
    at = F.floor((F.row_number().over(Window.partitionBy("_cx", "_cy").orderBy(*order)) - 1) / BLOCK)
    places = rows.withColumn("_k", at).groupBy("_cx", "_cy", "_k", x, y).agg(F.collect_list(F.struct(*others)).alias("m"))
    ends = [f(c).alias(f"{n}{k}") for k, c in (("x", x), ("y", y)) for n, f in (("low_", F.min), ("high_", F.max))]
    blocks = places.groupBy("_cx", "_cy", "_k").agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "m")).alias("p"), *ends)
    a = blocks.select(*[F.col(c).alias(f"a{c}") for c in blocks.columns], F.inline(after))
    b = blocks.select(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), *[F.col(c).alias(f"b{c}") for c in blocks.columns if c not in ("_cx", "_cy")])
    here = (F.col("a_cx") == F.col("cx")) & (F.col("a_cy") == F.col("cy"))
    reach = [F.col(f"{u}low_{c}") <= F.col(f"{v}high_{c}") + width for c in "xy" for u, v in ("ab", "ba")]
    both = a.join(b, ["cx", "cy"]).where(~here | (F.col("a_k") <= F.col("b_k"))).where(reduce(lambda p, q: p & q, reach))
    both = both.repartition(tasks, "a_cx", "a_cy", "a_k", "cx", "cy", "b_k").select("ap", "bp", (here & (F.col("a_k") == F.col("b_k"))).alias("same"))

    apart = both.select("bp", "same", F.inline("ap").alias("ax", "ay", "am")).select("same", "ax", "ay", "am", F.inline("bp").alias("bx", "by", "bm"))
    gap = {c: F.col(f"a{c}").cast("double") - F.col(f"b{c}") for c in "xy"}
    apart = apart.withColumn("d", F.sqrt(gap["x"] * gap["x"] + gap["y"] * gap["y"])).where(F.col("d") <= limit)
    if digits is not None:
        apart = apart.withColumn("d", F.round("d", digits))
    one = apart.select("same", "ax", "ay", "bx", "by", "bm", "d", F.explode("am").alias("a")).select("same", "ax", "ay", "bx", "by", "d", "a", F.explode("bm").alias("b"))
    first = F.col(f"a.{id_}") < F.col(f"b.{id_}")
    one = one.where(first | (~F.col("same") & (F.col(f"a.{id_}") > F.col(f"b.{id_}"))))
    of = lambda u, c: F.col(f"{u}x" if c == x else f"{u}y" if c == y else f"{u}.{c}")
    return one.select(*[F.when(first, of(u, c)).otherwise(of(v, c)).alias(f"{u}_{c}") for u, v in ("ab", "ba") for c in points.columns], "d")


def close_matches(names: DataFrame, vocabulary: DataFrame, cutoff: float = 0.6, k: int = 3) -> DataFrame:
    """For each name the exact match, else its k closest vocabulary words by Levenshtein similarity of at least cutoff. The vocabulary is a short list and is broadcast; a longer one is refused."""
    if vocabulary.limit(10_001).count() > 10_000:
        raise ValueError("the vocabulary of a fuzzy lookup may have 10,000 words at most")
    sim = 1 - F.levenshtein("name", "word") / F.greatest(F.length("name"), F.length("word"), F.lit(1))
    pairs = names.join(F.broadcast(vocabulary), F.lit(True)).withColumn("similarity", sim).where(F.col("similarity") >= cutoff)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("similarity"), "word")))
    exact = F.max(F.col("similarity") == 1).over(Window.partitionBy("name"))
    return ranked.withColumn("exact", exact).where((F.col("rank") <= k) & (~F.col("exact") | (F.col("rank") == 1))).drop("exact")
