"""Operator 5: base text statistics and cross-document line frequency, in DataFrame functions only.

Lines are normalised (trimmed, white space collapsed, ASCII lower case, digits read as 0) and hashed together with their host.
For each (host, line) the distinct documents that hold it are counted; byte-identical texts are one document, so that a copied
document does not turn its own sentences into boilerplate. A line is over the limit if it stands in more than `min_docs` documents
and in more than `percent` % of its host's distinct documents, or, where `enough_docs` is given, in more than so many of them at any
size of the host. Such lines are removed; a document that keeps less than
`keep_percent` % of its words is depleted and rejected.

Defined results: null text counts as empty (no words, base_failed, not kept); null host is a host of its own; repeated rows each get
their own result; extra columns pass through, but for those named like
an output column, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, skew

SPACE = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
OUTPUT = (*STATS, "removed", "removed_words", "depleted", "kept")
#: Largest number of over-limit lines that may be broadcast (16 bytes each).
BROADCAST_ROWS = 200_000
PARAMS = {"min_docs": 20, "percent": 2, "keep_percent": 30}


WHITE = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    """Trimmed first, so that no empty word is left to filter out."""
    return F.when(F.btrim(text, F.lit(WHITE)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(WHITE)), SPACE))


def _lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def _normal(line: Column) -> Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789\t\x0b\f\r", "abcdefghijklmnopqrstuvwxyz000000000    ")
    trimmed = F.btrim(low)
    return F.when(F.contains(trimmed, F.lit("  ")), F.regexp_replace(trimmed, " {2,}", " ")).otherwise(trimmed)


def _text(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text], F.lit(""))


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = _text(docs, text)
    chars = F.length(t)
    without = lambda gone: F.length(reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), gone, t))
    df = docs.withColumns({
        "__words": _words(t),
        "__lines": _lines(t),
        "word_chars": without(WHITE).cast("long"),
        "n_symbols": (chars - without("#*$%&|<>")).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__grams": F.when(
            F.size("__words") >= 3,
            F.slice(F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))), F.lit(1), F.size("__words") - 2),
        ).otherwise(F.array().cast("array<bigint>")),
    })
    # Only where some window is found twice are the windows sorted with their places.
    df = df.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__grams")) < F.size("__grams"), F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ))
    at = lambda k: F.get("__sorted", k)["h"]
    df = df.withColumn("__places", F.sort_array(F.transform(
        F.filter("__sorted", lambda x, k: F.coalesce(at(k - 1) == x["h"], F.lit(False)) | F.coalesce(at(k + 1) == x["h"], F.lit(False))),
        lambda x: x["i"],
    )))
    covered = F.aggregate(
        F.transform("__places", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__places", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__words", "__lines", "__grams", "__sorted", "__places").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """base_stats of docs and __lines: array<struct<line, n>>, the hash of each line (with its host) and its number of words; __hash, of the text."""
    named = F.coalesce(docs[host], F.lit("\x00"))
    t = _text(docs, text)
    one = lambda x: F.struct(F.xxhash64(named, x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    stats = base_stats(docs, text)
    return stats.withColumns({"__host": named, "__hash": F.xxhash64(t), "__normal": F.transform(_lines(t), _normal)}).withColumn("__lines", F.transform("__normal", one)).drop("__normal")


def frequent_lines(rows: DataFrame, min_docs: int = 20, percent: int = 2, enough_docs: int | None = None) -> DataFrame:
    """(line, n_docs) of the lines over the limit, from `measured` rows; the hash covers the host as well."""
    hosts = rows.groupBy("__host").agg(F.count_distinct("__hash").alias("host_docs"))
    lines = rows.select("__host", "__hash", F.explode(F.array_distinct(F.transform("__lines", lambda x: x["line"]))).alias("line"))
    counts = lines.groupBy("line").agg(F.count_distinct("__hash").alias("n_docs"), F.first("__host").alias("__host"))
    over = 100 * F.col("n_docs") > percent * F.col("host_docs")
    over = over if enough_docs is None else over | (F.col("n_docs") > enough_docs)
    return counts.where(F.col("n_docs") > min_docs).join(hosts, "__host").where(over).select("line", "n_docs")


def line_verdicts(rows: DataFrame, frequent: DataFrame, doc_id: str = "doc_id", bound: int = BROADCAST_ROWS) -> DataFrame:
    """For each document with lines over the limit: __id, __hash, removed_words, removed (line numbers among lines with words)."""
    lines = rows.select(F.col(doc_id).alias("__id"), "__hash", F.posexplode("__lines").alias("pos", "x")).select("__id", "__hash", "pos", "x.*")
    hits = frequent.select("line", F.lit(True).alias("over"))
    joined = lines.join(F.broadcast(hits), "line") if hits.limit(bound + 1).count() <= bound else skew.lookup(lines, hits, ["line"], F.col("__id")).where("over")
    # a line number counts once, also where rows are repeated
    once = joined.groupBy("__id", "__hash").agg(F.collect_set(F.struct("pos", "n")).alias("hit"))
    return once.select("__id", "__hash", F.transform("hit", lambda x: x["pos"]).alias("removed"), F.aggregate("hit", F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("removed_words"))


def apply(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", min_docs: int = 20, percent: int = 2, keep_percent: int = 30, carry: bool = True, enough_docs: int | None = None) -> DataFrame:
    """docs with the base statistics, removed_words, removed (numbers of removed lines among lines with words), depleted and kept.

    carry=False leaves out all columns of docs but the identity and the host: then no text is shuffled.
    """
    found = measured(docs, text, host)
    rows = scratch.saved(found.select(F.col(doc_id), "__host", "__hash", "__lines", *STATS), "measured")
    verdicts = line_verdicts(rows, scratch.saved(frequent_lines(rows, min_docs, percent, enough_docs), "lines"), doc_id)
    # one verdict for each (document, text)
    verdicts = verdicts.withColumnRenamed("__hash", "__same")
    stats = rows.drop("__lines", "__host")
    full = stats.join(verdicts, stats[doc_id].eqNullSafe(verdicts["__id"]) & (stats["__hash"] == verdicts["__same"]), "left").drop("__id", "__same")
    full = full.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    full = full.withColumn("depleted", 100 * (F.col("n_words") - F.col("removed_words")) < keep_percent * F.col("n_words"))
    full = full.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    if not carry:
        return full.drop("__hash")
    own = docs.drop(*[c for c in docs.columns if c in OUTPUT]).withColumn("__same", F.xxhash64(_text(docs, text)))
    full = full.dropDuplicates([doc_id, "__hash"]).withColumnRenamed(doc_id, "__id")
    return own.join(full, own[doc_id].eqNullSafe(full["__id"]) & (own["__same"] == full["__hash"])).drop("__id", "__hash", "__same")


def strip_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """The text without its over-limit lines (those in `removed`); other lines, blank ones included, stay as they are."""
    lines = F.split(F.col(text), "\n")
    blank = lambda x: F.btrim(x, F.lit(WHITE)) == ""
    marked = df.withColumn("__lines", F.when(F.size("removed") > 0, lines)).withColumn(
        # the number of each line with a word: how many such lines stand before it
        "__numbers", F.aggregate("__lines", F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("a")), lambda s, x: F.struct(
            (s["n"] + F.when(blank(x), 0).otherwise(1)).alias("n"), F.concat(s["a"], F.array(F.when(blank(x), -1).otherwise(s["n"]))).alias("a")
        ), lambda s: s["a"]),
    )
    kept = F.array_join(F.transform(F.filter(F.arrays_zip("__lines", "__numbers"), lambda z: ~F.array_contains("removed", z["__numbers"])), lambda z: z["__lines"]), "\n")
    return marked.withColumn(text, F.when(F.size("removed") > 0, kept).otherwise(F.col(text))).drop("__lines", "__numbers")
