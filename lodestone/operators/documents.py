"""Structure of markdown texts, chunks for a vector store, and readiness checks, by windows over lines of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def headings(rows: DataFrame) -> DataFrame:
    """Lines that start with # once trimmed; an indented one has level 0."""
    t = F.trim("line")
    return rows.where(t.startswith("#")).select("doc_id", "pos", F.length(F.regexp_extract("line", "^(#*)", 1)).alias("level"), F.substring(F.trim(F.regexp_replace(t, "^#+", "")), 1, 200).alias("text"))


def tables(rows: DataFrame, flush: bool = False, caption: str = "Tabella", back: int = 5) -> DataFrame:
    """Pipe tables: doc_id, table_no (from 1), start, n_rows, content, columns, caption.

    A table begins at the first line of a run of piped lines that has a dash too; one that is open at the end of the text counts only
    with flush=True. The caption is the earliest of the `back` lines before it that has the word; with an empty word, that is neither
    blank nor a heading.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    pipe = F.contains("line", F.lit("|"))
    fits = F.contains("line", F.lit(caption)) if caption else (F.trim("line") != "") & ~F.trim("line").startswith("#")
    marked = rows.withColumn("pipe", pipe).withColumn("island", F.sum((~pipe).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("found", F.first(F.when(fits, F.trim("line")), ignorenulls=True).over(w.rowsBetween(-back, -1))).withColumn("last", F.max("pos").over(Window.partitionBy("doc_id")))
    island = Window.partitionBy("doc_id", "island")
    dash = F.col("pipe") & F.col("line").rlike("[-─]")
    inside = marked.where("pipe").withColumn("start", F.min(F.when(dash, F.col("pos"))).over(island)).withColumn("end", F.max("pos").over(island)).where(F.col("pos") >= F.col("start"))
    if not flush:
        inside = inside.where(F.col("end") < F.col("last"))
    g = inside.groupBy("doc_id", "start").agg(
        F.count("*").alias("n_rows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"),
        F.min_by("line", "pos").alias("head"), F.min_by("found", "pos").alias("caption"),
    )
    cells = F.filter(F.transform(F.split("head", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return g.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")).alias("table_no"), "start", "n_rows", "content", cells.alias("columns"), F.coalesce("caption", F.lit("N/A")).alias("caption"))


def figures(rows: DataFrame, ahead: int = 4, cut: int | None = None) -> DataFrame:
    """Image lines with the first of the next lines that is neither blank nor a heading as caption."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    fits = (F.trim("line") != "") & ~F.trim("line").startswith("#")
    text = F.trim("line") if cut is None else F.substring(F.trim("line"), 1, cut)
    marked = rows.withColumn("caption", F.first(F.when(fits, text), ignorenulls=True).over(w.rowsBetween(1, ahead)))
    image = F.contains("line", F.lit("![")) | F.contains("line", F.lit("<!-- image"))
    return marked.where(image).select("doc_id", F.row_number().over(w).alias("figure_no"), "pos", F.coalesce("caption", F.lit("N/A")).alias("caption"))


def stats(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.length(text).alias("chars"), F.col(text).rlike(r"(?m)^#|\|").alias("structured"))


def table_meta(found: DataFrame) -> DataFrame:
    """potential columns of the first row and an estimated number of data rows."""
    return found.select("doc_id", "table_no", F.size("columns").alias("n_columns"), F.greatest(F.col("n_rows") - 1, F.lit(0)).alias("rows_estimated"))


def table_file(doc_id: Column, number: Column, caption: Column, columns: Column, content: Column) -> Column:
    """The text file of a table, with its head."""
    return F.concat_ws("\n", F.format_string("DOC %s TABLE %s", doc_id.cast("string"), number.cast("string")), F.concat(F.lit("CAPTION: "), caption), F.concat(F.lit("COLUMNS: "), F.array_join(columns, ", ")), F.repeat(F.lit("="), F.lit(40)), content)


def chunks(docs: DataFrame, found: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, kind, position, content: the text, then the tables, then the described images of each document."""
    body = docs.where(F.trim("text") != "").select("doc_id", F.lit("markdown_text").alias("kind"), F.lit(0).alias("position"), F.col("text").alias("content"))
    named = F.concat_ws("\n", F.concat(F.lit("TABELLA: "), F.col("caption")), F.when(F.size("columns") > 0, F.concat(F.lit("COLONNE: "), F.array_join("columns", ", "))), F.lit("CONTENUTO:"), F.col("content"))
    tab = found.select("doc_id", F.lit("table").alias("kind"), F.col("table_no").cast("int").alias("position"), named.alias("content"))
    pic = images.where("description is not null").select("doc_id", F.lit("image_vlm").alias("kind"), F.col("position").cast("int"), F.col("description").alias("content"))
    return body.unionByName(tab).unionByName(pic)


def manifest(parts: DataFrame) -> DataFrame:
    """One entry per document with chunks, in their order; content_types has one item per chunk."""
    order = F.when(F.col("kind") == "markdown_text", 0).when(F.col("kind") == "table", 1).otherwise(2)
    g = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "position", "kind", "content"))).alias("x"))
    return g.select("doc_id", F.transform("x", lambda c: c["kind"]).alias("content_types"), F.size("x").alias("n_chunks"), F.transform("x", lambda c: F.struct(c["kind"].alias("type"), c["content"].alias("content"))).alias("indexable_content"))


def readiness(images: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, n_images, n_texts, ready: as many descriptions as images."""
    a, b = images.groupBy("doc_id").agg(F.count("*").alias("n_images")), texts.groupBy("doc_id").agg(F.count("*").alias("n_texts"))
    j = a.join(b, "doc_id", "full_outer").na.fill(0, ["n_images", "n_texts"])
    return j.withColumn("ready", F.col("n_images") == F.col("n_texts"))


def zip_images(found: DataFrame, images: DataFrame) -> DataFrame:
    """The k-th figure of a document with its k-th image."""
    return found.join(images.withColumnRenamed("image_no", "figure_no"), ["doc_id", "figure_no"], "inner")


def scrape(pages: DataFrame, tags: dict[str, tuple[str, ...]]) -> DataFrame:
    """Records from html by tag chains, first non-empty wins: {field: (tag, fallback, ...)}."""
    from lodestone.functions.columns import first_tag

    return pages.select("page_id", "url", *[first_tag(F.col("html"), *chain).alias(field) for field, chain in tags.items()])


def extracted(files: DataFrame, extract, schema: str) -> DataFrame:
    """Plugs an extractor of PDF, OCR or image descriptions in: a function from batches of (path, content) to batches of `schema`."""
    return files.select("path", "content").mapInPandas(extract, schema)
