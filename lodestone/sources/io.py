"""Typed readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Written to the shared folder and read again, which ends its lineage."""
    at = work_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).options(sep=sep, header=header).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.options(sep=sep, header=header).csv(path)


def read_documents(spark: SparkSession, path: str, schema: str, skip: str = "vector_db_manifest") -> DataFrame:
    """JSON files of one document or a list of them each; files whose name starts with `skip` are left out. Unreadable files become rows with _corrupt."""
    rows = spark.read.schema(f"{schema}, _corrupt string").options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path)
    return rows.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(~F.col("_file").startswith(skip))


def write_json(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)


def read_stata(spark: SparkSession, path: str) -> DataFrame:
    """A Stata file, read by chunks of rows so that the driver holds one at a time."""
    parts = [spark.createDataFrame(chunk) for chunk in pd.read_stata(path, chunksize=100_000)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def images(spark: SparkSession, path: str) -> DataFrame:
    """(label, split, path, content) of an image folder: the label is the parent folder, the split a hash of the path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("label"), F.when(F.pmod(F.xxhash64("path"), F.lit(10)) < 8, "train").otherwise("test").alias("split"), "path", "content")


def is_jfif(content: Column) -> Column:
    """The JFIF mark at byte 7 of the content."""
    return F.coalesce(F.hex(F.substring(content, 7, 4)) == "4A464946", F.lit(False))


def arrays(spark: SparkSession, n: int, kind: str, seed: int = 42) -> DataFrame:
    """(i, v): synthetic values to sort: random, sorted, reversed or duplicates."""
    i = F.col("id")
    value = {"random": F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(10 * n)), "sorted": i, "reversed": n - 1 - i, "duplicates": F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(10))}[kind]
    return spark.range(n).select(i.alias("i"), value.cast("long").alias("v"))


def erdos_renyi(spark: SparkSession, n: int, p: float | None = None, seed: int = 42) -> DataFrame:
    """(src, dst, weight) with src < dst: each source draws its number of edges' gaps, so no pair table is built."""
    p = p if p is not None else np.log(n) / n

    def draw(batches):
        for b in batches:
            rows = []
            for s in b["id"]:
                rng = np.random.default_rng([seed, int(s)])
                at = int(s)
                while True:
                    at += int(rng.geometric(p))
                    if at >= n:
                        break
                    rows.append((int(s), at, int(rng.integers(1, 101))))
            yield pd.DataFrame(rows, columns=["src", "dst", "weight"])

    return spark.range(n).mapInPandas(draw, "src long, dst long, weight long")


def barabasi_albert(spark: SparkSession, n: int = 500, m: int = 3, seed: int = 42) -> DataFrame:
    """(src, dst): preferential attachment is sequential, so it is drawn on the driver; meant for small n."""
    rng = np.random.default_rng(seed)
    ends, edges = list(range(m)), []
    for v in range(m, n):
        for t in {int(x) for x in _distinct(rng, ends, m)}:
            edges.append((t, v))
            ends += [t, v]
    return spark.createDataFrame(edges, "src long, dst long")


def _distinct(rng, ends: list[int], m: int) -> set[int]:
    found: set[int] = set()
    while len(found) < m:
        found.add(ends[int(rng.integers(len(ends)))])
    return found


def street_network(nodes: DataFrame, edges: DataFrame, speeds: dict[str, float], default: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Adds speed_kph by road class and travel_time in seconds to edges (u, v, key, length in metres, highway)."""
    speed = F.coalesce(F.create_map(*[F.lit(x) for kv in speeds.items() for x in kv])[F.col("highway")], F.lit(default))
    return nodes, edges.withColumn("speed_kph", speed).withColumn("travel_time", F.col("length") / (F.col("speed_kph") / 3.6))


def pages_until(listing: DataFrame, empty_in_a_row: int = 2, page: str = "page", found: str = "n_found") -> DataFrame:
    """The rows of a paginated listing up to the stop rule: the scan ends after so many empty pages in a row."""
    from pyspark.sql import Window

    w = Window.partitionBy("listing").orderBy(page)
    marked = listing.withColumn("_full", F.sum((F.col(found) > 0).cast("int")).over(w))
    run = marked.withColumn("_empty", F.when(F.col(found) == 0, F.row_number().over(Window.partitionBy("listing", "_full").orderBy(F.col(found) > 0, page))).otherwise(0))
    stop = run.where(F.col("_empty") == empty_in_a_row).groupBy("listing").agg(F.min(page).alias("_stop"))
    return run.join(stop, "listing", "left").where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_full", "_empty", "_stop")
