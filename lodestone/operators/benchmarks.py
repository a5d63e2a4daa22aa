"""Timings of sorting and of graph algorithms by size of the input."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import io

from . import graph

RESULT = "algorithm string, size long, mean_time double, std_time double, min_time double, max_time double"


def timed(spark: SparkSession, cases: Sequence[tuple[str, int, Callable[[], DataFrame]]], runs: int) -> DataFrame:
    """Seconds of each case's whole result, over `runs` runs after a first one that isn't counted."""
    out = []
    for name, size, make in cases:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        took = took[1:]
        out.append((name, size, statistics.mean(took), statistics.pstdev(took), min(took), max(took)))
    return spark.createDataFrame(out, RESULT)


def sorting(spark: SparkSession, sizes: Sequence[int], kinds: Sequence[str] = ("random",), runs: int = 10) -> DataFrame:
    """The engine's sort of arrays of the given kinds."""
    return timed(spark, [(f"sort {k}", n, lambda n=n, k=k: io.arrays(spark, n, k).orderBy("v")) for k in kinds for n in sizes], runs)


def graphs(spark: SparkSession, sizes: Sequence[int], runs: int = 5) -> DataFrame:
    """Breadth-first search, cheapest paths and spanning tree of random graphs with p = ln n / n."""
    cases = []
    for n in sizes:
        edges = io.saved(io.erdos_renyi(spark, n), "edges")
        links = graph.both(edges.withColumn("weight", F.col("weight").cast("double")))
        cases += [("bfs", n, lambda e=links: graph.bfs(e, 0)), ("distances", n, lambda e=links: graph.distances(e, 0)), ("spanning tree", n, lambda e=edges: graph.minimum_spanning_tree(e))]
    return timed(spark, cases, runs)
