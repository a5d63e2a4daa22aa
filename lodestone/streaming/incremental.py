"""Incremental loads: only new items are processed, successes are appended, failures stay eligible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.relational import keep_first, not_loaded


def plan_load(listing: DataFrame, loaded: DataFrame, key: str = "url", order: str = "ordinal", cap: int | None = None) -> DataFrame:
    """The listing's first rows per key that aren't loaded yet, at most `cap` of them in order."""
    new = not_loaded(keep_first(listing, [key], [order]), loaded, key)
    return new.orderBy(order, key).limit(cap) if cap is not None else new


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and the dead letters."""
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    return results.where(good), results.where(~good)


def update_report(listing: DataFrame, loaded: DataFrame, results: DataFrame | None, key: str = "url") -> DataFrame:
    """existing, new_found, new_processed, failed; check-only without results."""
    a = loaded.select(key).distinct().agg(F.count("*").alias("existing"))
    b = not_loaded(listing.select(key).distinct(), loaded, key).agg(F.count("*").alias("new_found"))
    none = listing.sparkSession.createDataFrame([(0, 0)], "new_processed long, failed long")
    c = none if results is None else results.agg(F.count_if(F.col("status") == "success").alias("new_processed"), F.count_if(~F.coalesce(F.col("status") == "success", F.lit(False))).alias("failed"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and change: added or removed since the last run."""
    added = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def stream_load(spark: SparkSession, source: str, schema: str, key: str, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Files that arrive in `source` are deduplicated by key across batches, processed and appended to `sink`; failures go to sink_failed."""
    def one(batch: DataFrame, _: int) -> None:
        spark_ = batch.sparkSession
        try:
            old = spark_.read.parquet(sink)
            batch = batch.join(old.select(key).distinct(), key, "left_anti")
        except Exception as e:  # the first batch: the sink doesn't exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        done = process(batch.dropDuplicates([key])).persist()
        good, bad = split_results(done)
        good.write.mode("append").parquet(sink)
        bad.write.mode("append").parquet(f"{sink}_failed")
        done.unpersist()

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
