"""From raw documents to packed sequences: five operators of lodestone.llm, each working on all that the one before it kept.

What a stage leaves in the shared folder is deleted when the next one starts on the same tables, for its result has been written by then;
run() deletes each stage's as soon as its result is written, and other runs' are left alone. Of rows that repeat as a whole one stays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, near_dup, packing, pii, quality_rules, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A line in more documents of a host is cut, whatever the host's size.
ENOUGH_DOCS = 1000
#: No stage's tokens, surrogates or packing can be written in SQL; tests/llm/test_llm_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[scratch.Scope]] = defaultdict(list)


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are depleted; cuts over-limit lines out of the others."""
    judged = quality_rules.apply(docs.select(*COLUMNS), enough_docs=ENOUGH_DOCS)
    return _documents(quality_rules.strip_lines(judged.where("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of five-word-shingle similarity 0.8 or more; one row of those that repeat a doc_id and its columns."""
    docs = docs.select(*COLUMNS)
    gone = near_dup.classes(docs, n=5, percent=80).where("not kept").select("doc_id").distinct()
    kept = _without(docs, scratch.saved(gone, "gone"))
    again = scratch.saved(kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.isEmpty():
        kept = _without(kept, again).unionByName(kept.join(again, "doc_id", "left_semi").select(*COLUMNS).distinct())
    return _documents(kept)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.limit(near_dup.BROADCAST_ROWS + 1).count() <= near_dup.BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold windows of two or more benchmark items; cuts single items' windows out of the others."""
    found = decontaminate.scan(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _documents(decontaminate.clean(found))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    return _documents(pii.apply(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _tidy(stage: Stage, first: bool = False) -> Stage:
    """The stage, with tables of its own; those of the stage before it over the same sf_dir are deleted."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            for old in _left.pop(sf_dir, []):
                old.close()
        own = scratch.Scope(spark)
        _left[sf_dir].append(own)
        with own.entered():
            return stage(spark, docs, sf_dir)

    return run_stage


_PLAIN: list[tuple[str, Stage]] = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii_surrogates", personal_data), ("packing", packed)]
STAGES = [(name, _tidy(stage, first=not k)) for k, (name, stage) in enumerate(_PLAIN)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: scratch.Scope | None = None
    for _, stage in _PLAIN[:-1]:
        own, result = scratch.Scope(spark), scratch.Scope(spark)
        with own.entered():
            found = stage(spark, docs, sf_dir)
        with result.entered():
            docs = scratch.saved(found, "stage")
        own.close()
        if before:
            before.close()
        before = result
    return _PLAIN[-1][1](spark, docs, sf_dir)
