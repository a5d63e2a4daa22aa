"""Operator 2: benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII letters in lower case. Every run of 8 consecutive words
of an item is a window (all words of a shorter item are one). A document's window hashes are looked up in the set and each hit is
verified on the words' bytes. The benchmark is a stated query set: it is read and broadcast in blocks of at most `block_bytes` of text
(about 5 times that much memory), one at a time; for each block the document table is scanned once and the hits are written.

Defined results: null and empty texts have no words; items without words have no window; equal windows of several items hit each of
them; repeated rows get equal results; extra columns pass through `clean`; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textnp

WINDOW = 8
BLOCK_BYTES = 8 << 20


class Windows:
    """The windows of a block of items: for each length the sorted hashes with their first words; what a hash stands for is read and
    kept when a document first asks for it."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        data, offsets = textnp.utf8(pa.array([t for _, t in items], pa.large_string()))
        self.data = textnp.LOWER[data]
        starts, ends, rows = textnp.words(self.data, offsets, textnp.table("alnum"))
        hashes = textnp.word_hashes(self.data, starts, ends)
        self.starts, self.ends, self.rows = starts.astype(np.int32), ends.astype(np.int32), rows.astype(np.int32)
        self.ids = [str(i) for i, _ in items]
        counts = np.bincount(rows, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in np.unique(np.minimum(counts, n)).tolist():
            if m:
                grams = textnp.gram_hashes(hashes, m)
                own = np.flatnonzero((rows[: len(grams)] == rows[m - 1 :]) & (np.minimum(counts, n)[rows[: len(grams)]] == m))
                own = own[np.argsort(grams[own], kind="stable")]
                small = np.zeros(1 << 20, bool)
                small[(grams[own] & np.uint64(0xFFFFF)).astype(np.int64)] = True
                self.by_length[m] = (grams[own], small, own.astype(np.int32))
        self.read: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def named(self, m: int, place: int) -> dict[bytes, set[str]]:
        """The words of the windows that have the hash at this place, and the items of each."""
        known, _, at = self.by_length[m]
        if (m, place) not in self.read:
            found: dict[bytes, set[str]] = {}
            p = place
            while p < len(known) and known[p] == known[place]:
                found.setdefault(phrase(self.data, self.starts, self.ends, int(at[p]), m), set()).add(self.ids[self.rows[at[p]]])
                p += 1
            self.read[m, place] = found
        return self.read[m, place]


def phrase(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, m: int) -> bytes:
    return b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(first, first + m))


def _scan(block, carried: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = block.value
        is_word = textnp.table("alnum")
        for batch in batches:
            for part in textnp.slices(batch, "text"):
                data, offsets = textnp.utf8(part.column("text"))
                data = textnp.LOWER[data]
                starts, ends, rows = textnp.words(data, offsets, is_word)
                hashes = textnp.word_hashes(data, starts, ends)
                n_words = np.bincount(rows, minlength=part.num_rows).astype(np.int64)
                hit = np.zeros(len(starts), bool)
                items: dict[int, set[str]] = {}
                for m, (known, small, _) in windows.by_length.items():
                    grams = textnp.gram_hashes(hashes, m)
                    at = np.flatnonzero(small[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
                    at = at[rows[at] == rows[at + m - 1]]
                    place = np.searchsorted(known, grams[at])
                    sure = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == grams[at])
                    for k, p in zip(at[sure].tolist(), place[sure].tolist(), strict=True):
                        if ids := windows.named(m, p).get(phrase(data, starts, ends, k, m)):
                            hit[k : k + m] = True
                            items.setdefault(int(rows[k]), set()).update(ids)
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                runs: dict[int, list] = {}
                first = np.cumsum(n_words) - n_words
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    while a < b:  # a run of hit words may cross into the next document
                        row = int(rows[a])
                        to = min(b, int(first[row] + n_words[row]))
                        runs.setdefault(row, []).append({"word": a - int(first[row]), "words": to - a, "from": int(starts[a] - offsets[row]), "to": int(ends[to - 1] - offsets[row])})
                        a = to
                yield pa.RecordBatch.from_arrays(
                    [part.column(carried), pa.array(n_words), pa.array([sorted(items.get(i, ())) for i in range(part.num_rows)], pa.list_(pa.string())),
                     pa.array([runs.get(i, []) for i in range(part.num_rows)], pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])))],
                    ["row", "n_words", "items", "spans"],
                )

    return run


SCHEMA = "row long, n_words long, items array<string>, spans array<struct<word:long,words:long,from:long,to:long>>"


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[object, str]]]:
    held, size = [], 0
    for row in benchmark.select(item_id, text).toLocalIterator():
        held.append((row[0], row[1] or ""))
        size += len(held[-1][1]) + 64
        if size > most:
            yield held
            held, size = [], 0
    if held or not size:
        yield held


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, items (ids of items with occurring windows, as sorted strings) and spans (runs of hit words: word numbers and byte places)."""
    spark = docs.sparkSession
    scratch.ship(spark)
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        # One block: the scan carries each row's columns along instead of joining them again.
        return _carried(docs, spark.sparkContext.broadcast(Windows(block, n)), text)
    numbered = scratch.saved(docs.drop("n_words", "items", "spans").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found: list[DataFrame] = []
    for block in chain([block, following], blocks):
        sent = spark.sparkContext.broadcast(Windows(block, n))
        scanned = numbered.select(F.col("__row").alias("row"), F.col(text).alias("text")).mapInArrow(_scan(sent, "row"), SCHEMA)
        # the first block's rows tell the number of words; of the others only hits are written
        found.append(scratch.saved(scanned.where(F.size("items") > 0) if found else scanned, "hits"))
        sent.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("__spans"))
    every = every.withColumn("spans", _merged("__spans")).drop("__spans").withColumnRenamed("row", "__row")
    return numbered.join(every, "__row").drop("__row")


def _merged(spans: str):
    """Spans of several blocks, joined where they overlap or touch in words."""
    kind = "array<struct<word:bigint,words:bigint,from:bigint,to:bigint>>"
    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (last["word"] + last["words"] >= x["word"])
        longer = F.struct(last["word"].alias("word"), (F.greatest(last["word"] + last["words"], x["word"] + x["words"]) - last["word"]).alias("words"), last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.sort_array(spans), F.array().cast(kind), add)


def _carried(docs: DataFrame, block, text: str) -> DataFrame:
    scan_one = _scan(block, "row")
    kept = [c for c in docs.columns if c not in ("n_words", "items", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch, text):
                given = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(text)], ["row", "text"])
                found = [x for x in scan_one(iter([given]))]
                table = pa.Table.from_batches(found).combine_chunks()
                for x in table.to_batches() or []:
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), x.column("n_words"), x.column("items"), x.column("spans")], [*kept, "n_words", "items", "spans"])

    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(SCHEMA.split(", ", 1)[1])
    return docs.select(*kept).mapInArrow(run, StructType([*(f for f in docs.schema if f.name in kept), *extra]))


def report(found: DataFrame, doc_id: str = "doc_id", at_least: int = 2) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select(
        F.col(doc_id), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= at_least).alias("contaminated"),
    )


def clean(found: DataFrame, text: str = "text", at_least: int = 2) -> DataFrame:
    """Without the documents that hold windows of `at_least` items; from the others the hit spans are cut out of the text."""
    raw = F.encode(text, "utf-8")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x["to"]))
    stops = F.concat(F.transform("spans", lambda x: x["from"]), F.array(F.octet_length(text).cast("long")))
    rest = F.array_join(F.zip_with(edges, stops, lambda a, b: F.decode(F.substr(raw, (a + 1).cast("int"), (b - a).cast("int")), "utf-8")), "")
    return found.where(F.size("items") < at_least).withColumn(text, F.when(F.size("spans") > 0, rest).otherwise(F.col(text))).drop("n_words", "items", "spans")
