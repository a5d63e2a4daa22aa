"""Operator 1: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents in order of their ids. In every round a source of weight w earns window * w tokens and sends the
whole tokens its credit covers, cutting documents where the credit ends; the fraction left over is its deficit, carried to its next
round. So a round is one window's worth at the target proportions, to less than a token for each source. A source that earns fewer than
`grain` tokens a round waits until it can send `grain`, at an offset of its own, so that rare sources neither fall apart into single
tokens nor send all at once. Since all queues are known, the tokens a source has sent before a round are floor(round * earned + phase):
deficits carried over windows and partitions need no state, and the stream of sent segments (round, source, place in the queue) is a
distributed sort with running sums. The stream is cut every `window` tokens; only the last sequence is short. Weights are relative;
without any, sources share in proportion to their tokens, so all queues end together. A queue that ends leaves its share to the others.

Defined results: null and empty text give one piece, the end id; null doc_id comes first in its queue; null source is a queue of its own; rows that repeat a doc_id are
separate documents, told apart by their text's hash and a number; an empty table gives no piece; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, skew, textnp, tokens

WINDOW, GRAIN = 2048, 16


def _encoder(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = tokens.words(vocabulary)
        for batch in batches:
            for part in textnp.slices(batch, "text", 2 << 20):
                ids, lengths = tokens.end_with(*store.encode(part.column("text")), end)
                small = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), part.column("row"), pa.array(lengths), tokens.binary(small, lengths), pa.array(np.full(len(lengths), small.itemsize, np.int32))],
                    ["doc_id", "source", "row", "doc_tokens", "ids", "width"],
                )

    return run


def encoded(docs: DataFrame, vocabulary: str, end: int, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, row, doc_tokens, ids, width) of every row, saved. `row` is unique; it tells rows with one doc_id apart."""
    scratch.ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"), F.monotonically_increasing_id().alias("row"), docs[text].alias("text"))
    schema = "doc_id long, source string, row long, doc_tokens long, ids binary, width int"
    return scratch.saved(rows.mapInArrow(_encoder(vocabulary, end), schema), "ids")


def plan(sizes: DataFrame, window: int = WINDOW, weights: dict[str, float] | None = None, grain: int = GRAIN) -> DataFrame:
    """(row, doc_id, source, start, length, round, position) of the segments of sizes (doc_id, source, row, doc_tokens)."""
    queued = skew.running_sum(sizes, ["source"], ["doc_id", "row"], "doc_tokens", "before", "queues")
    totals = sizes.groupBy("source").agg(F.sum("doc_tokens").alias("total"))
    if weights is None:
        share = totals.select("source", F.col("total").cast("double").alias("w"))
    else:
        named = sizes.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 1.0)], "source string, w double")
        # a source without a weight gets the smallest one, so that its rows are still packed
        least = min([v for v in weights.values() if v > 0], default=1.0)
        share = totals.join(named, "source", "left").select("source", F.when(F.col("w") > 0, F.col("w")).otherwise(least).alias("w"))
    share = scratch.saved(share, "shares")
    whole = share.agg(F.sum("w")).first()[0] or 1.0
    earned = F.greatest(F.col("w") / F.lit(float(whole)) * window, F.lit(1e-9))
    share = share.select("source", earned.alias("earned"), (F.pmod(F.xxhash64("source"), F.lit(4096)) / 4096).alias("phase"))
    # one row for each source
    rows = queued.join(share, "source")
    q, before, after = F.col("earned"), F.col("before"), F.col("before") + F.col("doc_tokens")
    often = q >= grain
    sent = lambda r: F.greatest(F.lit(0).cast("long"), F.when(r <= 0, F.lit(0).cast("long")).otherwise(F.floor(r * q + F.col("phase")).cast("long")))
    first = F.when(often, F.greatest(F.lit(0).cast("long"), F.floor((before - 1) / q).cast("long") - 1)).otherwise(F.floor(before / grain).cast("long"))
    last = F.when(often, F.floor(after / q).cast("long") + 1).otherwise(F.floor((after - 1) / grain).cast("long"))
    turn = F.col("turn")
    rows = rows.withColumn("turn", F.explode(F.sequence(first, last)))
    low = F.greatest(before, F.when(often, sent(turn)).otherwise(turn * grain))
    high = F.least(after, F.when(often, sent(turn + 1)).otherwise((turn + 1) * grain))
    rows = rows.select("row", "doc_id", "source", "doc_tokens", (low - before).alias("start"), (high - low).alias("length"), F.when(often, turn).otherwise(F.floor((turn + F.col("phase")) * grain / q).cast("long")).alias("round"))
    return skew.running_sum(rows.where("length > 0"), [], ["round", "source", "doc_id", "row", "start"], "length", "position", "stream")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, ids, width, count, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width", "doc_tokens", "parts")), strict=True):
                flat = np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4")
                for p in parts:
                    start, left, at = p["start"], p["length"], p["position"]
                    while left:
                        n = min(left, window - at % window)
                        piece = flat[start : start + n].tobytes()
                        for column, value in zip(out, (doc, start, n, zlib.crc32(piece), count, at // window, at % window, piece), strict=True):
                            column.append(value)
                        start, left, at = start + n, left - n, at + n
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, vocabulary: str, end: int = 1, window: int = WINDOW, weights: dict[str, float] | None = None, grain: int = GRAIN) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    ids = encoded(docs, vocabulary, end)
    segments = plan(ids.select("doc_id", "source", "row", "doc_tokens"), window, weights, grain)
    parts = segments.groupBy("row").agg(F.collect_list(F.struct("start", "length", "position")).alias("parts"))
    joined = ids.select("row", "doc_id", "doc_tokens", "ids", "width").join(parts.hint("shuffle_hash"), "row")
    return joined.drop("row").mapInArrow(_cut(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids. A sequence is one window, so each group is bounded."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.transform(ordered, lambda x: F.hex(x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(whole, "")).alias("ids"))
