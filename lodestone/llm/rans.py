"""Operator 4: token ids in binary files coded with a static range asymmetric numeral system (rANS).

A file holds the ids of consecutive documents (ascending doc_id over the files in order of their names):

    magic "LRANS1\\0\\0" | header length u32 | header JSON | frequency table | document table | blocks | checkpoint table | trailer

The frequency table, shared by all blocks of a file, gives each occurring id a share of 2**SCALE. The documents' ids form one stream,
cut into blocks of BLOCK ids. A block is coded by LANES interleaved 64-bit coders (id i of the block belongs to coder i mod LANES),
which emit 32-bit words; it starts with its states and can be decoded without any other block. The checkpoint table has each block's
place, first id, and CRC-32 of its bytes and of its ids, so readers can start at any block and verify what they read.

Defined results: null and empty texts give only the end id; documents without a doc_id come first, their number stands in the header,
and they are read back without one; an empty table writes no file and reads back no row; rows that repeat a doc_id follow one another in
order of their text; extra columns aren't read.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, textnp, tokens

MAGIC = b"LRANS1\0\0"
SCALE, BLOCK, LANES = 20, 1 << 18, 512
LOW = np.uint64(1 << 31)
#: Ids of one file; a partition with more writes several files.
FILE_IDS = 8 << 20


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Shares of 2**SCALE in proportion to counts, at least 1 for each id that occurs."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if not total:
        return out
    out = np.where(counts > 0, np.maximum(1, counts * (1 << SCALE) // total), 0)
    rest = (1 << SCALE) - int(out.sum())
    for i in np.argsort(-out, kind="stable"):  # the most frequent ids take up what rounding left over
        change = rest if rest > 0 else max(rest, 1 - int(out[i]))
        out[i] += change
        rest -= change
        if not rest:
            return out
    raise ValueError("more ids than the table has shares")


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    f_all, c_all = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    states = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    for at in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
        f, c = f_all[at : at + LANES], c_all[at : at + LANES]
        x = states[: len(f)]
        over = x >= f << np.uint64(63 - SCALE)
        words.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(over, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        states[: len(f)] = (q << np.uint64(SCALE)) + r + c
    return states.astype("<u8").tobytes() + np.concatenate(words[::-1] or [np.zeros(0, "<u4")]).tobytes()


def decode_block(raw: bytes, n: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    states = np.frombuffer(raw, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(raw, "<u4", offset=8 * LANES).astype(np.uint64)
    out, used = np.empty(n, np.uint32), 0
    mask = np.uint64((1 << SCALE) - 1)
    freq, start = freq.astype(np.uint64), start.astype(np.uint64)
    for at in range(0, n, LANES):
        x = states[: min(LANES, n - at)]
        slot = x & mask
        s = symbol[slot.astype(np.int64)]
        out[at : at + len(x)] = s
        x = freq[s] * (x >> np.uint64(SCALE)) + slot - start[s]
        under = x < LOW
        need = int(under.sum())
        if used + need > len(words):
            raise ValueError("the block ends early")
        x[under] = (x[under] << np.uint64(32)) | words[used : used + need]
        used += need
        states[: len(x)] = x
    if used != len(words) or np.any(states != LOW):
        raise ValueError("the block is damaged")
    return out


def write_file(sink, ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, nameless: int = 0) -> None:
    """The first `nameless` documents have no doc_id."""
    counts = np.bincount(ids, minlength=1)
    freq = frequencies(counts)
    start = np.cumsum(freq) - freq
    used = np.flatnonzero(freq)
    body, checks, at = io.BytesIO(), [], 0
    for first in range(0, len(ids), BLOCK):
        block = ids[first : first + BLOCK]
        raw = encode_block(block, freq, start)
        checks.append((at, len(raw), first, len(block), zlib.crc32(raw), zlib.crc32(block.astype("<u4").tobytes())))
        body.write(raw)
        at += len(raw)
    table = zlib.compress(used.astype("<u4").tobytes() + freq[used].astype("<u4").tobytes(), 1)
    documents = zlib.compress(docs.astype("<i8").tobytes() + lengths.astype("<i8").tobytes(), 1)
    header = json.dumps({"scale": SCALE, "lanes": LANES, "ids": len(ids), "docs": len(docs), "nameless": nameless, "used": len(used), "table": len(table), "documents": len(documents), "body": at}).encode()
    points = b"".join(struct.pack("<qqqqII", *c) for c in checks)
    head = MAGIC + struct.pack("<I", len(header)) + header + table + documents
    for part in (head, body.getvalue(), points, struct.pack("<qI", len(checks), zlib.crc32(head + points)), MAGIC):
        sink.write(part)


class Reader:
    """Reads one file; blocks can be decoded in any order."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 20)
        n, check = struct.unpack("<qI", (tail := source.read(20))[:12])
        source.seek(0)
        head = source.read(12)
        if head[:8] != MAGIC or tail[12:] != MAGIC:
            raise ValueError("not a file of this format, or cut off")
        head += source.read(struct.unpack("<I", head[8:])[0])
        self.header = h = json.loads(head[12:])
        if (h["scale"], h["lanes"]) != (SCALE, LANES):
            raise ValueError("coded with other parameters")
        table, documents = source.read(h["table"]), source.read(h["documents"])
        self.body = len(head) + len(table) + len(documents)
        source.seek(self.body + h["body"])
        points = source.read(40 * n)
        if zlib.crc32(head + table + documents + points) != check:
            raise ValueError("tables fail their checksum")
        self.checkpoints = [struct.unpack_from("<qqqqII", points, 40 * i) for i in range(n)]
        used, freq = np.frombuffer(zlib.decompress(table), "<u4").reshape(2, -1).astype(np.int64)
        self.freq = np.zeros(int(used.max()) + 1 if len(used) else 1, np.int64)
        self.freq[used] = freq
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(used, freq).astype(np.int64)
        self.docs, self.lengths = np.frombuffer(zlib.decompress(documents), "<i8").reshape(2, -1)

    def block(self, k: int) -> np.ndarray:
        at, size, _, n, coded, plain = self.checkpoints[k]
        self.source.seek(self.body + at)
        raw = self.source.read(size)
        if zlib.crc32(raw) != coded:
            raise ValueError(f"block {k} fails its checksum")
        ids = decode_block(raw, n, self.freq, self.start, self.symbol)
        if zlib.crc32(ids.astype("<u4").tobytes()) != plain:
            raise ValueError(f"the ids of block {k} fail their checksum")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place in the file, ids), one block in memory at a time besides the document's own ids."""
        held: list[np.ndarray] = []
        k = have = at = 0
        names = [None] * self.header["nameless"] + self.docs.tolist()[self.header["nameless"] :]
        for doc, length in zip(names, self.lengths.tolist(), strict=True):
            while have < length:
                held.append(self.block(k))
                have += len(held[-1])
                k += 1
            flat = np.concatenate(held) if len(held) > 1 else held[0]
            yield doc, at, flat[:length]
            held, have, at = [flat[length:]], have - length, at + length


def _place(folder: str):
    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, vocabulary: str, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = _place(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store = tokens.words(vocabulary)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = nameless = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number, nameless
            ids, docs, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{base}/part-{part:06d}-{number:06d}.rans"
            with system.open_output_stream(f"{name}.{attempt}", compression=None) as sink:  # named only when whole; a task that runs again replaces it
                write_file(sink, ids, docs, lengths, nameless)
            system.move(f"{name}.{attempt}", name)
            held, number, nameless = [], number + 1, 0
            return pa.RecordBatch.from_pydict({"file": [name.rpartition("/")[2]], "n_ids": [len(ids)]})

        for batch in batches:
            for piece in textnp.slices(batch, "text", 2 << 20):
                ids, lengths = tokens.end_with(*store.encode(piece.column("text")), end)
                held.append((ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, piece.column("doc_id").fill_null(0).to_numpy(), lengths))
                nameless += piece.column("doc_id").null_count
                if sum(len(x) for x, _, _ in held) >= most:
                    yield flush()
        if held:
            yield flush()

    return run


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = 2, text: str = "text", doc_id: str = "doc_id", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files; returns their saved list (file, n_ids, base), base being the number of ids in the files before."""
    spark = docs.sparkSession
    scratch.ship(spark)
    folder = folder or scratch.path(spark, "rans")
    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = scratch.saved(ordered.mapInArrow(_writer(folder, vocabulary, end, file_ids), "file string, n_ids long"), "files")
    # one row for each file
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select(F.concat(F.lit(folder + "/"), "file").alias("file"), "n_ids", before.alias("base"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            system, name = _place(file)
            with system.open_input_file(name) as source:
                out: list[list] = [[], [], [], []]
                for doc, at, ids in Reader(source).documents():
                    for column, value in zip(out, (doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, each file decoded by one task."""
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "file").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
