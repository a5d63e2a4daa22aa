"""Operator 8: web archives of Zstandard-compressed WARC records, written and read.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the compression dictionary; then each record is one frame. Of
records with equal payloads of at least `least` bytes, that with the largest page_id is a response and the others are revisits that
name it and carry no payload; all smaller ones are responses. The dictionary is trained on at most SAMPLE_PAGES pages (those of
smallest hash), of at most SAMPLE_BYTES bytes each; it changes sizes only, never contents.

The reader loads the dictionary, decodes frame by frame, and checks: the record's version line, that required headers stand there
once, Content-Length against the block, the closing empty lines, the HTTP head, and each response's digest.

Defined results: null html counts as empty, null url as an empty one; a null page_id has an empty name and is read back as null (it
revisits a copy that has a page_id; without such a copy it is a response); pages that repeat a page_id each get a record; an empty table
gives no archive; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, skew

DICTIONARY_MAGIC = 0x184D2A5D
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 65_536
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def train(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> bytes:
    """A dictionary, or b"" where the sample is too small to train one."""
    n = pages.count()
    share = 1.0 if n <= SAMPLE_PAGES else 1.2 * SAMPLE_PAGES / n
    low = F.pmod(F.xxhash64(page_id), F.lit(1 << 30)).alias("h")
    chosen = pages.select(F.substring(F.encode(F.coalesce(html, F.lit("")), "utf-8"), 1, SAMPLE_BYTES).alias("x"), low).where(F.col("h") < int(share * (1 << 30)))
    # about 1.2 * SAMPLE_PAGES rows; the limit only guards against a page_id that repeats without end
    samples = [bytes(r.x) for r in sorted(chosen.limit(2 * SAMPLE_PAGES).collect(), key=lambda r: (r.h, r.x))[:SAMPLE_PAGES] if r.x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"Content-Length: {len(block)}",
    ]
    return CRLF.join(x.encode() for x in lines) + CRLF + CRLF + block + CRLF + CRLF


def parse(raw: bytes) -> dict:
    """The record of one frame, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or not gap:
        raise ValueError("no WARC/1.1 record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys():
        raise ValueError(f"headers are missing: {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the block")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(CRLF)[1:] if x.lower().startswith(b"content-length:")]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    page = lambda x: int(name) if (name := x.removeprefix("<urn:page:").removesuffix(">")) else None
    refers = fields.get("warc-refers-to")
    if not http.startswith(b"HTTP/1.1 200") or not gap or len(sizes) != 1:
        raise ValueError("no HTTP response in the block")
    if fields["warc-type"] == "response":
        if len(payload) != sizes[0] or hashlib.sha1(payload).hexdigest() != digest or refers:
            raise ValueError("the payload fails its length or digest")
    elif fields["warc-type"] != "revisit" or payload or not refers:
        raise ValueError("a revisit names its response and has no payload")
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "payload_bytes": sizes[0], "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page(refers) if refers else None, "payload": payload}


def frames(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The decoded records of an archive, after its dictionary, with a bounded part of the file in memory."""
    head = source.read(8)
    if len(head) < 8:
        raise ValueError("the archive is cut off")
    magic, size = struct.unpack("<II", head)
    dictionary, pending = None, head
    if magic == DICTIONARY_MAGIC:
        raw = source.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary is cut off")
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=16 << 20)
        dictionary, pending = zstandard.ZstdCompressionDict(raw), b""
    make = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        pending = pending or source.read(chunk)
        if not pending:
            return
        decoder, parts = make.decompressobj(), []
        while True:
            parts.append(decoder.decompress(pending))
            pending = decoder.unused_data
            if decoder.eof:
                break
            pending = source.read(chunk)
            if not pending:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def _writer(folder: str, dictionary: bytes, level: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        number = written = count = 0
        sink = name = None

        def close() -> pa.RecordBatch:
            sink.close()
            system.move(f"{name}.{attempt}", name)
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name.rpartition('/')[2]}"], "n_records": [count]})

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, refers = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "refers_to"))
                if sink is None:
                    name = f"{base}/part-{part:06d}-{number:06d}.warc.zst"
                    sink, written, count, number = system.open_output_stream(f"{name}.{attempt}", compression=None), 0, 0, number + 1
                    if dictionary:
                        sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                frame = packer.compress(record(page, url, html.encode(), digest, refers))
                sink.write(frame)
                written, count = written + len(frame), count + 1
                if written >= most:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return run


def write(pages: DataFrame, folder: str | None = None, least: int = 1000, level: int = 3, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes the archives; returns their saved list (file, n_records)."""
    spark = pages.sparkSession
    scratch.ship(spark)
    folder = folder or scratch.path(spark, "warc")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"), F.octet_length(html).alias("size"))
    large = F.col("size") >= least
    same = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = skew.lookup(rows, same, ["digest"], F.struct("page_id", "url")).withColumn("refers_to", F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    sent = found.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(folder, train(pages), level, file_bytes), "file string, n_records long")
    return scratch.saved(sent, "archives")


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("file").to_pylist():
            system, name = fs.FileSystem.from_uri(file)
            with system.open_input_stream(name, compression=None) as source:
                held: list[dict] = []
                for raw in frames(source):
                    held.append(parse(raw))
                    if len(held) >= 500:
                        yield _batch(held)
                        held = []
                yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in FIELDS), pa.array([r["payload"] for r in rows], pa.binary())], [*FIELDS, "payload"])


def read(files: DataFrame) -> DataFrame:
    """The archives' records: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (of responses)."""
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "file").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
