"""WARC archives: dictionary-compressed writer, and its reader.

A Zstandard dictionary is built from a bounded sample of the payloads. Each
archive file starts with a skippable frame that holds the dictionary; after it,
every record is a Zstandard frame of its own, compressed with the dictionary.

Of rows with equal payloads of at least `revisit_bytes` bytes, that with the
smallest key is a response; the others are revisits that name it and have no
payload. Every task writes one file to the shared folder under a name of its own
attempt; the manifest, a table, lists the files of the attempts that succeeded.
The reader streams each file, and recomputes the digest of each response.

Null payload: empty. Null key: larger than all others, written without a key and
read back null. Rows that repeat key and payload are alike: all responses, or all
revisits. No URL: the record has none. An empty table makes no files. Control
characters in URLs are percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm.common import new_path, written

#: Fixed value: the skippable frame that holds the dictionary, as the WARC specification's annex on Zstandard has it.
DICTIONARY_FRAME = 0x184D2A5D
READ_COLUMNS = "payload_bytes long, payload_digest string, record_type string, refers_to"


def dictionary(pages: DataFrame, payload: str, *, samples: int = 400, sample_bytes: int = 8_192, size: int = 65_536) -> bytes:
    """A dictionary from at most `samples` payloads, those with the smallest hashes; of each, at most sample_bytes."""
    found = pages.where(F.length(payload) > 0).withColumn("__h", F.xxhash64(payload))
    least = [r["__h"] for r in found.select("__h").distinct().orderBy("__h").limit(samples).collect()]  # hashes only: each task sends `samples` of them
    if not least:
        return b""
    chosen = found.where(F.col("__h") <= least[-1]).select("__h", F.substring(F.encode(payload, "UTF-8"), 1, sample_bytes).alias("b"))
    parts = [bytes(r["b"]) for r in chosen.groupBy("__h").agg(F.min("b").alias("b")).orderBy("__h").collect()]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small: the samples themselves serve as one
        return b"".join(parts)[:size]


def _record_id(key: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}:{digest}')}>"


def record(kind: str, key: str | None, url: str | None, digest: str, size: int, payload: bytes | None, refers: str | None, date: str) -> bytes:
    block = b""
    if payload is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(key, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        safe = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers, digest)}", f"X-Refers-To-Key: {refers}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    head += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 100, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; the manifest: (path, records, bytes)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(payload, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    long = rows.where(F.col("size") >= revisit_bytes).select("key", "digest")
    first = long.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = long.join(first, "digest").where(~F.col("key").eqNullSafe(F.col("first"))).distinct().toDF("d", "k", "refers")
    whole = rows.join(revisits, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    whole = whole.select(F.col("key").cast("string"), "url", "digest", "size", F.when(F.col("d").isNull(), F.col("payload")).alias("payload"), F.col("refers").cast("string"))
    sent = spark.sparkContext.broadcast(dictionary(pages, payload))
    folder = new_path(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        words = zstandard.ZstdCompressionDict(sent.value)
        packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True)
        out, name, n, size = None, f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(name)
                    size += out.write(struct.pack("<II", DICTIONARY_FRAME, len(sent.value)) + sent.value)
                data = r["payload"]
                size += out.write(packer.compress(record("revisit" if data is None else "response", r["key"], r["url"], r["digest"], r["size"], data, r["refers"], date)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})

    manifest = written(whole.mapInArrow(archive, "path string, records long, bytes long"), "manifest")
    manifest._oddsmith_folder = folder
    return manifest


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    words = zstandard.ZstdCompressionDict(stream.read(size))
    with zstandard.ZstdDecompressor(dict_data=words).stream_reader(stream, read_across_frames=True, closefd=False) as plain:
        text = io.BufferedReader(plain, 1 << 20)
        while line := text.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := text.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            block = text.read(int(head["Content-Length"]))
            if text.read(4) != b"\r\n\r\n":
                raise ValueError("a record isn't complete")
            yield head, block


def read(spark: SparkSession, manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """(key, url, READ_COLUMNS, payload) of each record of the manifest's files."""
    folder = manifest._oddsmith_folder

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path) as stream:
                    for head, block in records(stream):
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                        body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if body is not None and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload isn't what its digest says")
                        rows.append((head.get("X-Key"), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, kind, head.get("X-Refers-To-Key"), body))
                        held += len(block) + 500
                        if held > 8_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = manifest.select("path").repartition(max(1, manifest.count()))
    found = files.mapInArrow(parse, "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return found.withColumn("key", F.col("key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
