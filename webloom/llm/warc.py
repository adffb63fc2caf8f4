"""WARC archives with dictionary-compressed records.

Each archive is a .warc.zst file: a leading skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built
from the archive's own first records, then one Zstandard frame per record, so that any record can be read alone.
The dictionary is trained on at most DICT_SAMPLE_BYTES of the records; it changes sizes, never contents.

Records with equal payloads of at least `min_bytes` bytes are written once, as the response of the smallest
page id; the others are revisits that refer to it.  Equality is by SHA-256, computed in the JVM.  Pages are joined with the
digests that occur more than once; a digest that a third of the pages share is split by the adaptive skew join.

Tasks write to a name of their own attempt and hand back the names that count, so lost or repeated
tasks leave at most a file that nobody reads.  Files are rolled at ROLL_BYTES.  They are written through
pyarrow's file systems, so the folder may be any that executors reach (file://, hdfs://).

Nulls, ties and odd rows: null html is an empty payload; a null url leaves out the target; control characters in a url are
percent-encoded; of rows with one page id and payload each is a response if the id is the smallest; null ids are larger than all
others, and where all ids of a payload are null, each is a response.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_arrow_batches, materialise, new_path

MIN_BYTES = 100
DICT_BYTES = 32 << 10
DICT_SAMPLE_BYTES = 1 << 20
ROLL_BYTES = 512 << 20
#: Tasks that read archives at most.
MAX_TASKS = 20_000
SKIPPABLE_MAGIC = 0x184D2A5D
_DATE = "2024-01-01T00:00:00Z"


# ------------------------------------------------------------------------ records


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """A WARC/1.1 record; a revisit keeps headers only, and the payload's length in an extension field."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_clean(url)}"]),
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return fields, block.partition(b"\r\n\r\n")[2]


# ----------------------------------------------------------------------- archives


class Writer:
    """Writes records to one archive; the first ones are held back until the dictionary is built."""

    def __init__(self, out):
        self.out, self.waiting, self.held, self.squeeze, self.n, self.size = out, [], 0, None, 0, 0

    def add(self, raw: bytes) -> None:
        self.n += 1
        if self.squeeze is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if self.held >= DICT_SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.squeeze.compress(raw))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        content = b""
        if len(self.waiting) >= 8:
            try:
                content = zstandard.train_dictionary(DICT_BYTES, [x[: DICT_BYTES * 4] for x in self.waiting], k=1024, d=8).as_bytes()
            except zstandard.ZstdError:  # too little or too uniform to train on
                content = b""
        if not content:
            content = b"".join(self.waiting)[-DICT_BYTES:]  # a raw-content dictionary
        given = zstandard.ZstdCompressionDict(content)
        self.squeeze = zstandard.ZstdCompressor(level=3, dict_data=given, write_checksum=True, write_content_size=True)
        packed = zstandard.ZstdCompressor(level=9).compress(content)
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed)
        for raw in self.waiting:
            self._put(self.squeeze.compress(raw))
        self.waiting = []

    def close(self) -> None:
        if self.squeeze is None:
            self._begin()
        self.out.close()


def records(stream):
    """Raw records of an archive, one frame at a time, from any file object."""
    buffered = io.BufferedReader(stream, 1 << 20) if isinstance(stream, io.RawIOBase) else stream
    magic, size = struct.unpack("<II", buffered.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    given = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(buffered.read(size)))
    left = b""
    while True:
        inflate = zstandard.ZstdDecompressor(dict_data=given).decompressobj()
        parts = []
        while not inflate.eof:
            data = left or buffered.read(1 << 16)
            left = b""
            if not data:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(inflate.decompress(data))
        left = inflate.unused_data
        yield b"".join(parts)


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


def _write(folder: str):
    schema = pa.schema([("path", pa.string()), ("n", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        task, store, own, path = TaskContext.get(), None, None, None
        done = []
        for batch in batches:
            ids, urls, htmls, digests, refers, kinds = batch.columns
            for row in range(batch.num_rows):
                if own is None:
                    store, base = _open(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
                    path = f"{base}/{name}"
                    own = Writer(store.open_output_stream(path))
                payload = htmls[row].as_buffer().to_pybytes() if htmls[row].is_valid else b""
                own.add(record(ids[row].as_py(), urls[row].as_py(), payload, digests[row].as_py(), refers[row].as_py(), kinds[row].as_py()))
                if own.size >= ROLL_BYTES:
                    own.close()
                    done.append((path, own.n, own.size))
                    own = None
        if own is not None:
            own.close()
            done.append((path, own.n, own.size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page; returns the manifest (path, n, bytes) of the archives that count."""
    limit_arrow_batches(pages.sparkSession)
    body = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    same = rows.filter(F.length("html") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").select("digest", "first")
    # a table of its own, so that the adaptive skew join can split a digest that many pages share
    same = materialise(same, "repeated")
    joined = rows.join(same, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    out = joined.select("id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("kind"))
    return materialise(out.mapInArrow(_write(folder), "path string, n long, bytes long"), "manifest")


def _read(folder: str, with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def number(urn: str | None) -> int | None:
        return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])

    def run(batches):
        store, _ = _open(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path) as stream:
                    for raw in records(stream):
                        fields, payload = parse(raw)
                        named = fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "response":
                            digest = hashlib.sha256(payload).hexdigest()
                            if digest != named or len(payload) != int(fields["warc-payload-length"]):
                                raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                        rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), int(fields["warc-payload-length"]), named, fields["warc-type"], number(fields.get("warc-refers-to")), *[payload] * with_payload))
                        held += len(payload) * with_payload + 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null-free)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    # a task for each archive
    return manifest.select("path").repartition(max(1, min(manifest.count(), MAX_TASKS))).mapInArrow(_read(folder, with_payload), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    folder = new_path(spark, "warc")
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
             min(page_id) OVER (PARTITION BY h) AS lowest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> lowest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> lowest THEN lowest END AS refers_to
FROM d
"""
