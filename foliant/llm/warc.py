"""WARC archives of individually compressed records that share a Zstandard dictionary.

Each task writes one archive: a skippable frame that holds the dictionary, then one frame per record. The dictionary is
built from the first ``SAMPLE_RECORDS`` records of the archive (``SAMPLE_BYTES`` at most, each up to ``SAMPLE_EACH``);
these are held back until it is built, everything else streams. Equal payloads of at least ``LEAST_BYTES`` bytes are
stored once: the page with the largest id is the response, others are revisit records that refer to it.

Archives are written under a temporary name and renamed, so a task that runs twice leaves one whole file per attempt;
the manifest, itself a table in the shared folder, names the attempts that count.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import prepare, settled, shared_dir, small_or_shuffled

LEAST_BYTES = 1000
SKIPPABLE = 0x184D2A5D
LEVEL, DICTIONARY_BYTES = 3, 32 << 10
SAMPLE_RECORDS, SAMPLE_BYTES, SAMPLE_EACH = 400, 1 << 20, 8 << 10
SPACE = uuid.UUID("5f0d8a0e-6f6e-5f0b-9a55-3f1a1f0c7d10")
READ_BYTES = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def _line(value) -> str:
    """A header value on one line."""
    return " ".join(str(value).split())


def record(page_id, url, payload: bytes, sha1: str, refers_to) -> bytes:
    """A whole WARC/1.1 record; ``refers_to`` is the response's page id for a revisit, else None."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {_line(url) if url is not None else 'urn:none'}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from archived records; None if they are too few or too alike to build one."""
    samples = [r[:SAMPLE_EACH] for r in records]
    if len(samples) < 8 or sum(map(len, samples)) < 4 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """Writes records to a binary file: the dictionary frame first, then a frame for each record."""

    def __init__(self, out):
        self.out, self.held, self.bytes, self.compressor, self.records, self.written = out, [], 0, None, 0, 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.held.append(data)
            self.bytes += min(len(data), SAMPLE_EACH)
            if len(self.held) >= SAMPLE_RECORDS or self.bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.compressor.compress(data))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        dictionary = train(self.held)
        if dictionary is not None:
            raw = dictionary.as_bytes()
            self._put(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        for data in self.held:
            self._put(self.compressor.compress(data))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()


def frame_end(data, at: int) -> int | None:
    """Where the Zstandard frame that begins at ``at`` ends, by its header and block sizes; None if ``data`` ends before."""
    if len(data) < at + 5:
        return None
    if bytes(data[at : at + 4]) != zstandard.FRAME_HEADER:
        raise ValueError("no Zstandard frame")
    flags = data[at + 4]
    single, dictionary, size = flags >> 5 & 1, (0, 1, 2, 4)[flags & 3], (1 if flags >> 5 & 1 else 0, 2, 4, 8)[flags >> 6]
    place = at + 5 + (not single) + dictionary + size
    while len(data) >= place + 3:
        head = int.from_bytes(data[place : place + 3], "little")
        place += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # a run of one byte, or the block itself
        if head & 1:
            place += 4 * (flags >> 2 & 1)
            return place if place <= len(data) else None
    return None


def read(stream):
    """Yield the decompressed records of an archive, one at a time; each byte is copied once, however many frames there are."""
    head = stream.read(8)
    dictionary, data = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        dictionary, data = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1])), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    at, want = 0, READ_BYTES
    while True:
        view = memoryview(data)
        end = frame_end(view, at)
        if end is None:  # read on; a frame longer than what is held doubles the next read
            more = stream.read(want)
            if not more:
                if at < len(data):
                    raise ValueError("an archive ends within a record")
                return
            data, at, want = bytes(view[at:]) + more, 0, READ_BYTES if at else 2 * want
            continue
        yield decompressor.decompressobj().decompress(view[at:end])
        at = end


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record has another length than it says")
    return headers, block.partition(b"\r\n\r\n")[2]


def _write(batches, folder: str):
    """One archive from a task's rows (page_id, url, html, sha1, refers_to)."""
    system, base = fs.FileSystem.from_uri(folder)
    name, out, writer = f"{uuid.uuid4().hex}.warc.zst", None, None
    for batch in batches:
        for page_id, url, html, sha1, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
            if out is None:
                out = system.open_output_stream(posixpath.join(base, f"_{name}"), compression=None)
                writer = Writer(out)
            writer.add(record(page_id, url, (html or "").encode(), sha1, refers_to))
    if out is not None:
        writer.close()
        out.close()
        system.move(posixpath.join(base, f"_{name}"), posixpath.join(base, name))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([writer.records]), pa.array([writer.written])], names=["path", "records", "bytes"])


def _read(batches):
    """Rows of every record in the archives named; payloads are checked against their digests."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, base = fs.FileSystem.from_uri(path)
            rows = []
            with system.open_input_stream(base, compression=None) as stream:
                for data in read(stream):
                    headers, payload = parse(data)
                    sha1 = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != sha1:
                        raise ValueError(f"a payload in {path} has another digest")
                    page, to = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append((page and int(page), int(headers["x-payload-length"]), sha1, headers["warc-type"], to and int(to)))
                    if len(rows) >= 10_000:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, sha1, refers_to) of every page: which are revisits, and of which page.

    Null html counts as empty. Rows that tie for the largest page id of a payload are all responses; a payload whose
    pages all lack an id has responses only. Only ids and digests are shuffled to find copies; then a page meets its
    response by a join on the digest, hot payloads by a checked broadcast or split by AQE.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("sha1"), F.octet_length(html).alias("size"))
    many = rows.where(F.col("size") >= LEAST_BYTES).groupBy(F.col("sha1").alias("_sha1"), F.col("size").alias("_size"))
    many = many.agg(F.max("page_id").alias("_to"), F.count("*").alias("_n")).where("_n > 1 and _to is not null").drop("_n")
    many = small_or_shuffled(settled(many, "warc-copies"))
    out = rows.join(many, (F.col("sha1") == F.col("_sha1")) & (F.col("size") == F.col("_size")), "left")
    return out.select("page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("_to")), F.col("_to")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives of ``pages`` into ``folder`` (a URI all executors reach); the manifest (path, records, bytes).

    A record per row of ``pages``: null html is an empty payload, null urls and ids are left out, repeated rows are records
    of their own, payloads are stored whole. Other columns are not read. Empty tables write no archive and give no rows.
    Without ``folder`` the archives go to this application's shared folder and are deleted with it.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return settled(planned(pages).mapInArrow(lambda it: _write(it, folder), "path string, records long, bytes long"), "warc-manifest")


def read_back(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of the archives in ``manifest``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    prepare(spark)
    n = max(1, manifest.count())
    paths = manifest.select("path").repartition(n, "path") if n > 1 else manifest.select("path")
    return paths.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
