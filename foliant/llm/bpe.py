"""Byte-level BPE by public rank files: encoding in overlapping chunks, decoding by joining raw bytes.

A text of up to ``CHUNK`` characters is one chunk. A longer one is cut into chunks that overlap by ``OVERLAP`` and are dealt
to any tasks. Each chunk is pre-tokenised and encoded where it lies. The pattern never looks back, so two scans that
break at the same place go on alike: a chunk lists the breaks in the overlaps at its head and tail with the number of its
ids up to each, and two neighbours are stitched at the first break that both have. Breaks within ``MARGIN`` characters
of a chunk's end are not trusted, as the match there might have gone on. Stitching reads breaks and ids only, never text.

Where two neighbours share no break (one match longer than the overlap), the text is encoded again in whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import prepare, settled

CHUNK, OVERLAP, MARGIN = 1 << 14, 1 << 9, 16
#: Texts or chunks to an Arrow batch: their ids, as Python numbers, take several times their bytes.
BATCH = 64
#: A rank file is sent to the tasks; larger ones are refused.
MOST_RANK_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} has more than {MOST_RANK_BYTES} bytes")
    return data


class Codec:
    """Encodes and decodes by ranks (the bytes of a rank file) and a pre-token pattern; no special tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.piece = [b""] * (max(table.values()) + 1)
        for k, v in table.items():
            self.piece[v] = k

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        piece = self.piece
        return b"".join([piece[i] for i in ids])

    def breaks(self, chunk: str, whole: bool) -> list[int]:
        """Ends of the matches in a chunk; without those too near its end unless the text ends there (``whole``)."""
        most = len(chunk) if whole else len(chunk) - MARGIN
        return [m.end() for m in self.pattern.finditer(chunk) if m.end() <= most]

    def counted(self, chunk: str, first: bool, last: bool, step: int, overlap: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """(ids, breaks in the head overlap, ids up to each, breaks in the tail overlap, ids up to each) of a chunk.

        Breaks count from the chunk's start. The first chunk starts at a break, the last ends at one; ids after the last
        trusted break of another are left out, as the next chunk has them.
        """
        ends = self.breaks(chunk, last)
        ids, at, marks = [], 0, {}
        # piece by piece in the overlaps, where ids are counted; in one call between them
        inner = [e for e in ends if overlap < e < step and not chunk[e - 1].isspace()]
        jump = (next((e for e in ends if e >= overlap), 0), inner[-1] if inner else 0)
        for e in ends:
            if jump[0] < e < jump[1] or e <= at:
                continue
            ids.extend(self.encode(chunk[at:e]))
            at, marks[e] = e, len(ids)
        heads = [e for e in marks if e <= overlap and not first]
        tails = [e for e in marks if e >= step and not last]
        return ids, heads, [marks[e] for e in heads], tails, [marks[e] for e in tails]


@functools.lru_cache(maxsize=1)
def codec_of(ranks: bytes, pattern: str) -> Codec:
    """The codec of a Python worker: built once, kept for the tasks that follow."""
    return Codec(ranks, pattern)


def stitched(parts, step: int):
    """The ids of a text from its chunks' (ids, heads, counts, tails, counts) in order; None where neighbours share no break."""
    out, begin = [], 0
    for k, (ids, _, _, tails, ends) in enumerate(parts):
        if k + 1 == len(parts):
            out.append(ids[begin:])
            break
        _, heads, starts, _, _ = parts[k + 1]
        own = {e - step: n for e, n in zip(tails, ends)}
        seam = next(((own[h], n) for h, n in zip(heads, starts) if h in own), None)
        if seam is None:
            return None
        out.append(ids[begin : seam[0]])
        begin = seam[1]
    return [i for part in out for i in part]


def digests(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    packed = np.asarray(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _short(batches, ranks, pattern, with_ids):
    codec = codec_of(ranks, pattern)
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        ids = [codec.encode(t or "") for t in texts]
        yield _out(codec, keys, ids, with_ids)


def _out(codec, keys, ids, with_ids):
    n, a, b = zip(*[digests(codec, x) for x in ids]) if ids else ((), (), ())
    columns = [keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        columns.append(pa.array(ids, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _chunks(batches, chunk, overlap):
    """(row, mark, key, chunk number, last, chunk) of long texts."""
    for batch in batches:
        row, mark, key, text = batch.columns
        for i in range(batch.num_rows):
            t = text[i].as_py()
            starts = range(0, max(1, len(t) - overlap), chunk)
            for k, at in enumerate(starts):
                columns = [row.slice(i, 1), mark.slice(i, 1), key.slice(i, 1), pa.array([k], pa.int32()), pa.array([k + 1 == len(starts)]), pa.array([t[at : at + chunk + overlap]])]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "mark", "key", "k", "last", "chunk"])


def _encoded(batches, ranks, pattern, chunk, overlap):
    codec, names = codec_of(ranks, pattern), ("ids", "heads", "starts", "tails", "ends")
    for batch in batches:
        found = [codec.counted(c, k == 0, last, chunk, overlap) for k, last, c in zip(*(batch.column(x).to_pylist() for x in ("k", "last", "chunk")))]
        lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], names=["row", "mark", "key", "k", *names])


def _stitch(batches, ranks, pattern, with_ids, chunk):
    """Encoded chunks sorted by row and number to a row a text; n_tokens is null where the text must be encoded again."""
    codec, now, key, mark, parts = codec_of(ranks, pattern), None, None, None, []

    def done():
        ids = stitched(parts, chunk)
        out = _out(codec, key, [ids or []], with_ids)
        n = out.column(1) if ids is not None else pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([mark, key, n, *out.columns[2:]], names=["mark", *out.schema.names])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("ids", "heads", "starts", "tails", "ends")]
        for i, row in enumerate(batch.column("row").to_pylist()):
            if row != now:
                if parts:
                    yield done()
                now, key, mark, parts = row, batch.column("key").slice(i, 1), batch.column("mark").slice(i, 1), []
            parts.append(tuple(c[i] for c in columns))
    if parts:
        yield done()


def encode(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """A row per row of ``docs``: key, n_tokens (long), ids_sha256, decoded_sha256, and ids (array of int) if asked for.

    Null texts count as empty: no tokens. Both digests of an empty text are that of no bytes. Repeated rows stay; null keys
    stay null; extra columns are not read. Texts are encoded whole; those longer than a chunk are shuffled, chunk by chunk,
    then their ids. A task holds one text's ids at a time. Empty tables give no rows.
    """
    prepare(docs.sparkSession, BATCH)
    kind = docs.schema[key].dataType.simpleString()
    found = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = f"key {kind}, {found}"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = F.char_length("text") > chunk + overlap
    short = rows.where(F.col("text").isNull() | ~long).mapInArrow(lambda it: _short(it, ranks, pattern, with_ids), out)
    mark = F.xxhash64("key", "text")
    cut = rows.where(long).select(F.monotonically_increasing_id().alias("row"), mark.alias("mark"), "key", "text")
    cut = cut.mapInArrow(lambda it: _chunks(it, chunk, overlap), f"row long, mark long, key {kind}, k int, last boolean, chunk string").repartition("row", "k")
    cut = cut.mapInArrow(lambda it: _encoded(it, ranks, pattern, chunk, overlap), f"row long, mark long, key {kind}, k int, ids array<int>, heads array<int>, starts array<int>, tails array<int>, ends array<int>")
    cut = cut.repartition("row").sortWithinPartitions("row", "k")
    cut = settled(cut.mapInArrow(lambda it: _stitch(it, ranks, pattern, with_ids, chunk), f"mark long, {out}"), "bpe-long")
    made = short.unionByName(cut.where("n_tokens is not null").drop("mark"))
    again = cut.where("n_tokens is null").select(F.col("mark").alias("_mark")).distinct()
    if again.isEmpty():
        return made
    whole = rows.where(long).withColumn("mark", mark).join(again, F.col("mark") == F.col("_mark"), "left_semi").select("key", "text")
    return made.unionByName(whole.mapInArrow(lambda it: _short(it, ranks, pattern, with_ids), out))
