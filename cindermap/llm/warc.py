"""Operator 7: WARC archives of Zstandard frames, written and read.

An archive is a skippable frame that holds the dictionary, then one frame a record, so a reader can begin at any record
and a damaged one costs only itself. Every task writes its records into archives of about ``TARGET`` bytes, each with a
dictionary trained on a bounded sample of its own first payloads (archives of few records carry none), and gives the
file its name when it is whole.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the smallest page_id is a response; the others are
revisits that name it and hold no payload. Equality is found on digests: the pages move only when the table of repeated
digests is too large for Spark to send around.

The reader takes an archive as a stream: it loads the dictionary from the leading frame, decodes frame after frame, and
checks the version line, the block's length, the record's end, the payload's digest and length. A record that fails
raises ValueError with its number.

Defined cases: a null html is an empty payload; a null url gives a record without target; control characters and spaces
in urls are percent-encoded; a null page_id is written as an empty name, comes back as null, and is never the one that
others refer to unless all are null (then all are responses); rows that repeat a page_id with an equal payload are all
responses if it is the smallest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm.common import batch, encoded, shared_dir, store, table, write_file

MIN_REVISIT = 100
#: Bytes of an archive before compression of its last batch, sample for its dictionary and size of that.
TARGET, SAMPLE, DICTIONARY = 32 << 20, 1 << 20, 32 << 10
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
NAMES = uuid.UUID("6f5b9c0e-8f35-5d6e-9a51-6f2f0d6a7c11")
RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
RESULT_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. The payload of a response is the body of an HTTP message; a revisit has no block."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("X-Page-ID", "" if page_id is None else page_id)]
    block = b""
    if refers_to is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        head.append(("Content-Type", "application/http;msgtype=response"))
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", refers_to)]
    head.append(("Content-Length", len(block)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    taken, size = [], 0
    for s in samples:
        taken.append(s[: 16 << 10])
        size += len(taken[-1])
        if size >= SAMPLE:
            break
    if size < 8 * DICTIONARY or len(taken) < 32:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, taken, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The archive's bytes: the dictionary's frame if there is one, then a frame for each record."""
    trained = dictionary(records)
    if trained is not None:
        raw = trained.as_bytes()
        yield DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    compress = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in records:
        yield compress.compress(r)


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, records, size, k = TaskContext.get().partitionId(), [], 0, 0

        def out() -> pa.RecordBatch:
            path = f"{folder}/part-{part:05d}-{k:04d}.warc.zst"
            written = write_file(path, archive(records))
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(records)], "bytes": [written]})

        for rows in batches:
            for r in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = r
                records.append(record(page_id, url, encoded(html), digest, refers_to))
                size += len(records[-1])
                if size >= TARGET:
                    yield out()
                    records, size, k = [], 0, k + 1
        if records:
            yield out()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; one row each: path, records, bytes. Runs when the result is read, so read it once."""
    rows = pages.select("page_id", "url", "html", F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256).alias("digest"))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_REVISIT
    firsts = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    named = rows.join(firsts, "digest", "left")
    revisits = named.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return revisits.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(folder), "path string, records long, bytes long")


def frames(stream) -> Iterator[bytes]:
    """The content of each frame, the leading dictionary applied. ``stream`` has read(n)."""
    head = stream.read(8)
    trained = None
    if len(head) == 8 and int.from_bytes(head[:4], "little") in SKIPPABLE:
        raw, size = b"", int.from_bytes(head[4:], "little")
        while len(raw) < size:
            more = stream.read(size - len(raw))
            if not more:
                raise ValueError("the archive ends in its dictionary")
            raw += more
        if raw[:4] == (0xFD2FB528).to_bytes(4, "little"):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        trained, head = zstandard.ZstdCompressionDict(raw), b""
    decompress = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    data = head
    while data := data or stream.read(1 << 20):
        if len(data) < 8:
            data += stream.read(1 << 20)
        if int.from_bytes(data[:4], "little") in SKIPPABLE:
            size = 8 + int.from_bytes(data[4:8], "little")
            while len(data) < size and (more := stream.read(1 << 20)):
                data += more
            data = data[size:]
            continue
        frame, out = decompress.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                break
            data = stream.read(1 << 20)
            if not data:
                raise ValueError("the archive ends in a frame")
        yield b"".join(out)
        data = frame.unused_data


def parsed(raw: bytes) -> tuple:
    """A row of RESULT from one record; ValueError if it is not as it should be."""
    head, end, block = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != b"WARC/1.1" or not end:
        raise ValueError("no WARC/1.1 header")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[name.decode().lower()] = value.strip().decode()
    size = int(fields["content-length"])
    if len(block) != size + 4 or block[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the block")
    kind, digest, length, payload = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"]), None
    if kind == "response":
        http, end, payload = block[:size].partition(b"\r\n\r\n")
        if not end or not http.startswith(b"HTTP/1.1 200"):
            raise ValueError("no HTTP message")
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if fields["warc-payload-digest"] != f"sha256:{digest}" or length != int(fields["x-payload-length"]):
            raise ValueError("the payload does not match its digest and length")
    elif kind != "revisit":
        raise ValueError(f"a record of type {kind}")
    page_id, refers_to = fields["x-page-id"], fields.get("x-refers-to-page-id")
    return int(page_id) if page_id else None, length, digest, kind, int(refers_to) if refers_to else None, fields.get("warc-target-uri"), payload


def _read(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path in rows.column("path").to_pylist():
                fs, name = store(path)
                with fs.open_input_stream(name, compression=None) as stream:
                    out, size = [], 0
                    for i, raw in enumerate(frames(stream)):
                        try:
                            got = parsed(raw)
                        except (ValueError, KeyError) as e:
                            raise ValueError(f"{path}, record {i}: {e}") from e
                        out.append(got if payloads else (*got[:6], None))
                        size += len(raw)
                        if len(out) >= 2000 or size >= 16 << 20:
                            yield batch(RESULT, *zip(*out, strict=True))
                            out, size = [], 0
                    if out:
                        yield batch(RESULT, *zip(*out, strict=True))

    return read


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``paths.path``, one task an archive."""
    return paths.select("path").repartition(F.col("path")).mapInArrow(_read(payloads), RESULT_DDL)


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    written = write_archives(table(spark, sf_dir, "pages"), folder).select("path").collect()  # names of files
    paths = spark.createDataFrame([tuple(r) for r in written], "path string").repartition(max(1, len(written)))
    read = paths.mapInArrow(_read(False), RESULT_DDL)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
