"""WARC archives of separately compressed records that share a Zstandard dictionary.

Layout of an archive (`.warc.zst`): one skippable frame with the dictionary, then one Zstandard
frame for each record, so any record can be read by its offset with the dictionary alone.  The
dictionary is trained from the records of that archive.  An archive without enough text for a
dictionary has an empty leading frame and plain record frames.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest id is
the response and the others revisit it; rows that share that id too are all responses.  A null
payload is empty, a null id is written as such and never the one that is revisited unless all are
null.  Copies are told by SHA-1 and length of the payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm.shared_files import put
from tillwise.llm.staging import estimated_rows

#: Magic number of the skippable frame that holds a dictionary in WARC files (fixed value).
DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
TRAINING_BYTES = 4 << 20
LEVEL = 3
#: Copy groups are broadcast up to this many rows of about 60 bytes; beyond it Spark shuffles.
BROADCAST_ROWS = 500_000

MANIFEST = "archive string, records long, bytes long"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long, intact boolean")


def with_copies(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes, refers_to`` of each page.

    Sizes and digests are grouped without the payloads, and only groups of two or more come back.
    """
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", "html", F.sha1(raw).alias("payload_digest"),
                         F.octet_length(raw).cast("long").alias("payload_bytes"))
    groups = (pages.where(F.col("payload_bytes") >= least_bytes)
              .groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
              .agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    if estimated_rows(groups, BROADCAST_ROWS) <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    match = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))
    other = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return pages.join(groups, match, "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(other, F.col("newest")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no body and names the record it repeats."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {url or ''}".replace("\r", "%0D").replace("\n", "%0A"),
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}",
            f"X-Payload-Length: {size}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: "
                 "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The file of these records: dictionary frame, then a frame for each record."""
    import zstandard

    trained, samples, size = None, [], 0
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    for sample in records[::step]:
        samples.append(sample[:DICTIONARY_BYTES * 2])
        size += len(samples[-1])
    if len(samples) >= 8 and size >= 8 * 1024:
        try:
            trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples,
                                                 k=256, d=8)
        except zstandard.ZstdError:  # too little that repeats
            trained = None
    content = trained.as_bytes() if trained else b""
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(content)), content,
                     *[squeeze.compress(r) for r in records]])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Archives of up to ``ARCHIVE_BYTES`` of records each, in ``folder``, a shared URI.

    Returns the manifest; archives are written when it is computed.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            content, name = archive(held), f"part-{part:06d}-{number:05d}.warc.zst"
            put(folder, name, content)
            row = pa.RecordBatch.from_pydict({"archive": [name], "records": [len(held)],
                                              "bytes": [len(content)]})
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row["page_id"], row["url"], (row["html"] or "").encode(),
                                   row["payload_digest"], row["payload_bytes"], row["refers_to"]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return with_copies(pages, least_bytes).mapInArrow(write, MANIFEST)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    trained = zstandard.ZstdCompressionDict(content[8:8 + size]) if size else None
    unpack = zstandard.ZstdDecompressor(dict_data=trained)
    rest = memoryview(content)[8 + size:]
    while len(rest):
        one = unpack.decompressobj()
        parts, fed = [], 0
        while not one.eof:
            chunk = rest[fed:fed + (1 << 14)]
            if not len(chunk):
                raise ValueError("a record is cut short")
            parts.append(one.decompress(chunk))
            fed += len(chunk)
        rest = rest[fed - len(one.unused_data):]
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = [line.partition(": ") for line in head.decode().split("\r\n")[1:]]
        fields = {name: value for name, _, value in lines}
        yield fields, body[:int(fields["Content-Length"])]


def page_of(uri: str | None) -> int | None:
    number = (uri or "")[len("<urn:x-page:"):-1]
    return int(number) if number else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record: its page, payload size and digest, type and the page it repeats;
    ``intact`` tells whether the body agrees with the recorded digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("intact", pa.bool_())])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, body in records_of(content.as_py()):
                    said = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    response = fields["WARC-Type"] == "response"
                    digest = hashlib.sha1(body).hexdigest() if response else said
                    size = len(body) if response else int(fields["X-Payload-Length"])
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size,
                                 digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")),
                                 digest == said))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
             .select("content"))
    return files.mapInArrow(read, RECORD)
