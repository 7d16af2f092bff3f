"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standout.llm.catalog import query
from standout.llm.common import new_folder, partitions, stored, table
from standout.session import cut_lineage

#: Magic number of the skippable frame that holds the dictionary, and of dictionaries and frames (fixed by the formats).
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Payloads below this size are never replaced by a revisit.
LEAST_BYTES = 1000
#: An archive is closed once it is this large, so that a reader can hold one.
ARCHIVE_BYTES = 16 << 20
#: The dictionary of a task's archives is trained on its first records, up to this many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
LEVEL = 3
_SPACE = uuid.UUID("6f1e7a52-93c4-4c1b-a7d0-000000000000").int >> 64
_CHUNK = 1 << 15
_WRITTEN = "file string, records long, bytes long, dictionary_bytes long"
_READ = (
    "file string, at long, record_type string, record_id string, page_id long, url string, date string, "
    "payload binary, payload_bytes long, payload_digest string, refers_to long, error string"
)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """An identifier that holds the page_id; pages without one are named by URL and digest."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"
    return f"<urn:uuid:{uuid.UUID(int=_SPACE << 64 | page_id & (1 << 64) - 1)}>"


def page_of(identifier: str | None) -> int | None:
    """The page_id in a record identifier, if it holds one."""
    if not identifier:
        return None
    number = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 64 != _SPACE:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None = None) -> bytes:
    """One WARC record; with ``keeper`` a revisit of that page, which leaves the payload out."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if keeper is not None else http + payload
    fields = [
        ("WARC-Type", "response" if keeper is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if keeper is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(keeper, None, digest))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; raises ValueError where a header, a length or a digest is wrong."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")) or end < 0:
        raise ValueError("no WARC header")
    named = {}
    for line in data[:end].decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:40]!r}")
        named[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in named:
            raise ValueError(f"no {name}")
    length = named["content-length"]
    if not length.isdigit():
        raise ValueError("Content-Length is not a number")
    block, rest = data[end + 4 : end + 4 + int(length)], data[end + 4 + int(length) :]
    if len(block) != int(length) or rest != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    if (digest := named.get("warc-block-digest")) and digest != _sha1(block):
        raise ValueError("block digest differs")
    out = {
        "record_type": named["warc-type"],
        "record_id": named["warc-record-id"],
        "page_id": page_of(named["warc-record-id"]),
        "url": named.get("warc-target-uri"),
        "date": named["warc-date"],
    }
    if out["record_type"] not in ("response", "revisit"):
        return out
    http_end = block.find(b"\r\n\r\n")
    if http_end < 0:
        raise ValueError("no end of the HTTP header")
    http = dict(x.lower().split(b": ", 1) for x in block[:http_end].split(b"\r\n")[1:] if b": " in x)
    size = http.get(b"content-length", b"")
    if not size.isdigit():
        raise ValueError("no HTTP Content-Length")
    payload, digest = block[http_end + 4 :], named.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise ValueError("no payload digest")
    if out["record_type"] == "response":
        if len(payload) != int(size):
            raise ValueError("HTTP Content-Length does not fit the payload")
        if digest != _sha1(payload):
            raise ValueError("payload digest differs")
        out["payload"] = payload
    elif payload:
        raise ValueError("a revisit has a payload")
    out |= {"payload_bytes": int(size), "payload_digest": base64.b32decode(digest[5:]).hex()}
    if out["record_type"] == "revisit":
        out["refers_to"] = page_of(named.get("warc-refers-to"))
    return out


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records, or None where they are too few or too alike."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    if dictionary is None:
        return b""
    body = dictionary.as_bytes()
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive and where its records start; the dictionary may itself be compressed."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ValueError("the dictionary frame is cut off")
    body = bytes(data[8 : 8 + size])
    if body[:4] == struct.pack("<I", FRAME):
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 28)
    if body[:4] != struct.pack("<I", DICTIONARY):
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), 8 + size


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and record of each frame; raises where a frame is damaged or cut off."""
    data = memoryview(content)
    dictionary, at = load_dictionary(data)
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        start, frame, parts = at, unpack.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            chunk = data[at : at + _CHUNK]
            parts.append(frame.decompress(chunk))
            at += len(chunk)
        at -= len(frame.unused_data)
        yield start, b"".join(parts)


def classify(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, keepers)`` of the pages with a payload that a larger page_id has too: digest to the largest of them."""
    payload = F.coalesce("html", F.lit(""))
    marked = pages.where(F.octet_length(payload) >= least_bytes).select("page_id", F.sha1(payload).alias("digest"))
    marked = stored(marked, "warc-digests")
    shared = marked.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    same = marked.join(shared.drop("n"), "digest").where("page_id < keeper")
    same = same.select("page_id", "digest", "keeper").distinct()
    return same.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "keeper"))).alias("keepers"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a WARC record below ``folder`` and return ``(file, records, bytes, dictionary_bytes)``.

    A page whose payload of at least 1000 bytes another page with a larger page_id has too becomes a revisit of the
    largest such page. NULL html is an empty payload; NULL url leaves the header out; pages without a page_id are always
    responses, as are repeated rows of the largest page. Only page_id, url and html are read; an empty table gives no file.

    Pages are dealt by page_id and sorted, so a task that runs again writes the same bytes to the same names; a file gets its
    name when it is complete. ``folder`` must be a place that all executors reach (local path, hdfs, s3 ...).
    """
    n = partitions(pages.sparkSession)
    same = classify(pages)
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    rows = rows.repartition(n, "page_id").join(same, "page_id", "left")
    rows = rows.withColumn("keeper", F.col("keepers")[F.col("digest")])
    rows = rows.sortWithinPartitions("page_id", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        records = (
            record(*row)
            for batch in batches
            for row in zip(
                batch.column("page_id").to_pylist(),
                batch.column("url").to_pylist(),
                ((x or "").encode() for x in batch.column("html").to_pylist()),
                batch.column("keeper").to_pylist(),
            )
        )
        first, size = [], 0
        for data in records:
            first.append(data)
            size += len(data)
            if size >= SAMPLE_BYTES:
                break
        if not first:
            return
        dictionary = train(first)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        head, done, count = dictionary_frame(dictionary), [], 0
        name = out = None

        def waiting() -> Iterator[bytes]:
            yield from first
            yield from records

        for data in waiting():
            if out is None:
                name = f"part-{task.partitionId():05d}-{len(done):04d}.warc.zst"
                hidden = f"{root}/.{name}.{task.taskAttemptId()}"
                out = store.open_output_stream(hidden)
                out.write(head)
                count = 0
            out.write(pack.compress(data))
            count += 1
            if out.tell() >= archive_bytes:
                done.append(_close(store, out, hidden, root, name, count, len(head)))
                out = None
        if out is not None:
            done.append(_close(store, out, hidden, root, name, count, len(head)))
        yield pa.RecordBatch.from_pylist(done)

    return rows.select("page_id", "url", "html", "keeper").mapInArrow(write, _WRITTEN)


def _close(store, out, hidden: str, root: str, name: str, count: int, head: int) -> dict:
    size = out.tell()
    out.close()
    store.move(hidden, f"{root}/{name}")
    return {"file": name, "records": count, "bytes": size, "dictionary_bytes": max(0, head - 8)}


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives below ``folder``.

    Every record must be one frame with a valid header, fitting lengths and digests. One that is not gets a row with
    ``error`` and its place only; after a frame that cannot be decoded the rest of the file has no place to start from and is
    reported by that row. An archive without a leading dictionary is read without one.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    schema = spark.createDataFrame([], _READ).schema
    names = schema.fieldNames()
    arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for row in _records(path.as_py(), content.as_py()):
                    if not payload:
                        row.pop("payload", None)
                    size += len(row.get("payload") or b"") + 500
                    rows.append({k: row.get(k) for k in names})
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return found.select("path", "content").mapInArrow(read, _READ)


def _records(path: str, content: bytes) -> Iterator[dict]:
    at = 0
    try:
        for at, data in frames(content):
            try:
                yield {"file": path, "at": at, **parse(data)}
            except ValueError as wrong:
                yield {"file": path, "at": at, "error": str(wrong)}
    except (ValueError, zstandard.ZstdError) as wrong:
        yield {"file": path, "at": at, "error": f"archive: {wrong}"}


ROUND_TRIP_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), k AS (
  SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
"""


@query("op4_warc_round_trip", ROUND_TRIP_SQL)
def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only validated records carry page fields; a damaged one would show as a row with ``error``."""
    folder = new_folder(spark, "warc")
    cut_lineage(write_archives(table(spark, sf_dir, "pages"), folder))
    found = read_archives(spark, folder, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
