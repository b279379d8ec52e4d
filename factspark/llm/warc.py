"""WARC archives with segmented records: writing, and reading back with reassembly.

A page becomes a response record whose HTTP message is in chunked transfer framing; a message longer than a segment
goes on in continuation records. Pages with a payload that a smaller page id also has become revisit records.
Reading parses each file by itself, groups segments by the identifier of their origin, orders them by segment number,
verifies that none is missing and that their total length is as stated, and only then decodes the framing.
Files leave and reach the executors through Spark's own writer and reader, so a task that runs again leaves one copy.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, partitions, small_batches

SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16 << 10, 4 << 10, 2000
_BREAK, _DATE = b"\r\n\r\n", "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are dropped. Raises ValueError where framing is broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if size < 0 or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(data[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def _uri(url: str | None) -> str | None:
    return url and "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def response_records(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The response record of a page, then its continuations."""
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    origin = _urn(page_id, digest, copy)
    for n, part in enumerate(parts, 1):
        first = n == 1
        yield record(
            [
                ("WARC-Type", "response" if first else "continuation"),
                ("WARC-Record-ID", origin if first else _urn(page_id, digest, copy, n)),
                ("WARC-Date", _DATE),
                ("WARC-Target-URI", _uri(url)),
                ("WARC-Payload-Digest", f"sha1:{digest}" if first else None),
                ("WARC-Block-Digest", f"sha1:{base32_sha1(part)}"),
                ("WARC-Segment-Number", n if len(parts) > 1 else None),
                ("WARC-Segment-Origin-ID", None if first else origin),
                ("WARC-Segment-Total-Length", len(block) if n == len(parts) > 1 else None),
                ("Content-Type", "application/http; msgtype=response" if first else None),
                ("X-Page-Id", page_id if first else None),
            ],
            part,
        )


def revisit_record(page_id: int | None, copy: int, url: str | None, size: int, digest: str, refers_to: int) -> bytes:
    return record(
        [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", _urn("revisit", page_id, digest, copy)),
            ("WARC-Date", _DATE),
            ("WARC-Target-URI", _uri(url)),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _urn(refers_to, digest, 0)),
            ("Content-Type", "application/http; msgtype=response"),
            ("X-Page-Id", page_id),
            ("X-Payload-Length", size),
            ("X-Refers-To-Page", refers_to),
        ],
        _HTTP + b"\r\n",
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Write gzip-compressed archives, a record for each row.

    Of rows with equal payloads of at least least_bytes bytes, the one with the smallest id is a response and the others
    revisit it; a repeated row of that id is a response too. Null html is an empty payload. Ids may be null: such a row
    revisits if another row of its group has an id. Digests are grouped without texts, so a payload that many pages
    share costs a small row each; texts move once, dealt by id.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_column).cast("long").alias("i"), F.col(url_column).alias("u"), F.encode(F.coalesce(html_column, F.lit("")), "UTF-8").alias("p"))
    rows = rows.withColumn("d", F.sha1("p"))
    # a key without nulls: with a null-safe join the dealt texts would move again
    rows = rows.withColumn("k", F.concat_ws("|", "d", F.coalesce(F.col("i").cast("string"), F.lit("null"))))
    small = rows.where(F.octet_length("p") >= least_bytes).select("k", "i", "d")
    groups = small.groupBy("d").agg(F.min("i").alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1 and r is not null").drop("n")
    revisits = small.join(groups, "d").where(~F.col("i").eqNullSafe(F.col("r"))).select("k", "r").distinct()
    n = max(partitions(spark), rows.rdd.getNumPartitions())
    dealt = rows.select("k", "i", "u", "p").repartition(n, "k").join(revisits, "k", "left").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, copy = None, 0
        for batch in batches:
            out = []
            for k, i, u, p, r in zip(*(batch.column(k).to_pylist() for k in ("k", "i", "u", "p", "r"))):
                last, copy = k, copy + 1 if k == last else 0
                digest = base32_sha1(p)
                out.extend(response_records(i, copy, u, p, digest) if r is None else [revisit_record(i, copy, u, len(p), digest, r)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    made.write.option("lineSep", _BREAK.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, gzip members undone."""
    data = bytearray()
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        data += member.decompress(content)
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        content = member.unused_data
    data, at = bytes(data) + content, 0
    while at < len(data):
        end = data.find(_BREAK, at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield fields, block
        at = end + 4 + size + len(_BREAK)


def reassemble(parts: list[tuple[int, bytes, int | None]]) -> bytes:
    """One block of its segments (number, bytes, total length on the last one). Raises ValueError if one is missing."""
    parts = sorted(parts, key=lambda x: x[0])
    block = b"".join(x[1] for x in parts)
    if [x[0] for x in parts] != list(range(1, len(parts) + 1)) or (len(parts) > 1 and parts[-1][2] != len(block)):
        raise ValueError("segments are missing")
    return block


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message, chunked framing undone."""
    head, mark, body = block.partition(_BREAK)
    if not mark:
        raise ValueError("no HTTP header")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_FOUND = "key string, page_id long, record_type string, refers_to long, digest string, size long, part long, total long, block binary"


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path; key is the record's identifier, that of its origin for a continuation."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parse(content.as_py()):
                    kind = f["warc-type"]
                    size = len(payload_of(block)) if kind == "response" and "warc-segment-number" not in f else number(f.get("x-payload-length"))
                    whole = size is not None
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response" and whole and base32_sha1(payload_of(block)) != digest:
                        raise ValueError(f"{f['warc-record-id']}: the payload isn't that of its digest")
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), number(f.get("x-page-id")), None if kind == "continuation" else kind, number(f.get("x-refers-to-page")), digest, size, None if whole else int(f["warc-segment-number"]), number(f.get("warc-segment-total-length")), None if whole else block))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(list(zip(*rows)) or [[]] * 9, _FOUND.split(", "))], [x.split()[0] for x in _FOUND.split(", ")])

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, _FOUND)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each response and revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, segments.

    Segments meet by the identifier of their origin; whole records pass with their figures only. A missing segment, a
    wrong total length, broken framing or a wrong digest fails the job with the record's identifier.
    """
    found = records(spark, path)
    whole = found.where("block is null")
    parts = found.where("block is not null").groupBy("key").agg(F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.collect_list(F.struct("part", "block", "total")).alias("parts"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    payload = payload_of(reassemble([(p["part"], p["block"], p["total"]) for p in r["parts"]]))
                except ValueError as e:
                    raise ValueError(f"{r['key']}: {e}") from e
                if base32_sha1(payload) != r["digest"]:
                    raise ValueError(f"{r['key']}: the payload isn't that of its digest")
                rows.append({"page_id": r["page_id"], "payload_bytes": len(payload), "payload_digest": r["digest"], "record_type": "response", "refers_to": None, "segments": len(r["parts"])} | ({"payload": payload} if with_payload else {}))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segments", pa.int64())] + [("payload", pa.binary())] * with_payload))

    joined = parts.mapInArrow(run, schema + ", payload binary" * with_payload)
    if with_payload:
        return joined
    return joined.unionByName(whole.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", F.lit(1).cast("long").alias("segments")))


def round_trip(pages: DataFrame, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Write the archives of all pages into the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes, **columns)
    return read(pages.sparkSession, path)
