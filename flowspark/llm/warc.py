"""WARC archives: write captures, read records, assemble one nested row per capture.

A capture is a request, a response (or a revisit of an equal earlier payload) and a metadata record; request and
metadata name the response in WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.base import ORACLES, prepare, query, table, written
from flowspark.session import scratch_path

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name-based identifiers of URLs
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_RECORDS = 20_000
READ_BYTES = 1 << 20

RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str, copy: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}|{copy}|{kind}')}>"


def _record(kind: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers]
    return "\r\n".join([*lines, f"Content-Length: {len(block.encode())}", "", block]) + "\r\n"


def _header(value: str | None) -> str:
    """A header value has one line."""
    return " ".join((value or "").split())


def _records(batches):
    """Pages with their type -> the text of their three records; the writer adds the last line end."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            html, uri = r["html"], _header(r["url"])
            digest = base32_digest(html.encode())
            response = _record_id(r["page_id"], r["digest"], r["copy"], "response")
            about = [("WARC-Target-URI", uri)]
            here = about + [("WARC-Concurrent-To", response)]
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n"
            named = [("WARC-Record-ID", response), *about, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
            if r["revisit"]:
                first = _record_id(r["first"], r["digest"], 1, "response")
                out.append(_record("revisit", [*named, ("WARC-Refers-To", first), ("WARC-Profile", PROFILE)], head))
            else:
                out.append(_record("response", named, head + html))
            request = [("WARC-Record-ID", _record_id(r["page_id"], r["digest"], r["copy"], "request")), *here]
            out.append(_record("request", [*request, ("Content-Type", "application/http;msgtype=request")], f"GET {uri} HTTP/1.1\r\n\r\n"))
            metadata = [("WARC-Record-ID", _record_id(r["page_id"], r["digest"], r["copy"], "metadata")), *here]
            page = "" if r["page_id"] is None else f"page-id: {r['page_id']}\r\n"
            out.append(_record("metadata", [*metadata, ("Content-Type", "application/warc-fields")], page))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a capture for every row of ``pages`` (``page_id``, ``url``, ``html``) as gzipped WARC files.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the smallest ``page_id`` becomes
    a response, the others revisits of it.  A null html is the empty payload.  A null ``page_id`` comes after all
    others.  Of rows that repeat a page and its payload only one is the response; the others revisit it.
    Other columns are ignored.
    """
    pages = prepare(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    # A key without nulls, by which the payloads are dealt once, for the join and the copies' numbers.
    pages = pages.withColumn("own", F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", "size"))
    first = pages.groupBy("digest", "size").agg(F.min("page_id").alias("first"))
    keys = pages.select("own", "digest", "size").distinct().join(first, ["digest", "size"]).select("own", "first")
    typed = pages.join(keys, "own").withColumn("copy", F.row_number().over(Window.partitionBy("own").orderBy("url")))
    is_first = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    typed = typed.withColumn("revisit", (F.col("size") >= min_bytes) & ~is_first)
    # A revisit repeats no payload, so it need not go to the writer.
    typed = typed.select("page_id", "url", "html", "digest", "copy", "first", "revisit")
    typed.mapInArrow(_records, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


class _Reader:
    """Bytes of a WARC file, plain or gzipped (as a whole or record by record), a piece at a time."""

    def __init__(self, content: bytes):
        self.content, self.at, self.held = memoryview(content), 0, bytearray()
        self.expand = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        piece = bytes(self.content[self.at : self.at + READ_BYTES])
        if self.expand is None:
            self.at += len(piece)
            self.held += piece
            return True
        self.held += self.expand.decompress(piece)
        rest = len(self.expand.unused_data)
        self.at += len(piece) - rest
        if self.expand.eof:
            self.expand = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to the mark, which is dropped; None at the end of the file."""
        seen = 0
        while (place := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:place])
        del self.held[: place + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError("A WARC record ends before its Content-Length.")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_records(content: bytes):
    """Headers (names in lower case) and block of each record of a file."""
    reader = _Reader(content)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"Not a WARC record: {lines[0][:80]!r}")
        headers = _fields(lines[1:])
        yield headers, reader.take(int(headers["content-length"]))
        reader.take(4)


def _parse(with_payload: bool):
    def parse(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                held = 0
                for headers, block in parse_records(content.as_py()):
                    kind = headers.get("warc-type")
                    fields: dict[str, str] = {}
                    payload = block
                    if headers.get("content-type", "").startswith("application/http"):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        fields = _fields(top.decode("utf-8", "replace").split("\r\n")[1:])
                    elif headers.get("content-type") == "application/warc-fields":
                        fields = _fields(block.decode("utf-8", "replace").split("\r\n"))
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        actual = base32_digest(payload)
                        if digest not in (None, actual):
                            raise ValueError(f"Record {headers.get('warc-record-id')} does not match its payload digest.")
                        digest = actual
                    rows.append({
                        "type": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"),
                        "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
                        "payload_digest": digest, "payload_bytes": len(payload), "fields": list(fields.items()),
                        "payload": payload if with_payload else None,
                    })
                    held += len(payload) if with_payload else 200
                    if held > 8 * READ_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return parse


def _rows(rows: list[dict]) -> pa.RecordBatch:
    text = pa.string()
    kinds = {k: text for k in ("type", "record_id", "concurrent_to", "refers_to", "uri", "date", "payload_digest")}
    kinds |= {"payload_bytes": pa.int64(), "fields": pa.map_(text, text), "payload": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record: its identifiers, payload length and digest, the fields of its block, and the payload.

    Records are found by Content-Length, whatever their payload holds; a response that differs from its digest
    is an error.  A file is read by one task, as a gzip stream must be; the writer bounds the records in a file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse(with_payload), RECORD)


def assemble_captures(records: DataFrame) -> DataFrame:
    """Join each response or revisit with the request and metadata records that are concurrent to it.

    One nested row a capture: ``response`` (a struct, with ``payload_bytes`` and ``payload_digest`` of the full
    payload also for a revisit), ``requests`` and ``metadata`` (arrays, empty without any), and ``referred``, the
    metadata of the capture that a revisit refers to.  Requests and metadata that name no known response
    belong to no capture.
    """
    whole = F.struct("type", "record_id", "refers_to", "uri", "date", "payload_digest", "payload_bytes", "fields", "payload")
    main = records.where(F.col("type").isin("response", "revisit")).select("record_id", whole.alias("response"))

    def concurrent(kind: str, name: str) -> DataFrame:
        own = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        part = F.struct("record_id", "uri", "date", "fields")
        return own.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.collect_list(part).alias(name))

    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    requests, metadata = concurrent("request", "requests"), concurrent("metadata", "metadata")
    kind = requests.schema["requests"].dataType
    return main.join(requests, "record_id", "left").join(metadata, "record_id", "left").select(
        "record_id", "response", none("requests", kind), none("metadata", kind)
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures with ``payload_bytes`` and ``referred`` (metadata of the referred capture), also where a payload is elsewhere."""
    first = captures.where("response.type = 'response'").select(
        F.col("record_id").alias("first_id"), F.col("response.payload_bytes").alias("first_bytes"), F.col("metadata").alias("referred")
    )
    # What refers to nothing needs no partner: joined too, all of it would meet in one task.
    refers = F.col("response.refers_to").isNotNull()
    alone = captures.where(~refers).withColumn("first_bytes", F.lit(None).cast("long")).withColumn("referred", F.lit(None).cast(captures.schema["metadata"].dataType))
    joined = captures.where(refers).join(first, captures["response.refers_to"] == F.col("first_id"), "left").drop("first_id")
    size = F.when(F.col("response.type") == "revisit", F.col("first_bytes")).otherwise(F.col("response.payload_bytes"))
    return joined.unionByName(alone).withColumn("payload_bytes", size).drop("first_bytes")


@query("op2_warc_captures")
def warc_query(spark, folder: str) -> DataFrame:
    path = scratch_path(spark, "llm-warc")
    write_warc(table(spark, folder, "pages"), path)
    # The archives are parsed once, and written captures let a join split those that refer to one popular payload.
    records = written(read_warc(spark, path, with_payload=False), "warc-records")
    captures = resolve_revisits(written(assemble_captures(records), "captures"))
    page = lambda name: F.col(name)[0]["fields"]["page-id"].cast("long")
    return captures.select(
        page("metadata").alias("page_id"), "payload_bytes", F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), page("referred").alias("refers_to"),
    )


ORACLES["op2_warc_captures"] = " ".join("""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d
""".split())
