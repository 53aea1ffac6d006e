"""WARC derivatives: metadata and plain-text conversion records from response records.

``derive`` reads response records (header text and block bytes), parses the WARC header, the HTTP
head and the page, and makes two records per response: ``metadata`` (application/warc-fields:
status, content type, title, language, source headers and digests, out-links) and ``conversion``
(text/plain: the page's visible text).  Both name the response in WARC-Refers-To and keep its
target URI and date; ids are UUIDs drawn from the response's id, so reruns agree.

``write_warc`` stores text records as WARC files with Spark's text source, one file per partition.
``read_warc`` reads archives as bytes: a task walks a file record by record by its Content-Length, so a block may hold
anything; versions 1.x, plain files and gzip members are read, damaged stretches are skipped up to the next
version line.  A file is held in memory while it is walked (archives are cut at about 1 GB by custom), its decompressed
records one at a time.  Payloads with a chunked transfer encoding or a gzip or deflate content encoding are
decoded before the page is read; what cannot be decoded counts as it is.

Cases: a null block counts as empty; a block without an HTTP head is all payload; records of other
types are passed over; a response without an id gets one from its content; a response without a
date gets the epoch; bytes that are not in the declared charset are replaced; an empty table gives
an empty result; repeated responses give repeated records; other columns are ignored, but those
named in ``carry`` come along.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.html_blocks import leaves

VERSION = "WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
FIELDS = ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest",
          "source_payload_digest", "header", "block")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(parts))}>"


def header_text(fields: list[tuple[str, str]]) -> str:
    return "".join(f"{k}: {v}\r\n" for k, v in fields)


def one_line(s: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", s).strip()


def parse_header(text: str) -> dict[str, str]:
    """Lower-cased names -> values; a line that starts with white space goes on with the one before."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", text).splitlines():
        name, colon, value = line.partition(":")
        if colon and name.strip():
            out.setdefault(name.strip().lower(), value.strip())
    return out


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, header fields and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        head, _, payload = block.partition(b"\n\n")
    status, _, rest = head.decode("utf-8", "replace").partition("\n")
    return status.strip(), parse_header(rest), payload


def dechunked(data: bytes) -> bytes:
    """Payload of a chunked transfer encoding; as it is where it is not well-formed."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n").match(data, at):
        n = int(m[1], 16)
        if n == 0:
            return b"".join(out)
        if m.end() + n > len(data):
            break
        out.append(data[m.end(): m.end() + n])
        at = m.end() + n
        at += 2 if data[at: at + 2] == b"\r\n" else data[at: at + 1] == b"\n"
    return data


def decoded(payload: bytes, http: dict[str, str]) -> bytes:
    """The payload without its transfer and content encodings."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        payload = dechunked(payload)
    for coding in reversed([c.strip().lower() for c in http.get("content-encoding", "").split(",")]):
        # gzip, zlib and raw deflate streams; a cut stream gives what there is
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            try:
                payload = zlib.decompressobj(bits).decompress(payload)
                break
            except zlib.error:
                continue
    return payload


def response(url: str | None, html: str | None, date: str) -> tuple[str, bytes]:
    """Header and block of the response record of a page."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
             + str(len(payload)).encode() + b"\r\n\r\n" + payload)
    header = header_text([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url or "", digest(payload))),
        ("WARC-Target-URI", one_line(url or "")), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload))])
    return header, block


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """Response records (page_id, header, block) of the ``pages`` table."""

    def run(batches):
        for b in batches:
            made = [response(u, h, date) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()),
                                              pa.array([m[1] for m in made], pa.binary())],
                                             names=["page_id", "header", "block"])

    return (pages.select(F.col("page_id").cast("bigint"), "url", "html")
            .mapInArrow(run, "page_id bigint, header string, block binary"))


def derive_one(header: str | None, block: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one record; none if it is not a response."""
    src, block = parse_header(header or ""), block or b""
    if src.get("warc-type", "").lower() != "response":
        return []
    status, http, payload = split_http(block)
    rid = src.get("warc-record-id") or record_id("unnamed", src.get("warc-target-uri", ""), digest(block))
    uri, date = src.get("warc-target-uri", ""), src.get("warc-date") or EPOCH
    m = CHARSET.search(http.get("content-type", ""))
    body = decoded(payload, http)
    try:
        page = body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    links: list[str] = []
    blocks = leaves(page, links)
    title = next((x.text for x in blocks if x.path and x.path[-1] == "title"), "")
    text = "\n".join(x.text for x in blocks if "head" not in x.path)
    lang = LANG.search(page)
    payload_digest = src.get("warc-payload-digest") or digest(payload)
    info = [("status", one_line(status)), ("title", one_line(title)), ("language", lang[1].lower() if lang else ""),
            ("source-payload-digest", payload_digest), ("source-block-digest", src.get("warc-block-digest") or digest(block)),
            ("payload-length", str(len(payload))), ("text-length", str(len(text)))]
    info += [(f"http-header-{k}", one_line(v)) for k, v in http.items()]
    info += [(f"source-{k}", one_line(v)) for k, v in src.items()
             if k not in ("warc-payload-digest", "warc-block-digest")]
    info += [("outlink", one_line(x)) for x in links]
    out = []
    for kind, content_type, data in (("metadata", "application/warc-fields", header_text(info)),
                                     ("conversion", "text/plain; charset=utf-8", text)):
        raw = data.encode("utf-8", "surrogatepass")
        rec = {"record_type": kind, "record_id": record_id(kind, rid), "refers_to": rid, "target_uri": uri, "date": date,
               "content_type": content_type, "block_digest": digest(raw), "source_payload_digest": payload_digest}
        rec["header"] = header_text([
            ("WARC-Type", kind), ("WARC-Record-ID", rec["record_id"]), ("WARC-Refers-To", rid), ("WARC-Target-URI", uri),
            ("WARC-Date", date), ("Content-Type", content_type), ("Content-Length", str(len(raw))),
            ("WARC-Block-Digest", rec["block_digest"])])
        rec["block"] = data
        out.append(rec)
    return out


def derive(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of all response records (``header`` string, ``block`` binary)."""
    schema = [records.schema[c] for c in carry]

    def run(batches):
        for b in batches:
            got = [(i, r) for i, (h, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                   for r in derive_one(h, x)]
            at = pa.array([i for i, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(2 + i).take(at) for i in range(len(carry))]
                + [pa.array([r[f] for _, r in got], pa.string()) for f in FIELDS], names=[*carry, *FIELDS])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{f} string" for f in FIELDS])
    return records.select("header", "block", *carry).mapInArrow(run, ddl)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Records (``header``, text ``block``) as WARC files, one per partition."""
    whole = F.concat(F.lit(VERSION + "\r\n"), F.col("header"), F.lit("\r\n"), F.coalesce(F.col("block"), F.lit("")))
    (records.select(whole.alias("value")).write.mode("overwrite")
     .option("lineSep", "\r\n\r\n").option("compression", compression).text(path))


def _members(data: bytes):
    """The decompressed gzip members of a file; a damaged one gives what comes before the damage."""
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out = z.decompress(data)
        except zlib.error:
            return
        yield out
        data = z.unused_data.lstrip(b"\0")


START = re.compile(rb"WARC/1\.[0-9]+[ \t]*\r?\n")
HEAD_END = re.compile(rb"\r?\n\r?\n")
LENGTH = re.compile(rb"(?:^|\n)Content-Length:[ \t]*([0-9]+)", re.I)


def records_of(data: bytes):
    """(header text, block bytes) of the records of an archive."""
    rest = b""
    for part in _members(data) if data[:2] == b"\x1f\x8b" else (data,):
        buf, at = rest + part if rest else part, 0
        while m := START.search(buf, at):
            head = HEAD_END.search(buf, m.end() - 1)
            if not head:
                break
            header = buf[m.end(): head.start()] + b"\r\n"
            n = LENGTH.search(header)
            end = head.end() + (int(n[1]) if n else 0)
            if end > len(buf):
                break
            yield header.decode("utf-8", "replace"), buf[head.end(): end]
            at = end
        # what is left may go on in the next member
        rest = buf[at:]


def read_warc(spark, path: str) -> DataFrame:
    """(header, block binary) of the records of WARC files, plain or gzipped."""
    schema = pa.schema([("header", pa.string()), ("block", pa.binary())])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for r in records_of(content.as_py() or b""):
                    out.append(r)
                    size += len(r[1])
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, block binary")
