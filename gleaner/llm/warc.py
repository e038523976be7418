"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response record gives two records. The metadata record (application/
warc-fields) holds the page's title, language, outlinks and the source's HTTP
headers; the conversion record (text/plain) holds the page's visible text.
Both name the response in WARC-Refers-To and keep its target URI, date and
payload digest; their own block digests and lengths are computed.

Files are read and written as WARC, plain or gzipped; a reading task holds one
record at a time, and plain files are split between tasks.

Defined results: a null url or payload counts as empty, and so does a null
page_id in a record's id; a record that is no response, or that is cut off,
gives no derivative, and so does what follows damage within a gzip member;
record ids are name-based (UUID 5), so repeated rows give the same records;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import HEAD, table, trimmed

VERSION = b"WARC/1.1"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gleaner:warc")
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|" + HEAD + r"|<(?P<raw>script|style|noscript|template)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)", re.S | re.I)
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer aside main blockquote pre form td th hr".split())
MARKUP = re.compile(r"""</?([a-zA-Z][^\s/>]*)(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)|<[/!?][^>]*>""")
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
LINK = re.compile(r"<(a|area|link|img|script|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes; line breaks in header values become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode("utf-8", "surrogatepass") for k, v in headers if k != "Content-Length"]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: " + str(len(block)).encode(), b"", block, b"", b""])


def response(page_id: str, url: str, payload: bytes, date: str) -> bytes:
    """A response record of a stored page."""
    http = b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(len(payload)).encode(), b"", b""])
    block = http + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, digest(payload))), ("WARC-Target-URI", url), ("WARC-Date", date)]
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, block)


def unpacked(data: bytes) -> bytes:
    """Plain bytes of gzip members, as far as they are whole; what is no gzip is returned as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        if not member.eof:
            break
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out) if out or data[:2] == b"\x1f\x8b" else data


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each whole record, from plain bytes or gzip members."""
    data = unpacked(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers: dict[str, str] = {}
        last = ""
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and last:
                headers[last] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                last = name.strip().lower()
                headers[last] = value.strip()
        length = headers.get("content-length", "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            at = end
            continue
        yield headers, data[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)


def http_parts(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """HTTP headers and payload of a response block; a block without them is all payload."""
    if not block.startswith(b"HTTP/"):
        return [], block
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        return [], block
    pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return [(k.strip(), v.strip()) for k, _, v in pairs if k.strip()], payload


def plain_text(page: str) -> str:
    """Visible text, one line for each block, white space within lines collapsed."""
    # only elements break lines: a line break of the source is white space like any other
    text = MARKUP.sub(lambda m: "\0" if m[1] and m[1].lower() in BREAKS else "", HIDDEN.sub(" ", page.replace("\0", " ")))
    lines = (" ".join(html.unescape(line).split()) for line in text.split("\0"))
    return "\n".join(x for x in lines if x)


def decoded(http: list[tuple[str, str]], payload: bytes) -> str:
    declared = next((v for k, v in http if k.lower() == "content-type"), "").encode()
    found = CHARSET.search(declared) or CHARSET.search(payload[:1024])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """(kind, headers, block) of the records derived from a record; none unless it is a response."""
    if headers.get("warc-type") != "response":
        return []
    source, url = headers.get("warc-record-id", ""), headers.get("warc-target-uri", "")
    http, payload = http_parts(block)
    page = decoded(http, payload)
    fields = [("title", " ".join(html.unescape(m[1]).split())) for m in [TITLE.search(page)] if m]
    fields += [("languages", m[1].lower()) for m in [LANG.search(page)] if m]
    fields += [(f"http-header-{k.lower()}", v) for k, v in http]
    fields += [("source-block-digest", headers["warc-block-digest"])] * ("warc-block-digest" in headers)
    for m in LINK.finditer(HIDDEN.sub(" ", page)):
        target = html.unescape(m[2].strip("\"'")).strip()
        try:
            fields.append(("outlink", f"{urljoin(url, target)} {m[1].lower()}"))
        except ValueError:
            fields.append(("outlink", f"{target} {m[1].lower()}"))
    body = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    text = plain_text(page).encode("utf-8", "surrogatepass")
    out = []
    for kind, mime, made in (("metadata", "application/warc-fields", body), ("conversion", "text/plain; charset=utf-8", text)):
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Refers-To", source)]
        own += [(name, headers[name.lower()]) for name in ("WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-IP-Address", "WARC-Warcinfo-ID") if name.lower() in headers]
        out.append((kind, [*own, ("WARC-Block-Digest", digest(made)), ("Content-Type", mime)], made))
    return out


SCHEMA = "key string, kind string, record_id string, refers_to string, target_uri string, date string, payload_digest string, block_digest string, content_length long, record binary"


def derive(responses: DataFrame) -> DataFrame:
    """Derived records of (key, warc binary), where warc holds whole WARC records; key is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            size = 0
            for key, data in zip(batch.column(0), batch.column(1)):
                for headers, block in records(data.as_py() or b""):
                    for kind, own, made in derivatives(headers, block):
                        h = dict(own)
                        names = ("WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest")
                        fields = ("record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest")
                        whole = record(own, made)
                        size += len(whole)
                        rows.append({"key": key.as_py(), "kind": kind, **{f: h.get(n) for f, n in zip(fields, names)}, "content_length": len(made), "record": whole})
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return responses.select("key", "warc").mapInArrow(trimmed(run), SCHEMA)


ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(key, warc) of (page_id, url, html): each page as a response record. The table has no crawl date, so it is a parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(k.as_py() or "", u.as_py() or "", (h.as_py() or "").encode("utf-8", "surrogatepass"), date) for k, u, h in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "warc"])

    return pages.select(F.col("page_id").cast("string").alias("key"), "url", "html").mapInArrow(trimmed(run), "key string, warc binary")


BETWEEN = "\r\n\r\n"


def read_warc(spark, path: str) -> DataFrame:
    """(key, warc) of WARC files, plain or gzipped, a row for each record; key is the file's path.

    Records are cut where the version line of the next one follows an empty
    line; a record whose own block holds such a place counts as cut off.
    Damage within a file ends that file, not the job.
    """
    version = VERSION[:7].decode()
    lines = spark.read.option("lineSep", BETWEEN + version).option("ignoreCorruptFiles", "true").text(path)
    whole = F.when(F.col("value").startswith(version), F.col("value")).otherwise(F.concat(F.lit(version), F.col("value")))
    # the reader keeps bytes as they are, so a cast gives back what is no UTF-8
    raw = whole.cast("binary")
    head = F.substring_index(whole, BETWEEN, 1)
    size = F.octet_length(head) + len(BETWEEN) + F.regexp_extract(head, r"(?i)\r\ncontent-length:\s*(\d+)", 1).try_cast("int")
    # the last record of a file still ends with its own two line breaks
    exact = F.when(F.octet_length(raw) >= size, F.concat(raw.substr(F.lit(1), size), F.lit(BETWEEN).cast("binary"))).otherwise(raw)
    return lines.select(F.col("_metadata.file_path").alias("key"), exact.alias("warc"))


def write_warc(derived: DataFrame, folder: str) -> None:
    """Write derived records (columns kind, record) as folder/kind=.../*.warc.gz."""
    spark = derived.sparkSession
    # each record ends with two line breaks, which stand as the separator here
    text = F.col("record").substr(F.lit(1), F.length("record") - len(BETWEEN)).cast("string")
    derived.select("kind", text.alias("value")).write.partitionBy("kind").option("lineSep", BETWEEN).option("compression", "gzip").text(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "kind=*/part-*.txt.gz")) or []:
        files.rename(part.getPath(), part.getPath().suffix("").getParent().suffix("/" + part.getPath().getName().replace(".txt.gz", ".warc.gz")))


def content_of(record: str) -> Column:
    """The block of a record as text: what stands after its first empty line and before its last two line breaks."""
    head = F.substring_index(F.col(record).cast("string"), BETWEEN, 1)
    at = F.octet_length(head) + len(BETWEEN)
    return F.col(record).substr(at + 1, F.length(record) - at - len(BETWEEN)).cast("string")


def op3_warc_derivatives(spark, sf_dir) -> DataFrame:
    out = derive(responses_of(table(spark, sf_dir, "pages")))
    return out.select(F.col("key").cast("long").alias("page_id"), "kind", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest", "content_length", content_of("record").alias("content"))
