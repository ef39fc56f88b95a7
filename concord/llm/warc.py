"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

Every ``response`` record gives two records that point back at it by
``WARC-Refers-To`` (its record id) and keep its target, date and payload digest:

* ``metadata`` (``application/warc-fields``): the HTTP status line and every HTTP
  header of the source, in order, the source's block and payload digests, whether
  the payload matches its digest, the page's title, language and outgoing links,
  and the id of the conversion;
* ``conversion`` (``text/plain``): the page's text. Scripts, styles, comments and
  heads are left out, block elements end lines, character references are
  resolved, white space is folded.

Both carry ``WARC-Block-Digest`` and the conversion ``WARC-Payload-Digest``
(SHA-256, base 32).  Record ids are name-based UUIDs of the response's id and
the record type: building again gives the same ids, so a task that runs twice
or a second run over the same crawl links alike.

Records are rows (type, id, headers, block); ``write_files`` puts them into
.warc files in a shared folder, one or more for each task, and ``read_files``
parses such files (plain or gzip members).  Each record is handled on its own:
no shuffle, memory of one batch.

Edge cases: a null, empty or blank payload gives an empty text and no links; a
response without HTTP header block is taken as payload alone; a missing id is
derived from target, date and payload; repeated responses are derived each and share
ids; markup that never ends hides the rest (comments, hidden elements) or is text (tags), and
takes time in proportion to its length; damaged files give their whole records; other record types give nothing; empty tables give empty results; extra columns never clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "type string, id string, target string, date string, headers array<struct<name: string, value: string>>, block binary"
FILE_BYTES = 64 << 20
VERSION = b"WARC/1.1"
DERIVED = uuid.uuid5(uuid.NAMESPACE_URL, "urn:concord:warc:derived")

#: Elements that end a line, and elements whose contents are not shown.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_HIDDEN = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style head template noscript iframe svg".split()}
_NAME = re.compile(r"/?([a-zA-Z]\w*)")
_TITLE = re.compile(r"<title\b", re.I)
_END_TITLE = re.compile(r"</title\s*>", re.I)
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def scan(page: str) -> tuple[str, list[str]]:
    """(shown text with block ends as line ends, character references unresolved; link targets).

    One pass from ``<`` to ``>``, in time in proportion to the page: a comment or
    hidden element that never ends hides the rest, and once no ``>`` follows, every
    other ``<`` is text."""
    out, links, at, n = [], [], 0, len(page)
    while True:
        lt = page.find("<", at)
        if lt < 0:
            out.append(page[at:])
            return "".join(out), links
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            out += [page[at:lt], " "]
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(page, lt + 1)
        if not name and page[lt + 1: lt + 2] not in ("!", "?"):
            out.append(page[at: lt + 1])
            at = lt + 1
            continue
        gt = page.find(">", lt)
        if gt < 0:
            comment = page.find("<!--", lt)  # it hides the rest, as no --> can follow
            out += [page[at:]] if comment < 0 else [page[at:comment], " "]
            return "".join(out), links
        out.append(page[at:lt])
        at = gt + 1
        kind = name[1].lower() if name else ""
        closing = page[lt + 1] == "/"
        if not name:
            out.append(" ")
        elif kind in _HIDDEN and not closing:
            end = _HIDDEN[kind].search(page, at)
            out.append(" ")
            at = end.end() if end else n
        elif kind in _BLOCKS:
            out.append("\n")
        elif kind == "a" and not closing and (found := _HREF.match(page, lt + 2)):
            links.append(found[1] or found[2] or found[3] or "")


def title_of(page: str) -> str:
    """The contents of the first title element that ends."""
    begin = _TITLE.search(page)
    gt = page.find(">", begin.end()) if begin else -1
    end = _END_TITLE.search(page, gt) if gt >= 0 else None
    return page[gt + 1: end.start()] if end else ""


def language_of(page: str) -> str:
    """The first ``lang`` of an html element."""
    at = 0
    while (begin := _HTML.search(page, at)):
        gt = page.find(">", begin.end())
        at = len(page) if gt < 0 else gt
        if found := _LANG.search(page, begin.end(), at):
            return found[1]
    return ""


def digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def page_text(page: str) -> str:
    """The shown text, one line for each block, single spaces."""
    return _shown(scan(page)[0])


def _shown(bare: str) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in html.unescape(bare).split("\n")) if x)


def _one_line(text: str) -> str:
    return " ".join(text.split())


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload); without a header block all is payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, payload = block.partition(b"\n\n")
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    headers: list[tuple[str, list[str]]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and headers:  # a folded header goes on
            headers[-1][1].append(line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), [value.strip()]))
    return lines[0], [(name, " ".join(parts)) for name, parts in headers], payload


def _decoded(payload: bytes, http: list[tuple[str, str]]) -> str:
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response record; none for other types."""
    if (record["type"] or "").lower() != "response":
        return []
    block, headers = record["block"] or b"", record["headers"] or []
    source = {(h["name"] or "").lower(): h["value"] for h in headers}
    status, http, payload = split_http(block)
    target, date = record["target"] or "", record["date"] or ""
    source_id = record["id"] or f"<urn:uuid:{uuid.uuid5(DERIVED, f'{target} {date} {digest(payload)}')}>"
    ids = {kind: f"<urn:uuid:{uuid.uuid5(DERIVED, f'{source_id} {kind}')}>" for kind in ("metadata", "conversion")}
    page = _decoded(payload, http)
    bare, links = scan(page)
    text = _shown(bare).encode()
    claimed = source.get("warc-payload-digest")
    fields = [("status", status), *[(f"http-{k}", v) for k, v in http], ("source-block-digest", source.get("warc-block-digest") or digest(block)),
              ("source-payload-digest", claimed or digest(payload))]
    if claimed and claimed.startswith("sha256:"):
        fields.append(("payload-digest-valid", str(claimed == digest(payload)).lower()))
    fields += [("title", html.unescape(title_of(page))), ("language", language_of(page)), ("conversion", ids["conversion"])]
    fields += [("outlink", html.unescape(link)) for link in links]
    meta = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v).encode()
    out = []
    for kind, content, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        named = [("WARC-Refers-To", source_id), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date),
                 ("WARC-Source-Payload-Digest", claimed or digest(payload)), ("Content-Type", content), ("WARC-Block-Digest", digest(body))]
        if kind == "conversion":
            named.append(("WARC-Payload-Digest", digest(body)))
        out.append({"type": kind, "id": ids[kind], "target": target or None, "date": date or None, "block": body,
                    "headers": [{"name": k, "value": v} for k, v in named if v]})
    return out


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of raw pages; ``page_id`` is kept beside them."""
    key = F.coalesce(F.col(page_id).cast("string"), F.lit(""))
    name = F.sha2(F.concat_ws(" ", key, F.coalesce(url, F.lit(""))), 256)
    hexed = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = F.coalesce(F.col(page), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    header = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    return pages.select(
        F.col(page_id).alias("page_id"), F.lit("response").alias("type"), F.concat(F.lit("<urn:uuid:"), hexed, F.lit(">")).alias("id"),
        F.col(url).alias("target"), F.lit(date).alias("date"),
        F.array(header("Content-Type", F.lit("application/http; msgtype=response"))).alias("headers"), F.concat(head, body).alias("block"))


def derivatives(records: DataFrame, keep: str | None = None) -> DataFrame:
    """The derived records of all response records; ``keep``: a long column carried along."""
    columns = ["type", "id", "target", "date", "headers", "block"] + ([keep] if keep else [])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = [{**d, **({keep: r[keep]} if keep else {})} for r in batch.slice(lo, 256).to_pylist() for d in derive(r)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, types)], names=columns)

    pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pair, pa.binary(), pa.int64()]
    return records.select(*columns).mapInArrow(run, RECORD + (f", {keep} long" if keep else ""))


def to_bytes(record: dict) -> bytes:
    """The record as it stands in a file."""
    own = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["id"]), ("WARC-Target-URI", record["target"]), ("WARC-Date", record["date"])]
    rest = [(h["name"], h["value"]) for h in record["headers"] or [] if h["name"].lower() != "content-length"]
    block = record["block"] or b""
    lines = [f"{k}: {_one_line(v)}" for k, v in own + rest if v] + [f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _unzipped(data: bytes) -> bytes:
    """The contents of gzip members, up to the first that is cut short or damaged."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def from_bytes(data: bytes) -> list[dict]:
    """The records of a file's bytes, plain or of gzip members.  A record without a
    readable length is left out, and so is one that the file's end cuts short; those
    before and after it are read."""
    if data[:2] == b"\x1f\x8b":
        data = _unzipped(data)
    out, at = [], 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            break
        headers = [tuple(x.strip() for x in line.split(":", 1)) for line in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line]
        named = {k.lower(): v for k, v in headers}
        begin, length = head_end + 4, named.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", length):
            at += 1
            continue
        n = int(length)
        if begin + n > len(data):
            at += 1
            continue
        own = ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-length")
        out.append({"type": named.get("warc-type"), "id": named.get("warc-record-id"), "target": named.get("warc-target-uri"), "date": named.get("warc-date"),
                    "headers": [{"name": k, "value": v} for k, v in headers if k.lower() not in own], "block": data[begin: begin + n]})
        at = begin + n
    return out


def write_files(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes .warc.gz files (a gzip member for each record) into ``folder``; one row per file: file, n_records, n_bytes."""

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(path, recursive=True)
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, size
            name, draft = f"part-{part:06d}-{seq:04d}.warc.gz", f"{path}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft, compression=None) as f:
                f.write(b"".join(held))
            fs.move(draft, f"{path}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(held)], "n_bytes": [size]})
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            for r in batch.to_pylist():
                held.append(gzip.compress(to_bytes(r), 1, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return records.select("type", "id", "target", "date", "headers", "block").mapInArrow(run, "file string, n_records long, n_bytes long")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the .warc and .warc.gz files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("content")

    def run(batches):
        columns = ["type", "id", "target", "date", "headers", "block"]
        pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        for batch in batches:
            for content in batch.column(0):
                rows = from_bytes(content.as_py())
                for lo in range(0, len(rows), 256):
                    part = rows[lo: lo + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in zip(columns, [pa.string()] * 4 + [pair, pa.binary()])], names=columns)

    return files.mapInArrow(run, RECORD)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """One row per derived record of a table of pages, with the record's headers as columns."""
    value = lambda name: F.get(F.filter("headers", lambda h: h["name"] == name), F.lit(0))["value"]
    return derivatives(responses(pages), "page_id").select(
        "page_id", F.col("type").alias("record_type"), F.col("id").alias("record_id"), value("WARC-Refers-To").alias("refers_to"),
        F.col("target").alias("target_uri"), value("Content-Type").alias("content_type"), value("WARC-Block-Digest").alias("block_digest"),
        value("WARC-Source-Payload-Digest").alias("source_payload_digest"), F.octet_length("block").cast("long").alias("content_length"),
        F.col("block").cast("string").alias("content"))
