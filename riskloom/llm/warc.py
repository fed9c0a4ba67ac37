"""Derived web-archive records: responses to linked metadata and plain-text conversion records.

Pages become `response` records; WARC files of those are written and read by Spark, a part file
being a whole archive (`write`, `read`); archives of other writers are read as well: header names in any case,
with a blank after the colon or none. A foreign X-Page-Id that is no number gives no page id. `derive` turns responses into a `metadata` record (title,
language, links) and a `conversion` record (the page's text). Both name the response by
WARC-Refers-To and keep the source's target URI, date and payload digest, whatever the source says
they are; the conversion also names its metadata record as concurrent. Record ids are name-based
UUIDs of the source record and its payload, so a task that runs twice makes the same records, and
equal rows make equal records.

Null html: an empty payload and an empty text. Null url: no target URI header. Page text keeps its
order, one line for each block element; scripts, styles, comments and the head are no text, an
element of those that isn't closed hides all that follows, and a tag that isn't closed is text.
Pages are scanned once, from front to back, so very long or broken ones take time in proportion.
An empty table gives no records. Repeated rows are records of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import shared_folder

DATE = "1970-01-01T00:00:00Z"  # of pages that come without one
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table td th tr ul".split())
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template")}
NAME = re.compile(r"<(?:[!?]|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTE = re.compile(r"(?<![^\s=/\"'])([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*))")
TITLE_END = re.compile(r"</title", re.I)
BLANKS = re.compile(r"[^\S\n]+")
LONG_NUMBER = re.compile(r"&#[0-9]{1000,};?")  # stands for no character, but is more than int() takes
END = "\r\n\r\n"
# Header names of the format, which are case-insensitive
HEADERS = {x.lower(): x for x in "WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Payload-Digest WARC-Block-Digest WARC-Refers-To WARC-Concurrent-To Content-Length Content-Type".split()}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard one for URLs


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def unescaped(text: str) -> str:
    return entities.unescape(LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def parts(page: str):
    """(text before it, tag name or '', is it a closing tag, what stands in it, where the tag ends) of every tag, front to back.

    Raw elements and comments come as one tag without a name.
    """
    at = shown = 0
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = len(page) if j < 0 else j + 3
            yield page[shown:i], "", False, "", at
            shown = at
            continue
        m = NAME.match(page, i)
        if not m:
            at = i + 1
            continue
        j = page.find(">", i)
        if j < 0:
            break
        at, name = j + 1, (m[2] or "").lower()
        if name in RAW and not m[1]:
            end = RAW[name].search(page, at)
            at, name = end.end() if end else len(page), ""
        yield page[shown:i], name, bool(m[1]), page[m.end() : j] if name else "", at
        shown = at
    yield page[shown:], "", False, "", len(page)


def attribute(inside: str, name: str) -> str | None:
    """Value of a tag's first attribute of that name."""
    return next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(inside) if m[1].lower() == name), None)


def derived(page: str) -> tuple[str, str]:
    """The metadata fields and the plain text of a page."""
    title, language, links, text, in_head, titled = None, None, [], [], False, False
    for before, name, closing, inside, at in parts(page):
        if not in_head:
            text.append(before)
            text.append("\n" if name in BLOCKS or name == "head" else "" if name else " ")
        if name == "head":
            in_head = not closing
        elif name == "body":
            in_head = False
        elif closing:
            continue
        elif name == "a" and (to := attribute(inside, "href")) is not None:
            links.append(unescaped(to).strip())
        elif name == "title" and not titled:
            titled = True  # if this one isn't closed, no later one is
            if m := TITLE_END.search(page, at):
                title = " ".join(unescaped(page[at : m.start()]).split())
        elif name == "html" and language is None:
            language = attribute(inside, "lang")
    fields = [("title", title), ("language", language and language.lower()), *(("outlink", f"{x} L a/@href") for x in links)]
    lines = (x.strip() for x in BLANKS.sub(" ", unescaped("".join(text))).split("\n"))
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None), "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    return derived(page)[1]


def metadata_fields(page: str) -> str:
    return derived(page)[0]


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record: version line, headers that have a value, the block, two line ends."""
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + END.encode()


def fields(lines: list[str]) -> dict[str, str]:
    """Header lines as a dictionary: names of the format as it writes them, a blank after the colon or none, continued lines joined, the first of a name."""
    out: dict[str, str] = {}
    last = None
    for x in lines:
        if x[:1] in (" ", "\t") and last:
            out[last] += " " + x.strip()
            continue
        name, colon, value = x.partition(":")
        last = HEADERS.get(name.strip().lower(), name.strip()) if colon else None
        if last in out:
            last = None
        elif last:
            out[last] = value.strip()
    return out


def parse(data: bytes):
    """(headers, block) of every record in `data`, gzipped (in one member or many) or not, one unpacked after the other.

    What isn't a record, or has no length, is an error.
    """
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while line := stream.readline():
        if not line.strip():
            continue  # between records
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        headers = fields(lines)
        if not headers.get("Content-Length", "").isdecimal():
            raise ValueError(f"a record without a length: {headers}")
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"a record ends after {len(block)} of {n} bytes")
        yield headers, block


def named(*what) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(map(str, what)))}>"


def response(page_id: int | None, url: str | None, page: str | None, date: str | None = DATE) -> bytes:
    """A page as a response record; its id stands in the HTTP headers."""
    payload = (page or "").encode("utf-8", "replace")
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%bContent-Length: %d\r\n\r\n" % (own, len(payload)) + payload
    source = digest(payload)
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", named("response", page_id, url, source)), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", source), ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return serialise(headers, http)


def records(headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    sent = {k.lower(): v for k, v in fields(head.decode("utf-8", "replace").split("\r\n")[1:]).items()}
    page_id = sent.get("x-page-id", "")
    source = headers.get("WARC-Payload-Digest") or digest(payload)
    of, url, date = headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date")
    about, text = derived(payload.decode("utf-8", "replace"))
    ids = {k: named(k, of, source) for k in ("metadata", "conversion")}
    out = []
    for kind, made, content_type in (("metadata", about, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        made = made.encode("utf-8", "replace")
        own = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", of),
            ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", ids["metadata"] if kind == "conversion" else None),
            ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", digest(made)), ("Content-Type", content_type),
        ]
        out.append({
            "page_id": int(page_id) if re.fullmatch(r"-?[0-9]{1,18}", page_id) else None, "record_type": kind, "record_id": ids[kind], "refers_to": of, "target_uri": url,
            "content_type": content_type, "source_digest": source, "block_digest": digest(made), "content_length": len(made), "record": serialise(own, made),
        })
    return out


SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, source_digest string, block_digest string, content_length long, record binary"


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str | None = None) -> DataFrame:
    """One row, `record`, for each page: its response record without the line ends that close it."""

    def run(batches):
        for b in batches:
            made = [response(*(x.as_py() for x in row))[: -len(END)].decode() for row in zip(*b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["record"])

    when = F.col(date).cast("string") if date else F.lit(DATE)
    return pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(page).cast("string"), when.alias("_date")).mapInArrow(run, "record string")


def write(found: DataFrame, folder: str, records_per_file: int = 20_000) -> None:
    """Rows of `record` as WARC files, each part file a gzipped archive of its own."""
    found.select("record").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """headers and block of every record of the WARC files below a folder, whatever their names (but for Spark's hidden `_` and `.`), gzipped or not.

    A file is one value, so it has 2 GB at most; its records are unpacked one at a time.
    """

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([x for _, x in rows], pa.binary())], ["headers", "block"])

        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    rows.append((h, block))
                    size += len(block)
                    if size > 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(run, "headers map<string, string>, block binary")


def derive(found: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records among rows of (headers, block); no shuffle."""
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in SCHEMA.split(", ")])

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for headers, block in zip(b.column(0), b.column(1), strict=True):
                made = records(dict(headers.as_py()), block.as_py())
                rows += made
                size += sum(len(r["record"]) for r in made)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return found.where(F.lower(F.col("headers")["WARC-Type"]) == "response").select("headers", "block").mapInArrow(run, SCHEMA)


def build(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str | None = None) -> DataFrame:
    """The derived records of a table of pages, by way of WARC files of responses in the shared folder."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(responses(pages, page_id, url, page, date), folder)
    return derive(read(spark, folder))
