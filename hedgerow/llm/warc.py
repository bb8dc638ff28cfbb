"""WARC derivatives: response records -> linked metadata and plain-text conversion records.

A response is a row with an id, a target and a payload (string or bytes), and, where they are known, its record id, date
and HTTP head; these are carried over as they came, and what is not known is made up: a record id from the content key, a
fixed date, a plain head. The builder gives for each response its metadata record (title, links, source headers as JSON)
and its conversion record (plain text), both with WARC-Refers-To the response, WARC-Block-Digest and, for the response,
WARC-Payload-Digest. Record ids are name-based UUIDs (version 5) of their content keys, so reruns give the same ids.
`write_warc` writes each record as a gzip member in a Parquet row (members concatenate to a .warc.gz file); `read_warc`
reads such tables back, and `responses` turns the response records of one into rows for `build`.

Markup is read in one pass from tag to tag, so work grows in proportion to a page, whatever is left unclosed in it.

Defined results: null html is an empty payload, with empty text and no links; null url is an empty target; repeated
rows give equal records; malformed markup never fails: unclosed tags and comments run to the end; an empty table gives
no records; very long pages are processed whole; page ids keep their type; extra columns are not looked at. In a WARC
file, a record that breaks off has the block that is there, and header lines without a colon are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_lib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, runs_of

#: Pages carry no fetch time; a fixed one keeps records reproducible.
DATE = "2024-01-01T00:00:00Z"

_NAME = re.compile(r"<(/?)(\w*)")
_HIDDEN = {"script", "style", "noscript", "template", "head"}
_BLOCKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre main aside body html".split())
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in [*_HIDDEN, "title"]}
_TITLE = re.compile(r"<title\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_BARE = re.compile(r"[^\s>]+")


def pieces(page: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what the page is made of: "" for text, "a" for links, "break" for blocks' tags, "tag" for other
    ones, "hidden" for comments and elements that are not shown."""
    at = done = 0
    while (at := page.find("<", at)) >= 0:
        slash, name = _NAME.match(page, at).groups()
        name = name.lower()
        if page.startswith("<!--", at):
            kind, end = "hidden", page.find("-->", at + 4) + 3
            end = end if end > 2 else len(page)
        elif page[at + 1 : at + 2] and page[at + 1] in "!/?" or name[:1].isascii() and name[:1].isalpha():
            end = page.find(">", at) + 1
            closed, end = end > 0, end or len(page)
            kind = "break" if name in _BLOCKS and closed else "a" if name == "a" and not slash else "tag"
            if name in _HIDDEN and not slash and closed:
                m = _CLOSE[name].search(page, end)
                kind, end = "hidden", m.end() if m else len(page)
        else:
            at += 1
            continue
        if done < at:
            yield "", done, at
        yield kind, at, end
        at = done = end
    if done < len(page):
        yield "", done, len(page)


def plain_text(page: str) -> str:
    """Visible text, one line per block, entities decoded once, blanks collapsed, no empty lines."""
    shown = {"break": "\n", "hidden": " ", "tag": "", "a": ""}
    s = "".join(shown.get(kind, page[i:j]) if kind else page[i:j] for kind, i, j in pieces(page))
    lines = (" ".join(x.split()) for x in html_lib.unescape(s).split("\n"))
    return "\n".join(x for x in lines if x)


def title(page: str) -> str:
    m = _TITLE.search(page)
    start = page.find(">", m.end()) + 1 if m else 0
    if not start:
        return ""
    end = _CLOSE["title"].search(page, start)
    return " ".join(html_lib.unescape(page[start : end.start() if end else len(page)]).split())


def links(page: str) -> list[str]:
    out = []
    for kind, i, j in pieces(page):
        if kind == "a" and (m := _HREF.search(page, i, j)):
            at = m.end()
            end = page.find(page[at], at + 1) if page[at : at + 1] in ('"', "'") else -1
            bare = _BARE.match(page, at)
            if end >= 0 or bare:
                out.append(html_lib.unescape(page[at + 1 : end] if end >= 0 else bare[0]))
    return out


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(key))}>"


def plain_head(payload: bytes) -> str:
    """The head of a response of which only the payload is known."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"


def headers_of(head: str) -> dict[str, str]:
    """Status and fields of an HTTP head."""
    first, *rest = head.split("\r\n")
    fields = (x.partition(":") for x in rest)
    return {"Status": first.partition(" ")[2]} | {k.strip(): v.strip() for k, colon, v in fields if colon}


def derive(key: str, url: str | None, page: str | bytes | None, rid: str | None = None, date: str | None = None, head: str | None = None) -> list[dict]:
    """The response, metadata and conversion records of one response."""
    url, page = url or "", page or ""
    payload = page.encode("utf-8", "surrogatepass") if isinstance(page, str) else bytes(page)
    page = page if isinstance(page, str) else payload.decode("utf-8", "replace")
    head = plain_head(payload) if head is None else head
    ids = {k: record_id(k, key, url, hashlib.sha256(payload).hexdigest()) for k in ("response", "metadata", "conversion")}
    ids["response"] = rid or ids["response"]
    text = plain_text(page).encode("utf-8", "replace")
    found = links(page)
    about = {"title": title(page), "links": found, "http_headers": headers_of(head), "payload_digest": digest(payload)}
    meta = json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")

    def record(kind: str, content_type: str, body: bytes, **more: str) -> dict:
        return {"type": kind, "id": ids[kind], "refers_to": None, "uri": url, "date": date or DATE, "content_type": content_type, "block_digest": digest(body), "payload_digest": None, "block": body} | more

    return [
        record("response", "application/http; msgtype=response", head.encode() + b"\r\n\r\n" + payload, payload_digest=digest(payload)),
        record("metadata", "application/json", meta, refers_to=ids["response"]) | {"n_links": len(found), "title": about["title"]},
        record("conversion", "text/plain", text, refers_to=ids["response"]),
    ]


def serialize(r: dict) -> bytes:
    """A WARC/1.1 record."""
    head = [
        "WARC/1.1", f"WARC-Type: {r['type']}", f"WARC-Record-ID: {r['id']}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}",
        *([f"WARC-Refers-To: {r['refers_to']}"] if r["refers_to"] else []), f"WARC-Block-Digest: {r['block_digest']}",
        *([f"WARC-Payload-Digest: {r['payload_digest']}"] if r["payload_digest"] else []),
        f"Content-Type: {r['content_type']}", f"Content-Length: {len(r['block'])}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + r["block"] + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """Records of an uncompressed WARC file."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        fields = (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n"))
        head = {k: v.strip() for k, colon, v in fields if colon}
        size = head.get("Content-Length", "")
        size = int(size) if size.isdigit() else len(data)
        yield {"headers": head, "block": data[end + 4 : end + 4 + size]}
        at = end + 4 + size + 4


FIELDS = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, n_links int, title string, block binary"


def build(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", record_id_col: str | None = None, date_col: str | None = None, head_col: str | None = None) -> DataFrame:
    """Three records per response, with their blocks. head_col: its HTTP head, status line and fields without the blank
    line; record_id_col, date_col: as in its WARC record; null where they are not known."""
    known = [F.col(c).cast("string") if c else F.lit(None).cast("string") for c in (record_id_col, date_col, head_col)]
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), *(x.alias(n) for x, n in zip(known, ("rid", "date", "head"), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for i, j in runs_of((len(x[2] or "") for x in rows), 4 << 20):
                at, out = [], []
                for k, (page, url, body, *more) in enumerate(rows[i:j], i):
                    for r in derive(str(page), url, body, *more):
                        at.append(k)
                        out.append((r["type"], r["id"], r["refers_to"], r["uri"], r["date"], r["content_type"], r["block_digest"], r["payload_digest"], r.get("n_links"), r.get("title"), r["block"]))
                types = [*[pa.string()] * 8, pa.int32(), pa.string(), pa.binary()]
                names = ["page_id", *(x.split()[0] for x in FIELDS.split(", "))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)

    return src.mapInArrow(run, f"page_id {src.schema['page_id'].dataType.simpleString()}, {FIELDS}")


def responses(records: DataFrame) -> DataFrame:
    """The response records of `read_warc` as rows for `build`: record_id, url, date, head, html (the payload's bytes)."""
    rows = records.where(F.try_element_at("headers", F.lit("WARC-Type")) == "response")
    # One character a byte, so that places in the text are places in the block.
    end = F.instr(F.decode("block", "ISO-8859-1"), "\r\n\r\n")
    split = F.when(end > 0, end - 1).otherwise(F.octet_length("block"))
    field = lambda x: F.try_element_at("headers", F.lit(x))
    return rows.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("date"),
        F.decode(F.substring("block", F.lit(1), split), "UTF-8").alias("head"), F.substring("block", split + 5, F.octet_length("block")).alias("html"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzip members, in Parquet rows of one member each (`member` binary), ready to be concatenated in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            members = [gzip.compress(serialize(r | {"id": r["record_id"], "uri": r["target_uri"]}), mtime=0) for r in rows]
            yield pa.RecordBatch.from_pydict({"record_id": [r["record_id"] for r in rows], "member": pa.array(members, pa.binary())})

    records.mapInArrow(run, "record_id string, member binary").write.parquet(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block binary) of gzip-member rows written by write_warc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for m in b.column(0).to_pylist() for x in parse(gzip.decompress(m))]
            heads = pa.array([list(x["headers"].items()) for x in out], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([heads, pa.array([x["block"] for x in out], pa.binary())], ["headers", "block"])

    return spark.read.parquet(path).select("member").mapInArrow(run, "headers map<string,string>, block binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of every record of every page."""
    r = build(read(spark, sf_dir, "pages"))
    return r.select("page_id", "type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", "payload_digest", "n_links", "title", F.octet_length("block").cast("long").alias("content_length"))
