"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response record is a row: record_id, target_uri, date, http (the HTTP header block as text) and payload (the bytes of the body). Each
yields two records. The metadata record has one line per field (title, language, links, status, content type, each HTTP
header as it is, text length), the conversion record the
page's text. Both refer to the response by WARC-Refers-To, keep its target URI and date, and carry the digest of the source payload besides
that of their own block. Record identifiers are derived from the response's, so a task that runs again writes the same records.

A null or empty payload gives empty text and no links; a null header block gives no status; null identifiers, URIs and dates give null
references and are left out of the header. Bytes that are no UTF-8 (or the charset of the Content-Type) are replaced. Responses that are equal
throughout give equal records; another payload gives other record identifiers, whatever the response is called.

Pages are read in one pass whose time is in proportion to their length, for texts of any size and shape. A comment, script or style without an
end runs to the end of the page; a noscript or template without one is a tag like others; a bracket that begins no complete tag is text. Quoted
attribute values may hold brackets; where the quotes of a page do not pair up, tags from there on end at the next bracket. A <head>
without an end tag ends before the first text or element that is no part of a head. Control characters in URIs, dates and identifiers are
percent-encoded in headers, so none begins another line.

An empty table gives none. Ties do not arise. Other columns are not carried, whatever their names. Each row is converted on its own: no exchange.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.words import sliced

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
RECORD = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "source_digest string, block_digest string, content_length long, header string, block string"
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
# From a tag's name to its end; a quoted value may hold any character. Possessive, so that a failure is not tried again in parts.
_REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}
_BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol tr table section article nav header footer blockquote pre title br".split())
_HEAD_TAGS = frozenset("meta link base basefont bgsound noscript template".split())
_HIDDEN = ("noscript", "template")
_NUMBER = re.compile(r"&#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?")
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
_CHARSET = re.compile(r"^content-type:[^\n]*charset=\"?([\w-]+)", re.M | re.I)
_STATUS = re.compile(r"^HTTP/[\d.]+ (\d{3})")
# A line that begins with a blank goes on with the header before it.
_HEADER = re.compile(r"^([^\s:]+):[ \t]*([^\r\n]*(?:\r?\n[ \t]+[^\r\n]*)*)", re.M)
_TYPE = re.compile(r"^content-type:\s*([^;\r\n]+)", re.M | re.I)
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")

TEXT, OPEN, CLOSE, GAP = range(4)


def tokens_of(page: str) -> list[tuple[int, str, str]]:
    """(kind, name, content) of a page in one pass: texts, opening tags with their attributes, closing tags, and gaps, which are
    comments, scripts and styles. Each search starts where the last one ended, and one that finds nothing is not made again, so the
    time is in proportion to the page."""
    out: list[tuple[int, str, str]] = []
    at, begin, last_end, quotes = 0, 0, page.rfind(">"), True

    def text(end: int) -> None:
        if end > begin:
            out.append((TEXT, "", page[begin:end]))

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            text(at)
            end = page.find("-->", at + 4)
            out.append((GAP, "", ""))
            at = begin = len(page) if end < 0 else end + 3
            continue
        if at > last_end:
            break  # No tag ends behind this place.
        if page.startswith(("<!", "<?"), at):
            text(at)
            at = begin = page.find(">", at) + 1
            continue
        m = _NAME.match(page, at)
        if not m:
            at += 1
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:
            # The quotes of the page do not pair up: from here on a tag ends at the next bracket.
            quotes, end = False, page.find(">", m.end()) + 1
        else:
            end = rest.end()
        text(at)
        name, closing = m[1].lower(), page[at + 1] == "/"
        raw = None if closing else _RAW_END.get(name)
        if raw:
            stop = raw.search(page, end)
            out.append((GAP, "", ""))
            at = begin = stop.end() if stop else len(page)
            continue
        out.append((CLOSE, name, "") if closing else (OPEN, name, page[m.end() : end - 1]))
        at = begin = end
    text(len(page))
    return out


def _next(tokens: list[tuple[int, str, str]], kind: int, name: str) -> list[int]:
    """For each place the next token of this kind and name, or the number of tokens."""
    out, at = [len(tokens)] * (len(tokens) + 1), len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        if tokens[i][0] == kind and tokens[i][1] == name:
            at = i
        out[i] = at
    return out


def visible(tokens: list[tuple[int, str, str]]) -> str:
    """Text of the tokens, before entities are resolved: without the head and what noscript and template enclose."""
    size, out, i = len(tokens), [], 0
    ends = {name: _next(tokens, CLOSE, name) for name in (*_HIDDEN, "head", "title")}
    body = _next(tokens, OPEN, "body")
    while i < size:
        kind, name, content = tokens[i]
        if kind == OPEN and name in _HIDDEN and ends[name][i] < size:
            out.append(" ")
            i = ends[name][i]
        elif kind == OPEN and name == "head":
            out.append(" ")
            if ends["head"][i] < min(size, body[i]):
                i = ends["head"][i]
            else:
                # Without an end tag it ends before the first text or element that is no part of a head.
                while i + 1 < size:
                    kind, name, content = tokens[i + 1]
                    if kind == OPEN and name == "title":
                        i = min(ends["title"][i + 1], size) - 1
                    elif kind == TEXT and content.strip() or kind in (OPEN, CLOSE) and name not in _HEAD_TAGS and (kind, name) != (CLOSE, "title"):
                        break
                    i += 1
        elif kind == TEXT:
            out.append(content)
        elif kind == GAP:
            out.append(" ")
        elif name in _BREAKS:
            out.append("\n")
        i += 1
    return "".join(out)


def resolved(s: str) -> str:
    """Entities resolved; a number that is no character, of any length, is U+FFFD, and so is a lone surrogate."""

    def number(m: re.Match) -> str:
        digits, base = (m[1], 10) if m[1] else (m[2], 16)
        return "\ufffd" if len(digits) > 8 else f"&#{int(digits, base)};"

    return html.unescape(_NUMBER.sub(number, s))


def text_of_page(page: str) -> str:
    """Visible text: one line per block element, blanks made single, entities resolved after the tags are gone."""
    return _lines(visible(tokens_of(page)))


def _lines(raw: str) -> str:
    return _LINES.sub("\n", _BLANKS.sub(" ", resolved(raw))).strip()


def _attribute(attributes: str, wanted: str) -> str | None:
    """Value of the first attribute of this name; None when it is not there."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == wanted:
            return next((g for g in m.groups()[1:] if g is not None), "")
    return None


def _clean(s: str) -> str:
    return " ".join(resolved(s).split())


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def decoded(payload: bytes, http: str | None) -> str:
    named = _CHARSET.search(http or "")
    try:
        # Some charsets can name lone surrogates, which have no bytes in a record.
        return payload.decode(named[1] if named else "utf-8", "replace").encode("utf-8", "replace").decode()
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def metadata_of(page: str | list[tuple[int, str, str]], http: str | None, text: str) -> str:
    """The lines of a metadata block. Title, language and links are those of the page's tags; comments and scripts have none."""
    tokens = tokens_of(page) if isinstance(page, str) else page
    fields = [("http-status", _STATUS.match(http or "")), ("http-content-type", _TYPE.search(http or ""))]
    lines = [f"{k}: {_clean(m[1])}" for k, m in fields if m]
    begin = next((i for i, t in enumerate(tokens) if t[:2] == (OPEN, "title")), None)
    end = begin is not None and next((i for i in range(begin, len(tokens)) if tokens[i][:2] == (CLOSE, "title")), None)
    if end:
        lines.append(f"title: {_clean(''.join(c for kind, _, c in tokens[begin:end] if kind == TEXT))}")
    language = next((v for kind, name, c in tokens if kind == OPEN and name == "html" and (v := _attribute(c, "lang"))), None)
    if language:
        lines.append(f"language: {_clean(language)}")
    lines += [f"http-header: {m[1]}: {' '.join(m[2].split())}" for m in _HEADER.finditer(http or "")]
    links = (_attribute(c, "href") for kind, name, c in tokens if kind == OPEN and name == "a")
    lines += [f"outlink: {_clean(href)}" for href in links if href]
    return "\r\n".join([*lines, f"text-characters: {len(text)}"]) + "\r\n"


def field(value: str) -> str:
    """A value for one line of a header: control characters are percent-encoded, so that none can begin another line."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def derive_one(page_id, record_id, uri, date, http, payload) -> list[tuple]:
    """The metadata and the conversion record of a response, as rows of RECORD."""
    payload = payload or b""
    tokens = tokens_of(decoded(payload, http))
    text = _lines(visible(tokens))
    source = sha1(payload)
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", metadata_of(tokens, http, text)), ("conversion", "text/plain", text)):
        data = block.encode()
        own = f"<urn:uuid:{uuid.uuid5(SPACE, f'{record_id} {kind} {source}')}>"
        digest = sha1(data)
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date),
            ("WARC-Block-Digest", digest), ("WARC-Source-Payload-Digest", source), ("Content-Type", content), ("Content-Length", len(data)),
        ]
        header = "WARC/1.1\r\n" + "".join(f"{k}: {field(str(v))}\r\n" for k, v in fields if v is not None)
        out.append((page_id, kind, own, record_id, uri, date, content, source, digest, len(data), header, block))
    return out


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    kinds = [pa.int64() if c.split(" ")[1] == "long" else pa.string() for c in RECORD.split(", ")]
    for batch in sliced(batches, "payload"):
        cols = [batch.column(c).to_pylist() for c in ("page_id", "record_id", "target_uri", "date", "http", "payload")]
        rows = [r for row in zip(*cols) for r in derive_one(*row)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response; see the module."""
    cols = ["record_id", "target_uri", "date", "http"]
    rows = responses.select(F.col("page_id").cast("long"), *[F.col(c).cast("string") for c in cols], F.col("payload").cast("binary"))
    return rows.mapInArrow(_derived, RECORD)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Raw pages (page_id, url, html) as response records captured at `date`."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # From the content too: two captures of one address are two records. The digest and the number hold no separator.
    name = F.md5(F.concat_ws("|", F.sha1(body), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "url"))
    cut = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")
    )
    record_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))
    return pages.select("page_id", record_id.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), body.alias("payload"))


def write(records: DataFrame, path: str) -> None:
    """Records as text files in the WARC layout; each record is whole in one file."""
    # The writer adds the last byte of the blank line that ends a record.
    records.select(F.concat("header", F.lit("\r\n"), "block", F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: both records of every page."""
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
