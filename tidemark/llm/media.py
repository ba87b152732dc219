"""Media columns: interleaved document sequences with payloads resolved by digest.

parse_html turns a page into an ordered sequence of items, struct(pos, kind, text, ref,
caption): runs of text, and media references with their captions where they stand. Payloads
are kept apart, as losslessly coded 8-bit greyscale PNGs of PAGE samples a row, in a table
addressed by the payload's SHA-256. resolve joins the references to what was read back from
the stored bytes; the payload itself is never shuffled, and positions and captions stay as
they were parsed.

The query's pages hold the documents: each line is a paragraph, and after the first half of
them, rounded up, stands a figure with the whole text as its image and the doc_id as its
caption. A whole text is a payload as UTF-8, with bytes 255 up to a positive multiple of PAGE.
Defined cases: null and empty texts are PAGE bytes 255 and pages of a figure alone; null html
is an empty sequence; a figure's caption belongs to all its media, wherever in the figure it
stands, and is a run of text where the figure has none; a caption outside a figure is text if
it ends, else nothing; a reference without payload resolves to nulls; repeated rows each give
a row; texts of any length are one payload and one page; other columns, whatever their names,
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, reach_workers, rows_of, stage, texts

PAGE = 576
ZLIB_LEVEL = 3
SCHEME = "sha256:"
ITEMS = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of HTML: elements whose text isn't shown, and elements that end a run of text.
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}
MEDIA = {"img", "audio", "video", "source", "embed"}


class Sequence(HTMLParser):
    """The items of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figure: int | None = None
        self.said: list[str] = []
        self.caption: list[str] | None = None

    def end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, text: str | None = None, ref: str | None = None, caption: str | None = None) -> None:
        self.items.append({"pos": len(self.items), "kind": kind, "text": text, "ref": ref, "caption": caption})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.end_figure()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.end_caption()
            self.end_run()
            self.caption = []
        elif tag in MEDIA:
            named = dict(attrs)
            if named.get("src"):
                self.end_run()
                self.add("media", ref=named["src"], caption=named.get("alt") or None)
        elif tag in BLOCKS and self.caption is None:
            self.end_run()

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in BLOCKS and self.caption is None:
            self.end_run()

    def end_caption(self) -> None:
        """What the caption says is kept for the figure; outside of one it is a run of text."""
        if self.caption is None:
            return
        said = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figure is not None:
            self.said.append(said)
        elif said:
            self.add("text", text=said)

    def end_figure(self) -> None:
        if self.figure is None:
            self.end_run()
            return
        self.end_caption()
        self.end_run()
        said, media = " ".join(x for x in self.said if x), [i for i in self.items[self.figure :] if i["kind"] == "media"]
        if said and media:
            for item in media:
                item["caption"] = said
        elif said:
            self.add("text", text=said)
        self.figure, self.said = None, []

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end_figure()
    return parser.items


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % PAGE if data else PAGE)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image, PAGE samples a row, every row unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAGE)
    raw = np.zeros((len(rows), PAGE + 1), np.uint8)
    raw[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", PAGE, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, ZLIB_LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an image that to_png made; checks signature, sums, kind and size."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's sum is wrong")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if raw[:, 0].any():
        raise ValueError("a filtered row")
    return raw[:, 1:].reshape(-1)


def feature_of(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, and their shares by sixteenths of the range."""
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = (int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    return f"{mean:.4f},{spread:.4f}," + ",".join(f"{c / n:.4f}" for c in counts.reshape(16, 16).sum(axis=1).tolist())


def page_of(text: str, digest: str, caption: str) -> str:
    """A text as a page: a paragraph a line, and the figure after the first half of them."""
    lines = text.split("\n") if text else []
    figure = f'<figure><img src="{SCHEME}{digest}"><figcaption>{escape(caption)}</figcaption></figure>'
    half = (len(lines) + 1) // 2
    paragraphs = [f"<p>{escape(x, quote=False)}</p>" for x in lines]
    return "<!DOCTYPE html><html><body>" + "\n".join([*paragraphs[:half], figure, *paragraphs[half:]]) + "</body></html>"


_STORE = pa.schema([("digest", pa.string()), ("media", pa.binary())])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            payloads = [payload_of(t) for t in whole.slice(start, 500).column("text").to_pylist()]
            yield pa.record_batch([pa.array([hashlib.sha256(x).hexdigest() for x in payloads]), pa.array([to_png(x) for x in payloads], pa.binary())], schema=_STORE)


_PAGE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string())])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            out = []
            for doc_id, text in rows_of(whole.slice(start, 500), "doc_id", "text"):
                digest = hashlib.sha256(payload_of(text)).hexdigest()
                out.append((doc_id, len(text.encode("utf-8", "surrogatepass")), page_of(text, digest, "" if doc_id is None else str(doc_id))))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PAGE, strict=True)], schema=_PAGE)


_READ = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            out = []
            for digest, media in rows_of(whole.slice(start, 500), "digest", "media"):
                samples = from_png(media)
                data = samples.tobytes()
                out.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)


_ITEMS = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            part = whole.slice(start, 500)
            items = pa.array([parse_html(h) for h in part.column("html").to_pylist()], _ITEMS)
            kept = [n for n in part.schema.names if n != "html"]
            yield pa.record_batch([*(part.column(n) for n in kept), items], names=[*kept, "items"])


def interleave(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns to keep, and items: each page's ordered text and media references."""
    reach_workers(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_column).alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("html").schema)
    return rows.mapInArrow(_parsed, f"{schema}, items {ITEMS}")


def read_payloads(store: DataFrame) -> DataFrame:
    """One row per digest of a store (digest, media): what its stored bytes decode to."""
    reach_workers(store.sparkSession)
    read = store.select("digest", "media").mapInArrow(_read_back, READ)
    return read.groupBy("digest").agg(*(F.min(c).alias(c) for c in read.columns[1:]))


def resolve(sequences: DataFrame, payloads: DataFrame) -> DataFrame:
    """A row per media item: the sequence's own columns, pos, caption, and by its digest the
    payload's columns. Given payloads that are a written table, adaptive execution can split
    the references to a much copied payload."""
    own = [c for c in sequences.columns if c != "items"]
    items = sequences.select(*own, F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = items.select(*own, "item.pos", "item.caption", F.regexp_replace("item.ref", f"^{SCHEME}", "").alias("digest"))
    return refs.join(payloads, "digest", "left")


def store_documents(docs: DataFrame) -> DataFrame:
    """Write every document's payload; return the table (digest, media)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "media")
    stored = texts(docs).mapInArrow(_stored, "digest string, media binary")
    stored.write.option("compression", "none").parquet(path)
    return spark.read.schema(stored.schema).parquet(path)


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html): every document as a page with its payload's reference."""
    return texts(docs).mapInArrow(_pages, "doc_id long, n_bytes long, html string")


def media_columns(docs: DataFrame) -> DataFrame:
    """What query op4 returns, with the place and caption of the payload in the document's
    sequence, the number of its items, and a sum of its runs of text, a line each."""
    payloads = stage(read_payloads(store_documents(docs)), "payloads")
    sequences = interleave(pages_of(docs), "html", ("doc_id", "n_bytes"))
    runs = F.array_join(F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"]), "\n")
    found = resolve(sequences.select("*", F.size("items").alias("n_items"), F.crc32(runs.cast("binary")).alias("texts_crc32")), payloads)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_items", "texts_crc32")
