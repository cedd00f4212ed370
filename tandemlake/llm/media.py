"""Media columns: interleaved document sequences with payloads resolved by digest.

HTML becomes an ordered sequence of text and media references with captions; a media table holds each distinct payload
once, as an 8-bit greyscale PNG, under the digest of its content; references find their payload, or what was computed
from it, by a join on the digest. Positions come from the parser and stay with the rows, so text, media and captions
remain aligned however rows are shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, read_table, whole_text

#: Pixels in a row of a stored image.
WIDTH = 64
#: References to payloads of the media table.
SCHEME = "sha256:"
_SKIPPED = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "figure", "blockquote", "pre", "body", "nav", "header", "footer"}
_MEDIA = {"img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "object": "data"}
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"


class _Sequence(HTMLParser):
    """Texts and media references in the order in which they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.figures: list[int] = []  # the first item of each open figure
        self.captioned: set[int] = set()

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            at = dict(attrs)
            if at.get(_MEDIA[tag]):
                self.flush()
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "ref": at[_MEDIA[tag]], "caption": at.get("alt") or at.get("title")})
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append(len(self.items))

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figures:  # a figure's caption holds for each of its media but those of inner figures that have one
                inside = [i for i in self.items[self.figures[-1] :] if i["kind"] == "media" and i["position"] not in self.captioned]
                for i in inside if text else ():
                    i["caption"] = text
                    self.captioned.add(i["position"])
            elif text:
                self.words.append(f" {text} ")
                self.flush()
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def interleaved(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, items: the page's texts and media references in order. Null or empty HTML has no items."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {key: rows[key], "items": [parse_sequence(h) for h in rows["_html"]]}

    typed = pages.schema[key].dataType.simpleString()
    return map_columns(pages.select(key, F.col(html).alias("_html")), f"`{key}` {typed}, items array<{ITEM}>", work)


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale samples, WIDTH a row; the payload's length is a multiple of WIDTH."""
    height = len(payload) // WIDTH
    lines = bytearray()
    for at in range(0, len(payload), WIDTH):
        lines += b"\0" + payload[at : at + WIDTH]

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(lines), 4)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that `to_png` wrote; its checksums are verified."""
    at, packed, head = 8, [], b""
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk in a stored image")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height = struct.unpack_from(">II", head)
    lines = zlib.decompress(b"".join(packed))
    return b"".join([lines[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height)])


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def features(samples: bytes) -> str:
    """Rows, mean, spread and the 16-bin histogram of the samples, as a string."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    mean = float(counts @ np.arange(256)) / len(x)
    spread = max(0.0, float(counts @ np.arange(256) ** 2) / len(x) - mean * mean) ** 0.5
    bins = counts.reshape(16, 16).sum(axis=1)
    return f"rows={len(x) // WIDTH};mean={mean:.4f};std={spread:.4f};hist={'-'.join(map(str, bins))}"


def store_media(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The media table: digest of the unpadded payload, n_bytes, media. Each distinct payload is there once.

    Payloads are compressed before the shuffle that leaves one of each; null payloads count as empty.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        data = [p or b"" for p in rows["_payload"]]
        return {"digest": [hashlib.sha256(p).hexdigest() for p in data], "n_bytes": [len(p) for p in data], "media": [to_png(padded(p)) for p in data]}

    stored = map_columns(payloads.select(F.col(payload).alias("_payload")), "digest string, n_bytes bigint, media binary", work)
    return stored.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("media").alias("media"))


def describe_media(store: DataFrame) -> DataFrame:
    """What is read back from each stored image, by digest."""
    names = ("digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in names}
        for digest, n, media in zip(rows["digest"], rows["n_bytes"], rows["media"]):
            got = from_png(media)
            row = (digest, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(got))
            for c, v in zip(out, row):
                out[c].append(v)
        return out

    schema = "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_columns(store, schema, work)


def references(sequences: DataFrame, key: str) -> DataFrame:
    """key, position, digest, caption of every media reference to the store."""
    item = F.explode(F.filter("items", lambda i: (i["kind"] == "media") & F.startswith(i["ref"], F.lit(SCHEME))))
    return sequences.select(key, item.alias("item")).select(
        key, "item.position", F.substring(F.col("item.ref"), F.lit(len(SCHEME) + 1), F.length("item.ref")).alias("digest"), "item.caption"
    )


def resolve(sequences: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """References with what the store (or a table made from it) has under their digest; unknown digests give nulls.

    `found` has one row for each digest, so the join makes no more rows than there are references, and payloads
    that many pages share are moved once: only what was computed from them meets the references.
    """
    return references(sequences, key).join(found, "digest", "left")


def figure_html(payload: Column, caption: Column) -> Column:
    """A page that shows one stored payload."""
    return F.concat(F.lit(f'<article><figure><img src="{SCHEME}'), F.sha2(payload, 256), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", whole_text().cast("binary").alias("payload"))
    pages = docs.select("doc_id", figure_html(F.col("payload"), F.lit("whole text")).alias("html"))
    described = describe_media(store_media(docs))
    return resolve(interleaved(pages, "doc_id"), described, "doc_id").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
