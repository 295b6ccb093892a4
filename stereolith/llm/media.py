"""Media columns: interleaved document sequences.

HTML is parsed into one ordered sequence of text and media-reference structs. A
reference names its payload by digest; payloads lie once each in a store, as
8-bit grey images, and a join on the digest resolves them, so a payload that
many documents share is neither copied nor decoded for each of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, text_column, tied

ROW = 64  # samples in a row of a stored image
ITEM = "struct<pos:int,kind:string,text:string,media:string,caption:string>"
_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())])
#: Elements that end a run of text, that refer to media, and whose content isn't shown.
_BREAKS = frozenset("address article aside blockquote body br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul figure figcaption".split())
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "media", "embed": "media"}
_HIDDEN = frozenset("script style template noscript".split())


class _Reader(HTMLParser):
    """Gathers the items of one page in the order in which they stand."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figure: int | None = None  # the first item of the open figure
        self.caption: list[str] | None = None

    def _break(self) -> None:
        text = "".join(self.run).strip()
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "media": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BREAKS:
            self._break()
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self._break()
                self.items.append({"kind": _MEDIA[tag], "text": None, "media": found["src"], "caption": found.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = "".join(self.caption).strip()
            self.caption = None
            for item in self.items[self.figure or 0 :] if text else []:
                if item["media"] is not None:
                    item["caption"] = text
        elif tag == "figure":
            self.figure = None
        if tag in _BREAKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.run.append(data)


def parse_page(html: str) -> list[dict]:
    """The page's items in order, with ``pos`` from 0: shown text, and references with their caption (else their alt text)."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._break()
    return [{"pos": i} | item for i, item in enumerate(reader.items)]


def interleave(df: DataFrame, *, id_col: str, html_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the ``carry`` columns and ``items`` of every row: its text and its references in order.

    A null or empty page has no items; malformed HTML is
    read as far as it goes. Columns not named are not read.
    """
    rows = df.select(F.col(id_col), *[F.col(c) for c in carry], text_column(html_col).alias("__html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("items", T.ArrayType(T._parse_datatype_string(ITEM)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html"):
            items = [parse_page(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(items, pa.list_(_ITEM))], names=schema.names)

    return rows.mapInArrow(run, schema)


def pad(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of a row."""
    return payload + bytes(-len(payload) % ROW or (0 if payload else ROW))


def encode_image(samples: bytes) -> bytes:
    """A binary PGM image of 8-bit grey samples, ``ROW`` wide."""
    return b"P5\n%d %d\n255\n" % (ROW, len(samples) // ROW) + samples


def decode_image(stored: bytes) -> bytes:
    """The samples of a binary PGM image."""
    kind, size, depth = (head := stored.split(b"\n", 3))[:3]
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(head[3]) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return head[3]


def image_features(samples: bytes) -> str:
    """Mean, deviation, eight-bin histogram and a 16-bit profile hash of an image, as text.

    The hash says which sixteenths of the image are brighter than its mean.
    """
    grey = np.frombuffer(samples, np.uint8)
    histogram = np.bincount(grey >> 5, minlength=8)
    edges = np.arange(16) * len(grey) // 16
    part = np.add.reduceat(grey, edges, dtype=np.int64) / np.diff(edges, append=len(grey))
    profile = int("".join("1" if x > grey.mean() else "0" for x in part), 2)
    return f"{grey.mean():.4f} {grey.std():.4f} {','.join(map(str, histogram))} {profile:04x}"


def store_payloads(df: DataFrame, *, payload_col: str) -> DataFrame:
    """The media store of a binary column, written down: ``digest`` and ``media``.

    A task stores a payload that it meets again only once; tasks may store the
    same payload. Null counts as empty.
    """
    rows = df.select(F.coalesce(F.col(payload_col), F.lit(b"")).alias("__payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "__payload"):
            digests, images = [], []
            for raw in batch.column("__payload").to_pylist():
                digest = hashlib.sha256(raw).digest()
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest.hex())
                    images.append(encode_image(pad(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "media"])

    return materialize(rows.mapInArrow(run, "digest string, media binary"), "media")


def store_features(store: DataFrame, feature: Callable[[bytes], str] = image_features) -> DataFrame:
    """What the stored bytes say, a row for each digest.

    ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``,
    ``media_sha256`` and ``feature``, all from the media read back. Written down, so
    that a join with them can split a digest that many documents share.
    """
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples = decode_image(media)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    made = store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return materialize(made.dropDuplicates(["digest"]), "features")


def resolve(items: DataFrame, features: DataFrame, *, scheme: str = "sha256:") -> DataFrame:
    """Put each reference of :func:`interleave` beside its payload's row; a reference without one keeps nulls.

    Positions and captions stay with the reference. References of another scheme
    are kept too.
    """
    flat = items.withColumn("item", F.explode("items")).where("item.media is not null").drop("items")
    flat = flat.withColumn("digest", F.when(F.col("item.media").startswith(scheme), F.substring("item.media", len(scheme) + 1, 64)))
    named = flat.select("*", F.col("item.pos").alias("pos"), F.col("item.kind").alias("kind"), F.col("item.caption").alias("caption")).drop("item")
    return tied(named.join(features, "digest", "left"), features)
