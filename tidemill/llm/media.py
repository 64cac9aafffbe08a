"""Media columns: documents as ordered sequences of text and media, resolved by digest."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of, to_batch

WIDTH = 64
ITEM = "struct<position: int, kind: string, text: string, src: string, digest: string, caption: string>"
_ITEMS = pa.list_(pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in ("kind", "text", "src", "digest", "caption")]]))
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and those bytes filled up with zeros to a positive multiple of WIDTH."""
    data = text.encode()
    return len(data), data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, WIDTH samples a row, without loss."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each row begins with its filter: none
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(raw.tobytes(), 3)) + _part(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an image that to_png made."""
    if stored[:8] != _PNG:
        raise ValueError("not an image of this store")
    at, packed, shape = 8, [], (0, 0)
    while at < len(stored):
        (size,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        data = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError("an image part is damaged")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    return raw[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Mean, deviation, mean step between neighbours, shares of eight ranges, and an 8 x 8 average hash, as text."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    share = np.bincount(x >> 5, minlength=8) / len(x)
    rows = x.reshape(-1, WIDTH)
    bands = np.array_split(rows.reshape(len(rows), 8, 8).mean(axis=2), min(8, len(rows)))
    small = np.array([b.mean(axis=0) for b in bands])
    bits = np.zeros(64, dtype=np.uint8)
    bits[: small.size] = (small > small.mean()).ravel()
    numbers = [x.mean(), x.std(), np.abs(np.diff(x)).mean(), *share]
    return ";".join(f"{v:.6f}" for v in numbers) + ";" + np.packbits(bits).tobytes().hex()


#: Tags that begin a new item of text, and tags that refer to media.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th br hr title section article header footer blockquote pre figure figcaption script style".split())
MEDIA = frozenset("img video audio source".split())


class _Sequence(HTMLParser):
    """Texts of paragraphs and references of media, in order; a figure's caption goes to its media, before or behind it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip, self.caption = False, False
        self.figure: list[int] | None = None  # media of the open figure
        self.said: str | None = None  # its caption

    def _flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if self.skip or not text.strip():
            return
        if self.caption and self.figure is not None:
            self.said = text if self.said is None else self.said + text
        else:
            self._add("text", text=text)

    def _add(self, kind: str, text: str | None = None, src: str | None = None, caption: str | None = None) -> None:
        digest = src.removeprefix("sha256:") if src is not None and src.startswith("sha256:") else None
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "src": src, "digest": digest, "caption": caption})

    def _end_figure(self) -> None:
        if self.figure and self.said is not None:
            for k in self.figure:
                self.items[k]["caption"] = self.said
        elif self.said is not None:
            self._add("text", text=self.said)
        self.figure, self.said = None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in MEDIA:
            self._flush()
        if tag in BLOCKS:
            self.skip, self.caption = tag in ("script", "style"), tag == "figcaption"
        if tag == "figure":
            self._end_figure()
            self.figure = []
        if tag in MEDIA:
            own = dict(attrs)
            source = own.get("src")
            if source is None and tag in ("video", "audio"):
                return  # its sources follow
            self._add("media", src=source, caption=own.get("alt"))
            if self.figure is not None:
                self.figure.append(len(self.items) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self.skip = self.caption = False
        if tag == "figure":
            self._end_figure()

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A declaration such as <![foo bar]> is passed over, whatever is in it."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)


def parse_sequence(source: str) -> list[dict]:
    """Items (position, kind, text, src, digest, caption) of a page: kind text or media, positions from 0 without gaps.

    Any markup is taken as it comes: unclosed and crossed tags, and declarations that the parser knows nothing of, lose no
    text but their own. Media outside a figure keep their alternative text as caption; a figure's caption goes to all of
    its media, or is a text where it has none.
    """
    parser = _Sequence()
    try:
        parser.feed(source)
        parser.close()
    except (AssertionError, ValueError):  # markup that the parser itself gives up on: what is left of it is text
        parser.text.append(parser.rawdata)
    parser._flush()
    parser._end_figure()
    return parser.items


def interleaved(pages: DataFrame) -> DataFrame:
    """doc_id, items (array of ITEM) of pages (doc_id, html). Map only.

    Null and empty html have no items; a null doc_id stays null; repeated rows are pages of their own; an empty table gives
    an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield to_batch({"doc_id": (pa.int64(), batch.column(0)), "items": (_ITEMS, [parse_sequence(t) for t in texts_of(batch, "html")])})

    return pages.select("doc_id", "html").mapInArrow(run, f"doc_id long, items array<{ITEM}>")


def page_of(text: str, digest: str, caption: str) -> str:
    """A page of a text's lines, each a paragraph, with a figure behind the middle one."""
    lines = text.split("\n")
    middle = (len(lines) + 1) // 2
    parts = [f"<p>{html.escape(line, quote=False)}</p>" for line in lines]
    parts.insert(middle, f'<figure><img src="sha256:{digest}"><figcaption>{caption}</figcaption></figure>')
    return "\n".join(parts)


def media_pages(docs: DataFrame) -> DataFrame:
    """doc_id, html: a page of each text (page_of) that refers to the text's image by digest; the caption is its number of
    bytes. Map only; rows as in media_columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pages = []
            for text in texts_of(batch):
                n, payload = payload_of(text)
                pages.append(page_of(text, hashlib.sha256(payload).hexdigest(), str(n)))
            yield to_batch({"doc_id": (pa.int64(), batch.column(0)), "html": (pa.string(), pages)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, html string")


def media_store(docs: DataFrame) -> DataFrame:
    """digest, media: each text as an image, keyed by the SHA-256 of its payload. Map only; rows as in media_columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            payloads = [payload_of(text)[1] for text in texts_of(batch)]
            digests = [hashlib.sha256(p).hexdigest() for p in payloads]
            yield to_batch({"digest": (pa.string(), digests), "media": (pa.binary(), [to_png(p) for p in payloads])})

    return docs.select("text").mapInArrow(run, "digest string, media binary")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(store: DataFrame) -> DataFrame:
    """Digests and a feature of each row of a media store (digest, media), from the stored bytes. Map only.

    Rows that repeat a digest each get a row, and an empty store gives none; media are never null (media_store)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stored = batch.column(1).to_pylist()
            samples = [from_png(m) for m in stored]
            yield to_batch(
                {
                    "digest": (pa.string(), batch.column(0)),
                    "payload_bytes": (pa.int64(), [len(s) for s in samples]),
                    "payload_sha256": (pa.string(), [hashlib.sha256(s).hexdigest() for s in samples]),
                    "tail_crc32": (pa.int64(), [zlib.crc32(s[-WIDTH:]) for s in samples]),
                    "media_bytes": (pa.int64(), [len(m) for m in stored]),
                    "media_sha256": (pa.string(), [hashlib.sha256(m).hexdigest() for m in stored]),
                    "feature": (pa.string(), [feature_of(s) for s in samples]),
                }
            )

    return store.select("digest", "media").mapInArrow(run, FEATURES)


def resolve(sequences: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per item of sequences (doc_id, items): doc_id, n_items, the columns of ITEM, and those of resolved (digest, ...).

    All items come: ordered by position they are the document. Media are joined by digest, which for a store of payloads
    brings the payload and for features these; position and caption stay with their item. Texts are not moved. Text items,
    and media without a digest or with one that resolved lacks, have nulls. A sequence without items gives no rows; rows
    that repeat a doc_id give theirs each; resolved has one row per digest.
    """
    kept = ("position", "kind", "text", "src", "digest", "caption")
    items = sequences.select("doc_id", F.size("items").alias("n_items"), F.explode("items").alias("item"))
    items = items.select("doc_id", "n_items", *[f"item.{c}" for c in kept])
    found = items.filter("kind = 'media'").join(resolved, "digest", "left")
    return items.filter("kind <> 'media'").unionByName(found, allowMissingColumns=True)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, then FEATURES without digest, n_items, position: the image of every row of docs, resolved through
    the page of its whole text.

    Images are written once, in the tasks that make them, to a store in the shared folder; its rows are keyed by digest and
    equal ones are equal throughout. Each is read back where it lies; of a digest's features, a few numbers, one row stays,
    and the pages' references join those. So bytes of media never move between tasks, and copies of one text never meet.

    Null and empty texts are WIDTH zero bytes. n_bytes is the caption that the page carries, n_items counts the page's
    paragraphs and its image, position is the image's place among them; a null doc_id stays null; rows that repeat a doc_id
    each get a row; an empty table gives an empty result; other columns are not read.
    """
    store = materialize(media_store(docs), "media")
    found = media_features(store).groupBy("digest").agg(*[F.min(c).alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
    rows = resolve(interleaved(media_pages(docs)), materialize(found, "media-features")).filter("kind = 'media'")
    return rows.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "position")
