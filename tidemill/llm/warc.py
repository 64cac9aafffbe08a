"""WARC archives: a table of payload chunks, archives written from it and read back as such a table."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, to_batch

CHUNK = 1 << 18
#: Shares that copies of one payload are dealt to while their responses are found.
SALTS = 64
INDEX = "path string, record long, begin long, end long"
CHUNKS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk int, bytes_so_far long, sha1_so_far string, last boolean, data binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_URN = "<urn:x-page:%s>"


def records(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every row of pages.

    Of equal payloads of at least min_revisit bytes the row with the largest page_id is the response and the others, whose
    payload is null here, revisit it. Copies are counted by (digest, salt) first, so no task gets all copies of a payload,
    and only digests move to find the response; payloads move once. A null html is an empty payload; a null page_id is a
    record that is never another's response; rows that repeat a page_id each get a record; no rows give none; other columns
    are not read.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    parts = rows.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest", "payload_bytes", "salt").agg(F.max("page_id").alias("page"), F.count("*").alias("n"))
    totals = parts.groupBy("payload_digest", "payload_bytes").agg(F.max("page").alias("response"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    salted = parts.drop("n", "page").join(totals, ["payload_digest", "payload_bytes"])
    rows = rows.join(salted, ["payload_digest", "payload_bytes", "salt"], "left")
    revisit = F.coalesce(F.col("response") != F.col("page_id"), F.col("response").isNotNull())
    return rows.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"),
    )


def chunk_table(found: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """records with the payload as rows (chunk, n_chunks, data) of at most chunk_bytes; a revisit has one empty chunk.

    The chunks of a record follow one another in one partition. An empty or null payload has one empty chunk, so no record is
    left out; no records give no rows.
    """
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("payload"), F.lit(0)) / chunk_bytes)).cast("int")
    rows = found.select("*", n.alias("n_chunks")).select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    data: Column = F.substring(F.col("payload"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    return rows.withColumn("data", F.coalesce(data, F.lit(b""))).drop("payload")


def _header(r: dict) -> bytes:
    """The record's header and, of a response, its HTTP head; all lengths and digests are known before the payload is."""
    page = r["page_id"]
    block = len(_HTTP) + (r["payload_bytes"] if r["record_type"] == "response" else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: {_URN % ('null' if page is None else page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(c for c in r['url'] or '' if c >= ' ')}",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
        f"X-Payload-Length: {r['payload_bytes']}",
    ]
    if r["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_URN % r['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode() + _HTTP


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes the chunk table to archives in folder, one or more a partition; returns the written index: path, record, begin, end.

    Each record is a gzip member of its own, so begin and end are offsets in the file and any record can be read alone. A chunk is in memory at a time, with the digest of what has passed, which must end at the one in the header. Files are
    named by attempt, and the index has only those of attempts that ended, so tasks may be lost and run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out, path, begin, digest, record, packer = None, "", 0, None, 0, None
        for batch in batches:
            index = []
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["chunk"] == 0:
                    if out is None or out.tell() >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        path, out = f"{folder}/{name}", store.open_output_stream(f"{at}/{name}", compression=None)
                    begin, digest, packer = out.tell(), hashlib.sha1(), zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(packer.compress(_header(r)))
                digest.update(r["data"])
                out.write(packer.compress(r["data"]))
                if r["chunk"] == r["n_chunks"] - 1:
                    if r["record_type"] == "response" and digest.hexdigest() != r["payload_digest"]:
                        raise ValueError(f"page {r['page_id']}: its chunks do not have its digest")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    index.append((path, record, begin, out.tell()))
                    record += 1
            yield to_batch({c: (t, [x[k] for x in index]) for k, (c, t) in enumerate([("path", pa.string()), ("record", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])})
        if out is not None:
            out.close()

    return materialize(chunks.mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame, *, chunk_bytes: int = CHUNK, span_bytes: int = 16 << 20, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in index, each row with bytes and SHA-1 of the record's payload so far.

    Archives are read in spans of whole records of about span_bytes, any span by any task, chunk by chunk. The digest and
    length of a response are those of the bytes read; a revisit's are its header's.
    """
    spans = index.groupBy("path", F.expr(f"begin div {span_bytes}").alias("span")).agg(F.min("begin").alias("begin"), F.max("end").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(s["path"])
                with store.open_input_file(at) as f:
                    yield from _span(f, s["begin"], s["end"], chunk_bytes, with_data)

    return spans.repartition("path", "span").mapInArrow(run, CHUNKS)


class _Member:
    """The bytes of one gzip member of a file, decompressed as they are read."""

    def __init__(self, f, begin: int):
        f.seek(begin)
        self.f, self.z, self.held = f, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while not self.held and not self.z.eof:
            data = self.z.unconsumed_tail or self.f.read(1 << 16)
            self.held = self.z.decompress(data, CHUNK)
            if not data and not self.held:
                raise ValueError("an archive ends within a record")
        return bool(self.held)

    def read(self, n: int) -> bytes:
        out = []
        while n and self._more():
            out.append(self.held[:n])
            self.held, n = self.held[n:], n - len(out[-1])
        return b"".join(out)

    def lines(self) -> tuple[list[str], int]:
        """The lines up to an empty one, and the bytes they take with it."""
        head = b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError("an archive ends within a header")
            head, self.held = head + self.held, b""
        self.held = head[end + 4 :]
        return head[:end].decode().split("\r\n"), end + 4

    def end(self) -> int:
        """The offset behind the member in the file."""
        while self._more():
            self.held = b""
        return self.f.tell() - len(self.z.unused_data)


def _span(f, begin: int, end: int, chunk_bytes: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    rows, held = [], 0
    while begin < end:
        member = _Member(f, begin)
        head = dict(line.split(": ", 1) for line in member.lines()[0][1:])
        left = int(head["Content-Length"]) - member.lines()[1]  # less the HTTP head
        page = head["WARC-Record-ID"][len("<urn:x-page:") : -1]
        page = None if page == "null" else int(page)
        kind, chunk, done, digest = head["WARC-Type"], 0, 0, hashlib.sha1()
        refers = int(head["WARC-Refers-To"][len("<urn:x-page:") : -1]) if kind == "revisit" else None
        while True:
            data = member.read(min(chunk_bytes, left - done))
            if len(data) < min(chunk_bytes, left - done):
                raise ValueError("an archive ends within a record")
            digest.update(data)
            done += len(data)
            last = done == left
            full = digest.hexdigest()
            size, sha = (done, full) if kind == "response" else (int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"))
            rows.append((page, kind, refers, size if last else None, sha if last else None, chunk, done, full, last, data if with_data else None))
            held += len(data)
            if held >= 8 * chunk_bytes or len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)
                rows, held = [], 0
            if last:
                break
            chunk += 1
        begin = member.end()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)


def archive_pages(pages: DataFrame, *, min_revisit: int = 1000, chunk_bytes: int = CHUNK) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder; returns the index that read_archives takes.

    Null html is an empty payload; a null url is empty; a null page_id is a record of its own, never a response that others
    refer to unless all copies lack an id (then all are responses' copies that refer to none); rows that repeat a page_id
    are records of their own; an empty table makes no archive; other columns are not read.
    """
    chunks = chunk_table(records(pages, min_revisit), chunk_bytes)
    return write_archives(chunks, new_path(pages.sparkSession, "warc"))


def page_digests(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from the last chunk of each record: a row for each,
    null and repeated page_ids and empty payloads included; no chunks give no rows."""
    return chunks.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
