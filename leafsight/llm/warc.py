"""WARC archives with an index written first, and coalesced range reads by that index.

Archives are written by the tasks into a folder of a store that pyarrow reaches (a shared file
system, HDFS, an object store): one gzip member per record, and for each record a row of the
index with the file, offset, length, URL and digests. Reading takes rows of the index, sorts
them by file and offset, joins neighbours into one range read each and takes the records apart.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, without

MIN_REVISIT = 100
ROLL = 256 << 20
RANGE = 8 << 20
GAP = 64 << 10
DATE = "2020-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string, refers_to long"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record. A response holds an HTTP header and the payload, a revisit the HTTP header only; both say the payload's size and digest."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        # a URL can't hold these; they would end the field
        *([f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record, with its payload (None for a revisit) and the payload's length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {raw[:40]!r}")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return out | {"payload": None if out["warc-type"] == "revisit" else payload, "payload_bytes": length}


def plan_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, digest, bytes, refers_to) of rows whose payload, of `least` bytes or more, is that of a row with a smaller page_id."""
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("b"))
    slim = slim.select("page_id", "url", F.sha2("b", 256).alias("digest"), F.octet_length("b").cast("long").alias("bytes")).where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select(F.col("digest").alias("f_digest"), "refers_to")
    return slim.join(first, F.col("digest") == F.col("f_digest")).where("page_id > refers_to").select("page_id", "url", "digest", "bytes", "refers_to")


def write(pages: DataFrame, folder: str, least: int = MIN_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as archives below `folder`; the index, as a table in `folder`/index.

    A null html is an empty payload, a null URL leaves its field out. Among equal payloads of
    `least` bytes or more the smallest page_id is the response; rows with that same id are
    responses too, rows without an id are responses always. A row is told by its id and payload
    together: each row gives one record, also where an id has several payloads. Of revisits only
    ids and digests move; the payloads of responses stay where they are read, but for those that
    the filter of revisits can't tell apart. Other columns of pages are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    revisits = settle(plan_revisits(rows, least), "revisits")
    key = F.concat_ws(":", F.col("page_id").cast("string"), F.sha2(F.coalesce("html", F.lit("")), 256))
    # smaller payloads and rows without an id have no key: they are never revisits
    key = F.when(F.col("page_id").isNotNull() & (F.octet_length(F.coalesce("html", F.lit(""))) >= least), key)
    gone = revisits.select(F.concat_ws(":", F.col("page_id").cast("string"), "digest").alias("k")).distinct()
    none = F.lit(None)
    kept = without(rows, key, gone).select("page_id", "url", "html", none.cast("string").alias("digest"), none.cast("long").alias("bytes"), none.cast("long").alias("refers_to"))
    rows = kept.unionByName(revisits.select("page_id", "url", none.cast("string").alias("html"), "digest", "bytes", "refers_to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page_id, url, html, digest, size, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        # names are of this attempt alone: a rerun never touches what another has written
                        name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(f"{base}/archive", recursive=True)
                        out = store.open_output_stream(f"{base}/archive/{name}", compression=None)
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    if refers_to is None:
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, payload, size, digest, refers_to)) + packer.flush()
                    out.write(raw)
                    found.append((page_id, url, name, at, len(raw), digest, size, "response" if refers_to is None else "revisit", refers_to))
                    at += len(raw)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _INDEX_TYPES, strict=True)], _INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(put, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]


def _ranges(spots: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """Neighbours of one file joined while their gap is at most GAP and the range at most RANGE."""
    name, start, stop, held = None, 0, 0, []
    for i, (f, at, n) in enumerate(spots):
        if held and (f != name or at - stop > GAP or at + n - start > RANGE):
            yield name, start, stop - start, held
            held = []
        if not held:
            name, start = f, at
        stop = at + n
        held.append(i)
    if held:
        yield name, start, stop - start, held


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that rows of the index name, read back: PAGES, and the payload if asked for.

    Payloads of responses are digested anew; one that differs from its field is an error.
    """
    chunk = F.floor(F.col("offset") / RANGE)
    picked = index.select("file", "offset", "length", chunk.alias("chunk")).repartition(F.col("file"), F.col("chunk")).sortWithinPartitions("file", "offset")
    schema = PAGES + (", payload binary" if payloads else "")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        handle, opened = None, None
        for batch in batches:
            spots = list(zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True))
            for name, start, n, held in _ranges(spots):
                if name != opened:
                    handle, opened = store.open_input_file(f"{base}/archive/{name}"), name
                raw = handle.read_at(n, start)
                found = []
                for i in held:
                    x = parse(zlib.decompress(raw[spots[i][1] - start : spots[i][1] - start + spots[i][2]], 31))
                    digest = x["warc-payload-digest"].removeprefix("sha256:")
                    if x["payload"] is not None and hashlib.sha256(x["payload"]).hexdigest() != digest:
                        raise ValueError(f"{name}, {spots[i][1]}: the payload differs from its digest")
                    ids = [x.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to")]
                    found.append((*[int(ids[0]) if ids[0] else None, x["payload_bytes"], digest, x["warc-type"], int(ids[1]) if ids[1] else None], *([x["payload"]] if payloads else [])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [s.split()[0] for s in schema.split(", ")])

    return picked.mapInArrow(get, schema)


def remove(folder: str) -> None:
    """Delete archives and index."""
    store, base = fs.FileSystem.from_uri(folder)
    store.delete_dir(os.path.normpath(base))
