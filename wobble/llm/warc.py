"""WARC archives, index first (op 2).

:func:`write_archives` writes a gzip member per record and returns the index: file, offset, length, URL and
digest of each record. :func:`read_records` takes any selection of index rows, sorts them by file and offset,
cuts each file's list into spans, joins ranges that lie close into one read, and parses the records.

Of records with equal payloads (SHA-1 and length) of at least ``min_bytes`` bytes, that with the largest page id
is a ``response``; the others are ``revisit`` records with no body of their own that refer to it. Which record
that is comes from one row per digest, added up before the shuffle, so a payload that a third of all pages share
is no hot key for the rows themselves (the join back is one that Spark can split).

Defined results: a null payload is an empty one; null ids and URLs are written as absent and read back as null; a
null id is below every other, and of equal payloads with only null ids, or several rows with the largest id, all
are responses; other columns are ignored; an empty table gives no archive and an empty result. A task writes to
a file of its own attempt; only attempts whose rows reached the stored index count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import opened
from .shared import bounded_batches, shared_dir, stored, text_of

MIN_BYTES, GAP, SPAN = 1000, 64 << 10, 8 << 20
#: Archive bytes that a reading task gets at most, about, and at least if there are more cores than tasks.
TASK, LEAST = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Each page's digest, length, record type and the page it refers to, with the payload."""
    body = F.encode(text_of(text_col), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        body.alias("payload"),
        F.sha1(body).alias("payload_digest"),
        F.length(body).cast("bigint").alias("payload_bytes"),
    )
    slim = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    shared = stored(slim.agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-shared")
    shared = shared.withColumnsRenamed({"payload_digest": "d", "payload_bytes": "b"})
    rows = rows.join(shared, (rows.payload_digest == shared.d) & (rows.payload_bytes == shared.b), "left").drop("d", "b")
    again = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("largest")).alias("refers_to"),
    )


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{digest}')}>"


def _record(r: dict) -> bytes:
    """One record: WARC headers, then an HTTP response head and, but for a revisit, the payload."""
    digest = base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
    revisit = r["record_type"] == "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r["payload_bytes"]
    body += b"" if revisit else r["payload"]
    head = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {_record_id(r['page_id'], r['payload_digest'])}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(r['url'])}"] if r["url"] is not None else []
    head += [f"X-Page-ID: {r['page_id']}"] if r["page_id"] is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {r['payload_bytes']}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: {_record_id(r['refers_to'], r['payload_digest'])}", f"X-Refers-To-Page-ID: {r['refers_to']}"]
    head += [f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(url: str) -> str:
    """A URL without line breaks, which would end its header."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def write_archives(pages: DataFrame, out: str, min_bytes: int = MIN_BYTES, **columns) -> DataFrame:
    """Writes the archives below ``out`` and returns the stored index, a row per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, store, sink, at, index = f"{out}/{uuid.uuid4().hex}.warc.gz", None, None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                store, path = opened(file)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(path, compression=None)
            offsets, lengths = [], []
            for i in range(0, batch.num_rows, 64):
                for r in batch.slice(i, 64).to_pylist():
                    data = gzip.compress(_record(r), 5, mtime=0)
                    sink.write(data)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
            kept = [batch.column(c) for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            index.append(pa.record_batch([*kept, pa.array([file] * batch.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=NAMES))
        if sink is not None:
            sink.close()
        yield from index  # only once the archive is whole

    return stored(bounded_batches(planned(pages, min_bytes, **columns)).mapInArrow(write, INDEX), "warc-index")


NAMES = [x.split()[0] for x in INDEX.split(", ")]


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the index rows ``selected``, read from the archives.

    Columns: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``. Lengths and digests of
    responses are those of the bytes read, and are held against the headers; those of revisits are their headers'.
    """
    rows = selected.select("file", "offset", "length")
    # index rows are tiny, so tasks are counted by the bytes that they will read
    total = rows.agg(F.sum("length")).first()[0] or 0
    cores = selected.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-total // TASK), min(cores, total // LEAST))
    rows = rows.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    kinds = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for file, first, last, parts in spans(batch.to_pylist()):
                if file != name:
                    store, path = opened(file)
                    name, source = file, store.open_input_file(path)
                data = source.read_at(last - first, first)
                found = [parsed(zlib.decompress(data[a - first : a - first + n], 31)) for a, n in parts]
                if not with_payload:
                    found = [r | {"payload": None} for r in found]
                yield pa.RecordBatch.from_pylist(found, schema=SCHEMA)

    return bounded_batches(rows).mapInArrow(read, kinds)


SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def spans(rows: list[dict], gap: int = GAP, most: int = SPAN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads that cover sorted ranges: file, first byte, end, and the ranges. Ranges up to ``gap`` apart share a read of up to ``most`` bytes."""
    file, first, last, parts = None, 0, 0, []
    for r in rows:
        a, n = r["offset"], r["length"]
        if parts and (r["file"] != file or a > last + gap or max(last, a + n) - first > most):
            yield file, first, last, parts
            parts = []
        if not parts:
            file, first, last = r["file"], a, a
        parts.append((a, n))
        last = max(last, a + n)
    if parts:
        yield file, first, last, parts


def parsed(record: bytes) -> dict:
    """The fields of one record; raises ValueError where its parts disagree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    body = rest[: int(h["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    payload = body.partition(b"\r\n\r\n")[2]
    digest, n = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex(), int(h["x-payload-length"])
    if h["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != n:
            raise ValueError("a payload does not have its record's digest")
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    number = lambda k: int(h[k]) if k in h else None
    return {
        "page_id": number("x-page-id"),
        "url": h.get("warc-target-uri"),
        "record_type": h["warc-type"],
        "payload_bytes": n,
        "payload_digest": digest,
        "refers_to": number("x-refers-to-page-id"),
        "payload": payload if h["warc-type"] == "response" else None,
    }


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, **columns) -> DataFrame:
    """Writes every page to archives in the shared folder and reads every record back through the index."""
    index = write_archives(pages, shared_dir(pages.sparkSession, "warc"), min_bytes, **columns)
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
