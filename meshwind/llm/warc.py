"""WARC archives: write records, index them (offset, length, URL, digest), read selected ones by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, picked, shared_dir

#: Least payload bytes of a revisit, compressed bytes at which a task starts a new archive.
LEAST_REVISIT, SEGMENT = 100, 64 << 20
#: Ranges closer than GAP are read at once, up to CHUNK bytes; index rows are dealt to tasks by pieces of an archive of PIECE bytes.
GAP, CHUNK, PIECE = 256 << 10, 8 << 20, 16 << 20
#: Repeated digests (about 100 bytes each) up to which they are broadcast; beyond, pages are joined by shuffles.
BROADCAST_DIGESTS = 100_000
INDEX = "id {id}, url string, digest string, record_type string, refers_to {id}, payload_bytes long, file string, offset long, length long"


def assign_types(pages: DataFrame, *, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """(id, url, payload, digest, low): payload in UTF-8 (null: empty), low: the smallest id of a repeated payload, else null.

    Payloads under LEAST_REVISIT bytes have no low. Repeats are counted with partial aggregation, so a payload that many pages share is no hot key.
    """
    base = picked(pages, id=id_col, url=url_col, payload=payload_col).withColumn("payload", F.encode(F.coalesce("payload", F.lit("")), "UTF-8")).withColumn("digest", F.sha2("payload", 256))
    thin = base.where(F.octet_length("payload") >= LEAST_REVISIT).select("id", "digest")
    low = materialize(thin.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if low.count() <= BROADCAST_DIGESTS:
        return base.join(F.broadcast(low), "digest", "left")
    named = materialize(thin.join(low, "digest").distinct().select(F.col("id").alias("of"), F.col("digest").alias("same"), "low"))
    return base.join(named, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left").drop("of", "same")


def _record(kind: str, name: str, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{quote(name, safe='')}>", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{quote(refers, safe='')}>"]
    text = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(text) + deflate.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a gzip member that holds one record."""
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of assign_types' result into archives under ``folder``; the index, written as a table.

    Each attempt of a task writes archives of its own names; the index lists those of the attempt that counted, so lost
    and repeated attempts leave only unlisted files.
    """
    kind = typed.schema["id"].dataType.simpleString()

    def make():
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)

        name, at, sink = "", SEGMENT, None

        def close() -> None:
            if sink:
                sink.close()

        def work(batch: pa.RecordBatch) -> dict:
            nonlocal name, at, sink  # an archive goes on from one batch of a task to the next
            out = {n: [] for n in ("record_type", "refers_to", "payload_bytes", "file", "offset", "length")}
            for page, url, payload, digest, low in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "low"))):
                if at >= SEGMENT:
                    close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{path}/{name}", compression=None)
                repeat = low is not None and page != low
                data = _record("revisit" if repeat else "response", "null" if page is None else str(page), url, payload, digest, str(low) if repeat else None)
                sink.write(data)
                for k, v in zip(out, ("revisit" if repeat else "response", low if repeat else None, len(payload), name, at, len(data))):
                    out[k].append(v)
                at += len(data)
            return out | {c: batch.column(c) for c in ("id", "url", "digest")}

        work.close = close
        return work

    return materialize(arrow_map(typed.select("id", "url", "payload", "digest", "low"), make, INDEX.format(id=kind)))


def read_records(index: DataFrame, folder: str, *, payloads: bool = False) -> DataFrame:
    """Read the index rows' records: id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    Rows are dealt by archive and piece, sorted by offset, and neighbouring ranges are read at once. A response's
    payload is hashed again; a difference from its header or the index is an error. refers_to is what the record's header says.
    """
    kind = index.schema["id"].dataType.simpleString()
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-index.count() // 20_000))
    dealt = index.withColumn("piece", F.floor(F.col("offset") / PIECE)).repartition(parts, "file", "piece").sortWithinPartitions("file", "offset")

    def make():
        store, path = fs.FileSystem.from_uri(folder)

        def work(batch: pa.RecordBatch) -> dict:
            out = {n: [] for n in ("payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            where = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            digests = batch.column("digest").to_pylist()
            at = 0
            while at < len(where):
                file, start, length = where[at]
                end, to = start + length, at + 1
                while to < len(where) and where[to][0] == file and 0 <= where[to][1] - end <= GAP and where[to][1] + where[to][2] - start <= CHUNK:
                    end, to = where[to][1] + where[to][2], to + 1
                with store.open_input_file(f"{path}/{file}") as source:
                    data = source.read_at(end - start, start)
                for k in range(at, to):
                    _, offset, length = where[k]
                    headers, payload = parse_record(data[offset - start : offset - start + length])
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if digest != digests[k] or headers["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the record's digest differs")
                    out["record_type"].append(headers["warc-type"])
                    out["payload_digest"].append(digest)
                    refers = headers.get("warc-refers-to")
                    out["refers_to"].append(refers and unquote(refers.removeprefix("<urn:page:").removesuffix(">")))
                    out["payload_bytes"].append(len(payload) if headers["warc-type"] == "response" else int(headers["x-payload-length"]))
                    out["payload"].append(payload if payloads and headers["warc-type"] == "response" else None)
                at = to
            return out | {"id": batch.column("id")}

        return work

    found = arrow_map(dealt.select("id", "digest", "file", "offset", "length"), make, "id " + kind + ", payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads)
    return found.withColumn("refers_to", F.col("refers_to").cast(kind))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """The op1 digest: write all pages, index them, read every record back.

    Null html is an empty payload, a null url a record without target. Rows that repeat the smallest id of a payload are
    all responses; a null id counts as larger than others, and if all ids of a payload are null all its records are responses.
    An empty table gives no rows; other columns are ignored.
    """
    folder = shared_dir(pages.sparkSession)
    index = write_archives(assign_types(pages), folder)
    return read_records(index, folder).withColumnRenamed("id", "page_id")
