"""WARC archives written and read as a chunked record table: no record is held whole."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import discard, materialise, scratch

CHUNK_BYTES = 1 << 20
RECORD = "urn:record:page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record_chunks(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int, chunk_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (page, chunk number) of each record that is to be written: payload chunks for responses, one empty chunk for revisits.

    Also the written tables that they are read from.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(bytearray())) if dict(pages.dtypes)[payload_col] == "string" else F.coalesce(F.col(payload_col), F.lit(bytearray()))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest")
    )
    # Revisits are found on ids and digests alone; payloads then meet their marks by page, where no key is hot.
    slim = materialise(rows.select("page_id", "digest", "n"), "page_digests")
    same = slim.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    # Written before the join, so that the planner may split a payload that a third of all pages have.
    same = materialise(same, "shared_payloads")
    revisits = slim.join(same.hint("merge"), ["digest", "n"]).where("refers_to != page_id").select("page_id", "digest", "refers_to").distinct()
    marked = rows.join(revisits.hint("merge"), ["page_id", "digest"], "left")
    chunks = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("n") / chunk_bytes), F.lit(1))).cast("int")
    data: Column = F.when(F.col("refers_to").isNotNull(), F.lit(bytearray())).otherwise(F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return marked.select("*", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk_no")).select("page_id", "url", "n", "digest", "refers_to", "chunk_no", data.alias("data")), [slim, same]


def _head(page_id: int | None, url: str | None, n: int, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyspark import TaskContext

    store, root = fs.FileSystem.from_uri(folder)
    task = TaskContext.get()
    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
    out, gz, records = None, None, 0
    for batch in batches:
        columns = [batch.column(i) for i in range(6)]
        data = batch.column(6)
        for i in range(batch.num_rows):
            page_id, url, n, digest, refers_to, chunk_no = (c[i].as_py() for c in columns)
            if chunk_no == 0:
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                if gz is not None:
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(gz.compress(_head(page_id, url, n, _base32(bytes.fromhex(digest)), refers_to)))
                records += 1
            out.write(gz.compress(data[i].as_buffer()))
    if out is not None:
        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [records]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Write one WARC record per row and return the manifest: ``folder``, ``path``, ``records`` of each archive.

    Of rows with equal payloads (length and SHA-1) of at least ``min_bytes`` the
    one with the largest id is the response and the others are revisits of it;
    all smaller ones are responses. Each task streams its chunk rows into one
    archive of gzip members, under a name of its attempt; archives of lost
    attempts are in no manifest. The folder is in the cluster's shared one.

    Null payloads are empty, a null url has no target header, rows that repeat
    an id and payload are all responses, an empty table gives no archives,
    other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    chunks, inner = record_chunks(pages, id_col, url_col, payload_col, min_bytes, chunk_bytes)
    written = chunks.mapInArrow(lambda b: _write(b, folder), "path string, records bigint")
    manifest = materialise(written.withColumn("folder", F.lit(folder)), "manifest")
    discard(*inner)
    return manifest


CHUNKS = "page_id bigint, record_type string, url string, refers_to bigint, payload_bytes bigint, chunk_no int, is_last boolean, bytes_so_far bigint, digest_so_far string, data binary"


def _page(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(RECORD)
    return int(text) if text else None


def _fields(stream) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, and bytes of a header block."""
    first, size, fields = stream.readline(), 0, {}
    size = len(first)
    while True:
        line = stream.readline()
        size += len(line)
        if line in (b"\r\n", b""):
            return first.decode().strip(), fields, size
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()


def records(stream, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows (see CHUNKS) of an uncompressed archive stream; raises if a payload differs from its digest."""
    while True:
        first, head, _ = _fields(stream)
        if not first:
            return
        left = int(head["content-length"])
        _, http, size = _fields(stream)
        left -= size
        declared = head["warc-payload-digest"].removeprefix("sha1:")
        base = (_page(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"), _page(head.get("warc-refers-to")), int(http["content-length"]))
        if head["warc-type"] == "revisit":
            yield (*base, 0, True, 0, declared, b"")
        else:
            sha, done, k = hashlib.sha1(), 0, 0
            while left or k == 0:
                data = stream.read(min(chunk_bytes, left))
                if len(data) < min(chunk_bytes, left):
                    raise ValueError("the archive ends within a record")
                sha.update(data)
                left -= len(data)
                done += len(data)
                digest = _base32(sha.copy().digest())
                if not left and (digest != declared or done != base[-1]):
                    raise ValueError(f"record of page {base[0]} differs from its digest or length")
                yield (*base, k, not left, done, digest, data)
                k += 1
        stream.readline(), stream.readline()


def _read(batches: Iterator[pa.RecordBatch], chunk_bytes: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    import gzip

    from pyarrow import fs

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for folder, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, _ = fs.FileSystem.from_uri(folder)
            with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
                rows, size = [], 0
                for row in records(stream, chunk_bytes):
                    rows.append(row if with_data else (*row[:-1], None))
                    size += len(row[-1]) if with_data else 64
                    if size >= 8 << 20 or len(rows) >= 4096:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in a manifest: one row per record and chunk number, see CHUNKS.

    ``digest_so_far`` is the base32 SHA-1 of the payload up to the chunk's end,
    so the last chunk has that of all of it; it is compared with the record's
    header. Revisits have one empty chunk with the header's digest.
    ``payload_bytes`` comes from the stored HTTP head. Without ``with_data``
    payload bytes are digested and let go.
    """
    files = manifest.select("folder", "path")
    n = max(1, files.count())
    return files.repartition(n, "path").mapInArrow(lambda b: _read(b, chunk_bytes, with_data), CHUNKS)


def dangling_revisits(chunks: DataFrame) -> DataFrame:
    """Revisits whose response isn't in the table or has another digest."""
    last = chunks.where("is_last")
    wanted = last.where("record_type = 'revisit'").select("refers_to", "digest_so_far").distinct()
    there = last.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "digest_so_far")
    return wanted.join(there, ["refers_to", "digest_so_far"], "left_anti")
