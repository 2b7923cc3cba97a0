"""WARC archives over a chunked record table.

A page becomes a payload of chunks, rows of (record, chunk number, bytes), so that no step holds more
than a chunk of an oversized payload. Digests are carried along chunk by chunk, when archives are
written as when they are read. Each archive is one gzip member per record, written to the shared
folder under a temporary name and renamed when whole; a repeated task writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, materialise, new_folder, opened_file, scratch, shuffle_partitions, written_file

CHUNK = 1 << 20
#: Fixed value: the date written to every record, so that a repeated task writes the same bytes.
DATE = "2020-01-01T00:00:00Z"
_FIELDS = {
    "row": pa.int64(), "record_id": pa.int64(), "target": pa.string(), "chunk_no": pa.int32(), "last": pa.bool_(), "bytes": pa.binary(),
    "digest": pa.string(), "payload_bytes": pa.int64(),
}
_CHUNKS = "row long, record_id long, target string, chunk_no int, last boolean, bytes binary, digest string, payload_bytes long"


def base32_digest(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _cut(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Payloads to chunk rows, a few chunks a batch. The digest goes along from chunk to chunk; the last one has it and the size."""
    rows: dict[str, list] = {c: [] for c in _FIELDS}

    def flushed() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(rows[c], t) for c, t in _FIELDS.items()], names=list(_FIELDS))
        for v in rows.values():
            v.clear()
        return out

    held = 0
    for batch in batches:
        for i in range(batch.num_rows):
            row, record_id, target = (batch.column(c)[i].as_py() for c in ("row", "record_id", "target"))
            html = batch.column("html")[i]
            whole = html.as_buffer() if html.is_valid else None
            size, sha = (whole.size if whole is not None else 0), hashlib.sha1()
            chunks = max(1, -(-size // chunk))
            for k in range(chunks):
                piece = whole.slice(k * chunk, min(chunk, size - k * chunk)).to_pybytes() if size else b""
                sha.update(piece)
                last = k == chunks - 1
                values = (row, record_id, target, k, last, piece, base32_digest(sha.digest()) if last else None, size if last else None)
                for c, v in zip(_FIELDS, values):
                    rows[c].append(v)
                held += len(piece)
                if held >= 4 * chunk:
                    yield flushed()
                    held = 0
    yield flushed()


def _header(record_id: int | None, row: dict, length: int) -> bytes:
    lines = [
        "WARC/1.0", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{row['digest']}", f"X-Payload-Bytes: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if row["target"]:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%" + format(ord(c), "02X") for c in row["target"]))
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def _write(chunks: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order of (row, chunk) to archive files; yields (path, records). The names come
    from the partition's number, so that a repeated task writes the same files."""
    part = TaskContext.get().partitionId()
    done: list[tuple[str, int]] = []
    file = out = packer = None
    count = size = 0

    def put(data: bytes) -> None:
        nonlocal size
        size += out.write(data) or len(data)

    at = None
    for batch in chunks:
        for row in batch.to_pylist():
            if (row["row"], row["chunk_no"]) != (at or (row["row"], 0)):
                raise ValueError(f"the chunks of record {row['record_id']} don't lie side by side")
            at = None if row["last"] else (row["row"], row["chunk_no"] + 1)
            if file is None:
                path, count, size = f"{folder}/pages-{part:06d}-{len(done):04d}.warc.gz", 0, 0
                file = written_file(path)
                out = file.__enter__()
            if row["chunk_no"] == 0:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                put(packer.compress(_header(row["record_id"], row, row["payload_bytes"] if row["record_type"] == "response" else 0)))
                count += 1
            put(packer.compress(row["bytes"]))
            if row["last"]:
                put(packer.compress(b"\r\n\r\n") + packer.flush())
                if size >= archive_bytes:
                    file.__exit__(None, None, None)
                    done.append((path, count))
                    file = None
    if file is not None:
        file.__exit__(None, None, None)
        done.append((path, count))
    yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])


def read_records(path: str, chunk: int = CHUNK) -> Iterator[tuple[dict, int, bytes, bool]]:
    """(header, chunk number, bytes, last) of every record of an archive, holding one chunk at a time."""
    with opened_file(path) as file:
        data, unzip = b"", zlib.decompressobj(31)
        ready = bytearray()

        def more() -> bool:
            """Unpack some more; False at the end of the file."""
            nonlocal data, unzip
            while True:
                if unzip.eof:
                    data, unzip = unzip.unused_data or data, zlib.decompressobj(31)
                    if not data:
                        data = file.read(chunk)
                        if not data:
                            return False
                elif not data:
                    data = file.read(chunk)
                    if not data:
                        return False
                got = unzip.decompress(data, chunk)
                data = unzip.unconsumed_tail if not unzip.eof else b""
                if unzip.eof:
                    data = unzip.unused_data
                    unzip = zlib.decompressobj(31)
                if got:
                    ready.extend(got)
                    return True

        while True:
            while (end := ready.find(b"\r\n\r\n")) < 0:
                if not more():
                    if ready.strip():
                        raise ValueError(f"{path} ends within a record")
                    return
            head = dict(x.split(": ", 1) for x in bytes(ready[:end]).decode().split("\r\n")[1:])
            del ready[: end + 4]
            left, k = int(head["Content-Length"]), 0
            while True:
                while len(ready) < min(left, chunk):
                    if not more():
                        raise ValueError(f"{path} ends within a record")
                take = min(left, chunk)
                left -= take
                yield head, k, bytes(ready[:take]), left == 0
                del ready[:take]
                k += 1
                if left == 0:
                    break
            while len(ready) < 4:
                if not more():
                    raise ValueError(f"{path} ends within a record")
            if ready[:4] != b"\r\n\r\n":
                raise ValueError(f"a record of {path} has no proper end")
            del ready[:4]


def _urn_id(value: str | None) -> int | None:
    number = value.strip("<>").rsplit(":", 1)[1] if value else "None"
    return None if number == "None" else int(number)


_RECORDS = {
    "record_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "target": pa.string(),
    "stored_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive paths to one row per record: digest and size come from the chunks as they pass."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows: list[tuple] = []
            sha, size = hashlib.sha1(), 0
            for head, _, data, last in read_records(path):
                sha.update(data)
                size += len(data)
                if not last:
                    continue
                digest, response = base32_digest(sha.digest()), head["WARC-Type"] == "response"
                if response and (head["WARC-Payload-Digest"] != f"sha1:{digest}" or head["X-Payload-Bytes"] != str(size)):
                    raise ValueError(f"record {head['WARC-Record-ID']} of {path} is damaged")
                full = (size, digest) if response else (int(head["X-Payload-Bytes"]), head["WARC-Payload-Digest"].removeprefix("sha1:"))
                rows.append((_urn_id(head["WARC-Record-ID"]), head["WARC-Type"], _urn_id(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), size, *full))
                sha, size = hashlib.sha1(), 0
            columns = zip(*rows) if rows else [()] * len(_RECORDS)
            yield pa.record_batch([pa.array(list(v), t) for v, t in zip(columns, _RECORDS.values())], names=list(_RECORDS))


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = 64 << 20, chunk: int = CHUNK) -> DataFrame:
    """Write one WARC record per row and return the manifest (path, records) of the archives.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id
    is a response and the others are revisits of it; smaller payloads are all responses. Null html is
    an empty payload, a null url leaves out the target. A row that repeats an id gets a record of its
    own, with its own payload, and all records of the id that survives are responses, as are those
    without an id. An empty table gives no archive, a page with columns of other names none of its columns in it.
    Payloads are cut into a table of chunk rows (``row``, ``chunk_no``) where they are read, and travel once; from then on no step
    holds more of a payload than a few chunks, however long it is. Who revisits whom is told from the last chunks' digests and sizes alone.
    """
    spark = pages.sparkSession
    parts = shuffle_partitions(spark)
    with scratch(spark):
        base = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("target"), F.col(html_col).cast("string").alias("html"))
        chunks = base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda b: _cut(b, chunk), _CHUNKS)
        table = materialise(chunks, "warc-chunks")
        found = materialise(table.where("last").select("row", "record_id", "digest", "payload_bytes"), "warc-digests")
        firsts = found.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest", "payload_bytes").agg(F.min("record_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        # One row a payload on that side: adaptive execution can split the records of one that a third of the pages share.
        plan = found.join(firsts.drop("n"), ["digest", "payload_bytes"], "left").withColumn("revisit", F.coalesce(F.col("first") < F.col("record_id"), F.lit(False)))
        plan = plan.select(
            "row", "digest", "payload_bytes", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first")).alias("refers_to")
        )
        # A record's chunks are brought together here, whatever way the join then goes.
        joined = table.drop("digest", "payload_bytes").repartition(parts, "row").join(plan, "row").where("record_type = 'response' or chunk_no = 0")
        revisit = F.col("record_type") == "revisit"
        joined = joined.withColumn("bytes", F.when(~revisit, F.col("bytes")).otherwise(F.lit(b""))).withColumn("last", F.col("last") | revisit)
        folder = new_folder(spark, "warc")
        manifest = joined.sortWithinPartitions("row", "chunk_no").mapInArrow(lambda b: _write(b, folder, archive_bytes), "path string, records long")
        return keep(materialise(manifest, "warc-manifest"))


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives: record_id, record_type, refers_to, target, stored_bytes,
    payload_bytes, payload_digest (bare base32 SHA-1 of the full payload). Damaged records raise."""
    paths = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)))
    return paths.mapInArrow(_read, "record_id long, record_type string, refers_to long, target string, stored_bytes long, payload_bytes long, payload_digest string")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(manifest).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
