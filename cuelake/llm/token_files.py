"""Token-id files: canonical length-limited Huffman codes from global counts.

A file is a run of blocks. A block holds up to ``BLOCK_IDS`` ids of one document, starts at a byte and
can be decoded without any other; every ``STEP`` ids it notes the bit offset at which the next id starts,
so that decoding works on many places at once. Files are numbered in order of document id, and so are
the documents in them.

    file   = magic "CLTK1", code lengths (uint32 n, then n bytes), blocks, end mark
    block  = int64 document, uint32 block number, uint32 ids, uint32 payload bytes, bit offsets (uint32), payload
    end    = a block with 0xFFFFFFFF for its number of ids
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_folder, opened_file, shuffle_partitions, written_file
from .encoding import SLICE, encoder_of
from .hashing import text_slices

#: Fixed values of the file format.
MAGIC = b"CLTK1"
HEAD = struct.Struct("<qIII")
END = 0xFFFFFFFF
#: Set in the block number where a document has no id.
NO_ID = 1 << 31

LONGEST = 16
STEP = 256
BLOCK_IDS = 1 << 16


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code length of each id with a count over 0, at most ``longest`` bits (package-merge).

    Ids without a count get length 0. A single id gets one bit.
    """
    ids = np.flatnonzero(counts)
    if len(ids) <= 1:
        return np.bincount(ids, minlength=len(counts)).astype(np.uint8)
    if len(ids) > 1 << longest:
        raise ValueError(f"{len(ids)} ids don't fit into {longest} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.float64)
    # The packages of a level are pairs of neighbours of the merged list one level below. Per level it is
    # enough to know which places of the merged list are ids.
    merged, levels = weight, [np.ones(len(order), bool)]
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(order))
        merged = both[by]
    lengths, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for is_id in reversed(levels):
        n_ids = int(is_id[:take].sum())
        lengths[:n_ids] += 1
        take = 2 * (take - n_ids)
    out = np.zeros(len(counts), np.uint8)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): the lengths alone say them all."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """By the next ``longest`` bits: the id and its length."""
    ids, size = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = (1 << (longest - lengths[used].astype(np.int64))).astype(np.int64)
    filled = int(span.sum())
    ids[:filled] = np.repeat(used, span)
    size[:filled] = np.repeat(lengths[used], span)
    assert not len(used) or int(codes[used[0]]) == 0
    return ids, size


def encode_blocks(blocks: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(bit offsets, payload) of each block; all are packed at once, each from a byte of its own."""
    counts = np.array([len(b) for b in blocks], np.int64)
    if not counts.sum():
        return [(b"", b"")] * len(blocks)
    ids = np.concatenate(blocks)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    bits = np.concatenate([[0], ends])[bounds]
    block_bytes = (np.diff(bits) + 7) // 8
    byte_at = np.concatenate([[0], np.cumsum(block_bytes)])
    local = ends - size - np.repeat(bits[:-1], counts)
    at = local + np.repeat(byte_at[:-1] * 8, counts)
    # A code of at most 16 bits lies within 32 bits from a 16-bit border.
    word, shift = at >> 4, 32 - (at & 15) - size
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    total = np.bitwise_or.reduceat(value, first)
    halves = np.zeros(int(byte_at[-1] + 1) // 2 + 2, np.uint16)
    halves[word[first]] |= (total >> np.uint64(16)).astype(np.uint16)
    halves[word[first] + 1] |= (total & np.uint64(0xFFFF)).astype(np.uint16)
    data = halves.astype(">u2").tobytes()
    out = []
    for k in range(len(blocks)):
        offsets = local[bounds[k] : bounds[k + 1] : STEP].astype("<u4").tobytes()
        out.append((offsets, data[byte_at[k] : byte_at[k + 1]]))
    return out


def decode_blocks(blocks: list[tuple[int, bytes, bytes]], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of (number of ids, bit offsets, payload) blocks one after another. All places whose bit offset
    is noted go forward side by side, one id a step."""
    counts = np.array([n for n, _, _ in blocks], np.int64)
    total = int(counts.sum())
    out = np.zeros(total, np.uint32)
    if not total:
        return out
    ids, size = table
    data = b"".join(p for _, _, p in blocks) + b"\0\0\0\0"
    raw = np.frombuffer(data, np.uint8)
    window = (raw[:-3].astype(np.uint32) << 16) | (raw[1:-2].astype(np.uint32) << 8) | raw[2:-1]
    byte_at = np.concatenate([[0], np.cumsum([len(p) for _, _, p in blocks])])[:-1]
    lanes = -(-counts // STEP)
    at = np.frombuffer(b"".join(o for _, o, _ in blocks), "<u4").astype(np.int64) + np.repeat(byte_at * 8, lanes)
    lane_no = np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    place = np.repeat(np.cumsum(counts) - counts, lanes) + lane_no * STEP
    left = np.minimum(STEP, np.repeat(counts, lanes) - lane_no * STEP)
    order = np.argsort(-left, kind="stable")
    at, place, left = at[order], place[order], left[order]
    alive = np.searchsorted(-left, -np.arange(STEP), "left")
    for step in range(STEP):
        n = int(alive[step])
        if not n:
            break
        here = at[:n]
        key = (window[here >> 3] >> (8 - (here & 7)).astype(np.uint32)) & 0xFFFF
        out[place[:n] + step] = ids[key]
        here += size[key]
    return out


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ids of each document as 2-byte integers, and with each task's last row its counts of ids."""
    encoder = encoder_of(path, 2)
    counts = np.zeros(1 << 16, np.int64)
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    names = ["id", "ids", "counts", "row"]
    for batch in batches:
        for part, _, _ in text_slices(batch, size=SLICE):
            flat, borders = encoder.batch(part.column("text"), end_id)
            counts += np.bincount(flat, minlength=1 << 16)
            lists = pa.BinaryArray.from_buffers(kinds[1], len(borders) - 1, [None, pa.py_buffer((2 * borders).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.record_batch([part.column("id"), lists, pa.nulls(part.num_rows, kinds[2]), part.column("row")], names=names)
    yield pa.record_batch([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.array([zlib.compress(counts.tobytes())], kinds[2]), pa.nulls(1, kinds[3])], names=names)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int64)
    yield pa.record_batch([pa.array([zlib.compress(total.tobytes())], pa.binary())], names=["counts"])


def _packed(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes = canonical_codes(lengths)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["id", "block", "n_ids", "offsets", "payload"]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows, arrays = [], []
            for doc, ids in zip(*[part.column(c).to_pylist() for c in ("id", "ids")]):
                ids = np.frombuffer(ids, "<u2")
                for k, start in enumerate(range(0, len(ids), BLOCK_IDS)):
                    arrays.append(ids[start : start + BLOCK_IDS])
                    rows.append((doc, k, len(arrays[-1])))
            done = encode_blocks(arrays, lengths, codes)
            cols = [*zip(*rows)] + [*zip(*done)] if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _write(batches: Iterator[pa.RecordBatch], folder: str, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks in order of (document, block) to one file; yields its (file number, path, ids)."""
    part, ids = TaskContext.get().partitionId(), 0
    path = f"{folder}/tokens-{part:06d}.cltk"
    with written_file(path) as out:
        out.write(MAGIC + struct.pack("<I", len(lengths)) + lengths.tobytes())
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "block", "n_ids", "offsets", "payload")]
            whole = []
            for doc, block, n, offsets, payload in zip(*cols):
                whole.append(HEAD.pack(doc or 0, block | NO_ID if doc is None else block, n, len(payload)) + offsets + payload)
                ids += n
            out.write(b"".join(whole))
        out.write(HEAD.pack(0, 0, END, 0))
    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path], pa.string()), pa.array([ids], pa.int64())], names=["file", "path", "n_ids"])


def read_blocks(path: str) -> Iterator[tuple]:
    """First the code lengths, then (document, block number, ids, bit offsets, payload) of each block of a file."""
    import io

    with opened_file(path) as raw:
        file = io.BufferedReader(raw, 1 << 20)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        (n,) = struct.unpack("<I", file.read(4))
        yield np.frombuffer(file.read(n), np.uint8)
        while True:
            doc, block, n, size = HEAD.unpack(file.read(HEAD.size))
            if n == END:
                return
            offsets = file.read(4 * -(-n // STEP))
            yield None if block & NO_ID else doc, block & ~NO_ID, n, offsets, file.read(size)


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Files to one row per document, from the files alone; the first id's number counts all files before."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
    names = ["id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    for batch in batches:
        for path, at in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
            blocks = read_blocks(path)
            table = decode_table(next(blocks))
            held, size = [], 0
            open_doc: list | None = None  # a document whose blocks may go on: id, start, ids, crc, parts

            def rows(held=held, table=table):
                nonlocal at, open_doc
                out = []
                ids = decode_blocks([(n, o, p) for _, _, n, o, p in held], table).astype("<u4")
                place = 0
                for doc, block, n, _, _ in held:
                    part = ids[place : place + n].tobytes()
                    place += n
                    if block == 0:
                        if open_doc is not None:
                            out.append(open_doc)
                        open_doc = [doc, at, 0, 0, []]
                    open_doc[2] += n
                    open_doc[3] = zlib.crc32(part, open_doc[3])
                    if with_ids:
                        open_doc[4].append(part)
                    at += n
                held.clear()
                return out

            def table_of(found):
                cols = [[r[c] for r in found] for c in range(4)] + ([[b"".join(r[4]) for r in found]] if with_ids else [])
                return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

            for block in blocks:
                held.append(block)
                size += len(block[4])
                if size >= 2 << 20:
                    yield table_of(rows())
                    size = 0
            found = rows()
            if open_doc is not None:
                found.append(open_doc)
                open_doc = None
            yield table_of(found)


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the ids of all texts in ascending order of document id and return the manifest (file, path, n_ids).

    A document is the tokenizer's ids of its text and then ``end_id``; null and empty texts are the end
    id alone. Ids must be below 65,536. Rows that repeat a document id are documents of their own, one
    after another in an order that their ids of tokens give; documents without an id come first and are
    read back without one. An empty table gives files without documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    tokens = materialise(rows.mapInArrow(lambda b: _tokens(b, tokenizer, end_id), "id long, ids binary, counts binary, row long"), "token-ids")
    counts = tokens.where("counts is not null").select("counts")
    # One row of 65,536 counts a task, added up in a tree of tasks before the driver sees one row.
    n = counts.count()
    while n > 1:
        n = -(-n // 32)
        counts = counts.repartition(n).mapInArrow(_sum_counts, "counts binary")
    first = counts.first()
    total = np.frombuffer(zlib.decompress(first[0]), np.int64) if first else np.zeros(1 << 16, np.int64)
    lengths = code_lengths(total)
    size = int((total * lengths).sum()) // 8
    ids = tokens.where("counts is null").select("id", "ids", "row", F.xxhash64("ids").alias("mark"))
    files = max(1, min(shuffle_partitions(spark), size // (1 << 20) + 1), size // file_bytes + 1)
    folder = new_folder(spark, "token-files")
    # Ranges of documents in their order are files; an id on very many rows is parted too. The ids travel, the codes are made where they are written.
    dealt = ids.repartitionByRange(files, "id", "mark", "row").sortWithinPartitions("id", "mark", "row")
    written = dealt.mapInArrow(lambda b: _write(_packed(b, lengths), folder, lengths), "file int, path string, n_ids long")
    return materialise(written, "token-manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens (with the
    end id), ids_crc32 (of the ids as 4-byte little-endian integers), and on wish ids.

    The manifest has one row per file; the sums of ids before each file are made on the driver.
    """
    spark, before, rows = manifest.sparkSession, 0, []
    for row in sorted(manifest.collect(), key=lambda r: r["file"]):
        rows.append((row["path"], before))
        before += row["n_ids"]
    files = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))
    kinds = "id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.mapInArrow(lambda b: _read(b, with_ids), kinds)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest).withColumnRenamed("id", "doc_id")
