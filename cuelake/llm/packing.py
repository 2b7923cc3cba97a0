"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing takes pieces in order of falling length and puts each into the fullest sequence
that still has room. What it does depends on lengths only, and pieces of one length are alike, so the
plan is made from the count of pieces of each length: a segment tree over remaining capacities finds
the tightest class of open sequences, and a whole stretch of equal pieces fills equal sequences at
once. The plan has one row per stretch and is bounded by the capacity, not by the corpus. Pieces then
find their place by their rank among the pieces of their length, in parallel.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, materialise, shuffle_partitions
from .encoding import SLICE, encoder_of
from .hashing import text_slices

CAPACITY = 4096
END_ID = 1


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: how many open sequences have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` that some open sequence has left."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for ``counts`` pieces of each length.

    Returns rows (length, first rank, first sequence, pieces per sequence, offset of the first piece) in
    order of (length, first rank), and the number of sequences. A row tells that the pieces of that
    length from that rank on fill sequences one after another, so many in each.
    """
    tree, open_at, rows, sequences = CapacityTree(capacity), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit into {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_at[room].pop()
                tree.add(room, -n)
            each = room // length
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
            rows.append((length, rank, first, each, capacity - room))
            done = full * each + rest
            rank, left = rank + done, left - done
            for after, start, m in ((room - each * length, first, full), (room - rest * length, first + full, 1 if rest else 0), (room, first + full + (1 if rest else 0), n - full - (1 if rest else 0))):
                if m:
                    open_at[after].append((start, m))
                    tree.add(after, m)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequences


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path, 4)
    for batch in batches:
        for part, _, _ in text_slices(batch, size=SLICE):
            flat, borders = encoder.batch(part.column("text"), end_id)
            size = np.diff(borders)
            pieces = -(-size // capacity)
            of = np.repeat(np.arange(len(size)), pieces)
            number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(capacity, size[of] - start)
            at = borders[of] + start
            raw = memoryview(flat.tobytes())
            cut = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
            columns = [part.column("id").take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, cut)), pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(list(map(bytes, cut)), pa.binary())], [*names, "ids"]
            yield pa.record_batch(columns, names=names)


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and ids (little-endian, 4 bytes each) on wish.

    A document is the tokenizer's ids of its text and then ``end_id``; null and empty texts are the end
    id alone. Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity``.
    """
    kinds = "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _pieces(b, tokenizer, end_id, capacity, with_ids), kinds)


def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray, size: str) -> Iterator[pa.RecordBatch]:
    key = plan[:, 0] << 46 | plan[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (size, "_cl_rank"))
        at = np.searchsorted(key, length << 46 | rank, "right") - 1
        k = rank - plan[at, 1]
        cols = dict(zip(batch.schema.names, batch.columns))
        cols.pop("_cl_rank")
        cols["sequence_id"] = pa.array(plan[at, 2] + k // plan[at, 3])
        cols["offset"] = pa.array(plan[at, 4] + k % plan[at, 3] * length)
        yield pa.record_batch(list(cols.values()), names=list(cols))


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """``pieces`` (any columns, among them ``length`` from 1 to ``capacity``) with sequence_id and offset.

    The pieces of a sequence lie side by side from offset 0. An empty table gives no rows; a length out
    of range or null raises. Equal rows are separate pieces; which of the pieces of one length goes where is told by ``order``, null or
    repeated ids included. Columns named sequence_id and offset are replaced, others may have any names. Only the count of each length, at most
    ``capacity`` rows, comes to the driver.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    plain = materialise(by_place(pieces), "pieces")
    length, *order = (plain.columns[names.index(c)] for c in ("length", *order))
    if plain.where(F.col(length).isNull()).limit(1).count():
        raise ValueError("a piece has no length")
    # Ranks within a length are counted in shares, since one length may be that of a third of all pieces.
    shares = max(64, shuffle_partitions(spark))
    dealt = plain.withColumn("_cl_share", F.pmod(F.xxhash64(*order), F.lit(shares)).cast("int"))
    sizes = materialise(dealt.groupBy(length, "_cl_share").agg(F.count("*").alias("n")), "piece-sizes")
    plan, _ = best_fit_plan({r[length]: r["n"] for r in sizes.groupBy(length).agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy(length).orderBy("_cl_share").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(length, "_cl_share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_cl_base"))
    within = Window.partitionBy(length, "_cl_share").orderBy(*order)
    ranked = dealt.withColumn("_cl_rank", F.row_number().over(within)).join(bases, [length, "_cl_share"])
    ranked = ranked.select(*plain.columns, (F.col("_cl_rank") - 1 + F.col("_cl_base")).cast("long").alias("_cl_rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(lambda b: _place(b, plan, length), kinds).toDF(*names, "sequence_id", "offset")


def sequence_ids(packed: DataFrame) -> DataFrame:
    """Packed pieces with their ids to one row per sequence: sequence_id, ids (at most the capacity), n_tokens."""
    return packed.groupBy("sequence_id").agg(
        F.expr("aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> a || x.ids)").alias("ids"),
        F.sum("length").alias("n_tokens"),
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame) -> DataFrame:
    out = pack(cut_documents(docs, tokenizer_path("word_bpe_49k.json")))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
