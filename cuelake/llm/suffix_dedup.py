"""Substring dedup: every byte covered by a string of ``min_bytes`` bytes that also starts elsewhere goes.

The corpus is cut into small suffix-sorted blocks such that equal strings always meet in one block:

1. Each window of ``min_bytes`` bytes belongs to its anchor, the leftmost of its k-grams with the least
   hash. Windows side by side share anchors, so a text has few; the bytes of all windows of one
   anchor are its context. Equal windows have equal anchors. Anchors are matched by their hash.
2. Contexts that are equal as a whole, by two unlike 64-bit hashes beside the anchor's, are repeats in all their windows. Anchors seen once are none. What
   is left are anchors with several different contexts; one of each kind is compared byte by byte.
3. The contexts of whole anchors are sieved by the hashes of their windows, and what may repeat is joined
   to blocks of about ``BLOCK`` bytes. A block gets its
   Burrows-Wheeler transform, and the threshold-bounded interval expansion: starting from the empty
   string, intervals of equal prefixes are extended backward breadth first, which yields the common
   prefixes of neighbouring suffixes by increasing length; it stops at ``min_bytes``. Neighbours still
   undivided then share that many bytes.
4. An anchor with more than ``crowd`` different contexts isn't put into one block: its windows are
   counted by a 128-bit digest each, which any number of tasks can share.

Texts that are equal as a whole are found first, by digest, and only one of them goes through this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, by_place, keep, materialise, release, scratch, shuffle_partitions
from .hashing import SECOND_POWERS, SECOND_TABLE, mix, running_sums, stretch_hashes, text_slices

MIN_BYTES = 200
BLOCK = 1 << 20
CROWD = 8192
_SHARES = 32
_POSITION_BITS = 22
_SEGMENT = 1 << 21
_ANCHORS = "row long, mark long, key long, context long, context2 long, start long, windows int"
_SPANS = "row long, mark long, start long, stop long"


def _least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values side by side, from running minima of blocks in both directions."""
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(sums: np.ndarray, others: np.ndarray, a: int, b: int, min_bytes: int) -> tuple[np.ndarray, ...]:
    """(key, two hashes of the context, first window, windows) of the anchors of the text between a and b; windows count from a.
    ``others`` are running sums of the second kind."""
    gram = max(1, min_bytes // 3)
    out = []
    for seg in range(a, b - min_bytes + 1, _SEGMENT):
        stop = min(b, seg + _SEGMENT + min_bytes - 1)
        at = np.arange(seg, stop - gram + 1)
        value = mix(stretch_hashes(sums, at, at + gram))
        low = np.uint64((1 << _POSITION_BITS) - 1)
        best = _least_in_windows((value & ~low) | (at - seg).astype(np.uint64), min_bytes - gram + 1)
        place = (best & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([first, [len(place)]]))
        ends = seg + first + count + min_bytes - 1
        context = mix(stretch_hashes(sums, seg + first, ends) + count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        second = stretch_hashes(others, seg + first, ends, SECOND_POWERS)
        # The anchor's place in its context counts too: equal bytes have it at the same place.
        out.append((value[place[first]], context, second, seg - a + first, count))
    return tuple(np.concatenate(c) for c in zip(*out))


def _anchors(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, starts in text_slices(batch):
            sums, others = running_sums(data), running_sums(data, SECOND_TABLE, SECOND_POWERS)
            size = np.diff(starts)
            which = np.flatnonzero(size >= min_bytes)
            found = [anchors_of(sums, others, int(starts[i]), int(starts[i + 1]), min_bytes) for i in which]
            if not found:
                continue
            each = [len(f[0]) for f in found]
            key, context, second, first, count = (np.concatenate(c) for c in zip(*found))
            of = lambda c: np.repeat(part.column(c).to_numpy(zero_copy_only=False)[which], each)
            yield pa.record_batch(
                [pa.array(of("row")), pa.array(of("mark")), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(second.view(np.int64)), pa.array(first.astype(np.int64)), pa.array(count.astype(np.int32))],
                names=["row", "mark", "key", "context", "context2", "start", "windows"],
            )


def _contexts(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """Texts with the list of contexts wanted of them to one row per context with its bytes."""
    names = ["row", "mark", "key", "start", "bytes"]
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for i in range(batch.num_rows):
            data = batch.column("text")[i].as_buffer()
            row, mark = batch.column("row")[i].as_py(), batch.column("mark")[i].as_py()
            for x in batch.column("wanted")[i].as_py():
                stop = x["start"] + x["windows"] + min_bytes - 1
                rows.append((row, mark, x["key"], x["start"], data.slice(x["start"], stop - x["start"]).to_pybytes()))
                held += stop - x["start"]
            if held > 8 << 20 or i == batch.num_rows - 1:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=names)
                rows, held = [], 0


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (small integers, unique ends below all others) in order of their first ``depth`` symbols at least."""
    n, bits = len(text), max(1, int(text.max()).bit_length())
    span = max(1, 60 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(span, np.int64)])
    for k in range(span):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if span >= depth or rank[order[-1]] == n - 1:
            return np.argsort(rank, kind="stable")
        ahead = np.zeros(n, np.int64)
        ahead[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + ahead
        span *= 2


def repeated_starts(contexts: list[bytes], min_bytes: int) -> list[np.ndarray]:
    """Where in each of the contexts a string starts that another of them holds too."""
    if not contexts:
        return []
    size = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(size + 1) - 1
    ends_n = len(contexts)
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + ends_n
    text[ends] = np.arange(ends_n)
    n = len(text)
    # Deeper than any context, so that no two suffixes tie.
    order = suffix_order(text, int(size.max()) + 2)
    # The transform: the symbol before each suffix. Its stable sorting leads from a suffix to the one a symbol shorter.
    transform = text[order - 1]
    shorter = np.argsort(transform, kind="stable")
    first = text[order]
    divided = np.ones(n, bool)
    divided[1:] = first[1:] != first[:-1]
    open_rows = np.flatnonzero(~divided)
    above, here = shorter[open_rows - 1], shorter[open_rows]
    for _ in range(1, min_bytes):
        if not len(open_rows):
            break
        # Rows of one interval lead with one symbol; they part where the intervals of what follows part.
        until = np.cumsum(divided, dtype=np.int32)
        parts = until[above] != until[here]
        divided[open_rows[parts]] = True
        stay = ~parts
        open_rows, above, here = open_rows[stay], above[stay], here[stay]
    starts = np.unique(np.concatenate([order[open_rows], order[open_rows - 1]]))
    begin = ends - size
    of = np.searchsorted(ends, starts)
    return np.split(starts - begin[of], np.searchsorted(of, np.arange(1, ends_n)))


def shared_stretches(contexts: list[bytes], min_bytes: int) -> list[tuple[int, int, bytes]]:
    """(context, start, bytes) of the stretches whose windows have a hash that another window has too. Equal windows
    have equal hashes, so that nothing that repeats is left out; what only seems to repeat is for the sorting to tell."""
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size) - size
    sums = running_sums(np.frombuffer(b"".join(contexts), np.uint8))
    count = size - min_bytes + 1
    of = np.repeat(np.arange(len(contexts)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    value = mix(stretch_hashes(sums, begin[of] + at, begin[of] + at + min_bytes))
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    places = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    hit = np.flatnonzero(twice[places] == value)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(of[hit]) > 0)]))
    last = np.concatenate([first[1:], [len(hit)]]) - 1
    return [(c, a, contexts[c][a : b + min_bytes]) for c, a, b in zip(of[hit[first]].tolist(), at[hit[first]].tolist(), at[hit[last]].tolist())]


def _runs(starts: np.ndarray, min_bytes: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that windows at these starts cover, those side by side as one."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > 1) + 1
        for part in np.split(starts, cut):
            yield int(part[0]), int(part[-1]) + min_bytes


def _compare(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor to the byte ranges that repeat. Whole anchors are sieved by the hashes of their windows;
    what stays is put into blocks of whole anchors."""
    raw: list[tuple] = []
    held: list[tuple] = []
    raw_size = size = 0

    def sieved() -> int:
        kept = [(*raw[c][:2], raw[c][3] + a, data) for c, a, data in shared_stretches([x[4] for x in raw], min_bytes)]
        held.extend(kept)
        raw.clear()
        return sum(len(x[3]) for x in kept)

    def done() -> pa.RecordBatch:
        out = []
        for (row, mark, start, _), starts in zip(held, repeated_starts([x[3] for x in held], min_bytes)):
            out += [(row, mark, start + a, start + b) for a, b in _runs(starts, min_bytes)]
        held.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in list(zip(*out)) or [[]] * 4], names=["row", "mark", "start", "stop"])

    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("row", "mark", "key", "start", "bytes"))):
            if raw_size >= BLOCK and x[2] != raw[-1][2]:
                size += sieved()
                raw_size = 0
                if size >= BLOCK:
                    yield done()
                    size = 0
            raw.append(x)
            raw_size += len(x[4])
    if raw:
        sieved()
    if held:
        yield done()


def _window_digests(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, mark, start, data in zip(*(batch.column(c).to_pylist() for c in ("row", "mark", "start", "bytes"))):
            n = len(data) - min_bytes + 1
            digests = [hashlib.blake2b(data[k : k + min_bytes], digest_size=16).digest() for k in range(n)]
            yield pa.record_batch(
                [pa.array([row] * n), pa.array([mark] * n), pa.array(np.arange(start, start + n, dtype=np.int64)), pa.array(digests, pa.binary())],
                names=["row", "mark", "start", "digest"],
            )


def merge_spans(spans: list) -> list[tuple[int, int]]:
    """Union of byte ranges, in order; ranges that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keep_outside(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


class Repeats:
    """Documents with what repeats in them. ``table`` has the documents' columns, then row, mark, copies
    and spans (sorted, disjoint byte ranges; null: none). ``close()`` deletes the tables behind it."""

    def __init__(self, table: DataFrame, behind: list):
        self.table, self.behind = table, behind

    def close(self) -> None:
        for held in self.behind:
            held.drop() if isinstance(held, Stored) else release(held)


def _hot_keys(texts: DataFrame, min_bytes: int) -> list[int]:
    """Anchors that so many texts hold that their rows are worth splitting: at most 256, found in a 32nd of the texts.
    Which anchors are split changes no result."""
    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(32)) == 0).mapInArrow(lambda b: _anchors(b, min_bytes), _ANCHORS)
    counted = some.groupBy("key").agg(F.count("*").alias("n")).where("n >= 64")
    return [r[0] for r in counted.orderBy(F.desc("n"), "key").limit(256).collect()]


def _told(anchors: DataFrame, hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """(equal, wanted): rows of contexts that stand more than once, and one row for each context of an anchor that has
    several ``kinds`` of them, one of which at least stands once.

    Rows of a hot anchor are counted in ``_SHARES`` shares by row, then over the shares: a row whose context stands twice in
    its share needs no more, the others ask the sums.
    """
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    anchors = anchors.withColumn("share", F.when(is_hot, F.pmod("row", F.lit(_SHARES))).otherwise(-1))
    by_key, by_context = Window.partitionBy("key", "share"), Window.partitionBy("key", "share", "context", "context2")
    counted = (
        anchors.withColumn("nth", F.row_number().over(by_context.orderBy("row", "start")))
        .withColumn("same", F.count("*").over(by_context))
        .withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_key))
        .withColumn("single", F.min("same").over(by_key) == 1)
        .where("share >= 0 or same > 1 or (kinds > 1 and single)")
    )
    counted = materialise(counted, "anchors")
    place, ask = ["row", "mark", "start", "windows"], ["row", "mark", "key", "start", "windows", "kinds"]
    equal = counted.where("same > 1").select(*place)
    wanted = counted.where("share < 0 and nth = 1 and kinds > 1 and single").select(*ask)
    if not hot:
        return equal, wanted
    rows = counted.where("share >= 0")
    whole = rows.where("nth = 1").groupBy("key", "context", "context2").agg(F.sum("same").alias("same"), F.min(F.struct("row", "start", "mark", "windows")).alias("first"))
    whole = materialise(whole, "hot-contexts")
    # No more rows than hot anchors.
    keys = F.broadcast(whole.groupBy("key").agg(F.count("*").alias("kinds"), (F.min("same") == 1).alias("single")))
    asked = whole.join(keys.where("kinds > 1 and single"), "key").select("first.row", "first.mark", "key", "first.start", "first.windows", "kinds")
    alone = rows.where("same = 1").join(whole.where("same > 1").select("key", "context", "context2"), ["key", "context", "context2"], "left_semi")
    return equal.union(alone.select(*place)), wanted.union(asked.select(*ask))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, crowd: int = CROWD) -> Repeats:
    """Byte ranges of each text that strings of ``min_bytes`` bytes cover which also start anywhere else.

    Texts are UTF-8 bytes; null counts as empty; matches never cross documents. Repeated rows are
    documents of their own and so repeat each other. Ids may be null or repeat; an empty table gives no
    rows. The documents are written once, bucketed, so that text is shuffled a single time.
    """
    if min_bytes < 2:
        raise ValueError("min_bytes is at least 2")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    clash = {"_cl_row", "_cl_mark", "_cl_copies", "_cl_one"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are reserved")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    mark = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    row = F.xxhash64(F.col(id_col), digest)
    with scratch(spark):
        base = materialise(docs.select(row.alias("row"), mark.alias("mark"), F.unhex(digest).alias("digest")), "texts")
        classes = base.groupBy("digest").agg(F.count("*").alias("copies"), F.min("row").alias("one")).where("copies > 1")
        told = classes.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
        flags = base.dropDuplicates(["row", "mark"]).withColumn("share", F.pmod("row", F.lit(_SHARES)).cast("int")).join(told, ["digest", "share"], "left")
        flags = flags.select(F.col("row").alias("_cl_row"), F.col("mark").alias("_cl_mark"), F.coalesce("copies", F.lit(1)).alias("_cl_copies"), F.coalesce(F.col("one") == F.col("row"), F.lit(True)).alias("_cl_one"))
        flags = materialise(flags, "text-flags")
        keys = ["_cl_row", "_cl_mark"]
        whole = keep(Stored(docs.withColumn("_cl_row", row).withColumn("_cl_mark", mark).join(flags, keys), "repeats", keys))
        stored = whole.table
        texts = stored.where("_cl_one").select(F.col("_cl_row").alias("row"), F.col("_cl_mark").alias("mark"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        texts = texts.where(F.octet_length("text") >= min_bytes)
        equal, wanted = _told(texts.mapInArrow(lambda b: _anchors(b, min_bytes), _ANCHORS), _hot_keys(texts, min_bytes))
        equal = equal.select("row", "mark", "start", (F.col("start") + F.col("windows") + (min_bytes - 1)).alias("stop"))
        wanted = wanted.groupBy("row", "mark").agg(F.collect_list(F.struct("key", "start", "windows", "kinds")).alias("wanted"))
        wanted = materialise(wanted, "wanted")

        def cut(which: str) -> DataFrame:
            some = wanted.withColumn("wanted", F.expr(f"filter(wanted, x -> x.kinds {which} {crowd})")).where("size(wanted) > 0")
            joined = stored.where("_cl_one").join(some.select(F.col("row").alias("_cl_row"), F.col("mark").alias("_cl_mark"), "wanted"), keys)
            joined = joined.select(F.col("_cl_row").alias("row"), F.col("_cl_mark").alias("mark"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), "wanted")
            return joined.mapInArrow(lambda b: _contexts(b, min_bytes), "row long, mark long, key long, start long, bytes binary")

        blocks = cut("<=").repartition(parts, "key").sortWithinPartitions("key")
        spans = [equal, blocks.mapInArrow(lambda b: _compare(b, min_bytes), _SPANS)]
        if wanted.where(F.expr(f"exists(wanted, x -> x.kinds > {crowd})")).limit(1).count():
            windows = materialise(cut(">").mapInArrow(lambda b: _window_digests(b, min_bytes), "row long, mark long, start long, digest binary"), "windows")
            twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
            spans.append(windows.join(twice, "digest").select("row", "mark", "start", (F.col("start") + min_bytes).alias("stop")))
        spans = [materialise(s, "spans") for s in spans]
        every = spans[0]
        for s in spans[1:]:
            every = every.union(s)
        runs = every.groupBy("row", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
        merged = F.udf(lambda spans: merge_spans([tuple(s) for s in spans]), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])), useArrow=True)
        runs = keep(materialise(runs.select(F.col("row").alias("_cl_row"), F.col("mark").alias("_cl_mark"), merged("spans").alias("found")), "runs"))
    size = F.octet_length(text)
    every_byte = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.cast("long").alias("stop")))
    out = stored.join(runs, keys, "left")
    out = out.withColumn("_cl_spans", F.when((F.col("_cl_copies") > 1) & (size >= min_bytes), every_byte).when(F.col("_cl_copies") == 1, F.col("found")))
    return Repeats(out.drop("found", "_cl_one"), [whole, runs])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to counts and the digest of what stays."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            data = batch.column("text")[i].as_buffer().to_pybytes()
            spans = [(s["start"], s["stop"]) for s in batch.column("spans")[i].as_py() or []]
            rows.append((batch.column("id")[i].as_py(), len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(keep_outside(data, spans)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text column; rows and other columns stay, whatever their names.

    A character that is cut through goes whole. Null texts stay null.
    """
    plain = by_place(docs)
    own_id, text = (plain.columns[docs.columns.index(c)] for c in (id_col, text_col))
    found = find_repeats(plain, own_id, text, min_bytes)

    def kept(text, spans):
        return None if text is None else keep_outside(text.encode(), [(s["start"], s["stop"]) for s in spans or []]).decode("utf-8", "ignore")

    cut = F.udf(kept, "string", useArrow=True)
    out = found.table.withColumn(text, F.when(F.col("_cl_spans").isNotNull(), cut(F.col(text), F.col("_cl_spans"))).otherwise(F.col(text)))
    out = materialise(out.select(*plain.columns), "without-repeats")
    found.close()
    return out.toDF(*docs.columns)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_repeats(docs)
    rows = found.table.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("_cl_spans").alias("spans"))
    out = materialise(rows.mapInArrow(_kept, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "kept")
    found.close()
    return out.withColumnRenamed("id", "doc_id")
