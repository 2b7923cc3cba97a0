"""N-gram Jaccard join: a grouped prefix join that keeps components.

1. One pass describes every text: its number of distinct shingles and two order-free hashes of the set.
   Equal sets fold into a class.
2. Shingles are counted exactly over all classes. A task sends the shingles of a chunk of texts to buckets by
   hash, six bytes each; a bucket counts them and answers each chunk with those that it has seen elsewhere too.
   The chunk then knows each text's order of shingles: what it has alone first, then by count, then
   by hash. Shingles that a sample of the texts shows to be in very many come last, without being counted: any
   order that is the same for all texts is right, and so no bucket gets an entry from a third of them. A prefix whose tokens are all the text's own meets nothing and is left out there, as are
   own tokens of the others. Classes of equal size and equal prefix form a group, and groups meet
   where they share a token of their prefixes.
3. Only components are asked for, so a pair whose ends are already connected needs no test. First every
   group of a token's list meets the list's smallest, then its neighbours in the list that belong to other
   components: as many pairs as rows, not as their square. Such rounds go on, each in another order and
   over lists that still hold several components, while they find links and many pairs are left. What
   then still lies in different components meets in full: per token, blocks of groups meet in Arrow, where sizes, places and
   bit fields tell most pairs apart, and only pairs across components that nearly link are verified: the most promising
   ones of each two components first, and all of those that still lie apart at last.
4. A pair is verified by the exact size of the intersection. Before that, bit fields of both sets give
   an upper bound, which costs a fiftieth of the bytes. Only sets that some list needs travel, and texts never do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, by_place, connected_components, gathered, keep, materialise, scratch, shuffle_partitions
from .hashing import mix, shingles, text_slices

#: Places of a bitmap of ids: 2 MB, whatever the input.
IDS = 1 << 24
#: Shingles that a task sends at a time, and that a bucket counts at a time.
CHUNK_TOKENS, BUCKET_TOKENS = 1 << 22, 1 << 21
#: Rows of a token's list that one task orders at a time.
STRETCH = 1 << 16
#: Shingles that aren't counted: at most so many, seen in so many texts of a 64th of them.
HOT, HOT_FROM = 4096, 64
_HOT_TOKEN = 1 << 62
#: Groups of a token's list that meet those of another block, or each other, in one step.
BLOCK = 1024
#: Bits of the fields that are compared for each pair of a list; sets of more shingles than ``LARGE`` have a field that grows with them as well.
WIDE, LARGE = 2048, 512
_MESSAGE = "chunk long, bucket int, docs binary, tokens binary, levels binary"


def _distinct(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part, data, starts in text_slices(batch):
        grams, at = shingles(data, starts, n)
        yield part, [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:])]


def _describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, size, sig1, sig2) of each text's set."""
    names = ["id", "n", "sig1", "sig2"]
    for batch in batches:
        for part, sets in _distinct(batch, n):
            sig = np.zeros((2, len(sets)), np.uint64)
            for i, s in enumerate(sets):
                sig[0, i], sig[1, i] = s.sum(dtype=np.uint64), mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
            yield pa.record_batch([part.column("id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64))], names=names)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["chunk", "bucket", "docs", "tokens", "levels"])


def _token_counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _distinct(batch, n):
            if sets:
                tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])


def _hot_tokens(placed: DataFrame, n: int) -> np.ndarray:
    """Shingles of very many texts, sorted. Which ones are told changes no result."""
    some = placed.where(F.pmod(F.col("place"), F.lit(64)) == 0).mapInArrow(lambda b: _token_counts(b, n), "token long, n long")
    counted = some.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM)
    rows = counted.orderBy(F.desc("n"), "token").limit(HOT).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def _requests(batches: Iterator[pa.RecordBatch], n: int, reps, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Chunks of texts to one message for each bucket: which document (2 bytes) has which token (4 bytes), the bucket
    standing for the token's other bytes. Two more messages stay with the chunk, their bucket is negative: its ids and sizes, and
    which document has which hot token."""
    chunk = TaskContext.get().partitionId() << 32
    ids: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    held = 0

    def sent() -> list[tuple]:
        size = np.array([len(s) for s in sets], np.int32)
        grams, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), size)
        place = np.searchsorted(hot, grams)
        is_hot = hot[np.minimum(place, len(hot) - 1)] == grams if len(hot) else np.zeros(len(grams), bool)
        often = (chunk, -1 - chunk % buckets, doc[is_hot].tobytes(), place[is_hot].astype(np.uint32).tobytes(), b"\xff" * int(is_hot.sum()))
        grams, doc = grams[~is_hot], doc[~is_hot]
        bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        doc, grams = doc[order], grams[order].astype(np.uint32)
        rows = [(chunk, -1 - chunk % buckets, np.concatenate(ids).tobytes(), size.tobytes(), None), often]
        rows += [(chunk, b, doc[x:y].tobytes(), grams[x:y].tobytes(), None) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:])) if x < y]
        return rows

    for batch in batches:
        batch = batch.filter(pa.array(_marked(reps.value, batch.column("place").to_numpy())))
        for part, found in _distinct(batch, n):
            mine = part.column("id").to_numpy()
            for i, s in enumerate(found):
                if not len(s):
                    continue
                if sets and (held + len(s) > CHUNK_TOKENS or len(sets) == 1 << 16):
                    yield _messages(sent())
                    chunk, held = chunk + 1, 0
                    ids.clear()
                    sets.clear()
                ids.append(mine[i : i + 1])
                sets.append(s)
                held += len(s)
    if sets:
        yield _messages(sent())


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte: themselves up to 63, then sixteenths of powers of two, up to the top."""
    fine = 64 + 16 * (np.log2(np.maximum(counts, 64)) - 6)
    return np.where(counts < 64, counts, np.minimum(fine, 255)).astype(np.uint8)


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages sorted by bucket to answers with the tokens that the bucket has seen more than once, and their levels."""
    held: list[tuple] = []

    def answers() -> pa.RecordBatch:
        tokens = [np.frombuffer(x[3], np.uint32) for x in held]
        _, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        level, ends, rows = _levels(counts)[inverse], np.cumsum([len(t) for t in tokens]), []
        for (chunk, bucket, docs, _, _), mine, end in zip(held, tokens, ends):
            of = level[end - len(mine) : end]
            again = np.flatnonzero(of > 1)
            if len(again):
                rows.append((chunk, bucket, np.frombuffer(docs, np.uint16)[again].tobytes(), mine[again].tobytes(), of[again].tobytes()))
        held.clear()
        return _messages(rows)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[-1][1] != row[1]:
                yield answers()
            if row[1] < 0:
                yield _messages([row])
            else:
                held.append(row)
    if held:
        yield answers()


def _prefix_size(size: int, num: int, den: int) -> int:
    """How much of a set, in the common order, holds a token of every smaller set that may link with it."""
    return size - -(-num * size // den) + 1 if size else 0


def _prefixes(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Answers sorted by chunk to the prefixes that hold tokens of other texts: (id, n, own, prefix). ``own`` tokens
    that no other text has come before those of ``prefix``."""
    held: list[tuple] = []

    def heads() -> pa.RecordBatch:
        (ids, size), = [(np.frombuffer(x[2], np.int64), np.frombuffer(x[3], np.int32)) for x in held if x[4] is None]
        told = [x for x in held if x[4] is not None]
        doc = np.concatenate([np.frombuffer(x[2], np.uint16) for x in told] or [np.zeros(0, np.uint16)]).astype(np.int64)
        level = np.concatenate([np.frombuffer(x[4], np.uint8) for x in told] or [np.zeros(0, np.uint8)])
        token = np.concatenate([np.frombuffer(x[3], np.uint32).astype(np.int64) | (x[1] << 32 if x[1] >= 0 else _HOT_TOKEN) for x in told] or [np.zeros(0, np.int64)])
        held.clear()
        order = np.lexsort((token, level, doc))
        doc, token = doc[order], token[order]
        shared = np.bincount(doc, minlength=len(ids))
        own = size - shared
        wanted = np.maximum(0, np.array([_prefix_size(k, num, den) for k in size.tolist()], np.int64) - own)
        place = np.arange(len(doc)) - (np.cumsum(shared) - shared)[doc]
        token = token[place < wanted[doc]]
        rows = np.flatnonzero(wanted)
        ends = np.concatenate([[0], np.cumsum(wanted[rows])]).astype(np.int32)
        return pa.record_batch([pa.array(ids[rows]), pa.array(size[rows]), pa.array(own[rows].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(token))], names=["id", "n", "own", "prefix"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[-1][0] != row[0]:
                yield heads()
            held.append(row)
    if held:
        yield heads()


def _bits(s: np.ndarray) -> np.ndarray:
    """One bit for each token's place in a field of 2 to 4 bits per token, in 8-byte words."""
    field = np.zeros(max(64, 2 << (len(s) - 1).bit_length()) if len(s) else 64, bool)
    field[((s >> np.uint64(32)) & np.uint64(len(field) - 1)).astype(np.int64)] = True
    return np.packbits(field, bitorder="little").view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _marked(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(places: np.ndarray, size: int) -> np.ndarray:
    field = np.zeros(size, bool)
    field[places] = True
    return np.packbits(field, bitorder="little")


def _places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(IDS // 8, np.uint8)
    for batch in batches:
        found |= _bitmap(batch.column(0).to_numpy(), IDS)
    yield pa.record_batch([pa.array([zlib.compress(found, 1)], pa.binary())], names=["blob"])


def _either(blobs: Iterator[bytes]) -> bytes:
    found = np.zeros(IDS // 8, np.uint8)
    for x in blobs:
        found |= np.frombuffer(zlib.decompress(x), np.uint8)
    return zlib.compress(found, 1)


def _place() -> Column:
    return F.expr(f"pmod(xxhash64(id), {IDS})")


def _bitmap_of(ids: DataFrame):
    """Broadcast bitmap of the places of the ids: all of them are marked, and few others as long as there are few."""
    marks = gathered(ids.distinct().select(_place().alias("p")).mapInArrow(_places_of, "blob binary"), _either)
    return ids.sparkSession.sparkContext.broadcast(np.frombuffer(zlib.decompress(marks), np.uint8) if marks else np.zeros(IDS // 8, np.uint8))


def _sets(batches: Iterator[pa.RecordBatch], n: int, wanted) -> Iterator[pa.RecordBatch]:
    """Whole sets and their bit fields, of the texts whose id's place is marked."""
    for batch in batches:
        batch = batch.filter(pa.array(_marked(wanted.value, batch.column("place").to_numpy())))
        for part, sets in _distinct(batch, n):
            yield pa.record_batch([part.column("id"), pa.array([len(s) for s in sets], pa.int32()), _lists([_bits(s) for s in sets]), _lists(sets)], names=["id", "n", "bits", "grams"])


def _folded(a: str, b: str) -> list[Column]:
    """Two bit fields, the larger one folded once if they differ: token places are modulo the length."""
    half = lambda x, y: F.expr(
        f"case when size({x}) > size({y}) then zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (p, q) -> p | q) else {x} end"
    )
    return [half(a, b).alias(a), half(b, a).alias(b)]


def _lone(a: str, b: str) -> str:
    """Number of bits that ``a`` has and ``b`` lacks: as many tokens of the one set at least are not in the other.
    Fields that still differ in length say nothing."""
    return f"case when size({a}) = size({b}) then aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p & ~q)), 0, (t, c) -> t + c) else 0 end"


def _wide_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, wide, weight): a field of ``WIDE`` bits of each set, whatever its size, and how many of them are set."""
    for batch in batches:
        grams = batch.column("grams")
        flat, size = grams.flatten().to_numpy().view(np.uint64), np.diff(grams.offsets.to_numpy())
        field = np.zeros((len(size), WIDE), bool)
        field[np.repeat(np.arange(len(size)), size), (flat >> np.uint64(20) & np.uint64(WIDE - 1)).astype(np.int64)] = True
        words = np.packbits(field, axis=1, bitorder="little").view(np.int64)
        ends = pa.array(np.arange(len(size) + 1, dtype=np.int32) * (WIDE // 64))
        yield pa.record_batch([batch.column("gid"), pa.ListArray.from_arrays(ends, pa.array(words.ravel())), pa.array(field.sum(axis=1, dtype=np.int32))], names=["gid", "wide", "weight"])


def _wide_fit(num: int, den: int, nx: str = "nx", ny: str = "ny") -> str:
    """Whether the wide fields vx and vy, of wx and wy bits, of two sets of nx and ny shingles allow a link; null says nothing. As SQL:
    the query tells the same in ``_met_across``, as the driver compiles and keeps an expression of this length anew at each step of a plan."""
    common = " + ".join(f"bit_count(vx[{i}] & vy[{i}])" for i in range(WIDE // 64))
    # Bits that one set has alone stand for as many shingles at least, which are at most its size less the least intersection.
    least = lambda w, n, m: f"{w} * {num + den} - {den} * {n} + {num} * {m}"
    return f"(vx is null or vy is null or ({common}) * {num + den} >= greatest({least('wx', nx, ny)}, {least('wy', ny, nx)}))"


def _met_across(batches: Iterator[pa.RecordBatch], num: int, den: int, few: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs (gx < gy) of groups of other components that may link, of rows (token, low, high, block, gid, n, pos, part, wide, weight, field)
    sorted by token, low and high: those of block low meet those of block high. Sizes and places tell first (as ``_fits``), then the wide fields
    (as ``_wide_fit``), then the bit fields of large sets; fields that are null, or differ in length by more than two, say nothing.

    With ``few``, of the pairs that come together from the same two components only so many come out, those whose wide fields have most
    in common, and ``cut`` tells whether that leaves any out or groups of several members stand for these."""
    both, step, room = num + den, 256, 1 << 20

    def met(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and ``y`` whose sizes and places fit."""
        n, left, part = c["n"], c["n"] - c["pos"], c["part"]
        nx, ny = n[x, None], n[None, y]
        need = num * (nx + ny)
        fit = (part[x, None] != part[None, y]) & (nx * den >= ny * num) & (ny * den >= nx * num) & (left[x, None] * both >= need) & (left[None, y] * both >= need)
        i, j = np.nonzero(fit)
        return x[i], y[j]

    def spare(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How much more the wide fields have in common than a link needs; 0 if they say nothing."""
        n, w = c["n"], c["weight"]
        common = np.bitwise_count(c["wide"][i] & c["wide"][j]).sum(axis=1, dtype=np.int64)
        least = np.maximum(w[i] * both - den * n[i] + num * n[j], w[j] * both - den * n[j] + num * n[i])
        return np.where(c["known"][i] & c["known"][j], common * both - least, 0)

    def best(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``few`` pairs of each two components with most to spare, and ``cut``."""
        x, y = np.minimum(c["part"][i], c["part"][j]), np.maximum(c["part"][i], c["part"][j])
        order = np.lexsort((j, i, -more, y, x))
        i, j, x, y = i[order], j[order], x[order], y[order]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        size = np.diff(np.append(first, len(x)))
        stays = np.arange(len(x)) - np.repeat(first, size) < few
        cut = (np.repeat(size, size) > few) | ~(c["known"][i] & c["known"][j])
        return i[stays], j[stays], cut[stays]

    def fields_fit(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, size, fit = c["n"], c["length"], np.ones(len(i), bool)
        swap = size[i] < size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for words in np.unique(size[j][size[j] > 0]).tolist():
            at = np.arange(words)
            for times in (1, 2):
                of = np.flatnonzero((size[j] == words) & (size[i] == times * words))
                for k in range(0, len(of), max(1, room // words)):
                    some = of[k : k + max(1, room // words)]
                    a, b = i[some], j[some]
                    x, y = (c["flat"][c["start"][r][:, None] + at] for r in (a, b))
                    if times == 2:
                        x = x | c["flat"][c["start"][a][:, None] + words + at]
                    bound = num * (n[a] + n[b])
                    lone = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) * both
                    fit[some] = (lone(x, y) <= n[a] * both - bound) & (lone(y, x) <= n[b] * both - bound)
        return fit

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        c = {k: batch.column(k).to_numpy().astype(np.int64) for k in ("token", "low", "high", "block", "gid", "n", "pos", "part")}
        wide, field = batch.column("wide"), batch.column("field")
        c["known"], c["weight"] = wide.is_valid().to_numpy(zero_copy_only=False), batch.column("weight").fill_null(0).to_numpy().astype(np.int64)
        c["wide"] = np.zeros((len(batch), WIDE // 64), np.uint64)
        c["wide"][c["known"]] = wide.flatten().to_numpy().view(np.uint64).reshape(-1, WIDE // 64)
        c["flat"], c["length"] = field.flatten().to_numpy().view(np.uint64), field.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        c["start"] = np.cumsum(c["length"]) - c["length"]
        return c

    def pairs(c: dict[str, np.ndarray], ends: list[int]) -> Iterator[pa.RecordBatch]:
        for a, b in zip(ends, ends[1:]):
            rows = np.arange(a, b)
            alike = c["low"][a] == c["high"][a]
            lower, upper = rows[c["block"][a:b] == c["low"][a]], rows[c["block"][a:b] == c["high"][a]]
            for k in range(0, len(lower), step):
                i, j = met(c, lower[k : k + step], upper[k:] if alike else upper)
                if alike:
                    i, j = i[i < j], j[i < j]
                for m in range(0, len(i), room // WIDE * 64):
                    p, q = i[m : m + room // WIDE * 64], j[m : m + room // WIDE * 64]
                    more = spare(c, p, q)
                    p, q, more = p[more >= 0], q[more >= 0], more[more >= 0]
                    fit = fields_fit(c, p, q)
                    p, q, more = p[fit], q[fit], more[fit]
                    if not len(p):
                        continue
                    cut = []
                    if few:
                        p, q, cut = best(c, p, q, more)
                    x, y = c["gid"][p], c["gid"][q]
                    found = {"gx": np.minimum(x, y), "gy": np.maximum(x, y)} | ({"cut": cut} if few else {})
                    yield pa.record_batch([pa.array(v) for v in found.values()], names=[*found])

    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        c = columns(batch)
        ends = [0, *(np.flatnonzero(np.any([c[k][1:] != c[k][:-1] for k in ("token", "low", "high")], axis=0)) + 1).tolist()]
        yield from pairs(c, ends)
        held = batch.slice(ends[-1])
    if held is not None:
        yield from pairs(columns(held), [0, len(held)])


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Texts link when intersection * den >= union * num for similarity (num, den) of their sets of
    distinct ``n``-word shingles; A-Z count as a-z, words are cut at ASCII space. Null texts, empty ones
    and those without words have no shingles and link with nothing. Rows that repeat an id are texts of their
    own. Rows with a null id link with nothing and have a null component.
    Shingles are compared by 64-bit hashes. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return _near(rows, n, similarity)


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (8, 10)) -> tuple[DataFrame, DataFrame]:
    """All links of ``near_documents``: (class_a, class_b) with class_a < class_b, and one row per row: id, n_shingles, class.

    A class stands for the rows with one set of shingles, which all link with each other; two classes link as
    all their rows do. No pair that may link is left out: groups meet at every token of their prefixes, whatever
    component they are in, so the number of pairs grows with the square of a token's groups. Rows without
    shingles have no class. Classes are numbers of rows, so repeated and missing ids mix nothing.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("id"))
    keyed = materialise(keyed, "numbered")
    links, classed = _near(keyed.select("id", "text"), n, similarity, every=True)
    members = keyed.select("id", "doc").join(classed, "id").select(F.col("doc").alias("id"), "n_shingles", "class")
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")), members


def _verified(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes that link. Sizes, then a bound by bit fields, then the exact test."""
    need = f"ceil({num} * (a_n + b_n) / {den + num})"

    def side(name: str, *columns: str) -> DataFrame:
        return whole.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    near = pairs.where("a < b").distinct().join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    near = near.where(f"a_n * {den} >= b_n * {num} and b_n * {den} >= a_n * {num}").select("a", "b", "a_n", "b_n", *_folded("a_bits", "b_bits"))
    near = near.where(f"a_n - {_lone('a_bits', 'b_bits')} >= {need} and b_n - {_lone('b_bits', 'a_bits')} >= {need}").select("a", "b", "a_n", "b_n")
    near = materialise(near, "near-bits")
    exact = near.join(side("a", "grams"), "a").join(side("b", "grams"), "b").withColumn("common", F.expr("size(array_intersect(a_grams, b_grams))"))
    return materialise(exact.where(f"common * {den} >= (a_n + b_n - common) * {num}").select("a", "b"), "links")


def _fits(num: int, den: int, x: str = "x", y: str = "y") -> str:
    """At the first token that two linking sets share, both have at least as many tokens left as they need
    in common: a condition on sizes and places of two rows of a token's list."""
    return " and ".join(f"n{s} * {den} >= n{t} * {num} and n{s} - p{s} >= ceil({num} * (n{x} + n{y}) / {den + num})" for s, t in ((x, y), (y, x)))


def _dealt(placed: DataFrame) -> DataFrame:
    """Rows (token, gid, part, ...) of lists that hold several components, once for each pair of blocks (low, high) of the list that their ``block`` is of."""
    heavy = F.col("c") > BLOCK
    lists = placed.groupBy("token", "part").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.count("*").alias("parts"), F.ceil(F.sum(F.when(heavy, 0).otherwise(F.col("c"))) / BLOCK).alias("light"),
        F.collect_list(F.when(heavy, F.struct("part", F.ceil(F.col("c") / BLOCK).alias("blocks")))).alias("heavy"),
    )
    rows = placed.join(lists.where("parts > 1").drop("parts"), "token").withColumn("own", F.expr("try_element_at(filter(heavy, h -> h.part = part), 1).blocks"))
    rows = rows.withColumn("first", F.expr("if(own is null, 0, aggregate(filter(heavy, h -> h.part < part), light, (t, h) -> t + h.blocks))"))
    rows = rows.withColumn("block", F.expr("first + pmod(xxhash64(gid, 'block'), coalesce(own, light))"))
    others = F.expr("filter(sequence(0L, aggregate(heavy, light, (t, h) -> t + h.blocks) - 1), o -> own is null or o < first or o >= first + own)")
    return rows.withColumn("other", F.explode(others)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("light", "heavy", "own", "first", "other")


def _near(rows: DataFrame, n: int, similarity: tuple[int, int], every: bool = False):
    """``near_documents`` of (id, text); with ``every`` the verified pairs of classes and (id, n_shingles, class), ids being unique."""
    with scratch(rows.sparkSession):
        found = _found(rows, n, similarity, every)
        return tuple(keep(materialise(f, "near-found")) for f in found) if every else keep(materialise(found, "near-found"))


def _found(rows: DataFrame, n: int, similarity: tuple[int, int], every: bool):
    spark, (num, den) = rows.sparkSession, similarity
    parts = shuffle_partitions(spark)
    described = materialise(rows.mapInArrow(lambda b: _describe(b, n), "id long, n int, sig1 long, sig2 long"), "sets")
    sig = ["n", "sig1", "sig2"]
    if described.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
        return _own_numbers(rows, n, similarity)
    classes = materialise(described.where("n > 0 and id is not null").groupBy(*sig).agg(F.min("id").alias("rep")), "classes")
    placed = rows.where("id is not null").withColumn("place", _place())

    # A bucket's tokens fit into a task; there are as many buckets as the tokens ask for.
    buckets = max(parts, (classes.agg(F.sum("n")).first()[0] or 0) // BUCKET_TOKENS + 1)
    reps = _bitmap_of(classes.select(F.col("rep").alias("id")))
    hot = _hot_tokens(placed, n)
    asked = placed.mapInArrow(lambda b: _requests(b, n, reps, hot, buckets), _MESSAGE)
    told = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_replies, _MESSAGE)
    heads = told.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(lambda b: _prefixes(b, num, den), "id long, n int, own int, prefix array<long>")
    # The bitmap may let copies through, which aren't representatives.
    heads = materialise(heads.join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "prefixes")

    # Groups of equal size and prefix, known by their smallest id. A prefix with a token of its own is like no other.
    group = heads.where("own = 0").groupBy("n", F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2")).agg(F.min("id").alias("gid"), F.count("*").alias("c"))
    crowded = materialise(group.where("c > 1"), "crowded-groups")
    more = heads.where("own = 0").select("id", "n", F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2")).join(crowded, ["n", "p1", "p2"]).select("gid", "id", "n")
    more = materialise(more, "group-members")
    firsts = heads.join(more.where("gid != id").select("id"), "id", "left_anti")
    raw = firsts.select(F.col("id").alias("gid"), "n", "own", F.posexplode("prefix").alias("pos", "token"))
    # Two shingles of a text may look alike to a bucket: the first stands for both.
    raw = raw.groupBy("gid", "n", "token").agg(F.min(F.col("pos") + F.col("own")).alias("pos"))
    top = raw.groupBy("token").agg(F.count("*").alias("crowd"), F.min(F.struct("gid", "n", "pos")).alias("top")).where("crowd > 1")
    postings = materialise(raw.join(top, "token").select("token", "gid", "n", "pos", "crowd", "top"), "postings")
    postings_n = postings.count()

    wanted = _bitmap_of(postings.select(F.col("gid").alias("id")).union(more.select("id")))
    sets = placed.mapInArrow(lambda b: _sets(b, n, wanted), "id long, n int, bits array<long>, grams array<long>")
    whole = Stored(sets.repartition(parts, "id"), "sets", ["id"]).table

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, whole, num, den)

    def expanded(groups: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs of groups to pairs of members; a group without rows in ``members`` is its own one member."""
        of = lambda side, member: members.select(F.col("gid").alias(side), F.col("id").alias(member))
        both = groups.join(of("gx", "i"), "gx", "left").join(of("gy", "j"), "gy", "left")
        return both.select(F.coalesce("i", "gx").alias("i"), F.coalesce("j", "gy").alias("j"))

    end = lambda frame, s, names: frame.select("token", *[F.col(c).alias(f"{to}{s}") for c, to in names.items()])
    one = {"gid": "g", "n": "n", "pos": "p"}
    if every:
        met = end(postings, "x", one).join(end(postings, "y", one), "token").where(f"gx < gy and {_fits(num, den)}").select("gx", "gy").distinct()
        met = met.union(crowded.select(F.col("gid").alias("gx"), F.col("gid").alias("gy")))
        links = verified(expanded(met, more).where("i != j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")))
        return links, described.join(classes, sig, "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class"))

    # Every group meets the smallest one of each of its lists, and every member the group's smallest.
    star = postings.where("gid != top.gid").selectExpr("gid", "n as nx", "pos as px", "top.gid as g", "top.n as ny", "top.pos as py")
    star = star.where(_fits(num, den)).select(F.least("gid", "g").alias("a"), F.greatest("gid", "g").alias("b"))
    links = verified(star.union(more.where("gid != id").select(F.col("gid").alias("a"), F.col("id").alias("b"))))
    known = materialise(connected_components(links), "near-parts")

    def united(known: DataFrame, links: DataFrame) -> DataFrame:
        """``known`` after some more links. Only components and what joins them go through the rounds: many links between two are one edge."""
        named = lambda frame, c, to: frame.join(known.select(F.col("id").alias(c), F.col("component").alias(to)), c, "left")
        joined = named(named(links, "a", "pa"), "b", "pb").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        tops = connected_components(joined)
        told = known.join(tops.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
        fresh = tops.join(known.select("id"), "id", "left_anti").select("id", "component")
        return materialise(told.select("id", F.coalesce("top", "component").alias("component")).union(fresh), "near-parts")

    # Members of other components than their group's are groups of their own from here on: in the group's
    # lists, and in one that they have with the group alone.
    part_of = lambda frame, c, to: frame.join(known.select(F.col("id").alias(c), F.col("component").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    split = materialise(part_of(part_of(more.where("gid != id"), "gid", "gp"), "id", "ip").where("gp != ip").select("gid", "id", "n"), "split")
    stay = more.join(split.select("id"), "id", "left_anti").select("gid", "id")
    own = split.union(split.select("gid", F.col("gid").alias("id"), "n").distinct())
    own = own.join(own.groupBy("gid").agg(F.count("*").alias("crowd")), "gid").select(F.xxhash64("gid", F.lit("group")).alias("token"), F.col("id").alias("gid"), "n", F.lit(0).alias("pos"), "crowd")
    postings = postings.select("token", "gid", "n", "pos", "crowd")
    postings = postings.union(postings.join(split.select("gid", "id"), "gid").select("token", F.col("id").alias("gid"), "n", "pos", "crowd")).union(own)

    turn, before = 0, float("inf")
    while True:
        # Lists that hold one component have done their part.
        placed = part_of(postings.select("token", "gid", "n", "pos", "crowd"), "gid", "part")
        mixed = placed.groupBy("token", "part").agg(F.count("*").cast("double").alias("c"))
        mixed = mixed.groupBy("token").agg(F.count("*").alias("parts"), F.expr("(power(sum(c), 2) - sum(power(c, 2))) / 2").alias("pairs")).where("parts > 1")
        mixed = materialise(mixed, "mixed-lists")
        postings = materialise(placed.join(mixed.select("token"), "token"), "mixed-postings")
        left = mixed.agg(F.sum("pairs")).first()[0] or 0
        if left <= postings_n or left > 0.9 * before:
            break
        before = left
        # Neighbours of other components, in order of size first and then in other orders.
        order = ["n", "gid"] if turn == 0 else [F.xxhash64("gid", F.lit(turn))]
        lists = Window.partitionBy("token", F.expr(f"pmod(xxhash64(gid, {turn}, 1), crowd div {STRETCH} + 1)")).orderBy(*order)
        beside = postings.withColumn("next", F.lead(F.struct("gid", "n", "pos", "part")).over(lists)).where("next.part != part")
        beside = beside.selectExpr("gid", "next.gid as g", "n as nx", "pos as px", "next.n as ny", "next.pos as py").where(_fits(num, den))
        links = verified(beside.select(F.least("gid", "g").alias("a"), F.greatest("gid", "g").alias("b")))
        known = united(known, links)
        turn += 1

    # Groups of a token's list meet in blocks where they are of other components, sizes, places and fields are told there, and only pairs that
    # nearly link come out. A component with more groups of a list than a block holds has blocks of its own, which don't meet
    # each other. A group of several members has no field, as its members have fields of their own. Two components that link do so by very
    # many pairs and one is enough: their most promising pairs go first, a group's smallest member standing for it, those of a sixteenth
    # of the tokens before those of all. Components that these don't connect meet in full at the end, with all members.
    several = stay.where("gid != id").select("gid").distinct().withColumn("several", F.lit(True))
    fields = whole.join(postings.select("gid").distinct(), whole["id"] == F.col("gid"), "left_semi").select(F.col("id").alias("gid"), "n", "bits", "grams")
    wide = fields.select("gid", "grams").mapInArrow(_wide_fields, "gid long, wide array<long>, weight int")
    fields = fields.select("gid", F.when(F.col("n") > LARGE, F.col("bits")).alias("field")).join(wide, "gid").join(several, "gid", "left")
    fields = materialise(fields.where("several is null").drop("several"), "fields")
    for high, few in ((3, 1), (63, 1), (63, 16), (63, None)):
        some = postings.where(F.pmod(F.xxhash64("token", F.lit("turn")), F.lit(64)) <= high).select("token", "gid", "n", "pos")
        rows = _dealt(part_of(some, "gid", "part")).join(fields, "gid", "left")
        rows = rows.select("token", "low", "high", "block", "gid", "n", "pos", "part", "wide", "weight", "field").repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high")
        if few:
            across = rows.mapInArrow(lambda b: _met_across(b, num, den, few), "gx long, gy long, cut boolean").groupBy("gx", "gy").agg(F.max("cut").alias("cut"))
        else:
            across = rows.mapInArrow(lambda b: _met_across(b, num, den), "gx long, gy long").distinct()
        across = materialise(across, "met-groups")
        # Most turns of most tables connect nothing more.
        if across.isEmpty():
            if high < 63:
                continue
            break
        links = verified((expanded(across, stay) if not few else across.select(F.col("gx").alias("i"), F.col("gy").alias("j"))).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")))
        if not links.isEmpty():
            known = united(known, links)
        if high == 63 and few and across.where("cut").isEmpty():
            break

    # A set that a third of all texts have is one row on the right; adaptive execution splits its rows on the left.
    told = classes.join(known.withColumnRenamed("id", "rep"), "rep", "left").select(*sig, F.coalesce("component", "rep").alias("part"))
    out = described.join(told, sig, "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("part", "id")).alias("component_id"))


def _own_numbers(rows: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """For tables in which ids repeat: each row gets a number, and components their smallest id."""
    keyed = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = near_documents(keyed.withColumn("row", F.when(F.col("id").isNotNull(), F.col("row"))).where("row is not null").drop("id"), "row", "text", n, similarity)
    named = keyed.select("row", F.col("id").alias("doc")).join(found.withColumnRenamed("id", "row"), "row")
    named = materialise(named, "named")
    least = named.groupBy("component_id").agg(F.min("doc").alias("least"))
    out = named.join(least, "component_id").select(F.col("doc").alias("id"), "n_shingles", F.col("least").alias("component_id"))
    lone = rows.where("id is null").mapInArrow(lambda b: _describe(b, n), "id long, n int, sig1 long, sig2 long")
    return out.union(lone.select("id", F.col("n").cast("long"), F.lit(None).cast("long")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns as they were, whatever their names.

    Where ids repeat, each row is a text of its own: of a component's rows with the smallest id one stays, and
    rows whose texts link with nothing all stay, as do rows without an id.
    """
    plain = by_place(docs)
    own_id, text = (plain.columns[docs.columns.index(c)] for c in (id_col, text_col))
    ids = plain.select(F.col(own_id).cast("long").alias("id")).where("id is not null")
    if ids.groupBy("id").count().where("count > 1").limit(1).count():
        plain = materialise(plain.withColumn("_row", F.monotonically_increasing_id()), "near-numbered")
        known = plain.select("_row", F.col(own_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
        found = near_documents(known.where("_doc is not null"), "_row", "_text", n, similarity)
        placed = materialise(found.join(known.select(F.col("_row").alias("id"), "_doc"), "id"), "near-flags")
        # A row that links with nothing is its own component.
        stays = placed.groupBy("component_id").agg(F.min_by("id", F.struct("_doc", "id")).alias("id"))
        gone = placed.join(stays.select("id"), "id", "left_anti").select(F.col("id").alias("_gone"))
        return plain.join(gone, plain["_row"] == gone["_gone"], "left_anti").drop("_row").toDF(*docs.columns)
    found = near_documents(plain, own_id, text, n, similarity)
    gone = materialise(found.where("component_id < id").select(F.col("id").alias("_gone")), "near-flags")
    return plain.join(gone, plain[own_id] == gone["_gone"], "left_anti").toDF(*docs.columns)


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_documents(docs, n=3, similarity=(9, 10)).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS g FROM w
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * common >= 90 * (cx.n + cy.n - common)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS top FROM r GROUP BY x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.top, d.doc_id)) AS component_id
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""
