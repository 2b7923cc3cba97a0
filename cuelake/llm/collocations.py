"""Phrase collocations by weighted acyclic automata.

1. Texts become shards of words: a shard has its own numbers for its words and the stretches of numbers. Words
   are counted; only those frequent enough can stand in a candidate. They are numbered in the order of language and
   word, and each shard is told the numbers of its own.
2. A shard sorts its word pairs and triples and builds count transducers from them, one for each prefix range
   (first word, second word) of a language that it has n-grams of. An arc's weight is the count of the n-gram that ends with it; states with the same
   arcs and weights are one.
3. The transducers of a range, whatever shards they come from, are united and their weights summed. Range by range, what stays frequent
   enough is one transducer.
4. Parts are looked up by composition: the last two words of a triple go to the transducer of their range, which gives
   the pair its count and learns from the triple how often the pair stands inside it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, materialise, scratch, shuffle_partitions
from .hashing import mix, text_slices
from .terms import LOWER, distinct, numbered, runs

#: Words of one shard, at most: three numbers of its words fit into 63 bits.
SHARD_WORDS = (1 << 21) - 4
#: Words of one row of a shard's stretches.
STRETCH = 1 << 18
#: Occurrences of frequent words that make one prefix range.
RANGE = 1 << 20
#: Texts are read in slices of about so many bytes.
SLICE = 12 << 20
#: What ends a piece, and what lies between words.
STOPS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_STOP, _GAP = np.isin(np.arange(256), list(STOPS)), np.isin(np.arange(256), list(GAPS))
_SHARDS = "shard long, local int, lang string, word binary, n long, words binary"


def _smallest(a: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _packed(arrays: list[np.ndarray]) -> bytes:
    small = [_smallest(a) for a in arrays]
    return b"".join([struct.pack(f"<{len(small)}B{len(small)}I", *[a.itemsize for a in small], *[len(a) for a in small]), *[a.tobytes() for a in small]])


def _unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    head = struct.unpack_from(f"<{n}B{n}I", blob)
    out, at = [], 5 * n
    for size, count in zip(head[:n], head[n:]):
        out.append(np.frombuffer(blob, f"<u{size}", count, at).astype(np.int64))
        at += size * count
    return out


@dataclass
class CountTransducer:
    """Automaton of word pairs and triples. From the start an arc leads by each first word to a state, from there one by each
    second word to a state of third words. ``target`` says which; equal states are one, state 0 has no arcs."""

    first: np.ndarray
    first_at: np.ndarray
    second: np.ndarray
    second_n: np.ndarray
    target: np.ndarray
    state_at: np.ndarray
    third: np.ndarray
    third_n: np.ndarray

    @classmethod
    def build(cls, pairs: np.ndarray, n: np.ndarray, of: np.ndarray, third: np.ndarray, third_n: np.ndarray) -> CountTransducer:
        """From sorted pairs (first word above second) with counts, and sorted triples (index of their pair, third word) with counts."""
        first, at = np.unique(pairs >> np.uint64(32), return_index=True)
        size = np.bincount(of, minlength=len(pairs))
        begin = np.cumsum(size) - size
        # States with the same mark are compared arc by arc with the first of them; those that only look alike stay apart.
        mark = np.zeros(len(pairs), np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            arcs = mix(third.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(third_n.astype(np.uint64)))
            mark[full] = (np.add.reduceat(arcs, begin[full]) + mix(size[full].astype(np.uint64))) | np.uint64(1)
        marks, one, state = np.unique(mark, return_index=True, return_inverse=True)
        if len(full):
            holder = one[state]
            twin = np.minimum(begin[holder[of]] + np.arange(len(of)) - begin[of], len(third) - 1)
            odd = np.unique(np.concatenate([np.flatnonzero(size != size[holder]), of[(third != third[twin]) | (third_n != third_n[twin])]]))
            state[odd] = np.arange(len(one), len(one) + len(odd))
            one = np.concatenate([one, odd])
        held = size[one]
        start = begin[one]
        if not len(marks) or marks[0]:
            state, held, start = state + 1, np.concatenate([[0], held]), np.concatenate([[0], start])
        state_at = np.concatenate([[0], np.cumsum(held)])
        take = np.repeat(start - state_at[:-1], held) + np.arange(state_at[-1])
        return cls(first.astype(np.int64), np.append(at, len(pairs)), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), n, state, state_at, third[take], third_n[take])

    def to_bytes(self) -> bytes:
        return _packed([self.first, np.diff(self.first_at), self.second, self.second_n, self.target, np.diff(self.state_at), self.third, self.third_n])

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountTransducer:
        first, per_first, second, second_n, target, per_state, third, third_n = _unpacked(blob, 8)
        ends = lambda x: np.concatenate([[0], np.cumsum(x)])
        return cls(first, ends(per_first), second, second_n, target, ends(per_state), third, third_n)

    def pairs(self) -> np.ndarray:
        """All pairs, sorted; the arc of each has the same place in ``second_n`` and ``target``."""
        return (np.repeat(self.first, np.diff(self.first_at)).astype(np.uint64) << np.uint64(32)) | self.second.astype(np.uint64)

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the pair, third word, count) of all triples, sorted."""
        size = np.diff(self.state_at)[self.target]
        of = np.repeat(np.arange(len(size)), size)
        arc = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + self.state_at[self.target][of]
        return of, self.third[arc], self.third_n[arc]

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """Composition with the pairs asked for: the place of each pair's arc, -1 where there is none."""
        mine = self.pairs()
        at = np.minimum(np.searchsorted(mine, pairs), max(0, len(mine) - 1))
        return np.where(mine[at] == pairs, at, -1) if len(mine) else np.full(len(pairs), -1)


def union(parts: list[CountTransducer], least: int = 1) -> CountTransducer:
    """One transducer with the sums of all weights, of the n-grams with a sum of at least ``least``."""
    every, counts = [p.pairs() for p in parts], [p.second_n for p in parts]
    pairs, back = np.unique(np.concatenate(every), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, back, np.concatenate(counts))
    begin, keys, sums = 0, [], []
    for p, own in zip(parts, every):
        of, third, times = p.triples()
        keys.append((back[begin : begin + len(own)][of].astype(np.uint64) << np.uint64(32)) | third.astype(np.uint64))
        sums.append(times)
        begin += len(own)
    triples, back = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.zeros(len(triples), np.int64)
    np.add.at(times, back, np.concatenate(sums))
    stays, stays3 = n >= least, times >= least
    # A triple is never more frequent than its pair, so that its pair stays too.
    number = np.cumsum(stays) - 1
    of = number[(triples[stays3] >> np.uint64(32)).astype(np.int64)]
    return CountTransducer.build(pairs[stays], n[stays], of, (triples[stays3] & np.uint64(0xFFFFFFFF)).astype(np.int64), times[stays3])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, lang, text) to rows of _SHARDS: a shard's words with their counts, and its stretches: the number of each word, or -1 less it where a piece begins.

    Each n-gram belongs to the shard in which it begins; stretches run two words further."""
    fields = ["shard", "local", "lang", "word", "n", "words"]
    shard = None
    for batch in batches:
        if shard is None:
            shard = batch.column("row")[0].as_py() if batch.num_rows else None
        for part, data, starts in text_slices(batch, size=SLICE):
            stop = _STOP[data]
            solid = ~(stop | _GAP[data])
            begin, end, doc = runs(solid, starts)
            if not len(begin):
                continue
            code, words = distinct(LOWER[data], solid, begin, end)
            lang, langs = numbered(part.column("lang"))
            stops = np.flatnonzero(stop)
            opens = np.ones(len(begin), bool)
            opens[1:] = (doc[1:] != doc[:-1]) | (np.diff(np.searchsorted(stops, begin)) > 0)
            kind = lang[doc] * len(words) + code
            for at in range(0, len(kind), SHARD_WORDS):
                own = min(SHARD_WORDS, len(kind) - at)
                there, local = np.unique(kind[at : at + own + 2], return_inverse=True)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(there), shard, np.int64)), pa.array(np.arange(len(there), dtype=np.int32)), langs.take(pa.array(there // len(words))), words.take(pa.array(there % len(words))),
                        pa.array(np.bincount(local[:own], minlength=len(there))), pa.nulls(len(there), pa.binary()),
                    ],
                    names=fields,
                )
                signed = np.where(opens[at : at + own + 2], -1 - local, local).astype(np.int32)
                # The first row starts with the number of own words.
                rows = [b"".join([struct.pack("<i", own) if k == 0 else b"", signed[k : k + STRETCH].tobytes()]) for k in range(0, len(signed), STRETCH)]
                yield pa.record_batch(
                    [pa.array(np.full(len(rows), shard, np.int64)), pa.array(-np.arange(len(rows), 0, -1, dtype=np.int32)), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64()), pa.array(rows, pa.binary())],
                    names=fields,
                )
                shard += 1


def frequent_words(counted: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, number, at, wide, ranges): the words of ``counted`` (lang, word, f) with at least ``least`` occurrences.

    Numbers go from 0 in each language by the bytes of the word; ``at`` and ``wide`` are the word's place among the occurrences and its share of
    them, ``ranges`` is the language's number of prefix ranges. Running sums go over sorted partitions and then over one row for each of them.
    """
    parts = shuffle_partitions(counted.sparkSession)
    ranged = counted.where(F.col("f") >= least).repartitionByRange(parts, "lang", "word").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "frequent")
    sums = ranged.groupBy("lang", "part").agg(F.count("*").alias("k"), F.sum("f").alias("s"))
    every = Window.partitionBy("lang")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("lang", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"), F.sum("s").over(every).alias("whole"))
    inside = Window.partitionBy("lang", "part").orderBy("word")
    rows = ranged.withColumn("nth", F.row_number().over(inside) - 1).withColumn("sum", F.sum("f").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("f"))
    rows = rows.join(sums, ["lang", "part"])
    return rows.select(
        "lang", "word", "f", (F.col("k") + F.col("nth")).alias("number"), ((F.col("s") + F.col("sum")) / F.col("whole")).alias("at"),
        (F.col("f") / F.col("whole")).alias("wide"), F.ceil(F.col("whole") / RANGE).cast("long").alias("ranges"),
    )


def _range_of(ranges, at1, wide1, at2):
    """Prefix range of a pair: its place if second words were spread alike after every first word. The same expression on columns and arrays."""
    return ranges * (at1 + wide1 * at2)


_FRAGMENT = "lang string, range long, blob binary"


def _fragments(lang: pa.Array, numbers: np.ndarray, at: np.ndarray, wide: np.ndarray, ranges: np.ndarray, local: np.ndarray, stretches: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Count transducers of one shard by language and range. ``lang`` to ``local``: its frequent words."""
    own = struct.unpack_from("<i", stretches[0])[0]
    signed = np.frombuffer(b"".join([stretches[0][4:], *stretches[1:]]), np.int32).astype(np.int64)
    opens, word = signed < 0, np.where(signed < 0, -1 - signed, signed)
    code, langs = numbered(lang)
    order = np.lexsort((numbers, code))
    place = np.full(int(word.max()) + 1, -1)
    place[local[order]] = np.arange(len(order))
    code, numbers, at, wide, ranges = code[order], numbers[order], at[order], wide[order], ranges[order]
    word = place[word]
    bits = max(1, len(order).bit_length())
    joined = (word[:-1] >= 0) & (word[1:] >= 0) & ~opens[1:]
    two = np.flatnonzero(joined[:own])
    three = np.flatnonzero((joined[:-1] & joined[1:])[:own])
    pairs, n = np.unique((word[two] << bits) | word[two + 1], return_counts=True)
    triples, times = np.unique((((word[three] << bits) | word[three + 1]) << bits) | word[three + 2], return_counts=True)
    if not len(pairs):
        return
    of = np.searchsorted(pairs, triples >> bits)
    third = numbers[triples & ((1 << bits) - 1)]
    a, b = pairs >> bits, pairs & ((1 << bits) - 1)
    span = np.floor(_range_of(ranges[a], at[a], wide[a], at[b])).astype(np.int64)
    packed = (numbers[a].astype(np.uint64) << np.uint64(32)) | numbers[b].astype(np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (code[a][1:] != code[a][:-1])]))
    ends = np.append(cuts[1:], len(pairs))
    begin3, end3 = np.searchsorted(of, cuts), np.searchsorted(of, ends)
    rows: tuple[list, list, list] = ([], [], [])
    for i, j, k, m in zip(cuts, ends, begin3, end3):
        made = CountTransducer.build(packed[i:j], n[i:j], of[k:m] - i, third[k:m], times[k:m])
        for column, value in zip(rows, (langs[int(code[a[i]])].as_py(), int(span[i]), made.to_bytes())):
            column.append(value)
    yield pa.record_batch([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["lang", "range", "blob"])


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of all rows of one key after another; the rows come in the order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        at = 0
        columns = [batch.column(k) for k in keys]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        for end in [*(np.flatnonzero(change) + 1), batch.num_rows]:
            if end == at:
                continue
            key = tuple(c[at].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last, at = key, end
    if held:
        yield pa.Table.from_batches(held)


def _shard_transducers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _by_key(batches, ["shard"]):
        told = table.filter(pc.is_null(table["words"])).combine_chunks()
        stretches = table.filter(pc.is_valid(table["words"]))["words"].to_pylist()
        if told.num_rows:
            column = lambda c: told[c].to_numpy()
            yield from _fragments(told["lang"].combine_chunks(), column("number"), column("at"), column("wide"), column("ranges"), column("local"), stretches)


#: Arcs that are united at a time.
_ARCS = 1 << 22


def _united(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for table in _by_key(batches, ["lang", "range"]):
        whole, waiting, arcs = None, [], 0
        blobs = table["blob"]
        for i in range(len(blobs)):
            waiting.append(CountTransducer.from_bytes(blobs[i].as_py()))
            arcs += len(waiting[-1].second) + len(waiting[-1].target)
            if arcs >= _ARCS:
                whole, waiting, arcs = union([*([whole] if whole else []), *waiting]), [], 0
        whole = union([*([whole] if whole else []), *waiting], least)
        if len(whole.second):
            yield pa.record_batch([table["lang"].slice(0, 1).combine_chunks(), table["range"].slice(0, 1).combine_chunks(), pa.array([whole.to_bytes()], pa.binary())], names=["lang", "range", "blob"])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples of the united transducers with the count of their first two words."""
    for batch in batches:
        for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("blob")):
            t = CountTransducer.from_bytes(blob.as_py())
            of, third, n = t.triples()
            pair = t.pairs()[of]
            first, second = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(of), pa.string()), pa.array(first), pa.array(second), pa.array(third), pa.array(n), pa.array(t.second_n[of])], names=["lang", "x", "y", "z", "a", "head"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transducers and the triples that end in their pairs to triples with the count of their last two words (``tail``), and pairs with
    the count of the most frequent triple that they stand in (``inside``)."""
    names = ["lang", "x", "y", "z", "a", "head", "tail", "inside"]
    for table in _by_key(batches, ["lang", "range"]):
        blobs = table.filter(pc.is_valid(table["blob"]))["blob"]
        if not len(blobs):
            continue  # a pair of a triple has a transducer, so nobody asks here
        t = CountTransducer.from_bytes(blobs[0].as_py())
        asked = table.filter(pc.is_null(table["blob"])).combine_chunks()
        x, y, z, a, head = (asked[c].to_numpy() for c in ("x", "y", "z", "a", "head"))
        at = t.places((y.astype(np.uint64) << np.uint64(32)) | z.astype(np.uint64))
        inside = np.zeros(len(t.second), np.int64)
        np.maximum.at(inside, at, a)
        of, _, n = t.triples()
        np.maximum.at(inside, of, n)
        lang = table["lang"][0].as_py()
        many = len(t.second)
        none, pair = pa.nulls(many, pa.int64()), t.pairs()
        columns = [
            pa.array([lang] * (many + len(x)), pa.string()),
            *[pa.concat_arrays([p, pa.array(q)]) for p, q in (
                (pa.array((pair >> np.uint64(32)).astype(np.int64)), x), (pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)), y), (none, z), (pa.array(t.second_n), a),
                (none, head), (none, t.second_n[at]), (pa.array(inside), np.zeros(len(x), np.int64)))],
        ]
        yield pa.record_batch(columns, names=names)


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of two or three words of each language by score: lang, rank, phrase, a, l, r, n, score.

    Counts are over all documents. A phrase with ``a`` occurrences is a candidate from ``least`` on; candidates that a candidate of three
    words contains at least ``inside`` percent as often are dropped. Null text is empty, null lang is ``und``; repeated rows count each; ties
    go by a, then by the phrase's bytes; other columns of any names are not looked at; texts of any length are read whole; an empty table
    gives no rows. Exact for counts below 10**15 and up to 2**32 frequent words in a language.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    with scratch(spark):
        shards = materialise(base.mapInArrow(_shards, _SHARDS), "shards")
        words = shards.where("local >= 0").select("shard", "local", "lang", "word", "n")
        counted = materialise(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
        total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
        known = materialise(frequent_words(counted, least), "known")
        told = words.select("shard", "local", "lang", "word").join(known, ["lang", "word"]).select("shard", "local", "lang", "number", "at", "wide", "ranges", F.lit(None).cast("binary").alias("words"))
        rest = shards.where("local < 0").selectExpr("shard", "local", "cast(null as string)", "cast(null as long)", "cast(null as double)", "cast(null as double)", "cast(null as long)", "words")
        parts = shuffle_partitions(spark)
        both = told.union(rest).repartition(parts, "shard").sortWithinPartitions("shard", "local")
        fragments = both.mapInArrow(_shard_transducers, _FRAGMENT).repartition(parts, "lang", "range").sortWithinPartitions("lang", "range")
        united = materialise(fragments.mapInArrow(lambda b: _united(b, least), _FRAGMENT), "transducers")

        triples = united.mapInArrow(_triples, "lang string, x long, y long, z long, a long, head long")
        y = known.select("lang", F.col("number").alias("y"), "at", "wide", "ranges")
        z = known.select("lang", F.col("number").alias("z"), F.col("at").alias("at_z"))
        asked = triples.join(y, ["lang", "y"]).join(z, ["lang", "z"])
        asked = asked.select("lang", F.floor(_range_of(F.col("ranges"), F.col("at"), F.col("wide"), F.col("at_z"))).alias("range"), F.lit(None).cast("binary").alias("blob"), "x", "y", "z", "a", "head")
        holders = united.selectExpr("lang", "range", "blob", *[f"cast(null as long) as {c}" for c in ("x", "y", "z", "a", "head")])
        met = holders.union(asked).repartition(parts, "lang", "range").sortWithinPartitions("lang", "range")
        met = met.mapInArrow(_composed, "lang string, x long, y long, z long, a long, head long, tail long, inside long")
        candidates = materialise(met.where(F.col("inside") * 100 < F.col("a") * inside), "candidates")

        for c in ("x", "y", "z"):
            candidates = candidates.join(known.select("lang", F.col("number").alias(c), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}")), ["lang", c], "left")
        wide = lambda c: F.col(c).cast("decimal(15,0)")
        score = lambda left, right: F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), wide(left) * wide(right))
        part = lambda left, right: F.struct(score(left, right).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
        early, late = part("f_x", "tail"), part("head", "f_z")
        cut = F.when(F.col("z").isNull(), part("f_x", "f_y")).when(late["score"] < early["score"], late).otherwise(early)
        phrase = F.concat_ws(" ", *[F.col(f"word_{c}").cast("string") for c in ("x", "y", "z")])
        scored = candidates.select("lang", phrase.alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        # First the best of each share of a language, then the best of these.
        order = [F.desc("score"), F.desc("a"), "phrase"]
        share = F.pmod(F.xxhash64("phrase"), F.lit(64))
        best = scored.withColumn("share", share).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("nth") <= top)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return keep(materialise(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS x, NULL AS y, NULL AS z FROM w
  UNION ALL SELECT lang, 2, unnest(w[:-2]), unnest(w[2:]), NULL FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(w[:-3]), unnest(w[2:-2]), unnest(w[3:]) FROM w WHERE len(w) > 2
), f AS (SELECT lang, k, x, y, z, count(*) AS a FROM g GROUP BY ALL),
one AS (SELECT lang, x, a FROM f WHERE k = 1), two AS (SELECT lang, x, y, a FROM f WHERE k = 2 AND a >= 10), three AS (SELECT lang, x, y, z, a FROM f WHERE k = 3 AND a >= 10),
total AS (SELECT lang, sum(a) AS n FROM one GROUP BY lang),
inner2 AS (SELECT lang, x, y, max(a) AS longest FROM (SELECT lang, x, y, a FROM three UNION ALL SELECT lang, y, z, a FROM three) GROUP BY ALL),
c AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.a, i.a AS l, j.a AS r, 1 AS cut FROM two t JOIN one i ON i.lang = t.lang AND i.x = t.x JOIN one j ON j.lang = t.lang AND j.x = t.y
  LEFT JOIN inner2 m ON m.lang = t.lang AND m.x = t.x AND m.y = t.y WHERE coalesce(100 * m.longest < 50 * t.a, true)
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, i.a, j.a, 1 FROM three t JOIN one i ON i.lang = t.lang AND i.x = t.x JOIN two j ON j.lang = t.lang AND j.x = t.y AND j.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, i.a, j.a, 2 FROM three t JOIN two i ON i.lang = t.lang AND i.x = t.x AND i.y = t.y JOIN one j ON j.lang = t.lang AND j.x = t.z
), s AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM b WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM r JOIN total USING (lang) WHERE rank <= 2000
"""
