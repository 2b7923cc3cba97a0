"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes. A text is its words: runs of letters, in lower case, each
with a space before and after it. A byte is predicted from the bytes before it in its word, at most ``order`` of them. A
context predicts what it has been followed by in training, and escapes to the next shorter context with a probability
that grows with the number of different followers (method C); what a longer context would have predicted is
excluded from the shorter ones. The statistics are frozen after training, so the code length of a byte depends
only on the longest known context and the byte, and the tree becomes a table of code lengths and next contexts.

The language whose tree gives the shortest code wins. Each distinct word of a slice of texts is coded once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch
from .hashing import text_slices
from .terms import LETTER, LOWER, distinct, lengths, runs

#: At most so many documents of each language are learned from (more where rows repeat), those with the least hash.
SAMPLE = 2000
#: Bytes of the longest contexts, and how many contexts a language keeps.
ORDER, CONTEXTS = 5, 12_000
#: A longer word counts as several; its contexts begin anew.
LONGEST = 64
_SPACE = 32
_SLICE = 8 << 20


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word, distinct words in lower case, text of each word)."""
    solid = LETTER[data]
    begin, end, doc = runs(solid, starts)
    codes, words = distinct(LOWER[data], solid, begin, end)
    return codes, pc.utf8_lower(words.cast(pa.string())).cast(pa.binary()), doc


def _parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, size, word) of the words cut into parts of at most LONGEST bytes."""
    size = lengths(words)
    words = pa.concat_arrays([words]) if words.offset else words
    _, offsets, data = words.buffers()
    begin = np.frombuffer(offsets, np.int32)[: len(words)].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = np.maximum(1, -(-size // LONGEST))
    of = np.repeat(np.arange(len(size)), k)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    return data, begin[of] + nth * LONGEST, np.minimum(size[of] - nth * LONGEST, LONGEST), of


def _follow_counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, context, symbol, n): how often each byte follows each context, the empty one included."""
    for batch in batches:
        for part, data, starts in text_slices(batch, size=_SLICE):
            langs = part.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            codes, words, doc = _words(data, starts)
            seen, times = np.unique(lang[doc] * max(1, len(words)) + codes, return_counts=True)
            raw, begin, size, of = _parts(words)
            for number in np.unique(seen // max(1, len(words))):
                mine = seen // len(words) == number
                n_of = np.zeros(len(words), np.int64)
                n_of[seen[mine] % len(words)] = times[mine]
                use = np.flatnonzero(n_of[of])
                n = n_of[of[use]]
                # A part with its spaces; position k of it is coded from those before.
                full = size[use] + 2
                at = np.cumsum(full) - full
                text = np.full(full.sum(), _SPACE, np.uint64)
                k = np.arange(len(text)) - np.repeat(at, full)
                inner = (k > 0) & (k < np.repeat(full, full) - 1)
                text[inner] = raw[(np.repeat(begin[use], full) + k - 1)[inner]]
                weight = np.repeat(n, full)
                key, keys, counts = np.zeros(len(text), np.uint64), [], []
                for j in range(order + 1):
                    # The context's j bytes above the symbol, and j on top.
                    if j:
                        key[j:] |= text[:-j] << np.uint64(8 * j)
                    fits = np.flatnonzero(k >= max(1, j))
                    packed = (key[fits] | text[fits]) | np.uint64(j << 56)
                    found, back = np.unique(packed, return_inverse=True)
                    keys.append(found)
                    counts.append(np.bincount(back, weight[fits], len(found)).astype(np.int64))
                keys, counts = np.concatenate(keys), np.concatenate(counts)
                context = (keys >> np.uint64(8)).view(np.int64)
                yield pa.record_batch(
                    [pa.array([langs.dictionary[int(number)].as_py()] * len(keys), pa.string()), pa.array(context), pa.array((keys & np.uint64(255)).astype(np.int32)), pa.array(counts)],
                    names=["lang", "context", "symbol", "n"],
                )


@dataclass
class ContextTree:
    """Frozen statistics of one language: for each context (its length above its bytes) the counts of the bytes after it."""

    contexts: np.ndarray
    counts: dict[str, np.ndarray]  #: parallel arrays context, symbol, n

    def tables(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(code length in bits, next context) by context and symbol class, and the context before a word.

        ``symbols`` maps bytes to classes; class 0 stands for any byte that no tree knows.
        """
        classes = int(symbols.max()) + 1
        contexts = np.sort(np.union1d(self.contexts, [0]))  # the longest have the largest keys
        length, raw = contexts >> 48, contexts & ((1 << 48) - 1)
        place = {int(c): i for i, c in enumerate(contexts)}
        n = np.zeros((len(contexts), classes))
        at = np.searchsorted(contexts, self.counts["context"])
        np.add.at(n, (at, symbols[self.counts["symbol"]]), self.counts["n"])
        seen = n > 0
        total, kinds = n.sum(1), seen.sum(1)
        # A context's parent lacks its first byte.
        parent_key = np.where(length > 0, ((length - 1) << 48) | (raw & ((1 << (8 * np.maximum(length - 1, 0))) - 1)), 0)
        parent = np.searchsorted(contexts, parent_key)
        bits, onward = np.zeros((len(contexts), classes)), np.zeros((len(contexts), classes), np.int32)
        # What a byte costs in the parent's place once the context has escaped; the root escapes to all bytes that it hasn't seen.
        after = np.zeros((len(contexts), classes))
        byte_of = np.full(classes, -1)
        byte_of[symbols[symbols > 0]] = np.flatnonzero(symbols > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            for size in range(int(length.max()) + 1):
                me = np.flatnonzero(length == size)
                if size == 0:
                    after[0] = np.log2(max(1, 256 - kinds[0]))
                else:
                    up = parent[me]
                    rest = np.where(seen[me], 0, n[up]).sum(1)
                    new = (kinds[up] - kinds[me]).astype(float)
                    whole = (rest + new)[:, None]
                    there = -np.log2(n[up] / whole)
                    beyond = -np.log2(new[:, None] / whole) + after[up]
                    # A parent that has seen nothing more is passed by without cost.
                    after[me] = np.where(new[:, None] == 0, after[up], np.where(seen[up], there, beyond))
                whole = (total[me] + kinds[me])[:, None]
                bits[me] = np.where(seen[me], -np.log2(n[me] / whole), np.where(whole > 0, -np.log2(kinds[me][:, None] / whole), 0) + after[me])
                if size:
                    onward[me] = onward[parent[me]]
                for i in me:
                    # At most one entry for each context of the next length.
                    for c in np.flatnonzero(seen[i]):
                        longer = place.get(((size + 1) << 48) | (int(raw[i]) << 8) | int(byte_of[c])) if byte_of[c] >= 0 else None
                        if longer is not None:
                            onward[i, c] = longer
        return bits, onward, place.get((1 << 48) | _SPACE, 0)


@dataclass
class LanguageModel:
    """The trees of all learned languages, in order of their names."""

    langs: list[str]
    trees: list[ContextTree]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def symbols(self) -> np.ndarray:
        """Class of each byte; 0: no tree knows it."""
        known = np.zeros(256, bool)
        for tree in self.trees:
            known[tree.counts["symbol"]] = True
        return np.where(known, np.cumsum(known), 0)


#: The tables of the model that a worker used last.
_READY: dict[str, tuple] = {}


def _tables(model: LanguageModel) -> tuple:
    if model.key not in _READY:
        _READY.clear()
        symbols = model.symbols()
        _READY[model.key] = (symbols, [t.tables(symbols) for t in model.trees])
    return _READY[model.key]


def code_lengths(words: pa.Array, model: LanguageModel) -> np.ndarray:
    """Bits of each word (rows) in each language (columns), the space after it included."""
    symbols, tables = _tables(model)
    raw, begin, size, of = _parts(words)
    order = np.argsort(-size, kind="stable")
    begin, size, of = begin[order], size[order], of[order]
    out = np.zeros((len(words), len(tables)))
    states = [np.full(len(of), start, np.int32) for _, _, start in tables]
    sums = [np.zeros(len(of)) for _ in tables]
    for k in range(int(size[0]) + 1 if len(size) else 0):
        active, inside = np.searchsorted(-size, -k, "right"), np.searchsorted(-size, -k, "left")
        symbol = np.full(active, symbols[_SPACE])
        symbol[:inside] = symbols[raw[begin[:inside] + k]]
        for i, (bits, onward, _) in enumerate(tables):
            cell = states[i][:active].astype(np.int64) * bits.shape[1] + symbol
            sums[i][:active] += bits.ravel()[cell]
            states[i][:active] = onward.ravel()[cell]
    for i, s in enumerate(sums):
        np.add.at(out[:, i], of, s)
    return out


def predictor(model: LanguageModel):
    """Column function: text to (lang, score). The score is the winner's share of the probability of the text; of equal code lengths
    the first language's name wins."""

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for _, data, starts in text_slices(pa.record_batch([texts], names=["text"]), size=_SLICE):
            codes, words, doc = _words(data, starts)
            bits = code_lengths(words, model)
            total = np.zeros((len(starts) - 1, len(model.langs)))
            if len(codes):
                at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                total[doc[at]] = np.add.reduceat(bits[codes], at, axis=0)
            best = total.argmin(1)
            share = 1 / np.exp2(np.minimum(0, total.min(1, keepdims=True) - total)).sum(1)
            langs += [model.langs[b] for b in best]
            scores += share.tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE, order: int = ORDER, contexts: int = CONTEXTS) -> LanguageModel:
    """Trees of the languages in ``docs``; rows with a null text or language teach nothing.

    Of each language at most ``sample`` documents are read (more only where rows repeat), with their whole texts, those with the least hash of the text. Spark
    counts what follows each context; of each language the ``contexts`` most frequent contexts come to the driver.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must lie between 1 and 6")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    bound = rows.select("lang", "hash").withColumn("nth", nth).where(F.col("nth") <= sample).groupBy("lang").agg(F.max("hash").alias("bound"))
    spark = docs.sparkSession
    # One row a language, as the model has one tree.
    told = sorted((tuple(r) for r in bound.collect()), key=lambda r: r[0].encode())
    langs = [lang for lang, _ in told]
    with scratch(spark):
        some = rows.join(F.broadcast(spark.createDataFrame(told, "lang string, bound long")), "lang").where("hash <= bound").select("lang", "text")
        counts = some.mapInArrow(lambda b: _follow_counts(b, order), "lang string, context long, symbol int, n long")
        counts = materialise(counts.groupBy("lang", "context", "symbol").agg(F.sum("n").alias("n")), "follow-counts")
        # A context's parent is at least as frequent and shorter, so it is kept with it.
        most = counts.groupBy("lang", "context").agg(F.sum("n").alias("n"))
        most = most.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "context"))).where(F.col("nth") <= contexts)
        got = counts.join(most.select("lang", "context"), ["lang", "context"]).orderBy("lang", "context", "symbol").toArrow()
    trees, names = [], got["lang"].to_numpy(zero_copy_only=False)
    for lang in langs:
        mine = names == lang
        cols = {c: got[c].to_numpy(zero_copy_only=False)[mine] for c in ("context", "symbol", "n")}
        trees.append(ContextTree(np.unique(cols["context"]), cols))
    return LanguageModel(langs, trees)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", unknown: str = "und") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); columns of these names are replaced.

    A null text, one without a letter, and any text under a model of no language are ``unknown`` with score 0. Whole texts are
    read, of any length; nothing but the text is looked at, so ids may be null or repeat; an empty table gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    text = F.col(f"`{text_col}`")
    if not model.langs:
        return docs.select(*columns, F.lit(unknown).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = predictor(model)(text)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    pair = F.when(letters, found).otherwise(F.struct(F.lit(unknown).alias("lang"), F.lit(0.0).alias("score")))
    n = len(columns)
    plain = docs.select(*columns, pair).toDF(*[f"c{i}" for i in range(n + 1)])
    return plain.select(*[f"c{i}" for i in range(n)], f"c{n}.lang", f"c{n}.score").toDF(*[c for c in docs.columns if c not in ("lang_pred", "score")], "lang_pred", "score")


def held_out(id_column: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5. A null id counts as an empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
