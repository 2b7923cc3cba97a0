"""Word lists as tables: as many forms as there are, found by joins instead of one expression.

A text is cut into runs of word characters and what lies between. Runs next to each other, up to as many as the longest form
has, make a key that is joined to the keys of the forms; only what meets runs the one expression of its form,
at its place. So the list is never compiled, sent to tasks as a whole or held by the driver; tasks get a bitmap of fixed size with the
places of its keys, and make strings only of the keys that it lets through. Which of several
overlapping hits stay is told as by a matcher that goes from left to right (``match_lexicon``), by chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stores import keep, materialise, scratch
from .chains import reached
from .lexicon import LAST_MARK, PHRASE_GAP, WORD_GAP, surface_key

def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def form_table(lexicon: DataFrame) -> DataFrame:
    """One row for each enabled form of ``lexicon`` (canonical, category, forms, is_phrase, enabled): key, pattern, runs (of word characters), lead (characters
    before the first run), inner and tail (most characters between runs, and after the last), rank (the matcher's order), canonical, category.

    A form without a word character is an error, as no text has a key for it."""
    entries = lexicon.where(F.col("enabled") & (F.size("forms") > 0)).withColumn("longest", F.array_max(F.transform("forms", F.length)))
    rows = entries.select("canonical", "category", "is_phrase", "longest", F.explode(F.array_distinct("forms")).alias("form"))
    parts = F.split(F.trim(F.regexp_replace("form", r"(?U)[\s'’-]+", " ")), " ")
    rows = rows.withColumn("parts", parts).withColumn("runs", F.size(_matches(F.col("form"), r"(?U)\w+")))
    rows = rows.where(F.when(F.col("runs") == 0, F.raise_error(F.concat(F.lit("the word list has a form without letters: "), F.col("form"))).cast("boolean")).otherwise(True))
    quoted = F.transform("parts", lambda p: F.regexp_replace(p, r"([\\.^$|?*+()\[\]{}])", r"\\$1"))
    phrase = F.col("is_phrase") & (F.size("parts") > 1)
    tail = F.when(~phrase & F.col("form").rlike("['’]$"), LAST_MARK).otherwise("")
    pattern = F.concat(F.when(phrase, F.array_join(quoted, PHRASE_GAP)).otherwise(F.array_join(quoted, WORD_GAP)), tail)
    between = F.transform(_matches(F.col("form"), r"(?U)(?<=\w)\W+(?=\w)"), lambda g: F.length(g))
    return rows.select(
        F.regexp_replace(surface_key(F.col("form")), r"(?U)\W", "").alias("key"), pattern.alias("pattern"), "runs",
        F.length(F.regexp_extract(F.element_at("parts", 1), r"(?U)^(\W*)", 1)).alias("lead"), F.coalesce(F.array_max(between), F.lit(0)).alias("inner"),
        F.length(F.regexp_extract("form", r"(?U)(\W*)$", 1)).alias("tail"), F.struct(-F.col("longest"), "canonical", -F.length("form"), "form").alias("rank"), "canonical", "category",
    )


#: Places of the bitmap of keys, 2 MB: where it fills up, more keys travel and results stay the same.
PLACES_BITS = 24
#: Texts that are cut into keys at a time, and words whose hashes a task remembers.
TEXTS, WORDS = 256, 1 << 18
_BASE, _MIX, _ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def _hashes(words: list[str], known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and the factor for what stands before it: that of two words in one is h(x) * f(y) + h(y)."""
    if len(known) > WORDS:
        known.clear()
    for w in words:
        if w not in known:
            h, f = 0, 1
            for c in w:
                h, f = (h * _BASE + ord(c) + 1) & _ALL, f * _BASE & _ALL
            known[w] = h, f
    found = np.array([known[w] for w in words], np.uint64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(_MIX) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)


def _key_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(_places(_hashes(batch.column(0).to_pylist(), {})[0]))], names=["place"])


def _bitmap(forms: DataFrame):
    """Broadcast bitmap with the places of the keys of ``forms``."""
    places = forms.select("key").distinct().mapInArrow(_key_places, "place long")
    rows = places.groupBy(F.expr("place div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
    field = np.zeros((1 << PLACES_BITS) // 64, np.int64)
    field[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return forms.sparkSession.sparkContext.broadcast(field.view(np.uint64))


def _grams(batches: Iterator[pa.RecordBatch], keys: int, most: int, apart: int, after: int, lead: int, bitmap) -> Iterator[pa.RecordBatch]:
    """Texts as pieces (the key's columns, _p, _f: folded, _odd: where the first run of word characters is) to the keys of 1 to ``most`` runs
    that the bitmap lets through: the key's columns, begin, before, _key, core, after."""
    known: dict[str, tuple[int, int]] = {}

    def of(values: pa.Array, at: np.ndarray, there: np.ndarray) -> pa.Array:
        return pc.fill_null(values.take(pa.array(at, mask=~there)), "")

    for batch in batches:
        for low in range(0, batch.num_rows, TEXTS):
            part = batch.slice(low, TEXTS)
            pieces, folded = (part.column(c).flatten() for c in ("_p", "_f"))
            pieces = pieces.cast(pa.string())
            size = pc.list_value_length(part.column("_p")).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, first = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size) - size, size)
            place, length = np.arange(len(doc)) - first, pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(length) - length
            begin = begin - begin[first] if len(first) else begin
            words = folded.dictionary_encode()
            h, f = (x[words.indices.to_numpy(zero_copy_only=False)] for x in _hashes(words.dictionary.to_pylist(), known))
            from_odd = place - np.repeat(part.column("_odd").to_numpy(zero_copy_only=False), size)
            at = np.flatnonzero((from_odd >= 0) & (from_odd % 2 == 0))
            name = h[at]
            for k in range(1, most + 1):
                end = at + 2 * k - 2
                if k > 1:
                    there = place[at] + 2 * k - 2 < size[doc[at]]
                    at, name, end = at[there], name[there], end[there]
                    there = length[end - 1] <= apart
                    at, name, end = at[there], name[there], end[there]
                    name = name * f[end] + h[end]
                spot = _places(name)
                hit = (bitmap.value[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                a, e = at[hit], end[hit]
                if not len(a):
                    continue
                last = size[doc[a]] + first[a]
                join = lambda values, step: pc.binary_join_element_wise(*[values.take(pa.array(a + j)) for j in range(0, 2 * k - 1, step)], "")  # noqa: B023, E731
                rest, beyond = of(pieces, e + 1, e + 1 < last), of(pieces, e + 2, e + 2 < last)
                # What follows decides whether the hit ends here; of a long stretch its beginning is enough.
                more = pc.if_else(pc.less(pc.utf8_length(rest), after), pc.utf8_slice_codeunits(beyond, 0, 1), "")
                ends = pc.binary_join_element_wise(pc.utf8_slice_codeunits(rest, 0, after), more, "")
                ahead = pc.binary_join_element_wise(pc.if_else(pa.array(place[a] > 1), "w", ""), of(pieces, a - 1, place[a] > 0), "")
                mine = [c.take(pa.array(doc[a])) for c in part.columns[:keys]]
                told = [pa.array(begin[a].astype(np.int32)), pc.utf8_slice_codeunits(ahead, -lead - 1), join(folded.cast(pa.string()), 2), join(pieces, 1), ends]
                yield pa.record_batch([*mine, *told], names=[*part.schema.names[:keys], "begin", "before", "_key", "core", "after"])


def candidates(df: DataFrame, text: str, forms: DataFrame, key: list[str]) -> DataFrame:
    """All hits of single forms in ``df``, overlapping ones too: the columns of ``key``, char_start, char_end, word_raw, rank, canonical, category."""
    # Six numbers about the list; none grows with it.
    most, lead, inner, tail = forms.agg(F.max("runs"), F.max("lead"), F.max("inner"), F.max("tail")).first()
    if most is None:
        none = {"char_start": "int", "char_end": "int", "word_raw": "string"} | {c: forms.schema[c].dataType for c in ("rank", "canonical", "category")}
        return df.limit(0).select(*key, *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])
    apart, after = max(3, inner), max(1, tail) + 1
    cut = df.where(F.col(text) != "").select(*key, _matches(F.col(text), r"(?U)\w+|\W+").alias("_p"), F.contains(F.col(text), F.lit("\0")).alias("_nul"))
    # The pieces are folded as one string; a text that has the character between them goes piece by piece.
    folded = F.transform("_p", lambda x: F.lower(F.translate(F.upper(F.translate(x, "’ İ", "' i")), "Σ", "σ")))
    whole = F.array_join("_p", "\0")
    for x, y in zip("’\u0020İ", "' i"):
        whole = F.replace(whole, F.lit(x), F.lit(y))
    whole = F.lower(F.replace(F.upper(whole), F.lit("Σ"), F.lit("σ")))
    folded = F.when(F.col("_nul"), folded).otherwise(F.split(whole, "\0"))
    # Runs and what is between them take turns.
    cut = cut.withColumn("_f", folded).withColumn("_odd", F.when(F.col("_p")[0].rlike(r"(?U)^\w"), 0).otherwise(1))
    bitmap, kinds = _bitmap(forms), T.StructType([*df.select(*key).schema.fields, *T.StructType.fromDDL("begin int, before string, _key string, core string, after string").fields])
    grams = cut.mapInArrow(lambda b: _grams(b, len(key), most, apart, after, lead, bitmap), kinds)
    met = grams.join(forms.withColumnRenamed("key", "_key"), "_key")
    # Before a form that begins with a mark there must be no word character.
    free = (F.col("lead") == 0) | (F.length("before") >= F.col("lead")) & ~F.substr(F.col("before"), F.length("before") - F.col("lead"), F.lit(1)).rlike(r"(?U)^\w")
    there = F.concat(F.right("before", F.col("lead")), "core", "after")
    said = F.call_function("regexp_extract", there, F.concat(F.lit("(?iuU)^("), F.col("pattern"), F.lit(r")(?!\w)")), F.lit(1))
    hits = met.where(free).withColumn("word_raw", said).where("word_raw != ''").withColumn("char_start", F.col("begin") - F.col("lead"))
    return hits.select(*key, "char_start", (F.col("char_start") + F.length("word_raw")).alias("char_end"), "word_raw", "rank", "canonical", "category")


def leftmost(hits: DataFrame, key: list[str]) -> DataFrame:
    """Of ``hits`` (key, char_start, char_end, no two with one start) those that stay when a text is read from left to right and hits don't overlap."""
    order = Window.partitionBy(*key).orderBy("char_start")
    opens = F.col("char_start") >= F.coalesce(F.max("char_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parted = hits.withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*key, "_island")
    parted = parted.withColumn("idx", (F.row_number().over(island.orderBy("char_start")) - 1).cast("long")).withColumn("_n", F.count("*").over(island))
    parted = materialise(parted.drop("_opens"), "islands")
    # Of one hit, or of two that overlap, the first stays. Longer islands are chains.
    few = parted.where("_n < 3 and idx = 0")
    many = parted.where("_n > 2")
    group = [*key, "_island"]
    points = many.select(*group, F.col("char_start").alias("_at"), F.col("idx").alias("_to"), F.lit(None).cast("long").alias("_of"))
    asks = many.select(*group, F.col("char_end").alias("_at"), F.lit(None).cast("long").alias("_to"), F.col("idx").alias("_of"))
    from_here = Window.partitionBy(*group).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    linked = points.union(asks).withColumn("next", F.min("_to").over(from_here)).where("_of is not null").select(*group, F.col("_of").alias("idx"), "next")
    stay = reached(linked, group)
    return few.union(many.join(stay, [*group, "idx"]).select(*few.columns)).select(*hits.columns)


def match_table(df: DataFrame, text: str, lexicon: DataFrame, key: list[str]) -> DataFrame:
    """One row per hit: the columns of ``key``, char_start, char_end, word_raw, canonical, category; the hits of ``match_lexicon``.

    ``lexicon`` is a table (canonical, category, forms, is_phrase, enabled) of any size. ``key`` names columns without nulls that tell the rows of ``df`` apart;
    they have other names than the result's. Null and empty texts have no hits. A key that many rows have (a common word) is
    joined to a few forms, so adaptive execution can split it; of a form with a hundred thousand owners all are tried.
    """
    with scratch(df.sparkSession):
        forms = materialise(form_table(lexicon), "forms")
        found = candidates(df, text, forms, key)
        best = found.groupBy(*key, "char_start").agg(F.min(F.struct("rank", "category", "char_end", "word_raw", "canonical")).alias("b"))
        hits = best.select(*key, "char_start", "b.char_end", "b.word_raw", "b.canonical", "b.category")
        return keep(materialise(leftmost(hits, key), "lexicon-hits"))
