"""Source divergence audit: which sources of a language use its words differently.

Which terms a language keeps is found by iceberg prefix refinement. Texts become, slice by slice, a table with one
row for each term of a language in the slice. For every width 6, 12, 24, ... below its length, the row says in how
many documents the term is the first of those with its prefix of that width; so the distinct documents of
a prefix are a plain sum over the rows that begin with it, combined before it is shuffled. Level by level, prefixes in too few documents go,
and with them all the rows below them; the others are extended, until only complete terms are left.

Divergences compare groups term by term, also where a term is missing in one of them. The sum over all terms is taken apart into
what both groups lack, what one has (a histogram of counts for each group), and a correction for the
terms that both have, so that only pairs of sources that share a term are looked at. All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, materialise, release, scratch
from .hashing import text_slices
from .terms import LETTER, LOWER, distinct, in_order, lengths, numbered, runs

#: Bytes of text that make one slice of the term table.
SLICE = 16 << 20
#: Bytes of the first prefixes; each level doubles them.
FIRST = 6
#: Pairs of sources that are compared at a time.
PAIRS = 1 << 20
SCALE = 1_000_000_000
_TERMS = "lang string, term binary, docs long, firsts array<long>, sources array<string>, counts array<long>"


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _term_rows(batches: Iterator[pa.RecordBatch], first: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of texts to rows of _TERMS."""
    for batch in batches:
        for part, data, starts in text_slices(batch, size=size):
            solid = LETTER[data]
            begin, end, doc = runs(solid, starts)
            if not len(begin):
                continue
            term, words = in_order(*distinct(LOWER[data], solid, begin, end))
            lang, langs = numbered(part.column("lang"))
            source, sources = numbered(part.column("source"))
            n_words, size_of = len(words), lengths(words)
            # Pairs of document and term, in order.
            pair, times = np.unique(doc * n_words + term, return_counts=True)
            doc, term = pair // n_words, pair % n_words
            kinds, kind = np.unique(lang[doc] * n_words + term, return_inverse=True)
            word = kinds % n_words
            widths = [first << j for j in range(64) if first << j < size_of.max()]
            firsts = np.zeros((len(kinds), len(widths)), np.int64)
            for j, width in enumerate(widths):
                long = size_of > width
                prefixes = pc.binary_slice(words.filter(pa.array(long)), 0, width)
                new = np.ones(len(prefixes), bool)
                new[1:] = pc.not_equal(prefixes[1:], prefixes[:-1]).to_numpy(zero_copy_only=False)
                prefix = np.zeros(n_words, np.int64)
                prefix[long] = np.cumsum(new)
                there = np.flatnonzero(long[term])
                d, p = doc[there], prefix[term[there]]
                opens = np.ones(len(there), bool)
                opens[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
                firsts[:, j] = np.bincount(kind[there[opens]], minlength=len(kinds))
            has = np.array(widths, np.int64)[None, :] < size_of[word][:, None]
            by = kind * len(sources) + source[doc]
            order = np.argsort(by, kind="stable")
            by = by[order]
            at = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            each = np.add.reduceat(times[order], at)
            where = np.searchsorted(by[at] // len(sources), np.arange(len(kinds) + 1))
            yield pa.record_batch(
                [
                    langs.take(pa.array(kinds // n_words)), words.take(pa.array(word)), pa.array(np.bincount(kind, minlength=len(kinds))),
                    _lists(pa.array(firsts[has]), np.concatenate([[0], np.cumsum(has.sum(1))])),
                    _lists(sources.take(pa.array(by[at] % len(sources))), where), _lists(pa.array(each), where),
                ],
                names=["lang", "term", "docs", "firsts", "sources", "counts"],
            )


def term_table(docs: DataFrame, first: int = FIRST, size: int = SLICE) -> DataFrame:
    """Rows of _TERMS of ``docs`` (lang, source, text; no nulls): one for each term of a language in each slice."""
    return docs.select("lang", "source", "text").mapInArrow(lambda b: _term_rows(b, first, size), _TERMS)


def iceberg_terms(table: DataFrame, least: int, first: int = FIRST) -> DataFrame:
    """(lang, term) of those terms of ``table`` that stand in at least ``least`` documents of the language."""
    live, found, level, width = table.select("lang", "term", "docs", "firsts"), [], 0, first
    while True:
        whole = F.length("term") <= width
        prefix = F.substring("term", 1, width)
        n = F.sum(F.when(F.col("whole"), F.col("docs")).otherwise(F.get("firsts", F.lit(level))))
        sums = live.withColumn("whole", whole).groupBy("lang", "whole", prefix.alias("prefix")).agg(n.alias("n"))
        alive = materialise(sums.where(F.col("n") >= least).drop("n"), "prefixes")
        found.append(alive.where("whole").select("lang", F.col("prefix").alias("term")))
        longer = alive.where("not whole").select("lang", "prefix")
        if not longer.limit(1).count():
            break
        rest = live.where(~whole).withColumn("prefix", prefix).join(longer, ["lang", "prefix"], "left_semi").drop("prefix")
        before, live = live, materialise(rest, "live-terms")
        if level:
            release(before)
        level, width = level + 1, 2 * width
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / whole) by long division, three digits at a time: exact while ``whole`` is below 9 * 10**15."""
    rest, out = n + 1, F.lit(1).cast("long")
    for scale in (SCALE // 1000, SCALE // 1_000_000, 1):
        out = out + F.call_function("div", rest * 1000, whole) * scale
        rest = F.pmod(rest * 1000, whole)
    return out


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the list of their sources to what each pair of sources gets on top for terms that both have."""
    for batch in batches:
        lang, langs = numbered(batch.column("lang"))
        lists = batch.column("sources")
        flat = lists.flatten()
        source, sources = numbered(flat.field("source"))
        p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        # Each entry meets the others of its list; a stretch of entries at a time.
        of = np.repeat(np.arange(len(size)), size)
        work = np.cumsum(size[of])
        at = 0
        while at < len(of):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, "right")))
            k = size[of[at:to]]
            a = np.repeat(np.arange(at, to), k)
            b = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + begin[of[a]]
            a, b = a[a != b], b[a != b]
            more = _apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b])
            key = (lang[of[a]] * len(sources) + source[a]) * len(sources) + source[b]
            keys, back = np.unique(key, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, back, more)
            one, other = keys // len(sources), keys % len(sources)
            yield pa.record_batch(
                [langs.take(pa.array(one // len(sources))), sources.take(pa.array(one % len(sources))), sources.take(pa.array(other)), pa.array(sums)],
                names=["lang", "source", "item", "value"],
            )
            at = to


def _own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups with their histogram and the other groups of the language to what each pair gets without regard to shared terms."""
    for batch in batches:
        for row in batch.to_pylist():
            others = [x for x in row["others"] if x["source"] != row["source"]]
            if not others:
                continue
            p = np.array([x["p"] for x in row["histogram"]], np.int64)[:, None]
            k = np.array([x["terms"] for x in row["histogram"]], np.int64)[:, None]
            q0, p0 = np.array([x["p0"] for x in others], np.int64), row["p0"]
            none = _apart(np.int64(p0), q0)
            mine = (k * (_apart(p, q0) - none)).sum(0) + row["v"] * none
            back = _apart(q0, np.int64(p0))
            theirs = (k * (_apart(q0, p) - back)).sum(0)
            names, me, n = [x["source"] for x in others], row["source"], len(others)
            yield pa.record_batch(
                [pa.array([row["lang"]] * 2 * n, pa.string()), pa.array([me] * n + names, pa.string()), pa.array(names + [me] * n, pa.string()), pa.array(np.concatenate([mine, theirs]))],
                names=["lang", "source", "item", "value"],
            )


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row (lang, source, part, item, value, rank) for each comparison.

    Part ``pair``: each other source of the language with the divergence of the group from it, all of them. Part ``term``: the
    ``top`` terms that the group uses more than its language does. Null lang, source and text are read as empty ones; groups without
    terms and languages without kept terms are compared too (0 there); rows that repeat are documents of their own; texts of any length
    are read whole; other columns of any names are not looked at; an empty table gives no rows. Exact while a group has fewer than
    9 * 10**15 occurrences. A result row for each pair of a language's sources is what is asked for, so one row holds no more than a term's sources.
    """
    spark = docs.sparkSession
    base = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    with scratch(spark):
        table = materialise(term_table(base), "terms")
        kept = materialise(iceberg_terms(table, least), "kept-terms")
        # One row a term: its sources and how often each has it.
        rows = table.select("lang", "term", "sources", "counts").join(kept, ["lang", "term"])
        rows = rows.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
        counts = materialise(rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n")), "term-counts")
        vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
        used = counts.groupBy("lang", "source").agg(F.sum("n").alias("used"))
        groups = base.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        groups = groups.select("lang", "source", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("v", F.lit(0)).alias("v"))
        # Without kept terms nothing is divided; the one in place of zero keeps the expression whole.
        groups = materialise(groups.withColumn("whole", F.greatest(F.col("used") + F.col("v"), F.lit(1))).withColumn("p0", _share(F.lit(0).cast("long"), F.col("whole"))), "groups")
        mine = counts.join(groups.select("lang", "source", "whole", "p0"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("whole")))
        mine = materialise(mine.select("lang", "term", "source", "n", "p", "p0"), "shares")

        shared = mine.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("sources")).where(F.size("sources") > 1)
        pair = "lang string, source string, item string, value long"
        together = shared.select("lang", "sources").mapInArrow(_shared_terms, pair)
        histogram = mine.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("histogram"))
        others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
        own = groups.join(histogram, ["lang", "source"], "left").join(others, "lang")
        own = own.select("lang", "source", "v", "p0", F.coalesce("histogram", F.array().cast("array<struct<p:bigint,terms:bigint>>")).alias("histogram"), "others").mapInArrow(_own_terms, pair)
        pairs = own.union(together).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

        whole = groups.groupBy("lang").agg(F.greatest(F.sum("used") + F.max("v"), F.lit(1)).alias("lang_whole"))
        lang_counts = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(whole, "lang").select("lang", "term", _share(F.col("lang_n"), F.col("lang_whole")).alias("q"))
        terms = mine.join(lang_counts, ["lang", "term"]).where("p > q")
        terms = terms.select("lang", "source", F.col("term").cast("string").alias("item"), F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))

        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        best = terms.withColumn("rank", rank).where(F.col("rank") <= top)
        columns = ["lang", "source", "part", "item", "value", "rank"]
        out = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns).union(best.withColumn("part", F.lit("term")).select(*columns))
        return keep(materialise(out, "divergence"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS used FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.used + v.v)::HUGEINT AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
         GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1)::HUGEINT // (u.used + any_value(v.v))::HUGEINT AS q
      FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(used) AS used FROM g GROUP BY lang) u USING (lang) GROUP BY lang, term, u.used),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
      UNION ALL
      SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
