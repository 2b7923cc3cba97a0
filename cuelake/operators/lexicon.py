"""Word lists against text: compile, match, attribute, override, redact, check."""

from __future__ import annotations

import bisect
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import detect_censored, fold, fold_text, joined_pieces, mask_text, touched_words
from .intervals import bucketed

_OPEN, _CLOSE = "\u0001", "\u0002"


#: What may stand between the words of a phrase, between the parts of a word, and after a word that ends in an apostrophe.
PHRASE_GAP = "[ \\t\\u00a0'’-]{1,3}"
WORD_GAP = "['’-]?"
LAST_MARK = "['’]?"
_GAPS = re.compile(r"[\s'’-]+")


def form_parts(form: str) -> list[str]:
    """What a form is made of once spaces, hyphens and apostrophes are cut out."""
    parts = _GAPS.sub(" ", form).split()
    if not parts:
        raise ValueError(f"the word list has a form of separators only: {form!r}")
    return parts


def form_pattern(form: str, is_phrase: bool) -> str:
    """A form as a regular expression: a word may be written together or with one mark where the form has a gap, the
    words of a phrase stand one to three separators apart."""
    parts = [re.escape(p) for p in form_parts(form)]
    phrase = is_phrase and len(parts) > 1
    tail = LAST_MARK if not phrase and form.endswith(("'", "’")) else ""
    return (PHRASE_GAP if phrase else WORD_GAP).join(parts) + tail


def ranked_forms(entries: list[tuple]) -> list[tuple[str, str, str, str]]:
    """(key, pattern, canonical, category) of the enabled forms in the order in which a matcher tries them: entries by
    their longest form, then by name; an entry's own forms from long to short."""
    longest_first = sorted((e for e in entries if e[4] and e[2]), key=lambda e: (-max(len(f) for f in e[2]), e[0]))
    return [
        (_letters(form), form_pattern(form, is_phrase), canonical, category)
        for canonical, category, forms, is_phrase, _ in longest_first
        for form in sorted(set(forms), key=lambda f: (-len(f), f))
    ]


def compile_lexicon(entries: list[tuple]) -> str | None:
    """One alternation for a matcher; None if there is nothing to match."""
    patterns = [pattern for _, pattern, _, _ in ranked_forms(entries)]
    return "(?iuU)(?<!\\w)(?:" + "|".join(patterns) + ")(?!\\w)" if patterns else None


def _letters(form: str) -> str:
    return "".join(form_parts(form.replace("İ", "i").upper().lower().replace("ς", "σ")))


def surface_key(c: Column) -> Column:
    """What a hit and a form are compared by: letters without any separators. Upper case comes
    first, so that letters which the matcher takes for one another (long s, Kelvin sign, dotted I, final sigma) have one key.
    Spark drops an upper() right below a lower()."""
    return F.regexp_replace(F.lower(F.translate(F.upper(F.translate(c, "’ İ", "' i")), "Σ", "σ")), "[\\s\\u00a0'-]+", "")


def form_owners(entries: list[tuple], spark: SparkSession) -> DataFrame:
    """(key, forms): the forms with these letters as (pattern, canonical, category), in the order of the matcher."""
    owners: dict[str, list[tuple]] = {}
    for key, pattern, canonical, category in ranked_forms(entries):
        owners.setdefault(key, []).append((pattern, canonical, category))
    return spark.createDataFrame(list(owners.items()), "key string, forms array<struct<pattern:string,canonical:string,category:string>>")


def word_forms(entries: list[tuple], spark: SparkSession) -> DataFrame:
    """(form, canonical, category): the folded forms of enabled entries that are no phrases, each once, of its first owner."""
    first: dict[str, tuple] = {}
    for key, _, canonical, category in ranked_forms([e for e in entries if not e[3]]):
        first.setdefault(key, (key, canonical, category))
    return spark.createDataFrame(list(first.values()), "form string, canonical string, category string")


def match_lexicon(df: DataFrame, text: str, entries: list[tuple]) -> DataFrame:
    """One row per hit: the columns of ``df``, char_start, char_end, word_raw, canonical, category.

    Hits are leftmost, don't overlap and stand between non-word characters; case doesn't count. The word
    list comes as a Python list, is compiled to one expression and runs in the JVM. A hit belongs to the first form
    of the matcher's order that it matches as a whole; forms that share its letters, however they are parted, come
    into question. Input columns may have any name but those of the new ones.
    """
    pattern = compile_lexicon(entries)
    if pattern is None:
        return df.limit(0).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("char_start", "int"), ("char_end", "int"), ("word_raw", "string"), ("canonical", "string"), ("category", "string"))])
    cut = df.where(F.col(text).rlike(pattern)).withColumn("_hit", F.explode(_hit_list(text, pattern)))
    hits = cut.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_hit.a").alias("char_start"), F.col("_hit.b").alias("char_end"), F.col("_hit.w").alias("word_raw"))
    return _owned(hits, entries)


def _hit_list(text: str, pattern: str) -> Column:
    """Array of the hits of a text (a, b: from where to where, w). Marks in the text itself become another control character, which parts words as they do and is no gap in a phrase."""
    marked = F.regexp_replace(F.translate(F.col(text), _OPEN + _CLOSE, "\u0003\u0003"), pattern, f"{_OPEN}$0{_CLOSE}")
    return _hits_of(F.split(marked, f"[{_OPEN}{_CLOSE}]"))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("w", T.StringType())])))
def _hits_of(pieces: pa.Array) -> pa.Array:
    """Every other piece of a text is a hit."""
    size = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pieces.flatten()
    long = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    done = np.concatenate([[0], np.cumsum(long)])
    hit = (np.arange(len(long)) - np.repeat(begin, size)) % 2 == 1
    a = (done[:-1] - np.repeat(done[begin], size))[hit].astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(a), pa.array((a + long[hit]).astype(np.int32)), flat.filter(pa.array(hit))], ["a", "b", "w"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size // 2)]), pa.int32()), found)


def _owned(hits: DataFrame, entries: list[tuple]) -> DataFrame:
    """``hits`` with the canonical and category of the first form that matches word_raw as a whole."""
    spark = hits.sparkSession
    # The owners are as many as the forms that the caller listed.
    owners = F.broadcast(form_owners(entries, spark).select(F.col("key").alias("_owner_key"), F.col("forms").alias("_forms")))
    hits = hits.withColumn("_key", surface_key(F.col("word_raw"))).join(owners, F.col("_key") == F.col("_owner_key"))
    whole = F.filter("_forms", lambda x: F.rlike(F.col("word_raw"), F.concat(F.lit("^(?iuU)(?:"), x["pattern"], F.lit(")$"))))
    owner = F.when(F.size("_forms") > 1, F.get(whole, F.lit(0))).otherwise(F.col("_forms")[0])
    return hits.select("*", owner["canonical"].alias("canonical"), owner["category"].alias("category")).drop("_key", "_owner_key", "_forms")


def find_hits(cues: DataFrame, entries: list[tuple]) -> DataFrame:
    """Hits in cues with times in proportion to their place in the text. Times are whole milliseconds."""
    hits = match_lexicon(cues, "text", entries)
    at = lambda c: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * F.col(c) / F.length("text"))
    return hits.withColumn("hit_start_ms", at("char_start")).withColumn("hit_end_ms", at("char_end"))


def select_entries(lexicon: DataFrame, categories: list[str], extras: list[str]) -> DataFrame:
    return lexicon.where(F.col("enabled") & (F.col("category").isin(categories) | F.col("canonical").isin(extras)))


def effective_lexicon(base: DataFrame, overrides: DataFrame, custom: DataFrame) -> DataFrame:
    """The base list with each user's ``enabled`` where there is one, then the user's own entries."""
    mine = overrides.select("canonical", F.col("enabled").alias("_mine"))
    return base.join(mine, "canonical", "left").withColumn("enabled", F.coalesce("_mine", "enabled")).drop("_mine").unionByName(custom)


#: The narrower scope wins.
SCOPES = {"global": 0, "title": 1, "item": 2}


def suppress(hits: DataFrame, rules: DataFrame, ascii_only: bool = False) -> DataFrame:
    """``hits`` (hit_id, item_id, title_id, canonical, context) with ``mode`` of the winning rule and ``whitelisted``.

    Narrowest scope first, then a rule with a context over one without, then allow over suppress. A context
    rule applies where its folded text stands in the hit's folded context. Suppressed hits stay, flagged.
    ``ascii_only`` says that contexts and rules are ASCII.
    """
    rank = F.create_map(*[F.lit(x) for p in SCOPES.items() for x in p])
    r = rules.select("canonical", "scope", F.col("scope_id"), F.col("context_text"), "mode")
    scoped = [
        hits.join(r.where("scope = 'global'"), "canonical"),
        hits.join(r.where("scope = 'title'").withColumn("title_id", F.col("scope_id")), ["canonical", "title_id"]),
        hits.join(r.where("scope = 'item'").withColumn("item_id", F.col("scope_id")), ["canonical", "item_id"]),
    ]
    cols = ["hit_id", "context", "scope", "context_text", "mode"]
    found = scoped[0].select(*cols).union(scoped[1].select(*cols)).union(scoped[2].select(*cols))
    has = F.coalesce(F.col("context_text") != "", F.lit(False))
    applies = ~has | fold(F.col("context"), ascii_only).contains(fold(F.col("context_text"), ascii_only))
    won = found.where(applies).groupBy("hit_id").agg(
        F.max_by("mode", F.struct(F.try_element_at(rank, F.col("scope")), has.cast("int"), (F.col("mode") == "allow").cast("int"))).alias("mode")
    )
    return hits.join(won, "hit_id", "left").withColumn("whitelisted", F.coalesce(F.col("mode") == "suppress", F.lit(False)))


def redact(df: DataFrame, text: str, entries: list[tuple], mask: str = "*") -> DataFrame:
    """``df`` with the hits in ``text`` masked and ``n_hits``; separators inside a hit stay."""
    pattern = compile_lexicon(entries)
    if pattern is None:
        return df.withColumn("redacted", F.col(text)).withColumn("n_hits", F.lit(0))
    marked = F.regexp_replace(F.translate(F.col(text), _OPEN + _CLOSE, "  "), pattern, f"{_OPEN}$0{_CLOSE}")
    pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]")
    done = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, mask_text(x, mask)).otherwise(x)), "")
    n_hits = F.when(F.col(text).isNull(), 0).otherwise(((F.size(pieces) - 1) / 2).cast("int"))
    return df.withColumn("redacted", done).withColumn("n_hits", n_hits)


def stands_for(censor: Column, form: Column) -> Column:
    """Whether a masked word may stand for a form. Masked: about as long, and every letter left in its place; one letter and a
    tail: the form ends with the tail. Both: the same first letter."""
    in_place = F.forall(censor["revealed"], lambda r: F.substr(form, r["pos"] + 1, F.lit(1)) == r["letter"])
    masked = (F.abs(F.length(form) - censor["length"]) <= 1) & in_place
    tailed = (censor["suffix"] != "") & form.endswith(censor["suffix"])
    return (F.substring(form, 1, 1) == censor["first_letter"]) & F.when(censor["style"] == "masked", masked).otherwise(tailed)


def censored_candidates(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """Masked words (token_id, censor) with each single-word form (form, canonical) that they may stand for."""
    by_letter = forms.where(~F.col("form").contains(" ")).withColumn("_first", F.substring("form", 1, 1))
    met = tokens.withColumn("_first", F.col("censor.first_letter")).join(by_letter, "_first").drop("_first")
    return met.where(stands_for(F.col("censor"), F.col("form"))).dropDuplicates(["token_id", "form"])


def innocent_gate(corpus: DataFrame, word: str, entries: list[tuple], never: DataFrame, never_word: str) -> DataFrame:
    """(word, violation, canonical): words of ``corpus`` that match an entry although they are innocent, each enabled or
    not as the list says, and words of ``never`` that look censored. No row: the word list passes."""
    hits = match_lexicon(corpus.select(F.col(word).alias("word")), "word", entries)
    masked = never.select(F.col(never_word).alias("word")).where(detect_censored(F.col("word")).isNotNull())
    matched = hits.select("word", F.lit("matches").alias("violation"), "canonical").distinct()
    return matched.union(masked.select("word", F.lit("censored"), F.lit(None).cast("string")).distinct())


def lexicon_conflicts(lexicon: DataFrame, never: list[str]) -> DataFrame:
    """(kind, name): names used twice, forms with two owners, forms that must never match, forms of the wrong shape, and where there is a
    ``focus`` of words to listen for, names whose focus isn't part of them."""
    forms = lexicon.select("canonical", "is_phrase", F.explode("forms").alias("form"))
    twice = lexicon.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_canonical").alias("kind"), F.col("canonical").alias("name"))
    owned = forms.groupBy("form").agg(F.count_distinct("canonical").alias("n")).where("n > 1").select(F.lit("two_owners"), "form")
    barred = forms.where(fold(F.col("form")).isin(never)).select(F.lit("never_match"), "form")
    shape = forms.where(~F.col("form").rlike(r"^[\w'’ -]+$") | (F.col("is_phrase") != F.col("form").contains(" "))).select(F.lit("shape"), "form")
    found = twice.union(owned).union(barred).union(shape)
    if "focus" not in lexicon.columns:
        return found
    astray = F.size(F.array_except("focus", F.split("canonical", " "))) > 0
    return found.union(lexicon.where(astray).select(F.lit("focus"), "canonical"))


def lexicon_sync_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(outcome, n): what a new word list changes. The user's ``enabled`` is never overwritten, custom entries stay."""
    o = old.select("canonical", F.col("forms").alias("of"), F.col("enabled").alias("oe"), "is_builtin")
    n = new.select("canonical", F.col("forms").alias("nf"), F.col("enabled").alias("ne"))
    joined = o.join(n, "canonical", "full_outer")
    outcome = (
        F.when(F.col("of").isNull(), "inserted").when(F.col("nf").isNull() & ~F.col("is_builtin"), "custom_kept").when(F.col("nf").isNull(), "removed")
        .when(F.array_sort("of") != F.array_sort("nf"), "updated").when(F.col("oe") != F.col("ne"), "enabled_preserved").otherwise("same")
    )
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def profile_key(categories: list[str], extras: list[str], entries: list[tuple], never: list[str], pads: tuple[int, int] = (80, 120), gap: int = 0, mute_censored: bool = True) -> str:
    """What of a profile and its word list decides what is muted, as one hash; names, the order of anything and disabled entries don't count."""
    told = sorted([canonical, category, sorted(set(forms))] for canonical, category, forms, _, enabled in entries if enabled)
    parts = [sorted(set(categories)), sorted(set(extras)), list(pads), gap, mute_censored, told, sorted(set(never))]
    return hashlib.sha1(json.dumps(parts).encode()).hexdigest()


def ruleset_fingerprint(items: DataFrame, entries_key: str, rules: DataFrame) -> DataFrame:
    """(item_id, fingerprint): equal exactly when the rules in scope, with what they are for, and ``entries_key`` (see ``profile_key``) are equal, in any order."""
    line = F.to_json(F.struct("canonical", "scope", F.coalesce("scope_id", F.lit(-1)).alias("scope_id"), F.coalesce("context_text", F.lit("")).alias("context_text"), F.when(F.col("mode") != "suppress", F.col("mode")).alias("mode")))
    told = rules.select("scope", "scope_id", line.alias("line"))
    # One row of global rules for all, then an equality join for each narrower scope.
    every = told.where("scope = 'global'").agg(F.collect_set("line").alias("g"))
    of = lambda scope, name: told.where(F.col("scope") == scope).groupBy(F.col("scope_id").alias(f"{scope}_id")).agg(F.collect_set("line").alias(name))
    scoped = items.select("item_id", "title_id").join(of("title", "t"), "title_id", "left").join(of("item", "i"), "item_id", "left").crossJoin(F.broadcast(every))
    empty = F.array().cast("array<string>")
    parts = scoped.select("item_id", F.array_sort(F.array_distinct(F.concat("g", F.coalesce("t", empty), F.coalesce("i", empty)))).alias("rules"))
    return parts.select("item_id", F.sha1(F.to_json(F.struct(F.lit(entries_key).alias("entries"), "rules"))).alias("fingerprint"))


def join_tokens(words: DataFrame) -> DataFrame:
    """(item_id, joined, places): per item the words (item_id, word_index, norm) one space apart, a line break instead where words
    without letters (``norm`` empty) lie between, so that no phrase reaches across. ``places``: word_index, char_start, char_end."""
    order = Window.partitionBy("item_id").orderBy("word_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    there = F.length("norm") > 0
    placed = words.withColumns({
        "_first": F.coalesce(F.max(F.when(there, 1)).over(before), F.lit(0)) == 0,
        # The word before, if it was one without letters, leaves a break.
        "_break": F.coalesce(~F.lag(there).over(order), F.lit(False)),
        "_done": F.coalesce(F.sum(F.when(there, F.length("norm") + 1)).over(before), F.lit(0)),
    })
    placed = placed.withColumn("_text", F.when(there, F.concat(F.when(F.col("_first"), "").when(F.col("_break"), "\n").otherwise(" "), F.col("norm"))).otherwise(""))
    start = F.when(there | F.col("_first"), F.col("_done")).otherwise(F.col("_done") - 1).cast("int")
    placed = placed.withColumn("char_start", start).withColumn("char_end", start + F.length("norm"))
    return placed.groupBy("item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "_text"))), lambda x: x["_text"]), "").alias("joined"),
        F.array_sort(F.collect_list(F.struct("word_index", "char_start", "char_end"))).alias("places"),
    )


def span_to_tokens(spans: DataFrame, joined: DataFrame, width: int = 128) -> DataFrame:
    """``spans`` (item_id, char_start, char_end) of joined texts with first_word and last_word, the words that they touch;
    words without letters have no width and are none of them. A span past the last word has nulls. Spans meet the words of their stretch of the text."""
    places = joined.select("item_id", F.explode("places").alias("p")).select("item_id", "p.word_index", F.col("p.char_start").alias("_w0"), F.col("p.char_end").alias("_w1"))
    words = bucketed(places.where("_w1 > _w0"), "_w0", "_w1", width, "_b")
    key = ["item_id", "char_start", "char_end"]
    asked = bucketed(spans.select(*key).distinct(), "char_start", "char_end", width, "_b")
    met = asked.join(words, ["item_id", "_b"]).where("_w0 < char_end and _w1 > char_start")
    found = met.groupBy(*key).agg(F.min("word_index").alias("first_word"), F.max("word_index").alias("last_word"))
    return spans.join(found, key, "left").select(*spans.columns, "first_word", "last_word")


def hit_pieces(words: str, entries: list[tuple]) -> Column:
    """The pieces of a list of words, folded and joined as by ``join_tokens``, where entries may stand: see ``joined_pieces``. ``piece_hits`` tells the hits in them."""
    parts = [form_parts(form) for _, _, forms, _, enabled in entries if enabled for form in forms]
    # Between two parts there are three separators at most, after the last one a mark.
    reach = max((sum(map(len, p)) + 3 * (len(p) - 1) + 1 for p in parts), default=0)
    return joined_pieces(F.col(words), [p[0] for p in parts], [p[-1] for p in parts], reach)


def piece_hits(df: DataFrame, pieces: str, entries: list[tuple]) -> DataFrame:
    """Hits in the ``hit_pieces`` of each item_id, as ``list_hits`` tells them."""
    pattern = compile_lexicon(entries)
    if pattern is None:
        kinds = (("char_start", "int"), ("char_end", "int"), ("word_raw", "string"), ("canonical", "string"), ("category", "string"), ("first_word", "int"), ("last_word", "int"))
        return df.limit(0).select("item_id", *[F.lit(None).cast(t).alias(n) for n, t in kinds])
    rows = df.select("item_id", F.explode(pieces).alias("_j")).select("item_id", "_j.at", F.col("_j.joined").alias("_text"), "_j.index", "_j.begin", "_j.end")
    rows = rows.where(F.col("_text").rlike(pattern)).withColumn("h", _hit_list("_text", pattern))
    rows = rows.withColumn("_touched", touched_words(F.col("begin"), F.col("end"), F.col("h.a"), F.col("h.b")))
    # Places among the words with letters become places in the list.
    place = lambda i: F.get("index", i)
    spans = F.transform("_touched", lambda t: F.struct(place(t["first"]).alias("first"), place(t["last"]).alias("last")))
    each = rows.withColumn("t", spans).select("item_id", "at", F.explode(F.arrays_zip("h", "t")).alias("_x"))
    hits = each.select("item_id", (F.col("at") + F.col("_x.h.a")).alias("char_start"), (F.col("at") + F.col("_x.h.b")).alias("char_end"), F.col("_x.h.w").alias("word_raw"), F.col("_x.t.first").alias("first_word"), F.col("_x.t.last").alias("last_word"))
    return _owned(hits, entries).select("item_id", "char_start", "char_end", "word_raw", "canonical", "category", "first_word", "last_word")


def list_hits(df: DataFrame, words: str, entries: list[tuple]) -> DataFrame:
    """Hits in lists of words (item_id and the array ``words``), folded and joined as by ``join_tokens``, with the words that they touch: item_id, char_start, char_end, word_raw,
    canonical, category, first_word, last_word (places in the array). What ``match_lexicon`` and ``span_to_tokens`` tell, without a row for each word: nothing but hits
    leaves the rows, and nothing is shuffled."""
    rows = df.where(F.col(words).isNotNull())
    return piece_hits(rows.select("item_id", hit_pieces(words, entries).alias("_pieces")), "_pieces", entries)


#: Marks of subtitle files, and what the escapes among them show.
MARKUP = re.compile(r"(\{[^}]*\}|\\[Nnh])")
ESCAPES = {"\\N": "\n", "\\n": "\n", "\\h": " "}
_REDACTED = "struct<redacted:string,n_hits:int,tags_dropped:int>"


def redact_markup(df: DataFrame, text: str, entries: list[tuple], mask: str = "*", rules: list[tuple[str, str]] = ()) -> DataFrame:
    """``df`` with redacted, n_hits and tags_dropped: like ``redact``, but on what a line shows.

    Words that a mark cuts through are found; what stands between their letters goes with them, and blocks in braces are counted.
    Marks elsewhere stay. ``rules``: (canonical, context) of hits to leave alone, an empty context meaning anywhere, any other where its folded
    text stands in the folded line. Lines without marks and rules never leave the JVM.
    """
    pattern = compile_lexicon(entries)
    if pattern is None:
        return df.select("*", F.col(text).alias("redacted"), F.lit(0).alias("n_hits"), F.lit(0).alias("tags_dropped"))
    finder = re.compile(pattern.replace("(?iuU)", "(?i)"))
    forms = [(re.compile(f"(?i){p}"), canonical) for _, p, canonical, _ in ranked_forms(entries)]
    spared: dict[str, list[str]] = {}
    for canonical, context in rules:
        spared.setdefault(canonical, []).append(fold_text(context or ""))

    def stays(hit: str, line: str) -> bool:
        owner = next((c for p, c in forms if p.fullmatch(hit)), None)
        return any(not context or context in fold_text(line) for context in spared.get(owner, ()))

    def one(raw: str | None) -> dict:
        if raw is None:
            return {"redacted": None, "n_hits": 0, "tags_dropped": 0}
        # Where each piece that shows begins in the line and in the raw text, and how long it is there.
        shown, begins, places, size, at = [], [], [], 0, 0
        for k, token in enumerate(MARKUP.split(raw)):
            piece = ESCAPES.get(token, "") if k % 2 else token
            if piece:
                shown.append(piece)
                begins.append(size)
                places.append((at, len(token) if k % 2 else 1))
                size += len(piece)
            at += len(token)

        def place(i: int) -> tuple[int, int]:
            k = bisect.bisect_right(begins, i) - 1
            return places[k][0] + i - begins[k], places[k][1]

        line = "".join(shown)
        out, done, hits, dropped = [], 0, 0, 0
        for m in finder.finditer(line):
            if stays(m[0], line):
                continue
            a, b = place(m.start())[0], sum(place(m.end() - 1))
            hits += 1
            dropped += sum(t.startswith("{") for t in MARKUP.findall(raw[a:b]))
            out += [raw[done:a], re.sub("[^ \t\u00a0'’-]", lambda _: mask, m[0])]
            done = b
        return {"redacted": "".join([*out, raw[done:]]), "n_hits": hits, "tags_dropped": dropped}

    @F.arrow_udf(_REDACTED)
    def by_line(lines: pa.Array) -> pa.Array:
        kind = pa.struct([("redacted", pa.string()), ("n_hits", pa.int32()), ("tags_dropped", pa.int32())])
        return pa.array([one(x) for x in lines.to_pylist()], kind)

    plain = redact(df, text, entries, mask)
    marked = F.col(text).rlike(r"\{[^}]*\}|\\[Nnh]") | F.lit(bool(spared))
    # The helper gets null for lines that it isn't needed for.
    out = plain.withColumn("_r", by_line(F.when(marked, F.col(text))))
    pick = lambda c, other: F.when(marked, F.col(f"_r.{c}")).otherwise(other)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], pick("redacted", F.col("redacted")).alias("redacted"), pick("n_hits", F.col("n_hits")).alias("n_hits"), pick("tags_dropped", F.lit(0)).alias("tags_dropped"))


def redaction_totals(df: DataFrame, by: list[str], text: str, entries: list[tuple], **more) -> DataFrame:
    """What ``redact_markup`` did, for each ``by``: lines, changed ones, hits and dropped marks. Lines of null text count and have none."""
    out = redact_markup(df, text, entries, **more)
    return out.groupBy(*by).agg(F.count("*").alias("lines"), F.count_if(F.col("n_hits") > 0).alias("changed"), F.sum("n_hits").alias("hits"), F.sum("tags_dropped").alias("tags_dropped"))
