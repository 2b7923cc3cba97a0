"""Column expressions on words and texts."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Outer punctuation, characters that mask letters, and letter-like marks made ASCII.
WRAPPERS = '"“”«»‹›()[]{}<>,.!?:;…—–~|/\\¡¿+=&^%'
MASKS = "*_#@$"
QUOTES_AND_DASHES = ("’ʼ‘–—‑", "'''---")
LONGEST_MASKED = 14
#: What every masked word has one of.
MAY_BE_CENSORED = "[*_#@$-]"


def strip_wrappers(c: Column) -> Column:
    """Outer punctuation goes; mask characters, hyphens and apostrophes stay."""
    return F.trim(F.btrim(F.trim(c), F.lit(WRAPPERS)))


@F.arrow_udf(T.StringType())
def _fold_unicode(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts.to_pylist()], pa.string())


def normalize_text(c: Column, ascii_only: bool = False) -> Column:
    """NFKC and case folding, plain quotes and dashes, single spaces. ``ascii_only`` says that texts are
    ASCII, where lower case is the same and no Python is needed."""
    plain = c.rlike(r"^[\x00-\x7F]*$")
    # Of ASCII texts only nulls go to Python.
    folded = F.lower(c) if ascii_only else F.when(plain, F.lower(c)).otherwise(_fold_unicode(F.when(~plain, c)))
    return F.trim(F.regexp_replace(F.translate(folded, *QUOTES_AND_DASHES), r"\s+", " "))


def fold(c: Column, ascii_only: bool = False) -> Column:
    """The key by which words are compared."""
    return F.translate(normalize_text(c, ascii_only), "'-", "")


_BLANKS = re.compile("[ \t\n\x0b\f\r]+")


#: Quotes, dashes, hyphens and apostrophes, which folded words go without.
_NO_QUOTES = dict.fromkeys(map(ord, QUOTES_AND_DASHES[0] + "'-"))
#: Words of these alone have no other form under NFKC, and fold letter by letter but for the sharp s.
_SIMPLE = "^[!-~À-ÖØ-öø-ÿ“”«»¡¿‘’–—]*$"


def _fold_word(word: str) -> str:
    """``fold`` of ``strip_wrappers`` of a word, outside Spark."""
    plain = unicodedata.normalize("NFKC", word.strip(" ").strip(WRAPPERS).strip(" ")).casefold()
    return _BLANKS.sub(" ", plain).strip(" ").translate(_NO_QUOTES)


def _fold_words(words: pa.Array) -> pa.Array:
    """``_fold_word`` of each: simple words, as most are, all at once."""
    odd = pc.invert(pc.match_substring_regex(words, _SIMPLE))
    folded = pc.replace_substring(pc.utf8_lower(pc.utf8_trim(words, WRAPPERS)), "ß", "ss")
    for mark in "'-‘’–—":
        folded = pc.replace_substring(folded, mark, "")
    return pc.replace_with_mask(folded, odd, pa.array(map(_fold_word, words.filter(odd).to_pylist()), pa.string()))


def _coded(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(folded, codes): the distinct words of a batch folded once, and the number of each word among them; null is the last code."""
    coded = flat.dictionary_encode()
    names = pa.concat_arrays([_fold_words(coded.dictionary), pa.nulls(1, pa.string())])
    return names, pc.fill_null(coded.indices, len(names) - 1).to_numpy(zero_copy_only=False)


#: Lists that are handled at a time.
_LISTS = 256


def _by_slices(one, lists: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([one(lists.slice(at, _LISTS)) for at in range(0, len(lists), _LISTS)]) if len(lists) else pa.array([], kind)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


@F.arrow_udf(T.ArrayType(T.StringType()))
def folded_lists(lists: pa.Array) -> pa.Array:
    """Arrays of words, each without its outer punctuation and folded: ``fold(strip_wrappers(word))``, word by word; a null array is empty."""

    def one(some: pa.Array) -> pa.Array:
        names, codes = _coded(some.flatten())
        return pa.ListArray.from_arrays(_offsets(_sizes(some)), names.take(pa.array(codes)))

    return _by_slices(one, lists, pa.list_(pa.string()))


def _case_key(words: pa.Array) -> pa.Array:
    """Letter by letter what a matcher that ignores case compares, which is less than case folding."""
    return pc.utf8_lower(pc.utf8_upper(words))


#: Beginnings and endings of forms that words are searched for; of longer lists any word may be a part.
_MOST_PARTS = 4096


def _holding(parts: list[str]) -> str | None:
    """Expression for words that hold one of the parts, which are never empty; None: any word may."""
    each = sorted(set(_case_key(pa.array(parts, pa.string())).to_pylist()))
    return "|".join(map(re.escape, each)) if len(each) <= _MOST_PARTS else None


_PIECE = [("at", pa.int32()), ("joined", pa.string()), ("index", pa.list_(pa.int32())), ("begin", pa.list_(pa.int32())), ("end", pa.list_(pa.int32()))]


def joined_pieces(words: Column, first: list[str], last: list[str], reach: int) -> Column:
    """Of arrays of words, folded as by ``folded_lists`` and joined as by ``join_tokens``, the pieces of the text where a form may stand that begins with one of the parts ``first``,
    ends with one of ``last`` and is at most ``reach`` long: where the piece begins, its text, and of each of its words with letters the place in the array and in the piece.

    A part lies within a word, case aside. Pieces begin and end between words, apart from each other, and hold every word that a form which begins in them
    can touch, so a matcher finds in them what it finds in the whole text.
    """
    starts, ends = _holding(first), _holding(last)

    def holds(key: pa.Array, pattern: str | None) -> np.ndarray:
        return np.ones(len(key), bool) if pattern is None else pc.fill_null(pc.match_substring_regex(key, pattern), False).to_numpy(zero_copy_only=False)

    def one(some: pa.Array) -> pa.Array:
        sizes = _sizes(some)
        names, codes = _coded(some.flatten())
        length = pc.fill_null(pc.utf8_length(names), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        there = length[codes] > 0
        after_none = np.concatenate([[False], ~there[:-1]])[there] if len(codes) else there
        row, pos, codes = row[there], pos[there], codes[there]
        long = length[codes]
        # Rows lie one behind another on one line, too far apart for a form.
        ahead = np.cumsum(long + 1) - (long + 1)
        place = ahead + row * (reach + 2)
        key = _case_key(names)
        closing = np.concatenate([[0], np.cumsum(holds(key, ends)[codes])])
        at = np.flatnonzero(holds(key, starts)[codes])
        upto = np.searchsorted(place, place[at] + long[at] + reach, "left")
        some_end = closing[upto] > closing[at]
        at, upto = at[some_end], upto[some_end]
        # Pieces that share words are one.
        opens = np.flatnonzero(np.concatenate([[True], at[1:] >= upto[:-1]])) if len(at) else at
        lo, hi = at[opens], upto[np.append(opens[1:], len(at)) - 1] if len(at) else at
        n = hi - lo
        offsets = _offsets(n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        every = np.repeat(lo, n) + within
        # A word begins its piece, or comes after a space, or a line break where words without letters lie before it.
        told = names.slice(0, len(names) - 1)
        spelt = pc.binary_join_element_wise(pa.array([" ", "\n"]).take(pa.array(after_none[every].astype(np.int8))), told.take(pa.array(codes[every])), "")
        spelt = pc.if_else(pa.array(within == 0), told.take(pa.array(codes[every])), spelt)
        begin = ahead[every] - np.repeat(ahead[lo], n)
        lists_of = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
        head = np.searchsorted(row, row[lo], "left")
        fields = [pa.array((ahead[lo] - ahead[head]).astype(np.int32)), pc.binary_join(pa.ListArray.from_arrays(offsets, spelt), ""), lists_of(pos[every]), lists_of(begin), lists_of(begin + long[every])]
        return pa.ListArray.from_arrays(_offsets(np.bincount(row[lo], minlength=len(sizes))), pa.StructArray.from_arrays(fields, fields=list(pa.struct(_PIECE))))

    ints = T.ArrayType(T.IntegerType())

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("joined", T.StringType()), *(T.StructField(c, ints) for c in ("index", "begin", "end"))])))
    def pieces(lists: pa.Array) -> pa.Array:
        return _by_slices(one, lists, pa.list_(pa.struct(_PIECE)))

    return pieces(words)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))
def touched_words(begins: pa.Array, ends: pa.Array, froms: pa.Array, tos: pa.Array) -> pa.Array:
    """For the spans (``froms``, ``tos``) of each row the first and the last of its words (``begins``, ``ends``, in order, apart) that each touches, by number; nulls: none."""
    n, k = _sizes(begins), _sizes(froms)
    b, e, a, z = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (begins, ends, froms, tos))
    # Rows lie one behind another on one line, so that all are searched at once.
    wide = max([x.max() for x in (e, z) if len(x)], default=0) + 2
    at, of = np.repeat(np.arange(len(n)), n) * wide, np.repeat(np.arange(len(k)), k) * wide
    first, last = np.searchsorted(e + at, a + of, "right"), np.searchsorted(b + at, z + of, "left") - 1
    base = np.repeat(np.cumsum(n) - n, k)
    none = last < first
    told = [pa.array((x - base).astype(np.int32), mask=none) for x in (first, last)]
    return pa.ListArray.from_arrays(_offsets(k), pa.StructArray.from_arrays(told, ["first", "last"]))


def with_folded(df: DataFrame, source: str, name: str) -> DataFrame:
    """``df`` with ``name``, the ``fold`` of a column. ASCII rows, as most are, and nulls go a way of their own, on which nothing is sent to Python."""
    other = F.col(source).rlike(r"[^\x00-\x7F]")
    plain = df.where(~F.coalesce(other, F.lit(False))).withColumn(name, fold(F.col(source), ascii_only=True))
    return plain.unionByName(df.where(other).withColumn(name, fold(F.col(source))))


def fold_text(text: str) -> str:
    """``fold`` of one text, outside Spark."""
    plain = unicodedata.normalize("NFKC", text).casefold().translate(str.maketrans(*QUOTES_AND_DASHES))
    return " ".join(plain.split()).replace("'", "").replace("-", "")


def detect_censored(core: Column, folded: Column | None = None, never_match: Column | None = None) -> Column:
    """Struct (style, first_letter, length, revealed, suffix) of a masked word, else null.

    ``masked``: a letter, then letters and mask characters, or a letter, two hyphens or more and letters.
    ``hyphen``: one letter, a hyphen, and up to six small letters. ``never_match``: an array of folded words that don't count.
    """
    low = F.lower(core)
    dashed = core.rlike(r"^[A-Za-z]-{2,}[A-Za-z]*$")
    masked = core.rlike(r"^[A-Za-z][A-Za-z*_#@$]{1,13}$") & core.rlike(r"[*_#@$]")
    tailed = core.rlike(r"^[A-Za-z]-[a-z]{1,6}$")
    letters = F.filter(
        F.transform(F.sequence(F.lit(0), F.length(core) - 1), lambda i: F.struct(i.alias("pos"), F.substr(low, i + 1, F.lit(1)).alias("letter"))),
        lambda x: x["letter"].rlike("[a-z]"),
    )
    ok = F.length(core).between(1, LONGEST_MASKED) & core.rlike(r"[A-Za-z]")
    if never_match is not None:
        ok = ok & ~F.array_contains(never_match, fold(core) if folded is None else folded)
    style = F.when(dashed | masked, "masked").when(tailed, "hyphen")
    out = F.struct(
        style.alias("style"),
        F.substring(low, 1, 1).alias("first_letter"),
        F.length(core).alias("length"),
        F.when(dashed | masked, letters).otherwise(F.slice(letters, 1, 1)).alias("revealed"),
        F.when(dashed | masked, "").otherwise(F.substring(core, 3, 6)).alias("suffix"),
    )
    return F.when(ok & style.isNotNull(), out)


def classify_token(core: Column, censored: Column) -> Column:
    """``empty`` without a letter, ``censored`` or ``word``."""
    return F.when(~core.rlike(r"\p{L}"), "empty").when(censored.isNotNull(), "censored").otherwise("word")


def mask_text(c: Column, mask: str = "*") -> Column:
    """Everything but separators becomes the mask; the length stays."""
    return F.regexp_replace(c, "[^ \\t\\u00a0'’-]", mask.replace("\\", "\\\\").replace("$", "\\$"))


#: Two-letter languages and their three-letter names, that for output first.
LANGUAGES = {
    "en": "eng", "es": "spa", "fr": "fre fra", "de": "ger deu", "it": "ita", "pt": "por", "ru": "rus", "ja": "jpn", "ko": "kor", "zh": "chi zho",
    "nl": "dut nld", "sv": "swe", "no": "nor", "da": "dan", "fi": "fin", "pl": "pol", "cs": "cze ces", "hu": "hun", "el": "gre ell", "tr": "tur",
    "ar": "ara", "he": "heb", "hi": "hin", "th": "tha", "vi": "vie", "id": "ind", "ms": "may msa", "uk": "ukr", "bg": "bul", "ro": "rum ron",
    "sk": "slo slk", "sl": "slv", "hr": "hrv", "sr": "srp", "et": "est", "lv": "lav", "lt": "lit", "ca": "cat", "ta": "tam", "te": "tel",
    "bn": "ben", "mr": "mar", "ur": "urd", "fa": "fas per", "is": "isl ice", "ga": "gle", "cy": "wel cym", "eu": "eus baq", "gl": "glg", "af": "afr",
    "sw": "swa", "ml": "mal", "kn": "kan",
}
#: Each name of a language and the one it goes by here.
LANGUAGE_NAMES = {name: names.split()[0] for two, names in LANGUAGES.items() for name in (two, *names.split())}


def lang_tag(c: Column) -> Column:
    """Lower case, region cut off; null where nothing is named. ``und`` stays: tagged as unknown is not untagged."""
    cut = F.split(F.lower(F.trim(c)), "[-_]")[0]
    return F.when(F.trim(c) != "", cut)


def lang_norm(c: Column) -> Column:
    """``lang_tag`` with one three-letter name for each language; unknown names stay as they are, null stays null."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    cut = lang_tag(c)
    return F.coalesce(F.try_element_at(names, cut), cut)


def lang_matches(a: Column, b: Column) -> Column:
    """Same language, whichever of its names; also the same unknown name. A null or empty tag matches nothing."""
    return F.coalesce(lang_norm(a) == lang_norm(b), F.lit(False))


def lang_effective(tag: Column, default: Column) -> Column:
    """The tag's language, or the default where the tag says nothing; ``und`` says nothing."""
    told = lambda c: F.nullif(lang_norm(c), F.lit("und"))
    return F.coalesce(told(tag), told(default))


def json_field(c: Column, path: str, kind: str) -> Column:
    """A field of a JSON text, null where the text is no JSON or the field no such value."""
    return F.get_json_object(c, path).try_cast(kind) if hasattr(c, "try_cast") else F.get_json_object(c, path).cast(kind)


def snapshot_hash(c: Column, field: str = "profile_hash") -> Column:
    """The hash that a run's stored settings name; null where they are missing, no JSON object, or name none."""
    return F.get_json_object(c, f"$.{field}")


def as_utc(c: Column) -> Column:
    """A stored time without a zone is UTC: it gets the zone and isn't shifted, whatever the session's zone is."""
    return F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())


def item_label(kind: Column, title: Column, year: Column, code: Column, episode_title: Column | None = None) -> Column:
    """``Title (year)`` of a film, ``Title S01E01 — name`` of an episode; what is missing is left out, a missing title is ``Unknown``."""
    name = F.coalesce(title, F.lit("Unknown"))
    film = F.concat(name, F.when(title.isNotNull() & year.isNotNull() & (year != 0), F.format_string(" (%d)", year)).otherwise(""))
    tail = F.lit("") if episode_title is None else F.when(F.coalesce(episode_title, F.lit("")) != "", F.concat(F.lit(" — "), episode_title)).otherwise("")
    return F.when(kind == "movie", film).otherwise(F.concat(name, F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit(" "), code)).otherwise(""), tail))


def span_code(spans: Column) -> Column:
    """Of an array of struct(season, episode): ``S01E01`` for one; ``S01E01-E03`` for several of a season without gaps; otherwise each by
    itself, joined by ``+``; empty for none."""
    every = F.array_sort(F.array_distinct(spans))
    first, last = F.element_at(every, 1), F.element_at(every, -1)
    one = lambda x: F.format_string("S%02dE%02d", x["season"], x["episode"])
    run = (first["season"] == last["season"]) & (last["episode"] - first["episode"] + 1 == F.size(every))
    return (
        F.when(F.coalesce(F.size(every), F.lit(0)) < 1, "").when(F.size(every) == 1, one(first))
        .when(run, F.concat(one(first), F.format_string("-E%02d", last["episode"]))).otherwise(F.array_join(F.transform(every, one), "+"))
    )


def episode_code(season: Column, episodes: Column) -> Column:
    """``span_code`` of episodes of one season."""
    return span_code(F.transform(episodes, lambda e: F.struct(season.alias("season"), e.alias("episode"))))


def similarity(a: Column, b: Column) -> Column:
    """Indel similarity in percent: 200 * longest common subsequence / sum of lengths; two empty words: 100.

    One row of the usual table is an array that each letter of ``a`` replaces.
    """
    n = F.length(b)
    start = F.array_repeat(F.lit(0), n + 1)

    def next_row(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), n), F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(
                F.when(F.substr(b, j, F.lit(1)) == x, F.element_at(row, j) + 1)
                .otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, -1)))
            )),
        )

    table = F.aggregate(F.split(a, ""), start, next_row)
    total = F.length(a) + n
    return F.when(total == 0, 100.0).when((F.length(a) == 0) | (n == 0), 0.0).otherwise(F.lit(200.0) * F.element_at(table, -1) / total)


def _letters_of(words: list[str]) -> np.ndarray:
    """Code points of words, one row each, zeros after the end."""
    width = max(1, max(map(len, words), default=1))
    return np.array(words, f"<U{width}").view("<u4").reshape(len(words), width)


def _bags(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How often the letters of each of 32 classes stand in a word."""
    row = np.repeat(np.arange(len(size)), size)
    return np.bincount(row * 32 + letters[np.arange(letters.shape[1]) < size[:, None]] % 32, minlength=32 * len(size)).reshape(-1, 32)


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of words. A word's row of the usual table is one number, of which a bit
    is out where the length grows; all pairs take a step at once. Longer words than 63 letters go one by one, with long numbers."""
    out = np.zeros(len(a), np.int64)
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    short = np.flatnonzero((size_a < 64) & (size_b < 64))
    if len(short):
        x, y = _letters_of([a[i] for i in short]), _letters_of([b[i] for i in short])
        n, m = size_a[short], size_b[short]
        bits = np.uint64(1) << np.arange(y.shape[1], dtype=np.uint64)
        row = np.full(len(short), np.uint64(0xFFFFFFFFFFFFFFFF))
        for k in range(x.shape[1]):
            at = np.where((y == x[:, k : k + 1]) & (n > k)[:, None] & (np.arange(y.shape[1]) < m[:, None]), bits, np.uint64(0)).sum(1, dtype=np.uint64)
            met = row & at
            row = (row + met) | (row - met)
        out[short] = np.bitwise_count(~row)
    for i in np.flatnonzero((size_a > 63) | (size_b > 63)):
        places: dict[str, int] = {}
        for k, c in enumerate(b[i]):
            places[c] = places.get(c, 0) | 1 << k
        whole = (1 << len(b[i])) - 1
        row = whole
        for c in a[i]:
            met = row & places.get(c, 0)
            row = ((row + met) | (row - met)) & whole
        out[i] = len(b[i]) - row.bit_count()
    return out


def _scores(a: list[str], b: list[str], least: float) -> np.ndarray:
    """``similarity`` of each pair of words, 0 where lengths or letters tell that it is below ``least``."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    total = n + m
    score = np.where(total == 0, 100.0, 0.0)
    maybe = np.flatnonzero(200.0 * np.minimum(n, m) >= least * np.maximum(total, 1))
    if len(maybe):
        bag = [_bags(_letters_of([x[i] for i in maybe]), k[maybe]) for x, k in ((a, n), (b, m))]
        maybe = maybe[(200.0 * np.minimum(*bag).sum(1) >= least * total[maybe]) & (total[maybe] > 0)]
        if len(maybe):
            score[maybe] = 200.0 * common_letters([a[i] for i in maybe], [b[i] for i in maybe]) / total[maybe]
    return score


def _near(words: pa.Array, targets: list[str], least: float) -> np.ndarray:
    """Which of the words, none of them named twice if they are many, resemble one of the targets; nulls and empty words don't."""
    size = pc.fill_null(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    near = np.zeros(len(words), bool)
    for t in filter(None, targets):
        maybe = np.flatnonzero(~near & (size > 0) & (200.0 * np.minimum(size, len(t)) >= least * (size + len(t))))
        if len(maybe):
            # As many letters of the target as the shortest of these words needs in common with it.
            need, kind = int(np.ceil(least * (size[maybe].min() + len(t)) / 200.0 - 1e-9)), "".join(map(re.escape, sorted(set(t))))
            told = words.take(pa.array(maybe))
            if 0 < need < 100:
                enough = pc.match_substring_regex(told, f"^(?:[^{kind}]*[{kind}]){{{need}}}")
                maybe, told = maybe[enough.to_numpy(zero_copy_only=False)], told.filter(enough)
            near[maybe] = _scores(told.to_pylist(), [t] * len(maybe), least) >= least
    return near


def resembles(word: Column, targets: list[str], least: float) -> Column:
    """Whether the ``similarity`` of a word to one of the few ``targets`` is ``least`` or more; not for null and the empty word."""

    @F.arrow_udf("boolean")
    def like(words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        near = np.append(_near(coded.dictionary, targets, least), False)
        return pa.array(near[pc.fill_null(coded.indices, len(near) - 1).to_numpy(zero_copy_only=False)])

    return like(word)


def resembling(words: Column, targets: list[str], least: float) -> Column:
    """Of arrays of words, folded as by ``folded_lists``, those that ``resembles`` tells: their place and the folded word. Of a slice of lists each distinct word is measured once."""

    def one(some: pa.Array) -> pa.Array:
        sizes = _sizes(some)
        names, codes = _coded(some.flatten())
        kept = np.flatnonzero(_near(names, targets, least)[codes])
        row = np.repeat(np.arange(len(sizes)), sizes)[kept]
        pos = kept - (np.cumsum(sizes) - sizes)[row]
        told = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), names.take(pa.array(codes[kept]))], ["word_index", "word"])
        return pa.ListArray.from_arrays(_offsets(np.bincount(row, minlength=len(sizes))), told)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("word_index", T.IntegerType()), T.StructField("word", T.StringType())])))
    def like(lists: pa.Array) -> pa.Array:
        return _by_slices(one, lists, pa.list_(pa.struct([("word_index", pa.int32()), ("word", pa.string())])))

    return like(words)


def best_similarity(word: Column, targets: Column, least: float) -> Column:
    """``similarity`` of a word to the nearest of its targets, null below ``least``. Of a batch each pair of a word and a target is measured once, and only
    where their lengths and letters let it reach ``least``."""

    @F.arrow_udf("double")
    def best(words: pa.Array, lists: pa.Array) -> pa.Array:
        of = pc.list_parent_indices(lists)
        pairs = pa.table({"w": words.take(of), "t": lists.flatten(), "of": of})
        pairs = pairs.filter(pc.and_(pc.is_valid(pairs["w"]), pc.is_valid(pairs["t"])))
        each = pairs.group_by(["w", "t"]).aggregate([])
        score = _scores(each["w"].to_pylist(), each["t"].to_pylist(), least)
        joined = pairs.join(each.append_column("s", pa.array(score)), ["w", "t"])
        row, s = joined["of"].to_numpy(), joined["s"].to_numpy()
        out = np.full(len(words), -1.0)
        np.maximum.at(out, row, s)
        return pa.array(out, mask=out < max(least, 0.0))

    return best(word, targets)
