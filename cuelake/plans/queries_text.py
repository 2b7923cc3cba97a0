"""Queries on texts, word lists and times, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import align, intervals, large_lexicon, lexicon
from . import fixtures as fx

Q: dict = {}
SQL: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_CORE = "trim(trim(trim(word), '\"“”«»‹›()[]{}<>,.!?:;…—–~|/\\¡¿+=&^%'))"
_FOLDED = "regexp_replace(replace(lower(%s), 'ß', 'ss'), '[''-]', '', 'g')"
_TOKENS = f"(SELECT item_id, word_index, {_CORE} AS core FROM {fx.WORDS_SQL})"
_FORMS = "(VALUES ('rewh'), ('orre'), ('thatin'), ('ononst'), ('inoran'), ('hehely')) AS f(form)"
_IN_FORMS = "('rewh', 'orre', 'thatin', 'ononst', 'inoran', 'hehely')"
#: Single words of the test list, found between non-word characters.
_WORD_HITS = f"(SELECT doc_id, lower(u) AS form FROM (SELECT doc_id, unnest(string_split_regex(text, '{fx.NO_WORD}')) AS u FROM documents))"
_SINGLE = [e for e in fx.LEXICON if not e[3]]


@add("match_word_counts", f"SELECT lx.canonical, lx.category, count(*) AS total, count(DISTINCT h.doc_id) AS documents FROM {_WORD_HITS} h JOIN {fx.SQL_FORMS} ON lx.form = h.form GROUP BY ALL")
def _(spark, d):
    hits = lexicon.match_lexicon(fx.table(spark, d, "documents").select("doc_id", "text"), "text", _SINGLE)
    return hits.groupBy("canonical", "category").agg(F.count("*").alias("total"), F.count_distinct("doc_id").alias("documents"))


@add("strip_wrappers", f"SELECT core, count(*) AS n FROM {_TOKENS} GROUP BY 1")
def _(spark, d):
    return fx.words(spark, d).select(text.strip_wrappers(F.col("word")).alias("core")).groupBy("core").agg(F.count("*").alias("n"))


@add("fold_words", f"SELECT {_FOLDED % 'core'} AS folded, count(*) AS n FROM {_TOKENS} GROUP BY 1")
def _(spark, d):
    return fx.words(spark, d).select(text.fold(text.strip_wrappers(F.col("word"))).alias("folded")).groupBy("folded").agg(F.count("*").alias("n"))


_DASHED = "regexp_full_match(core, '[A-Za-z]-{2,}[A-Za-z]*')"
_MASKED = f"({_DASHED} OR (regexp_full_match(core, '[A-Za-z][A-Za-z*_#@$]{{1,13}}') AND regexp_matches(core, '[*_#@$]')))"
_STYLE = f"CASE WHEN length(core) NOT BETWEEN 1 AND 14 OR NOT regexp_matches(core, '[A-Za-z]') THEN NULL WHEN {_MASKED} THEN 'masked' WHEN regexp_full_match(core, '[A-Za-z]-[a-z]{{1,6}}') THEN 'hyphen' END"


@add("classify_tokens", f"SELECT CASE WHEN NOT regexp_matches(core, '\\p{{L}}') THEN 'empty' WHEN {_STYLE} IS NOT NULL THEN 'censored' ELSE 'word' END AS kind, count(*) AS n FROM {_TOKENS} GROUP BY 1")
def _(spark, d):
    core = text.strip_wrappers(F.col("word"))
    return fx.words(spark, d).select(text.classify_token(core, text.detect_censored(core)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@add("censored_tokens", f"SELECT item_id, word_index, {_STYLE} AS style, lower(core[1]) AS first_letter, length(core) AS length FROM {_TOKENS} WHERE {_STYLE} IS NOT NULL")
def _(spark, d):
    rows = fx.words(spark, d).select("item_id", "word_index", text.detect_censored(text.strip_wrappers(F.col("word"))).alias("c")).where("c is not null")
    return rows.select("item_id", "word_index", "c.style", "c.first_letter", "c.length")


@add("censored_candidates", f"""
WITH t AS (SELECT item_id, word_index, lower(core) AS c, {_STYLE} AS style FROM {_TOKENS})
SELECT item_id, word_index, form FROM t, {_FORMS}
WHERE c[1] = form[1] AND CASE style WHEN 'masked' THEN abs(length(form) - length(c)) <= 1 AND list_bool_and(list_transform(range(1, length(c) + 1), lambda i: NOT regexp_matches(c[i], '[a-z]') OR c[i] = form[i]))
  WHEN 'hyphen' THEN suffix(form, c[3:]) END GROUP BY ALL""")
def _(spark, d):
    rows = fx.words(spark, d).withColumn("censor", text.detect_censored(text.strip_wrappers(F.col("word")))).where("censor is not null")
    rows = rows.select("item_id", "word_index", "censor", F.struct("item_id", "word_index").alias("token_id"))
    return lexicon.censored_candidates(rows, lexicon.word_forms(_SINGLE, spark)).select("item_id", "word_index", "form")


@add("mask_text", f"SELECT item_id, cue_index, regexp_replace(text, '[^ \\t\\x{{00a0}}''’-]', '*', 'g') AS masked FROM {fx.CUES_SQL}")
def _(spark, d):
    return fx.cues(spark, d).select("item_id", "cue_index", text.mask_text(F.col("text")).alias("masked"))


_LANG = "CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' WHEN 'de' THEN 'ger' WHEN 'es' THEN 'spa' ELSE lang END"


@add("language_names", f"SELECT {_LANG} AS language, count(*) AS n, count(*) FILTER ({_LANG} = 'eng') AS english FROM documents GROUP BY 1")
def _(spark, d):
    rows = fx.table(spark, d, "documents").select(text.lang_norm(F.col("lang")).alias("language"), text.lang_matches(F.col("lang"), F.lit("en-US")).alias("en"))
    return rows.groupBy("language").agg(F.count("*").alias("n"), F.count_if("en").alias("english"))


@add("content_fingerprint", "SELECT doc_id, sha1(b[1:100] || CASE WHEN octet_length(b) > 200 THEN b[octet_length(b) - 99:octet_length(b)] ELSE ''::BLOB END || encode(octet_length(b)::VARCHAR)) AS fingerprint FROM (SELECT doc_id, encode(text) AS b FROM documents)")
def _(spark, d):
    from ..sources.readers import content_fingerprint

    return fx.table(spark, d, "documents").select("doc_id", content_fingerprint(F.col("text"), 100).alias("fingerprint"))


@add("safe_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", text.json_field(F.col("props"), "$.k", "bigint").alias("k"))


@add("episode_codes", """
SELECT o_custkey AS item, CASE WHEN count(DISTINCT e) = 1 THEN printf('S01E%02d', min(e)) WHEN max(e) - min(e) + 1 = count(DISTINCT e) THEN printf('S01E%02d-E%02d', min(e), max(e))
       ELSE array_to_string(list_transform(list_sort(list_distinct(list(e))), lambda x: printf('S01E%02d', x)), '+') END AS code
FROM (SELECT o_custkey, CAST(o_orderkey % 20 + 1 AS INT) AS e FROM orders) GROUP BY 1""")
def _(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 20 + 1).cast("int").alias("e")).groupBy("item").agg(F.collect_set("e").alias("eps"))
    return o.select("item", text.episode_code(F.lit(1), F.col("eps")).alias("code"))


@add("span_codes", """
SELECT o_custkey AS item, CASE WHEN count(DISTINCT (s, e)) = 1 THEN printf('S%02dE%02d', min(s), min(e)) WHEN count(DISTINCT s) = 1 AND max(e) - min(e) + 1 = count(DISTINCT e) THEN printf('S%02dE%02d-E%02d', min(s), min(e), max(e))
       ELSE array_to_string(list_transform(list_sort(list_distinct(list({'s': s, 'e': e}))), lambda x: printf('S%02dE%02d', x.s, x.e)), '+') END AS code
FROM (SELECT o_custkey, CAST(o_custkey % 3 + CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 2 ELSE 0 END AS INT) AS s, CAST(o_orderkey % 4 + 1 AS INT) AS e FROM orders) GROUP BY 1""")
def _(spark, d):
    k, item = F.col("o_orderkey"), F.col("o_custkey")
    season = (item % 3 + F.when(item % 5 == 0, k % 2).otherwise(0)).cast("int")
    o = fx.table(spark, d, "orders").groupBy(item.alias("item")).agg(F.collect_set(F.struct(season.alias("season"), (k % 4 + 1).cast("int").alias("episode"))).alias("spans"))
    return o.select("item", text.span_code(F.col("spans")).alias("code"))


@add("find_hits", f"""
WITH c AS (SELECT item_id, cue_index, start_ms, end_ms, length(text) AS size, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+|{fx.NO_WORD}') AS ps FROM {fx.CUES_SQL}),
p AS (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM c), h AS (SELECT *, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) AS a, length(ps[i]) AS n FROM p WHERE lower(ps[i]) IN {_IN_FORMS})
SELECT item_id, cue_index, CAST(a AS INT) AS char_start, lx.canonical, start_ms + CAST(floor((end_ms - start_ms) * a / size) AS BIGINT) AS hit_start_ms, start_ms + CAST(floor((end_ms - start_ms) * (a + n) / size) AS BIGINT) AS hit_end_ms
FROM h JOIN {fx.SQL_FORMS} ON lx.form = lower(ps[i])""")
def _(spark, d):
    return lexicon.find_hits(fx.cues(spark, d), _SINGLE).select("item_id", "cue_index", "char_start", "canonical", "hit_start_ms", "hit_end_ms")


_PIECES = f"regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+|{fx.NO_WORD}')"
_HIT_COUNT = f"CAST(len(list_filter({_PIECES}, lambda w: lower(w) IN {_IN_FORMS})) AS INT)"


@add("redact", f"""
SELECT doc_id, {_HIT_COUNT} AS n_hits, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform({_PIECES}, lambda w: CASE WHEN lower(w) IN {_IN_FORMS} THEN repeat('*', length(w)) ELSE w END), '') END AS redacted FROM documents""")
def _(spark, d):
    return lexicon.redact(fx.table(spark, d, "documents"), "text", _SINGLE).select("doc_id", "n_hits", "redacted")


@add("redaction_stats", f"SELECT source, count(*) AS documents, count(*) FILTER (n > 0) AS changed, sum(n)::BIGINT AS hits FROM (SELECT source, {_HIT_COUNT} AS n FROM documents) GROUP BY 1")
def _(spark, d):
    out = lexicon.redact(fx.table(spark, d, "documents"), "text", _SINGLE)
    return out.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("n_hits") > 0).alias("changed"), F.sum("n_hits").alias("hits"))


@add("phrase_documents", f"SELECT count(*) AS documents FROM documents WHERE regexp_matches(text, '(?i)(^|{fx.NO_WORD[:-1]})of[ \\t\\x{{a0}}''’-]{{1,3}}the($|{fx.NO_WORD[:-1]})')")
def _(spark, d):
    hits = lexicon.match_lexicon(fx.table(spark, d, "documents").select("doc_id", "text"), "text", [fx.LEXICON[4]])
    return hits.agg(F.count_distinct("doc_id").alias("documents"))


_RULES = [("rewh", "global", None, "", "suppress"), ("rewh", "title", 3, "", "allow"), ("thatin", "global", None, "", "suppress"), ("thatin", "item", 7, "", "allow"), ("ononst", "title", 5, "", "suppress"), ("inoran", "global", None, "the", "suppress")]


@add("suppress", f"""
WITH h AS (SELECT DISTINCT doc_id, lx.canonical, text FROM (SELECT doc_id, text, lower(unnest(string_split_regex(text, '{fx.NO_WORD}'))) AS form FROM documents) x JOIN {fx.SQL_FORMS} ON lx.form = x.form)
SELECT doc_id, canonical, CASE canonical WHEN 'rewh' THEN doc_id % 20 <> 3 WHEN 'thatin' THEN doc_id <> 7 WHEN 'ononst' THEN doc_id % 20 = 5
       WHEN 'inoran' THEN contains({_FOLDED % 'text'}, 'the') ELSE false END AS whitelisted FROM h""")
def _(spark, d):
    hits = lexicon.match_lexicon(fx.table(spark, d, "documents").select("doc_id", "text"), "text", _SINGLE)
    hits = hits.select("doc_id", "canonical", F.col("text").alias("context")).dropDuplicates(["doc_id", "canonical"])
    hits = hits.select("*", F.struct("doc_id", "canonical").alias("hit_id"), F.col("doc_id").alias("item_id"), (F.col("doc_id") % 20).alias("title_id"))
    table = spark.createDataFrame([(c, s, i, x, m) for c, s, i, x, m in _RULES], "canonical string, scope string, scope_id long, context_text string, mode string")
    return lexicon.suppress(hits, table).select("doc_id", "canonical", "whitelisted")


@add("innocent_gate", f"""
WITH w AS MATERIALIZED (SELECT DISTINCT core FROM {_TOKENS}),
p AS (SELECT core, CASE WHEN regexp_full_match(core, '[A-Za-z0-9_]*') THEN [core] ELSE string_split_regex(core, '{fx.NO_WORD}') END AS parts FROM w),
h AS (SELECT DISTINCT core, lx.canonical FROM (SELECT core, lower(unnest(parts)) AS form FROM p) x JOIN {fx.SQL_FORMS} ON lx.form = x.form)
SELECT core AS word, 'matches' AS violation, canonical FROM h UNION ALL SELECT core, 'censored', NULL FROM w WHERE {_STYLE} IS NOT NULL""")
def _(spark, d):
    corpus = fx.words(spark, d).select(text.strip_wrappers(F.col("word")).alias("word")).distinct()
    return lexicon.innocent_gate(corpus, "word", _SINGLE, corpus, "word")


_PHRASES = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')"


@add("large_lexicon", f"""
WITH RECURSIVE b AS (SELECT {_PHRASES} AS w FROM benchmark),
forms AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS form FROM b UNION SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM b),
d AS (SELECT doc_id, {_PIECES} AS p FROM documents),
t AS (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM d),
r AS (SELECT doc_id, w, lead(w) OVER o AS g, lead(w, 2) OVER o AS x, lead(w, 3) OVER o AS h, lead(w, 4) OVER o AS y, sum(length(w)) OVER o - length(w) AS a FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, a, w || g || x AS raw, lower(w || ' ' || x) AS form FROM r WHERE regexp_full_match(g, '[ \\t\\x{{a0}}''’-]{{1,3}}')
 UNION ALL SELECT doc_id, a, w || g || x || h || y, lower(w || ' ' || x || ' ' || y) FROM r WHERE regexp_full_match(g, '[ \\t\\x{{a0}}''’-]{{1,3}}') AND regexp_full_match(h, '[ \\t\\x{{a0}}''’-]{{1,3}}')),
hits AS MATERIALIZED (SELECT doc_id, a, max_by(form, length(form)) AS form, a + max_by(length(raw), length(form)) AS e FROM k JOIN forms USING (form) GROUP BY doc_id, a),
jump AS MATERIALIZED (SELECT u.doc_id, u.a, u.form, u.e, v.a AS nxt FROM hits u ASOF LEFT JOIN hits v ON u.doc_id = v.doc_id AND u.e <= v.a),
walk AS (SELECT doc_id, min(a) AS a FROM hits GROUP BY doc_id UNION ALL SELECT j.doc_id, j.nxt FROM walk JOIN jump j ON j.doc_id = walk.doc_id AND j.a = walk.a WHERE j.nxt IS NOT NULL)
SELECT doc_id, CAST(a AS INT) AS char_start, CAST(e AS INT) AS char_end, form AS canonical FROM walk JOIN jump USING (doc_id, a)""")
def _(spark, d):
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")))
    empty = F.array().cast("array<string>")
    phrases = fx.table(spark, d, "benchmark").select(w.alias("w")).select(F.explode(F.concat(F.coalesce(runs(2), empty), F.coalesce(runs(3), empty))).alias("form")).distinct()
    lists = phrases.select(F.col("form").alias("canonical"), F.lit("strong").alias("category"), F.array("form").alias("forms"), F.lit(True).alias("is_phrase"), F.lit(True).alias("enabled"))
    return large_lexicon.match_table(fx.table(spark, d, "documents"), "text", lists, ["doc_id"]).select("doc_id", "char_start", "char_end", "canonical")


# Ranges.
_MERGE = (
    "SELECT item_id, min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM (SELECT *, sum(o) OVER (PARTITION BY item_id ORDER BY \"start\", \"end\", event_id ROWS UNBOUNDED PRECEDING) AS island FROM "
    f"(SELECT *, CASE WHEN \"start\" - max(\"end\") OVER (PARTITION BY item_id ORDER BY \"start\", \"end\", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {fx.HOUR} THEN 0 ELSE 1 END AS o FROM {fx.RANGES_SQL} WHERE \"end\" > \"start\")) GROUP BY item_id, island"
)


@add("merge_ranges", _MERGE)
def _(spark, d):
    return intervals.merge_ranges(fx.ranges(spark, d), fx.HOUR)


@add("pad_spans", "SELECT event_id, greatest(0, s - 0.08) AS a, CASE WHEN least(500, e + 0.12) - greatest(0, s - 0.08) < 0.02 THEN least(500, greatest(0, s - 0.08) + 0.02) ELSE least(500, e + 0.12) END AS b FROM (SELECT event_id, CAST(event_id % 600 AS DOUBLE) AS s, CAST(event_id % 600 AS DOUBLE) + value / 1000 AS e FROM events)")
def _(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", (F.col("event_id") % 600).cast("double").alias("s"), "value").withColumn("e", F.col("s") + F.col("value") / 1000)
    a, b = rules.pad_span(F.col("s"), F.col("e"), F.lit(500.0))
    return ev.select("event_id", a.alias("a"), b.alias("b"))


@add("guard_spans", """
WITH e AS (SELECT event_id, CAST(event_id % 600 AS DOUBLE) AS s, CAST(event_id % 600 AS DOUBLE) + value / 10 AS e, CASE WHEN event_id % 3 > 0 THEN event_id % 600 - event_id % 4 END AS c, CASE WHEN event_id % 5 = 0 THEN event_id % 600 + 0.5 END AS f FROM events),
r AS (SELECT *, CASE WHEN e - s > 3 THEN 'length' WHEN abs((s + e) / 2 - (c + 1.5)) > 2.5 THEN 'distance' END AS reason FROM e)
SELECT event_id, round(s, 6) AS "start", round(e, 6) AS "end", false AS suspicious, reason FROM r WHERE reason IS NULL
UNION ALL SELECT event_id, round(coalesce(f, CASE WHEN c IS NOT NULL THEN greatest(0, c + 0.1) END, s), 6), round(coalesce(f + 1, c + 2.9, s + 1), 6), true, reason FROM r WHERE reason IS NOT NULL""")
def _(spark, d):
    e, k = F.col("event_id"), F.col("event_id") % 600
    ev = fx.table(spark, d, "events").select("event_id", k.cast("double").alias("s"), "value").withColumn("e", F.col("s") + F.col("value") / 10)
    c, f = F.when(e % 3 > 0, k - e % 4), F.when(e % 5 == 0, k + 0.5)
    span = rules.guard_span(F.col("s"), F.col("e"), c, c + 2, F.lit(0.5), fallback=(f, f + 1))
    ev = ev.select("event_id", span.alias("g"))
    return ev.select("event_id", F.round("g.start", 6).alias("start"), F.round("g.end", 6).alias("end"), "g.suspicious", "g.reason")


@add("clip_windows", "SELECT event_id, round(greatest(0, least((s + e) / 2 - w / 2, 600 - w)), 6) AS a, round(least(600, greatest(0, least((s + e) / 2 - w / 2, 600 - w)) + w), 6) AS b FROM (SELECT event_id, s, e, greatest(5, e - s) AS w FROM (SELECT event_id, CAST(event_id % 600 AS DOUBLE) AS s, CAST(event_id % 600 AS DOUBLE) + value / 10 AS e FROM events))")
def _(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", (F.col("event_id") % 600).cast("double").alias("s"), "value").withColumn("e", F.col("s") + F.col("value") / 10)
    w = rules.clip_window(F.col("s"), F.col("e"), F.lit(600.0))
    return ev.select("event_id", F.round(w["start"], 6).alias("a"), F.round(w["end"], 6).alias("b"))


@add("range_coverage", f"""
WITH m AS ({_MERGE}), s AS (SELECT item_id, event_id, "start" - {fx.HOUR} AS a, "start" + {fx.HOUR} AS b FROM {fx.RANGES_SQL})
SELECT s.event_id, least(1.0, coalesce(sum(greatest(0, least(b, m."end") - greatest(a, m."start"))) FILTER (m."start" IS NOT NULL), 0) / (b - a))::DOUBLE AS covered FROM s LEFT JOIN m ON m.item_id = s.item_id AND a <= m."end" AND m."start" <= b GROUP BY s.event_id, a, b""")
def _(spark, d):
    ranges = fx.ranges(spark, d)
    spans = ranges.select("item_id", "event_id", (F.col("start") - fx.HOUR).alias("start"), (F.col("start") + fx.HOUR).alias("end"))
    return intervals.coverage(spans, intervals.merge_ranges(ranges, fx.HOUR), ["item_id", "event_id"], 24 * fx.HOUR).select("event_id", F.col("covered").cast("double").alias("covered"))


@add("longest_ranges", f"""
SELECT item_id, a, b FROM (SELECT item_id, "start" + 1000 AS a, "end" - 1000 AS b, row_number() OVER (PARTITION BY item_id ORDER BY "end" - "start" DESC, "start") AS n FROM ({_MERGE}) WHERE "end" - "start" >= 2000000) WHERE n <= 3""")
def _(spark, d):
    out = intervals.longest_ranges(intervals.merge_ranges(fx.ranges(spark, d), fx.HOUR), 3, 2_000_000, 1000)
    return out.select("item_id", F.col("start").alias("a"), F.col("end").alias("b"))


@add("events_to_intervals", f"""
SELECT a.event_id, a.at_us AS "start", coalesce(min(b.at_us), a.at_us + 2000000) AS "end" FROM {fx.EVENTS_SQL} a LEFT JOIN {fx.EVENTS_SQL} b ON a.item_id = b.item_id AND b.at_us > a.at_us WHERE a.event_type <> 'Test' GROUP BY a.event_id, a.at_us""")
def _(spark, d):
    ev = fx.catalog_events(spark, d).select("event_id", "item_id", "event_type", F.col("at_us").alias("at"))
    return intervals.events_to_intervals(ev, F.col("event_type") == "Test", 2_000_000).select("event_id", "start", "end")


@add("free_windows", f"""
WITH r AS (SELECT item_id, ("start" // 1000000) % 3000 AS s, ("start" // 1000000) % 3000 + 20 AS e FROM {fx.RANGES_SQL}),
c AS (SELECT item_id, pos FROM (SELECT DISTINCT item_id FROM r), (SELECT unnest(range(1499 % 7, 3000, 7)) AS pos) WHERE pos <= 2999),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.item_id = c.item_id AND c.pos < r.e + 2 AND r.s - 2 < c.pos + 1))
SELECT item_id, min_by(pos, (abs(pos - 1499), -pos)) AS free_start FROM f GROUP BY 1""")
def _(spark, d):
    second = F.expr("(start div 1000000) % 3000")
    r = fx.ranges(spark, d).select("item_id", second.alias("start"), (second + 20).alias("end"))
    return intervals.free_window(r, r.select("item_id").distinct().withColumn("duration", F.lit(3000)), 1, 2, 7)


@add("cue_windows", f"""
WITH w AS (SELECT item_id, greatest(start_ms - 1500, 0) AS s, end_ms + 1500 AS e, cue_index FROM {fx.CUES_SQL} WHERE length(text) % 3 = 0)
SELECT item_id, min(s) AS "start", max(e) AS "end" FROM (SELECT *, sum(o) OVER (PARTITION BY item_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM
 (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY item_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2000 THEN 0 ELSE 1 END AS o FROM w)) GROUP BY item_id, k""")
def _(spark, d):
    cues = fx.cues(spark, d).withColumnsRenamed({"start_ms": "start", "end_ms": "end"})
    return intervals.cue_windows(cues, cues.where("length(text) % 3 = 0"), 1500, 2000)


@add("words_near", f"""
SELECT c.item_id, c.cue_index, count(*) AS n, min(w.word_index) AS first FROM (SELECT item_id, word_index - word_index % 10 AS cue_index, start_ms AS s, start_ms + 2000 AS e FROM {fx.WORDS_SQL} WHERE word_index % 10 = 0) c
JOIN {fx.WORDS_SQL} w ON w.item_id = c.item_id AND w.start_ms BETWEEN c.s - 1000 AND c.e + 1000 GROUP BY ALL""")
def _(spark, d):
    words = fx.words(spark, d)
    hits = words.where("word_index % 10 = 0").select("item_id", F.col("word_index").alias("cue_index"), "start_ms", (F.col("start_ms") + 2000).alias("end_ms"))
    return align.words_near(hits, words).groupBy("item_id", "cue_index").agg(F.count("*").alias("n"), F.min("word_index").alias("first"))


@add("pick_timing")
def _(spark, d):
    words = fx.words(spark, d).withColumn("core", text.strip_wrappers(F.col("word"))).drop("word")
    hits = fx.said(spark, d, ["rewh", "thatin", "ononst"]).select(
        F.xxhash64("item_id", "word_index").alias("hit_id"), "item_id", (F.col("start_ms") - 500).alias("start_ms"), (F.col("end_ms") + 500).alias("end_ms"),
        F.col("start_ms").cast("double").alias("expected_ms"), F.array("word").alias("targets"),
    )
    return align.pick_timing(hits, words, never=tuple(fx.NEVER))


@add("words_in_windows", f"""
SELECT w.item_id, count(*) FILTER (EXISTS (SELECT 1 FROM (SELECT item_id, start_ms AS s, start_ms + 5000 AS e FROM {fx.WORDS_SQL} WHERE word_index % 100 = 0) x WHERE x.item_id = w.item_id AND w.start_ms BETWEEN x.s - 1000 AND x.e + 1000)) AS inside, count(*) AS n FROM {fx.WORDS_SQL} w GROUP BY 1""")
def _(spark, d):
    words = fx.words(spark, d)
    windows = words.where("word_index % 100 = 0").select("item_id", F.col("start_ms").alias("start"), (F.col("start_ms") + 5000).alias("end"))
    return align.words_in_windows(words, windows).groupBy("item_id").agg(F.count_if("inside").alias("inside"), F.count("*").alias("n"))


@add("assign_to_segment", f"""
WITH w AS (SELECT item_id, word_index, (start_ms + end_ms) / 2 AS mid FROM {fx.WORDS_SQL}), s AS (SELECT item_id, word_index // 50 AS seg, start_ms AS a, start_ms + 12000 AS b FROM {fx.WORDS_SQL} WHERE word_index % 50 = 0)
SELECT w.item_id, word_index, min_by(seg, (CASE WHEN mid < a THEN a - mid WHEN mid > b THEN mid - b ELSE 0 END, seg)) AS seg_index FROM w JOIN s USING (item_id) GROUP BY ALL""")
def _(spark, d):
    words = fx.words(spark, d)
    segs = words.where("word_index % 50 = 0").select("item_id", F.expr("word_index div 50").alias("seg_index"), F.col("start_ms").alias("start"), (F.col("start_ms") + 12000).alias("end"))
    return align.assign_to_segment(words, segs)


@add("cue_word_spans", f"""
WITH c AS (SELECT item_id, cue_index, start_ms, end_ms, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM {fx.CUES_SQL}),
e AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i, length(array_to_string(ws, ' ')) AS size FROM c)
SELECT item_id, cue_index, i - 1 AS pos, ws[i] AS word, start_ms + CAST(floor((end_ms - start_ms) * (length(array_to_string(ws[1:i], ' ')) - length(ws[i])) / size) AS BIGINT) AS word_start_ms FROM e""")
def _(spark, d):
    cues = fx.cues(spark, d)
    return align.cue_word_spans(cues).select("item_id", "cue_index", "pos", "word", "word_start_ms")


@add("plan_probes")
def _(spark, d):
    return align.plan_probes(fx.cues(spark, d))


@add("drift_measure", f"""
WITH x AS (SELECT item_id, CAST(cue_index % 3 AS INT) AS probe, CAST((cue_index * 37 + item_id * 11) % 900 AS DOUBLE) - 450 AS delta, substr(text, 1, 3) AS word FROM {fx.CUES_SQL}),
p AS (SELECT item_id, probe, quantile_cont(delta, 0.5) AS m FROM x GROUP BY ALL)
SELECT a.item_id, spread, probes, timed, "offset", heard FROM (SELECT item_id, CASE WHEN count(m) > 1 THEN max(m) - min(m) ELSE 0 END AS spread, count(*) AS probes, count(m) AS timed FROM p GROUP BY 1) a
JOIN (SELECT item_id, quantile_cont(delta, 0.5) AS "offset", count(DISTINCT word) AS heard FROM x GROUP BY 1) b USING (item_id)""")
def _(spark, d):
    x = fx.cues(spark, d).select("item_id", (F.col("cue_index") % 3).cast("int").alias("probe"), (((F.col("cue_index") * 37 + F.col("item_id") * 11) % 900).cast("double") - 450).alias("delta"), F.substring("text", 1, 3).alias("word"), F.lit(1.0).alias("coverage"))
    return align.drift_measure(x).select("item_id", "spread", "probes", "timed", "offset", "heard")


@add("drift_verdicts", """
SELECT event_id, CASE WHEN p < 2 THEN 'skipped' WHEN h < 8 THEN 'skipped' WHEN c < 0.4 THEN 'discard' WHEN t < 2 THEN 'skipped' WHEN abs(o) > 0.7 THEN 'unreliable' WHEN s > 0.5 THEN 'unreliable' ELSE 'ok' END AS action
FROM (SELECT event_id, event_id % 4 AS p, event_id % 30 AS h, (event_id % 10) / 10 AS c, event_id % 3 + 1 AS t, (event_id % 21 - 10) / 10 AS o, (event_id % 7) / 10 AS s FROM events)""")
def _(spark, d):
    e = F.col("event_id")
    v = rules.drift_verdict(e % 4, e % 30, (e % 10) / 10, e % 3 + 1, (e % 21 - 10) / 10, (e % 7) / 10)
    return fx.table(spark, d, "events").select("event_id", v["action"].alias("action"))
