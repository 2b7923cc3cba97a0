"""Queries on streams of files, word-list upkeep, audits and the rest of the catalogue, each with the SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import align, catalog, intervals, lexicon, media, runs, scoring
from ..session import shared_dir
from ..sources import readers
from . import fixtures as fx
from .queries_runs import _spans

Q: dict = {}
SQL: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_KINDS = ("video", "audio", "subtitle")
_CODECS = ("flac", "truehd", "dts", "eac3", "ac3", "aac", "opus", "wma")
_pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int"))
_list = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _parts(spark, d):
    return fx.table(spark, d, "part").withColumn("k", F.col("p_partkey")).withColumn("g", F.expr("p_partkey div 6"))


# Streams of files.
@add("media_streams", f"""
SELECT k // 6 AS doc, row_number() OVER (PARTITION BY k // 6 ORDER BY k) - 1 AS pos, {_list(_KINDS)}[k % 3 + 1] AS kind, p_brand AS lang, 'default' AS flags,
row_number() OVER (PARTITION BY k // 6, k % 3 ORDER BY k) - 1 AS typed_index FROM (SELECT p_partkey AS k, p_brand FROM part)""")
def _(spark, d):
    stream = F.struct(
        "k", _pick(_KINDS, F.col("k") % 3).alias("codec_type"), F.create_map(F.lit("LANGUAGE"), F.col("p_brand")).alias("tags"),
        F.create_map(F.lit("default"), F.lit(1), F.lit("forced"), F.lit(0)).alias("disposition"),
    )
    docs = _parts(spark, d).groupBy(F.col("g").alias("doc")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(stream), lambda a, b: (a["k"] - b["k"]).cast("int")).alias("streams"))).alias("body"))
    out = readers.explode_media_streams(docs)
    return out.select("doc", F.col("pos").cast("long").alias("pos"), "kind", F.col("tags")["language"].alias("lang"), F.array_join("flags", ",").alias("flags"), F.col("typed_index").cast("long").alias("typed_index"))


_AUDIO = ("flac", "TrueHD", "dts", "eac3", "ac3", "aac", "opus", "pcm_s24le", "xyz")


@add("audio_plan", f"""
WITH s AS (SELECT p_partkey AS k, lower({_list(_AUDIO)}[p_partkey % 9 + 1]) AS codec, ['Dolby TrueHD + Dolby Atmos', 'x'][p_partkey % 2 + 1] AS profile, p_partkey // 9 % 9 AS ch, p_partkey * 997 % 1200000 AS raw, p_partkey % 11 = 0 AS forced, p_partkey % 3 * 12 AS depth FROM part),
t AS (SELECT *, greatest(ch, 1) AS n, CASE WHEN raw BETWEEN 32000 AND 8000000 THEN raw ELSE 0 END AS rate FROM s),
f AS (SELECT *, CASE WHEN forced THEN 'forced_lossless' WHEN n > 6 THEN 'channels_gt_6' WHEN codec = 'truehd' AND k % 2 = 0 THEN 'truehd_atmos' WHEN codec IN ('flac', 'truehd', 'dts', 'pcm_s24le') THEN 'lossless_source' END AS why FROM t)
SELECT k, CASE WHEN why IS NOT NULL THEN 'flac' WHEN codec IN ('eac3', 'ac3') THEN codec ELSE 'aac' END AS encoder,
 CASE WHEN why IS NOT NULL THEN -1 WHEN codec = 'eac3' THEN greatest([96000, 224000, 384000, 384000, 640000, 640000][n], least(1024000, rate)) WHEN codec = 'ac3' THEN CASE WHEN n >= 3 THEN 640000 ELSE least(640000, greatest(192000, rate)) END
  ELSE greatest((n + 1) // 2 * 160000, least((n + 1) // 2 * 256000, rate)) END AS bit_rate,
 CASE WHEN why IS NOT NULL THEN CASE WHEN depth > 16 THEN 's32' ELSE 's16' END END AS sample_format,
 coalesce(why, CASE WHEN codec IN ('eac3', 'ac3', 'aac') THEN codec || '_passthrough' WHEN codec = 'opus' THEN 'lossy_fallback_aac' ELSE 'unknown_codec_fallback' END) AS reason FROM f""")
def _(spark, d):
    k = F.col("k")
    plan = rules.audio_plan(_pick(_AUDIO, k % 9), _pick(("Dolby TrueHD + Dolby Atmos", "x"), k % 2), F.expr("k div 9 % 9"), k * 997 % 1_200_000, k % 11 == 0, k % 3 * 12)
    return _parts(spark, d).select("k", plan.alias("p")).select("k", "p.encoder", F.coalesce("p.bit_rate", F.lit(-1)).alias("bit_rate"), "p.sample_format", "p.reason")


@add("stream_bitrates", """
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 100 WHEN p_partkey % 3 = 1 THEN p_partkey * 7 WHEN p_partkey % 6 = 2 THEN CAST(trunc(p_size * 8000 / 50) AS BIGINT) ELSE -1 END AS bitrate,
CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5 ELSE 3600 + 120 + (p_partkey % 60) END::DOUBLE AS seconds FROM part""")
def _(spark, d):
    k = F.col("k")
    tags = F.when(k % 3 == 1, F.create_map(F.lit("BPS-eng"), (k * 7).cast("string"))).when(k % 6 == 2, F.create_map(F.lit("NUMBER_OF_BYTES"), (F.col("p_size").cast("long") * 1000).cast("string"))).otherwise(F.create_map(F.lit("title"), F.lit("x")))
    rate = rules.stream_bitrate(F.when(k % 3 == 0, (k * 100).cast("string")).otherwise("N/A"), tags, F.lit(50.0))
    length = rules.stream_duration(F.when(k % 2 == 0, (F.col("p_size") + 0.5).cast("string")), F.concat(F.lit("01:02:"), (k % 60).cast("string")))
    return _parts(spark, d).select("k", F.coalesce(rate, F.lit(-1)).alias("bitrate"), length.alias("seconds"))


_LANGS = ("en", "eng", "fr", "und")
_TRACKS = f"(SELECT p_partkey // 6 AS item_id, p_partkey AS track, p_partkey % 4 = 0 AS sidecar, {_list(_LANGS)}[p_size % 4 + 1] AS lang, p_partkey % 3 = 0 AS forced, p_partkey % 7 = 0 AS image, p_partkey % 5 = 0 AS is_default FROM part)"


def _tracks(spark, d):
    k = F.col("k")
    return _parts(spark, d).select(F.col("g").alias("item_id"), k.alias("track"), (k % 4 == 0).alias("sidecar"), _pick(_LANGS, F.col("p_size") % 4).alias("lang"), (k % 3 == 0).alias("forced"), (k % 7 == 0).alias("image"), (k % 5 == 0).alias("is_default"))


@add("choose_subtitle", f"""
WITH t AS (SELECT *, lang IN ('en', 'eng') AS mine, max(CASE WHEN sidecar AND lang IN ('en', 'eng') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id) AS own FROM {_TRACKS}),
r AS (SELECT *, CASE WHEN sidecar THEN CASE WHEN mine THEN 1 WHEN own = 0 AND lang = 'und' THEN 2 END WHEN image THEN CASE WHEN mine AND NOT forced THEN 7 WHEN mine THEN 8 ELSE 9 END WHEN mine THEN CASE WHEN forced THEN 4 ELSE 3 END WHEN forced THEN 6 ELSE 5 END AS rank FROM t)
SELECT item_id, track, ['sidecar_preferred_language', 'sidecar_untagged', 'embedded_preferred_language', 'embedded_preferred_language_forced', 'embedded_any_text', 'embedded_forced_only', 'ocr_preferred_language', 'ocr_preferred_language_forced', 'ocr_any'][rank] AS reason,
 row_number() OVER (PARTITION BY item_id ORDER BY rank, track) AS place FROM r WHERE rank IS NOT NULL""")
def _(spark, d):
    return media.choose_subtitle(_tracks(spark, d), "eng").select("item_id", "track", "reason", F.col("place").cast("long").alias("place"))


@add("choose_audio", f"""
SELECT item_id, track FROM (SELECT item_id, track, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN lang IN ('en', 'eng') THEN 0 WHEN lang = 'und' THEN 1 WHEN is_default THEN 2 ELSE 3 END, forced, NOT is_default, track) AS n FROM {_TRACKS}) WHERE n = 1""")
def _(spark, d):
    return media.choose_audio(_tracks(spark, d).withColumnRenamed("forced", "commentary"), "eng")


# Transcripts, labels, the run table.
@add("transcript_words", """
WITH w AS (SELECT conv_id AS item_id, turn, string_split(text, ' ') AS ws FROM conversations), e AS (SELECT item_id, turn, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY turn, i) - 1 AS word_index, word FROM e""")
def _(spark, d):
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word")))
    docs = fx.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("turn", words.alias("words")))).alias("segments"))
    out = readers.read_transcripts(docs.select("item_id", F.to_json(F.struct("segments")).alias("body")))
    return out.select("item_id", F.col("word_index").cast("long").alias("word_index"), "word")


@add("label_problems", """
WITH l AS (SELECT event_id, user_id AS clip_id, event_id % 50 AS a, event_id % 7 AS b FROM events), t AS (SELECT clip_id FROM l GROUP BY 1 HAVING count(DISTINCT (a, b * 10)) > 1)
SELECT event_id, CASE WHEN clip_id IN (FROM t) THEN 'duplicate clip' WHEN b * 10 <= a THEN 'clip ends first' WHEN event_id % 60 < a OR event_id % 60 > b * 10 THEN 'outside its clip' END AS problem FROM l""")
def _(spark, d):
    e = F.col("event_id")
    clips = fx.table(spark, d, "events").select("event_id", F.col("user_id").alias("clip_id"), (e % 50).alias("clip_start"), (e % 7 * 10).alias("clip_end"), (e % 60 - 1).alias("start"), (e % 60 + 1).alias("end"))
    return readers.checked_labels(clips).select("event_id", "problem")


@add("rewritten_run", 'SELECT l_orderkey AS item_id, l_partkey AS "start", l_suppkey AS "end", l_returnflag AS canonical FROM lineitem WHERE l_orderkey % 8 = 3 AND l_linenumber > 2')
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("start"), F.col("l_suppkey").alias("end"), F.col("l_returnflag").alias("canonical"), (F.col("l_orderkey") % 8).alias("run_id"), "l_linenumber")
    path = f"{shared_dir(spark)}/run-table-{uuid.uuid4().hex}"
    readers.write_run(rows, path)
    readers.write_run(rows.where("run_id = 3 and l_linenumber > 2"), path)
    return readers.read_run(spark, path, 3).select("item_id", "start", "end", "canonical")


# Word lists and profiles.
_BASE = "(SELECT 'w' || p_partkey AS canonical, p_brand AS category, p_partkey % 3 <> 0 AS enabled FROM part)"


def _base(spark, d):
    return _parts(spark, d).select(F.concat(F.lit("w"), "k").alias("canonical"), F.col("p_brand").alias("category"), (F.col("k") % 3 != 0).alias("enabled"), "k")


@add("effective_lexicon", f"""
SELECT b.canonical, b.category, coalesce(o.e, b.enabled) AS enabled FROM {_BASE} b LEFT JOIN (SELECT 'w' || p_partkey AS c, p_partkey % 2 = 0 AS e FROM part WHERE p_partkey % 5 = 0) o ON o.c = b.canonical
UNION ALL SELECT 'x' || n_name, 'own', true FROM nation""")
def _(spark, d):
    base = _base(spark, d)
    mine = fx.table(spark, d, "nation").select(F.concat(F.lit("x"), "n_name").alias("canonical"), F.lit("own").alias("category"), F.lit(True).alias("enabled"))
    return lexicon.effective_lexicon(base.drop("k"), base.where("k % 5 = 0").select("canonical", (F.col("k") % 2 == 0).alias("enabled")), mine).select("canonical", "category", "enabled")


@add("resolve_profile", f"""
SELECT item_id, p AS profile_id, CASE WHEN p % 2 = 0 THEN 'strong,mild' ELSE 'own' || p END AS categories FROM (SELECT item_id, CASE WHEN title_id % 4 = 0 THEN 1 ELSE n_regionkey END AS p FROM {fx.ITEMS_SQL} JOIN nation ON n_nationkey = title_id)""")
def _(spark, d):
    titles = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("title_id"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("profile_id"))
    own = F.array(F.concat(F.lit("own"), F.col("r_regionkey").cast("string")))
    profiles = fx.table(spark, d, "region").select(F.col("r_regionkey").alias("profile_id"), (F.col("r_regionkey") == 1).alias("is_default"), F.when(F.col("r_regionkey") % 2 != 0, own).alias("categories"))
    return catalog.resolve_profile(fx.items(spark, d), titles, profiles, ["strong", "mild"]).select("item_id", "profile_id", F.array_join("categories", ",").alias("categories"))


@add("ruleset_groups", f"SELECT title_id % 3 = 0 AS own_rules, item_id % 100 = 0 AS item_rules, CASE WHEN item_id % 100 = 0 THEN item_id WHEN title_id % 3 = 0 THEN title_id ELSE -1 END AS name, count(*) AS n FROM {fx.ITEMS_SQL} GROUP BY ALL")
def _(spark, d):
    it = fx.items(spark, d).select("item_id", "title_id")
    scoped = it.where("title_id % 3 = 0").select("title_id").distinct().select(F.lit("title").alias("scope"), F.col("title_id").cast("long").alias("scope_id"))
    scoped = scoped.union(it.where("item_id % 100 = 0").select(F.lit("item"), F.col("item_id").cast("long")))
    table = scoped.select(F.lit("darn").alias("canonical"), "scope", "scope_id", F.concat_ws(" ", F.col("scope"), F.col("scope_id").cast("string")).alias("context_text"), F.lit("allow").alias("mode"))
    table = table.union(spark.createDataFrame([("heck", "global", None, "", "suppress")], table.schema))
    prints = lexicon.ruleset_fingerprint(it, "v1", table).join(it, "item_id")
    flags = prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("title_id").alias("title_id"), F.min("item_id").alias("item_id"))
    # Equal rules give one fingerprint, so that each title, or item with rules of its own, is one row.
    own, single = F.col("title_id") % 3 == 0, (F.col("item_id") % 100 == 0) & (F.col("n") == 1)
    split = flags.select(own.alias("own_rules"), single.alias("item_rules"), F.when(single, F.col("item_id")).when(own, F.col("title_id")).otherwise(-1).cast("long").alias("name"), "n")
    return split.groupBy("own_rules", "item_rules", "name").agg(F.sum("n").alias("n"))


_LEX = "(SELECT 'c' || p_partkey % 1500 AS canonical, 'f' || p_partkey % 1800 AS form, p_partkey % 40 = 0 AS is_phrase FROM part)"


@add("lexicon_conflicts", f"""
SELECT 'duplicate_canonical' AS kind, canonical AS name FROM {_LEX} GROUP BY canonical HAVING count(*) > 1 UNION ALL SELECT 'two_owners', form FROM {_LEX} GROUP BY form HAVING count(DISTINCT canonical) > 1
UNION ALL SELECT 'never_match', form FROM {_LEX} WHERE form IN ('f7', 'f11') UNION ALL SELECT 'shape', form FROM {_LEX} WHERE is_phrase""")
def _(spark, d):
    k = F.col("k")
    rows = _parts(spark, d).select(F.concat(F.lit("c"), (k % 1500).cast("string")).alias("canonical"), F.array(F.concat(F.lit("f"), (k % 1800).cast("string"))).alias("forms"), (k % 40 == 0).alias("is_phrase"))
    return lexicon.lexicon_conflicts(rows, ["f7", "f11"])


@add("lexicon_sync", "SELECT CASE WHEN k % 11 = 0 THEN 'inserted' WHEN k % 7 = 0 AND k % 2 = 0 THEN 'custom_kept' WHEN k % 7 = 0 THEN 'removed' WHEN k % 5 = 0 THEN 'updated' WHEN k % 3 = 0 THEN 'enabled_preserved' ELSE 'same' END AS outcome, count(*) AS n FROM (SELECT p_partkey AS k FROM part) WHERE NOT (k % 11 = 0 AND k % 7 = 0) GROUP BY 1")
def _(spark, d):
    k = F.col("k")
    rows = _parts(spark, d).select("k", F.concat(F.lit("w"), "k").alias("canonical"))
    old = rows.where("k % 11 != 0").select("canonical", F.array("canonical").alias("forms"), (k % 3 != 0).alias("enabled"), (k % 2 != 0).alias("is_builtin"))
    new = rows.where("k % 7 != 0").select("canonical", F.when(k % 5 == 0, F.array("canonical", F.lit("z"))).otherwise(F.array("canonical")).alias("forms"), F.lit(True).alias("enabled"))
    return lexicon.lexicon_sync_diff(old, new)


# Times.
@add("shifted_words", f"SELECT item_id, word_index, greatest(0, start_ms / 1000 - 1.25)::DOUBLE AS at FROM {fx.WORDS_SQL}")
def _(spark, d):
    return fx.words(spark, d).select("item_id", "word_index", rules.shift_clock(F.col("start_ms") / 1000, F.lit(1.25)).alias("at"))


@add("cue_batches", f"""
WITH RECURSIVE c AS (SELECT item_id, start_ms / 1000 AS s, end_ms / 1000 AS e, row_number() OVER (PARTITION BY item_id ORDER BY start_ms, end_ms) AS k FROM {fx.CUES_SQL}),
r AS (SELECT item_id, k, s AS first, 1 AS n, 0 AS batch FROM c WHERE k = 1 UNION ALL
SELECT c.item_id, c.k, CASE WHEN c.e - r.first > 40 OR r.n >= 4 THEN c.s ELSE r.first END, CASE WHEN c.e - r.first > 40 OR r.n >= 4 THEN 1 ELSE r.n + 1 END, r.batch + CASE WHEN c.e - r.first > 40 OR r.n >= 4 THEN 1 ELSE 0 END FROM r JOIN c ON c.item_id = r.item_id AND c.k = r.k + 1)
SELECT item_id, batch, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, d):
    segs = fx.cues(spark, d).select("item_id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    return intervals.batch_segments(segs, 40, 4).groupBy("item_id", "batch").agg(F.count("*").alias("n"))


@add("stage_progress", """
WITH e AS (SELECT event_id, user_id, event_type, least(1, greatest(0, (event_id % 14 - 2) / 10)) AS part, last_value(CASE WHEN event_id % 97 = 0 THEN 'full' WHEN event_id % 89 = 0 THEN 'short' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM events),
s(w, t, b, n, total) AS (VALUES ('', 'signup', 0, 5, 100), ('', 'view', 5, 70, 100), ('', 'click', 75, 5, 100), ('', 'purchase', 80, 20, 100), ('full', 'signup', 0, 5, 427), ('full', 'view', 5, 400, 427), ('full', 'click', 405, 2, 427), ('full', 'purchase', 407, 20, 427),
 ('short', 'signup', 0, 1, 4), ('short', 'view', 1, 1, 4), ('short', 'click', 2, 1, 4), ('short', 'purchase', 3, 1, 4))
SELECT event_id, round(greatest(coalesce(max((b + n * part) * 100 / total) OVER (PARTITION BY user_id ORDER BY event_id), 0), CASE WHEN user_id % 3 = 0 THEN 75 ELSE 0 END), 6) AS percent FROM e LEFT JOIN s ON s.t = e.event_type AND s.w = coalesce(e.w, '')""")
def _(spark, d):
    e = F.col("event_id")
    named = F.when(e % 97 == 0, "full").when(e % 89 == 0, "short")
    ev = fx.table(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), e.alias("seq"), F.col("event_type").alias("stage"), ((e % 14 - 2) / 10).alias("part"), named.alias("weights"))
    done = ev.where("run_id % 3 = 0").select("run_id", F.explode(F.array(F.lit("signup"), F.lit("view"), F.lit("other"))).alias("stage")).distinct()
    tables = {"full": {"signup": 5, "view": 400, "click": 2, "purchase": 20}, "short": {}}
    out = intervals.stage_progress(ev, {"signup": 5, "view": 70, "click": 5, "purchase": 20}, done, tables)
    return out.select("event_id", F.round("percent", 6).alias("percent"))


@add("phrase_timing", """
SELECT hit_id, min(s) AS start_ms, max(s + 50) AS end_ms, min(q) AS confidence, count(s) < max(w) AS suspicious FROM (SELECT l_orderkey AS hit_id, CASE WHEN l_returnflag <> 'A' THEN l_linenumber * 100 END AS s, l_quantity AS q, l_orderkey % 4 + 1 AS w FROM lineitem) GROUP BY 1 HAVING count(s) > 0""")
def _(spark, d):
    at = F.when(F.col("l_returnflag") != "A", F.col("l_linenumber") * 100)
    parts = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hit_id"), (F.col("l_orderkey") % 4 + 1).alias("wanted"), at.alias("start_ms"), (at + 50).alias("end_ms"), F.col("l_quantity").alias("confidence"))
    return align.pick_phrase_timing(parts)


@add("subtitle_fallback", """
SELECT event_id AS hit_id, CASE WHEN event_id % 3 = 0 THEN event_id * 10 + 5 ELSE greatest(0, event_id * 10 - 400) END AS det_start_ms, CASE WHEN event_id % 3 = 0 THEN event_id * 10 + 90 ELSE event_id * 10 + 500 END AS det_end_ms, event_id % 3 <> 0 AS suspicious,
CASE WHEN event_id % 3 = 0 THEN 'both' ELSE 'subtitle' END AS found_by, NOT (event_id % 3 <> 0 AND event_id % 2 = 0) AS muted FROM events""")
def _(spark, d):
    e = F.col("event_id")
    hits = fx.table(spark, d, "events").select(e.alias("hit_id"), (e * 10).alias("hit_start_ms"), (e * 10 + 100).alias("hit_end_ms"), (e % 2 == 0).alias("ocr"))
    timed = hits.where("hit_id % 3 = 0").select("hit_id", (F.col("hit_start_ms") + 5).alias("start_ms"), (F.col("hit_end_ms") - 10).alias("end_ms"), F.lit(0.9).alias("confidence"))
    return align.subtitle_fallback(hits, timed, ocr=F.col("ocr")).select("hit_id", "det_start_ms", "det_end_ms", "suspicious", "found_by", "muted")


_NORM = "replace(lower(trim(trim(trim(word), '\"“”«»‹›()[]{}<>,.!?:;…—–~|/\\¡¿+=&^%'))), 'ß', 'ss')"


@add("stt_only", f"""
WITH w AS (SELECT item_id, word_index, start_ms, regexp_replace({_NORM}, '[''-]', '', 'g') AS norm FROM {fx.WORDS_SQL})
SELECT item_id, word_index, lx.canonical FROM w JOIN {fx.SQL_FORMS} ON lx.form = norm WHERE NOT EXISTS (SELECT 1 FROM {fx.WORDS_SQL} x WHERE x.word_index % 9 = 0 AND x.item_id = w.item_id AND w.start_ms < x.end_ms + 300 AND x.start_ms - 300 < w.start_ms + 300)""")
def _(spark, d):
    words = fx.timed(fx.word_lists(spark, d), text.folded_lists(F.col("words")), "norm").withColumn("probability", ((F.col("item_id") * 31 + F.col("word_index") * 17) % 100) / 100)
    found = fx.words(spark, d).where("word_index % 9 = 0").select("item_id", (F.col("start_ms") - 300).alias("d0"), (F.col("end_ms") + 300).alias("d1"))
    forms = F.broadcast(lexicon.word_forms([e for e in fx.LEXICON if not e[3]], spark).withColumnRenamed("form", "key"))  # as many rows as the caller listed
    return align.stt_only(words, forms, found).select("item_id", "word_index", "canonical")


@add("standalone_censored")
def _(spark, d):
    # Only words with a mask or a hyphen are cut out of their texts and looked at.
    lists = fx.word_lists(spark, d).where(F.col("words").isNotNull())
    some = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("word_index"), w.alias("word"))), lambda x: x["word"].rlike(text.MAY_BE_CENSORED))
    words = lists.select("item_id", F.explode(some).alias("w")).select("item_id", "w.word_index", "w.word").withColumns({"start_ms": F.col("word_index").cast("long") * 400, "end_ms": F.col("word_index").cast("long") * 400 + 300})
    words = words.withColumn("censor", text.detect_censored(text.strip_wrappers(F.col("word")))).where("censor is not null")
    tokens = words.select("item_id", "start_ms", "end_ms", "censor", F.struct("item_id", "word_index").alias("token_id"))
    forms = lexicon.word_forms([e for e in fx.LEXICON if not e[3]], spark)
    found = fx.words(spark, d).where("word_index % 9 = 0").select("item_id", F.col("start_ms").alias("d0"), F.col("end_ms").alias("d1"))
    return align.standalone_censored(tokens.drop("censor"), lexicon.censored_candidates(tokens.select("token_id", "censor"), forms), found)


@add("align_probes")
def _(spark, d):
    cues = fx.cues(spark, d)
    heard = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (F.col("start_ms") + i * 250).alias("start_ms")))
    late = F.transform(F.filter(heard, lambda x: F.length(x["word"]) % 5 != 0), lambda x: F.struct(x["word"].alias("word"), (x["start_ms"] + 120).alias("start_ms")))
    return align.align_probe(cues.select("item_id", F.col("cue_index").cast("int").alias("probe"), heard.alias("sub"), late.alias("stt")))


# Catalogue.
@add("pre_existing", "SELECT o_orderkey AS item_id, o_orderkey % 3 <> 0 AND (o_orderkey % 4 = 0 OR o_orderdate < TIMESTAMP '1995-01-01') AS pre_existing FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    pre = rules.is_pre_existing(F.when(k % 3 == 0, "movie").otherwise("series"), F.when(k % 4 != 0, F.col("o_orderdate")), F.lit("1995-01-01").cast("timestamp_ntz"))
    return fx.table(spark, d, "orders").select(k.alias("item_id"), pre.alias("pre_existing"))


@add("mirror_children", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'inserted' WHEN o_orderkey % 4 = 0 THEN 'deleted' WHEN o_orderkey % 5 = 0 THEN 'updated' ELSE 'same' END AS outcome
FROM orders WHERE NOT (o_orderkey % 3 = 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 7 = 0))""")
def _(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("name"))
    name = F.when(F.col("k") % 5 == 0, F.concat("name", F.lit("!"))).when(F.col("k") % 7 != 0, F.col("name"))
    old, new = o.where("k % 3 != 0"), o.where("k % 4 != 0 and not (k % 3 = 0 and k % 7 = 0)").withColumn("name", name)
    return catalog.mirror_children(old, new, ["k"], ["name"])


_AUDITED = f"(SELECT run_id, item_id, CASE WHEN run_id % 10 = 0 THEN 'done' ELSE 'failed' END AS state FROM {fx.RUNS_SQL} WHERE run_id % 10 < 2)"


@add("audit_candidates", f"""
SELECT item_id FROM {fx.ITEMS_SQL} i WHERE status = 'clean' AND enabled AND item_id % 3 <> 0 AND NOT EXISTS (FROM {_AUDITED} a WHERE a.item_id = i.item_id AND a.state = 'done') AND (SELECT count(*) FROM {_AUDITED} a WHERE a.item_id = i.item_id AND a.state = 'failed') < 2""")
def _(spark, d):
    more = {"mode": F.lit("windowed"), "original_kept": F.col("item_id") % 3 != 0, "duration": F.lit(3000.0), "content": F.lit("c"), "rules": F.lit("r"), "cleaned": F.col("item_id")}
    audits = fx.runs(spark, d).where("run_id % 10 < 2").select("item_id", F.lit("c").alias("content"), F.lit("r").alias("rules"), F.when(F.col("run_id") % 10 == 0, "done").otherwise("failed").alias("state"))
    return catalog.audit_candidates(fx.items(spark, d).withColumns(more), audits).select("item_id")


@add("audits_to_promote", f"""
WITH r AS {fx.RUNS_SQL}, t AS (SELECT run_id, item_id, created FROM r WHERE priority = 1 ORDER BY created DESC, run_id DESC LIMIT 50),
f AS (SELECT run_id, ['new', 'improved', 'matched', 'new'][(run_id + idx) % 4 + 1] AS outcome, muted, whitelisted, CASE WHEN idx % 3 > 0 THEN idx % 5 / 4.0 END AS confidence FROM {fx.DETECTIONS_SQL}),
e AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN max(run_id) ELSE min(run_id) END AS evidence FROM r WHERE item_id % 7 > 0 GROUP BY 1),
last AS (SELECT item_id, max(created) AS last FROM r WHERE NOT dry_run AND state = 'done' GROUP BY 1)
SELECT t.run_id, t.item_id FROM t JOIN e USING (item_id) LEFT JOIN last USING (item_id) WHERE t.item_id % 3 > 0 AND e.evidence <> t.run_id AND coalesce(last.last <= t.created, true)
 AND t.run_id IN (SELECT run_id FROM f WHERE outcome = 'new' AND muted AND NOT whitelisted AND coalesce(confidence >= 0.5, true))""")
def _(spark, d):
    r = fx.runs(spark, d)
    audits = r.where("priority = 1").select("run_id", "item_id", "created")
    items = r.select("item_id", F.when(F.col("item_id") % 3 > 0, "clean").otherwise("pending").alias("status")).distinct()
    evidence = r.where("item_id % 7 > 0").groupBy("item_id").agg(F.when(F.col("item_id") % 5 == 0, F.max("run_id")).otherwise(F.min("run_id")).alias("evidence_run_id"))
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("new", "improved", "matched", "new")]), ((F.col("run_id") + F.col("idx")) % 4 + 1).cast("int"))
    findings = fx.detections(spark, d).select("run_id", outcome.alias("outcome"), "muted", "whitelisted", F.when(F.col("idx") % 3 > 0, (F.col("idx") % 5) / 4).alias("confidence"))
    return catalog.audits_to_promote(audits, items, evidence, r, findings, floor=0.5)


@add("defer_existing", f"SELECT c_custkey AS item_id, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 AND NOT EXISTS (FROM orders WHERE o_custkey = c_custkey) THEN true ELSE c_custkey % 5 = 0 END AS skip FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    rows = fx.table(spark, d, "customer").select(k.alias("item_id"), F.when(k % 5 == 0, True).alias("skip"), (k % 2 == 0).alias("pre_existing"))
    return catalog.defer_existing(rows, fx.runs(spark, d)).select("item_id", "skip")


@add("orphan_backups", f"SELECT backup_id, CASE WHEN state = 'kept' AND item_id % 4 = 0 THEN 'orphaned' ELSE state END AS state, CAST(CASE WHEN state = 'kept' AND item_id % 4 = 0 THEN DATE '2001-02-11' ELSE purge_after END AS VARCHAR) AS purge_after FROM {fx.BACKUPS_SQL}")
def _(spark, d):
    b = fx.backups(spark, d)
    out = catalog.orphan_backups(b, b.where("item_id % 4 = 0").select("item_id"), F.lit("2001-02-01").cast("date"), 10)
    return out.select("backup_id", "state", F.col("purge_after").cast("string").alias("purge_after"))


@add("added_rules", "SELECT DISTINCT 'item' AS scope, c_custkey AS scope_id, c_mktsegment AS canonical, 'allow' AS mode FROM customer WHERE c_custkey % 3 <> 0")
def _(spark, d):
    r = fx.table(spark, d, "customer").select(F.lit("item").alias("scope"), F.col("c_custkey").alias("scope_id"), F.col("c_mktsegment").alias("canonical"), F.lit("allow").alias("mode"))
    return catalog.add_rules(r.where("scope_id % 3 = 0"), r.union(r))


@add("stale_runs", f"SELECT run_id, CASE WHEN run_id % 4 >= 3 OR priority = 2 THEN 'retired' ELSE 'requeued' END AS outcome FROM {fx.RUNS_SQL} WHERE state = 'done' AND (run_id % 6 = 0 OR created < TIMESTAMP '1995-06-01')")
def _(spark, d):
    k = F.col("run_id")
    r = fx.runs(spark, d).withColumns({"state": F.when(F.col("state") == "done", "running").otherwise("queued"), "heartbeat": F.when(k % 6 != 0, F.col("created")), "attempts": k % 4, "stage": F.when(F.col("priority") == 2, "swap").otherwise("render")})
    return runs.retire_stale(r, F.lit("1995-06-01 00:02:00").cast("timestamp")).select("run_id", "outcome")


@add("stored_events", "SELECT event_id, props AS body, event_type, event_type <> 'error' AS accepted FROM events")
def _(spark, d):
    raw = fx.table(spark, d, "events").select("event_id", "props", F.col("event_type").alias("kind"), F.when(F.col("event_type") == "error", F.lit("[1]")).otherwise(F.to_json(F.struct(F.col("event_type").alias("eventType")))).alias("body"))
    out = readers.read_catalog_events(raw)
    return out.select("event_id", F.col("props").alias("body"), F.coalesce("event_type", "kind").alias("event_type"), "accepted")


@add("merged_run")
def _(spark, d):
    wide = {"mute_start": F.col("start") - 80_000, "mute_end": F.col("end") + 120_000}
    prior, found = _spans(spark, d, 0).withColumns(wide), _spans(spark, d, 500_000).where("idx % 3 = 0").withColumns(wide)
    return scoring.merged_run(prior, found, scoring.compare_runs(prior, found, 1_000_000, 60_000_000))[1]
