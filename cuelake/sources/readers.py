"""Readers: cue files, catalogue events, stream descriptions, transcripts, labels; and the run table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{1,3})"
_LINE = _TIME + r"[ \t]*-->[ \t]*" + _TIME


def _millis(line: Column, group: int) -> Column:
    part = lambda k: F.coalesce(F.regexp_extract(line, _LINE, k).try_cast("bigint"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(line, _LINE, group + 3), 3, "0").try_cast("bigint")
    return ((part(group) * 60 + part(group + 1)) * 60 + part(group + 2)) * 1000 + F.coalesce(fraction, F.lit(0))


def parse_cues(files: DataFrame, path: str = "path", content: str = "value") -> DataFrame:
    """SRT and VTT texts to cues (item_id, cue_index, start_ms, end_ms, text). Markup goes; cues without text are
    left out, but the others keep their ordinal in the file."""
    body = F.regexp_replace(F.regexp_replace(F.col(content), "^﻿", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(body, r"\n[ \t]*\n+"), lambda b: b.rlike(_LINE))
    rows = files.select(F.col(path).alias("item_id"), F.posexplode(blocks).alias("cue_index", "block"))
    text = F.regexp_replace(F.col("block"), r"(?s)^.*?-->[^\n]*\n?", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>|\{[^}]*\}", ""), r"\s+", " "))
    return rows.select("item_id", "cue_index", _millis(F.col("block"), 1).alias("start_ms"), _millis(F.col("block"), 5).alias("end_ms"), text.alias("text")).where("text != ''")


#: Marks of styled subtitle lines that show as a space or a line break.
_SHOWN = r"\\\\[Nnh]"
_DIALOGUE = r"^Dialogue:\s*[^,]*,(\d+:\d{1,2}:\d{2}[.:]\d{1,3}),(\d+:\d{1,2}:\d{2}[.:]\d{1,3}),(?:[^,]*,){6}([^\n]*)"


def parse_styled(files: DataFrame, path: str = "path", content: str = "value") -> DataFrame:
    """Styled subtitle texts (ASS, SSA) to cues: item_id, cue_index, start_ms, end_ms, text. Comments, drawings and lines without text
    are left out, but the others keep their ordinal among the events of the file; times may be in hundredths."""
    body = F.regexp_replace(F.regexp_replace(F.col(content), "^\ufeff", ""), "\r\n?", "\n")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("^(Dialogue|Comment):"))
    rows = files.select(F.col(path).alias("item_id"), F.posexplode(lines).alias("cue_index", "line"))
    part = lambda k: F.regexp_extract("line", _DIALOGUE, k)

    def millis(c: Column) -> Column:
        p = F.split(c, "[:.]")
        return ((p[0].try_cast("bigint") * 60 + p[1].try_cast("bigint")) * 60 + p[2].try_cast("bigint")) * 1000 + F.rpad(p[3], 3, "0").try_cast("bigint")

    drawing = part(3).rlike(r"\{[^}]*\\p[1-9][^}]*\}")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(part(3), r"\{[^}]*\}", ""), r"\\[Nnh]", " "), r"\s+", " "))
    kept = rows.where(F.col("line").startswith("Dialogue:") & (part(1) != "") & ~drawing)
    return kept.select("item_id", "cue_index", millis(part(1)).alias("start_ms"), millis(part(2)).alias("end_ms"), text.alias("text")).where("text != ''")


def cue_errors(files: DataFrame, cues: DataFrame, path: str = "path") -> DataFrame:
    """(item_id, error) of files that gave no cue at all: they fail by themselves, not the job."""
    none = files.select(F.col(path).alias("item_id")).join(cues.select("item_id").distinct(), "item_id", "left_anti")
    return none.select("item_id", F.lit("no cues").alias("error"))


def read_cues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cues, errors) of the cue files of a folder; each file is an item. Styled files are told by what they hold. Bytes that are no text
    don't end the job."""
    files = spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("value"))
    styled = F.col("value").rlike(r"(?m)^Dialogue:")
    cues = parse_cues(files.where(~styled)).unionByName(parse_styled(files.where(styled)))
    return cues, cue_errors(files, cues)


def read_lexicon(spark: SparkSession, documents: list[dict]) -> list[tuple]:
    """Word-list documents (category, entries) to lexicon rows: the name is a form of its own, compounds become entries,
    forms are unique and longest first; a disabled entry must carry a note."""
    rows = []
    for doc in documents:
        for e in doc["entries"]:
            if not e.get("enabled", True) and not e.get("note"):
                raise ValueError(f"{e['canonical']} is disabled without a note")
            forms = sorted({e["canonical"], *e.get("forms", [])}, key=lambda f: (-len(f), f))
            rows.append((e["canonical"], doc["category"], forms, bool(e.get("is_phrase", False)), e.get("enabled", True)))
            rows += [(c, doc["category"], [c], False, e.get("enabled", True)) for c in e.get("compounds", [])]
    return rows


_ENTRY = "canonical:string,forms:array<string>,is_phrase:boolean,enabled:boolean,note:string,focus:array<string>"
WORD_LISTS = f"category string, entries array<struct<{_ENTRY},compounds:array<struct<{_ENTRY}>>>>"


def read_word_lists(spark: SparkSession, path: str) -> DataFrame:
    """Word-list files of a folder, each a JSON object (category, entries) that may run over several lines, as a table: canonical, category, forms, is_phrase,
    enabled, focus, parent, note, what ``match_table`` takes.

    The name is a form of its own, compounds become entries of their own with their ``parent``, forms are unique and longest first, a name with a space is a phrase. An error, raised when the row is read: a file that
    isn't named after its category, a disabled entry without a note, a name given twice, ``is_phrase`` or forms that contradict the name, focus words that aren't part of a phrase.
    """
    files = spark.read.schema(WORD_LISTS).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))
    entries = files.select("category", "_file", F.explode("entries").alias("e"))
    own = [f"e.{c}" for c in ("canonical", "forms", "is_phrase", "enabled", "note", "focus")]
    tops = entries.select("category", "_file", *own, F.lit(None).cast("string").alias("parent"))
    below = entries.select("category", "_file", F.col("e.canonical").alias("parent"), F.explode("e.compounds").alias("e")).select("category", "_file", *own, "parent")
    rows = tops.unionByName(below)
    twice = F.count("*").over(Window.partitionBy("canonical"))
    forms = F.array_distinct(F.concat(F.array("canonical"), F.coalesce("forms", F.array().cast("array<string>"))))
    ordered = F.transform(F.array_sort(F.transform(forms, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f")))), lambda x: x["f"])
    phrase = F.col("canonical").contains(" ")
    words = F.split("canonical", " +")
    focus = F.coalesce("focus", F.array().cast("array<string>"))
    enabled = F.coalesce("enabled", F.lit(True))
    problem = (
        F.when(F.col("canonical").isNull(), "an entry without a name").when(F.col("category") != F.col("_file"), "the file isn't named after its category").when(F.col("_n") > 1, "the name is given twice")
        .when(~enabled & (F.coalesce("note", F.lit("")) == ""), "disabled without a note").when(F.col("is_phrase") != phrase, "is_phrase contradicts the name")
        .when(~phrase & F.exists(ordered, lambda f: f.contains(" ")), "a word with forms of several words").when((F.size(focus) > 0) & ~phrase, "focus on a word")
        .when(F.size(F.array_except(focus, words)) > 0, "focus words that aren't part of the name")
    )
    checked = rows.withColumn("_n", twice).withColumn("_problem", problem)
    fine = F.when(F.col("_problem").isNotNull(), F.raise_error(F.concat_ws(": ", "_file", "canonical", "_problem")).cast("boolean")).otherwise(True)
    return checked.where(fine).select("canonical", "category", ordered.alias("forms"), phrase.alias("is_phrase"), enabled.alias("enabled"), focus.alias("focus"), "parent", "note")


def read_catalog_events(raw: DataFrame, body: str = "body", longest: int = 1 << 20) -> DataFrame:
    """Raw event texts with event_type (cut to 48 characters), payload fields and ``accepted``; the body stays as it is."""
    kind = F.get_json_object(body, "$.eventType")
    is_object = F.get_json_object(body, "$").startswith("{")
    return raw.withColumns({
        "event_type": F.substring(kind, 1, 48), "series_id": F.get_json_object(body, "$.series.id").try_cast("bigint"),
        "movie_id": F.get_json_object(body, "$.movie.id").try_cast("bigint"),
        "accepted": F.coalesce(is_object & kind.isNotNull() & (F.octet_length(body) <= longest), F.lit(False)),
    })


STREAMS = "streams array<struct<codec_name:string,codec_type:string,profile:string,channels:int,bit_rate:string,start_time:string,disposition:map<string,int>,tags:map<string,string>>>, chapters array<string>, format struct<duration:string,size:string,tags:map<string,string>>"


def explode_media_streams(docs: DataFrame, doc: str = "doc", body: str = "body", hash_tag: str = "profile_hash", profile: str | None = None) -> DataFrame:
    """One row per stream: typed_index counts within its kind, tag names in small letters, flags that are set, sorted; of the file its chapters, its attachments, and
    ``already_clean``, whether its tag ``hash_tag`` (in letters of any size) names the ``profile``, never without one."""
    attached = F.size(F.filter("j.streams", lambda x: x["codec_type"] == "attachment")).alias("attachments")
    said = F.map_values(F.map_filter(F.coalesce("j.format.tags", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k) == hash_tag.lower()))
    clean = F.coalesce(F.get(said, F.lit(0)) == profile, F.lit(False)) if profile else F.lit(False)
    rows = docs.select(F.col(doc).alias("doc"), F.from_json(body, STREAMS).alias("j")).select("doc", F.size("j.chapters").alias("chapters"), attached, clean.alias("already_clean"), F.posexplode("j.streams").alias("pos", "s"))
    nth = F.row_number().over(Window.partitionBy("doc", "kind").orderBy("pos")) - 1
    tags = F.transform_keys(F.coalesce("s.tags", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    return rows.select(
        "doc", "pos", F.col("s.codec_type").alias("kind"), F.col("s.codec_name").alias("codec"), F.col("s.profile").alias("profile"), F.col("s.channels").alias("channels"),
        F.col("s.bit_rate").alias("bit_rate"), tags.alias("tags"), F.array_sort(F.map_keys(F.map_filter(F.coalesce("s.disposition", F.create_map().cast("map<string,int>")), lambda k, v: v == 1))).alias("flags"), "chapters", "attachments", "already_clean",
    ).withColumn("typed_index", nth)


def read_transcripts(docs: DataFrame, item: str = "item_id", body: str = "body") -> DataFrame:
    """Nested transcripts to words with a running index."""
    schema = "segments array<struct<start:double,end:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>"
    segs = docs.select(F.col(item).alias("item_id"), F.posexplode(F.from_json(body, schema)["segments"]).alias("seg_index", "s"))
    words = segs.select("item_id", "seg_index", F.posexplode("s.words").alias("pos", "w"))
    index = F.row_number().over(Window.partitionBy("item_id").orderBy("seg_index", "pos")) - 1
    return words.select("item_id", index.alias("word_index"), "seg_index", "w.*")


def checked_labels(clips: DataFrame) -> DataFrame:
    """Labels (clip_id, clip_start, clip_end, start, end, word) with ``problem``, null where all is well."""
    n = F.count_distinct("clip_start", "clip_end")
    twice = clips.groupBy("clip_id").agg(n.alias("n")).where("n > 1").select("clip_id", F.lit(True).alias("twice"))
    mid = (F.col("start") + F.col("end")) / 2
    problem = (
        F.when(F.col("clip_id").isNull(), "no clip").when(F.col("twice"), "duplicate clip").when(F.col("clip_end") <= F.col("clip_start"), "clip ends first")
        .when((mid < F.col("clip_start")) | (mid > F.col("clip_end")), "outside its clip")
    )
    return clips.join(twice, "clip_id", "left").withColumn("problem", problem).drop("twice")


def content_fingerprint(content: Column, chunk: int) -> Column:
    """SHA-1 of the first and, beyond twice the chunk, the last ``chunk`` bytes and the number of bytes; texts count in UTF-8."""
    raw = content.cast("binary")
    size = F.octet_length(raw)
    tail = F.when(size > 2 * chunk, F.substring(raw, -chunk, chunk)).otherwise(F.lit(b""))
    return F.sha1(F.concat(F.substring(raw, 1, chunk), tail, size.cast("string").cast("binary")))


def write_run(detections: DataFrame, path: str) -> None:
    """Detections of some runs: rows of the same runs are replaced, those of others stay."""
    detections.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id).orderBy("start", "end", "canonical")
