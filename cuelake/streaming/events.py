"""Event streams. Each operator takes a batch or a streaming DataFrame unless it says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chains import first_from, numbered, reached
from ..operators.lexicon import find_hits
from ..stores import keep, materialise, scratch

#: Event kinds and what they lead to; kinds that are only stored; actions that need a known title.
ROUTES = {
    "SeriesAdd": "add_title", "MovieAdded": "add_title", "SeriesDelete": "delete_title", "MovieDelete": "delete_title",
    "Rename": "rename", "EpisodeFileDelete": "file_delete", "MovieFileDelete": "file_delete", "Download": "download",
}
STORE_ONLY = ("Test", "Grab", "Health", "HealthRestored", "ApplicationUpdate", "ManualInteractionRequired", "Retag")
NEEDS_TITLE = ("rename", "file_delete", "download")


def route_events(events: DataFrame, titles: DataFrame) -> DataFrame:
    """Events (event_type, title_id) with ``action`` and ``note``; events without a kind, of an unknown kind or, where a title is needed, of an
    unknown title are stored with a note. ``titles`` is a table; ``events`` may be a stream."""
    table = F.create_map(*[F.lit(x) for p in ROUTES.items() for x in p])
    known = titles.select("title_id").distinct().withColumn("_known", F.lit(True))
    action = F.try_element_at(table, F.col("event_type"))
    none = F.coalesce(F.col("event_type") == "", F.lit(True))
    stored = F.col("event_type").isin(*STORE_ONLY)
    joined = events.join(known, "title_id", "left")
    lost = F.col("_known").isNull() & action.isin(*NEEDS_TITLE)
    note = F.when(none, "no event type").when(action.isNull() & ~stored, "unknown type").when(lost, "unknown title")
    return joined.withColumn("note", note).withColumn("action", F.when(action.isNull() | lost, "store_only").otherwise(action)).drop("_known")


def dedupe_stream(events: DataFrame, seconds: int = 60) -> DataFrame:
    """A streaming DataFrame (item_id, event_type, ts) without repeats within ``seconds``."""
    return events.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark(["item_id", "event_type"])


def dedupe_events(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Batch form, exact: of an item's events of one type (in order of at_us, event_id), those within ``seconds`` after a kept one go.

    Whether an event stays depends on the last that stayed: each event finds the first one that it would let stay, and the chain from
    an item's first is followed. Items and types may be null, and one may hold a third of all events."""
    with scratch(events.sparkSession):
        rows = events.select("event_id", "item_id", "event_type", "at_us", F.struct("item_id", "event_type").alias("_k"))
        placed = materialise(numbered(rows, ["_k"], [F.col("at_us"), F.col("event_id")]), "events")
        silent = seconds * 1_000_000
        linked = first_from(placed.select("_k", "idx", "at_us"), ["_k"], F.col("at_us"), F.col("at_us") + silent + 1, max(1, 64 * silent))
        stay = reached(linked, ["_k"])
        out = placed.join(stay, ["_k", "idx"], "left_semi").select("event_id", "item_id", "event_type", "at_us")
        return keep(materialise(out, "deduped"))


def item_state(events: DataFrame) -> DataFrame:
    """Batch form: the state of each item after its events in order (at_us, event_id): the last download or file delete
    tells the status, any download lifts a skip, a title delete with no later addition disables."""
    order = F.struct("at_us", "event_id")
    of = lambda *kinds: F.col("event_type").isin(*kinds)
    last = lambda cond: F.max(F.when(cond, order))
    s = events.groupBy("item_id").agg(
        last(of("Download")).alias("dl"), last(of("EpisodeFileDelete", "MovieFileDelete")).alias("fd"), last(of("SeriesDelete", "MovieDelete")).alias("td"),
        last(of("SeriesAdd", "MovieAdded")).alias("ta"), F.count_if(of("Rename")).alias("renames"), F.count("*").alias("n_events"),
    )
    status = F.when(F.col("dl").isNull() & F.col("fd").isNull(), "unknown").when(F.col("fd").isNull() | (F.col("dl") > F.col("fd")), "pending").otherwise("stale")
    disabled = F.coalesce(F.col("td") > F.col("ta"), F.col("td").isNotNull())
    return s.select("item_id", status.alias("status"), F.col("dl").isNotNull().alias("unskipped"), disabled.alias("disabled"), "renames", "n_events")


def item_state_stream(events: DataFrame) -> DataFrame:
    """Streaming form of item_state: one row per item and trigger with events, from state held per item. Events of one
    time count in the order in which they come."""

    def fold(key, batches, state):
        at, kind, unskipped, title_at, disabled, renames, n = state.get if state.exists else (-1, "unknown", False, -1, False, 0, 0)
        for pdf in batches:
            for t, e in zip(pdf["at_us"], pdf["event_type"]):
                n += 1
                renames += e == "Rename"
                unskipped |= e == "Download"
                if e in ("Download", "EpisodeFileDelete", "MovieFileDelete") and t >= at:
                    at, kind = t, "pending" if e == "Download" else "stale"
                if e in ("SeriesAdd", "MovieAdded", "SeriesDelete", "MovieDelete") and t >= title_at:
                    title_at, disabled = t, e in ("SeriesDelete", "MovieDelete")
        state.update((int(at), kind, bool(unskipped), int(title_at), bool(disabled), int(renames), int(n)))
        yield pd.DataFrame({"item_id": [key[0]], "status": [kind], "unskipped": [bool(unskipped)], "disabled": [bool(disabled)], "renames": [int(renames)], "n_events": [int(n)]})

    out = "item_id long, status string, unskipped boolean, disabled boolean, renames long, n_events long"
    held = "at long, kind string, unskipped boolean, title_at long, disabled boolean, renames long, n long"
    return events.groupBy("item_id").applyInPandasWithState(fold, out, held, "update", "NoTimeout")


def merge_ranges_stream(events: DataFrame, gap_us: int, late: str = "10 minutes") -> DataFrame:
    """Ranges (item_id, ts, dur_us) that lie at most ``gap_us`` apart as one; for batches and, with a watermark, streams."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.concat((F.col("dur_us") + gap_us + 1).cast("string"), F.lit(" microseconds"))
    out = stream.groupBy("item_id", F.session_window("ts", span).alias("w")).agg(F.count("*").alias("n"))
    return out.select("item_id", F.unix_micros("w.start").alias("start"), (F.unix_micros("w.end") - gap_us - 1).alias("end"), "n")


def stale_heartbeats(beats: DataFrame, now_us: int, silent: int = 120) -> DataFrame:
    """Runs whose last beat is older than ``silent`` seconds."""
    return beats.groupBy("run_id").agg(F.max("at_us").alias("last_us")).where(F.col("last_us") < now_us - silent * 1_000_000)


def store_events(events: DataFrame, path: str, checkpoint: str):
    """Start a query that stores a stream of raw events before anything is decided on them."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_stream(cues: DataFrame, entries: list[tuple]) -> DataFrame:
    """Hits of a word list in a stream of cues: no state, each cue by itself, as ``find_hits`` on a table."""
    return find_hits(cues, entries)
