"""Catalogue of titles and items: upserts, selections, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stores import shuffle_partitions


def upsert(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], kept: dict[str, Column]) -> DataFrame:
    """Full outer join: a new value wins unless it is null; ``kept`` columns are the old ones, or a default for new rows."""
    a, b = old.alias("a"), new.select(*keys, *fields).alias("b")
    joined = a.join(b, keys, "full_outer")
    return joined.select(
        *keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in fields], *[F.coalesce(F.col(f"a.{c}"), d).alias(c) for c, d in kept.items()]
    )


def missing(known: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Known rows that the feed lacks; negative ids are placeholders."""
    return known.where(F.col(key) >= 0).join(feed, key, "left_anti")


#: Fixed value: the file at the root of the backups that is none.
README = "README.txt"


def reconcile_listing(files: DataFrame, rows: DataFrame, today: Column | None = None, days: int = 0, root: str = "", relocating: bool = False) -> DataFrame:
    """(path, outcome): files without a row are adopted; rows (path, and ``state`` if there is one) of kept and orphaned backups without a file are purged. With ``today`` also purge_after of adopted
    files, ``days`` from then, null for 0. Files whose name begins with a dot are none, nor is the README at ``root``; rows of other states without a file are as they
    should be. While backups are ``relocating`` a row may still name a file's old place, so nothing is told at all."""
    readme = f"{root.rstrip('/')}/{README}" if root else README
    f = files.where(~F.col("path").rlike(r"(^|/)\.[^/]*$") & (F.col("path") != readme)).select("path", F.lit(True).alias("on_disk"))
    state = F.col("state") if "state" in rows.columns else F.lit("kept")
    joined = f.join(rows.select("path", F.lit(True).alias("known"), state.alias("state")), "path", "full_outer").where(F.lit(not relocating))
    joined = joined.where(F.col("on_disk") | F.coalesce(F.col("state").isin("kept", "orphaned"), F.lit(False)))
    out = joined.select("path", F.when(F.col("known").isNull(), "adopted").when(F.col("on_disk").isNull(), "purged").otherwise("same").alias("outcome"))
    if today is None:
        return out
    return out.withColumn("purge_after", F.when(F.lit(days > 0) & (F.col("outcome") == "adopted"), F.date_add(today, days)))


#: What a merged row takes from the other one where it has nothing itself.
MERGED_FIELDS = ("last_run_id", "cleaned_at", "fingerprint")


def resolve_items(items: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of the feed against the stored items, as they are before any of the files: (resolved, merges).

    ``items``: item_id, title_id, kind, season, episode, episode_title, file_id, path, size, status, skip and ``MERGED_FIELDS``.
    ``files``: title_id, kind, season, episode, episode_title, path, file_id, size, defer. A file's item is that of its
    (title, season, episode), for films the title's first; else the first one at its path, which then is
    adopted by the file's title; else it is created, skipped if ``defer`` says so. If both ways lead to different items they are
    merged: the first one stays, takes over what it lacks, and ``merges`` tells (loser, winner) for the children.
    ``resolved`` has the columns of ``items`` and ``outcome``: created, adopted, merged, updated (new path) or same.
    A skip that is there is never changed.
    """
    fields = ["episode_title", "path", "size", "status", "skip", *MERGED_FIELDS]
    held = F.struct("item_id", "title_id", *fields)
    by_key = items.where("kind = 'episode'").groupBy("title_id", "season", "episode").agg(F.min(F.struct("item_id", held.alias("v")))["v"].alias("_key"))
    by_title = items.groupBy("title_id").agg(F.min(F.struct("item_id", held.alias("v")))["v"].alias("_film"))
    by_path = items.groupBy("path").agg(F.min(F.struct("item_id", held.alias("v")))["v"].alias("_path"))
    found = files.join(by_key, ["title_id", "season", "episode"], "left").join(by_title, "title_id", "left").join(by_path, "path", "left")
    found = found.withColumn("_key", F.when(F.col("kind") == "movie", F.col("_film")).otherwise(F.col("_key"))).drop("_film")
    has_key, has_path = F.col("_key").isNotNull(), F.col("_path").isNotNull()
    both = has_key & has_path & (F.col("_key.item_id") != F.col("_path.item_id"))
    outcome = (
        F.when(both, "merged").when(has_key, F.when(F.col("_key.path").eqNullSafe(F.col("path")), "same").otherwise("updated"))
        .when(has_path, F.when(F.col("_path.title_id").eqNullSafe(F.col("title_id")), "same").otherwise("adopted")).otherwise("created")
    )
    old = F.when(has_key, F.col("_key")).otherwise(F.col("_path"))
    found = found.withColumn("outcome", outcome).withColumn("_old", old)
    taken = (F.col("outcome") == "merged") & F.col("_old.status").isin("untracked", "pending") & (F.col("_path.status") != "untracked")
    status = F.when(taken, F.col("_path.status")).otherwise(F.coalesce("_old.status", F.lit("untracked")))
    resolved = found.select(
        F.col("_old.item_id").alias("item_id"), "title_id", "kind", "season", "episode", F.coalesce("episode_title", "_old.episode_title").alias("episode_title"),
        "file_id", "path", F.coalesce("size", "_old.size").alias("size"), status.alias("status"),
        F.when(F.col("_old").isNull(), F.coalesce("defer", F.lit(False))).otherwise(F.col("_old.skip")).alias("skip"),
        *[F.when(F.col("outcome") == "merged", F.coalesce(f"_old.{c}", f"_path.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in MERGED_FIELDS], "outcome",
    )
    merges = found.where("outcome = 'merged'").select(F.col("_path.item_id").alias("loser"), F.col("_key.item_id").alias("winner")).distinct()
    return resolved, merges


def repoint(children: DataFrame, merges: DataFrame) -> DataFrame:
    """``children`` with the item_id of merged items exchanged for that of the item that stays; an item merged into several goes to the first."""
    to = merges.groupBy(F.col("loser").alias("item_id")).agg(F.min("winner").alias("_winner"))
    return children.join(to, "item_id", "left").withColumn("item_id", F.coalesce("_winner", "item_id")).drop("_winner").select(*children.columns)


def stale_items(items: DataFrame, live: DataFrame, synced: DataFrame) -> DataFrame:
    """(item_id) of items of the ``synced`` titles that the feed no longer lists in ``live`` and that aren't stale yet; titles
    with a negative id are placeholders and never synced. ``orphan_backups`` tells what becomes of their backups."""
    titles = synced.where("title_id >= 0").select("title_id").distinct()
    return items.where("status != 'stale'").join(titles, "title_id", "left_semi").join(live.select("item_id").distinct(), "item_id", "left_anti").select("item_id")


#: Rules of a scope, and items, that go together: a pack of each makes at most about the square of this many pairs at once.
_PACK = 256


def _packed(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """``key`` and ``name``, arrays of about ``_PACK`` values of that key, dealt by their hash; nulls are kept."""
    count = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    sized = rows.join(count, key) if key else rows.crossJoin(count)  # one row
    dealt = sized.withColumn("_p", F.pmod(F.xxhash64(value, F.lit(1)), F.ceil(F.col("_n") / _PACK)))
    return dealt.groupBy(*key, "_p").agg(F.transform(F.collect_list(F.struct(value)), lambda x: x[value]).alias(name)).drop("_p")


def rules_in_scope(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(item_id, rule_id, scope) of the rules that hold for each item: global ones, those of its title, its own.

    The result grows with items times rules of a scope, so packs of items meet packs of rules, the meetings are dealt evenly to many tasks, and a pair is
    made only where it is told. No task holds more than the pairs of one meeting, however many rules or items a title has.
    """
    kept = rules.select("rule_id", "scope", "scope_id")
    every = kept.where("scope = 'global'").select("rule_id")
    title = kept.where("scope = 'title' and scope_id is not null").select("rule_id", F.col("scope_id").alias("title_id"))
    own = kept.where("scope = 'item'").select("rule_id", F.col("scope_id").alias("item_id"))
    titled = items.where("title_id is not null").select("item_id", "title_id")
    # Little comes in and much goes out: by its size alone the input would be a task or two.
    spark = items.sparkSession
    tasks = max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)

    def meet(scope: str, key: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = _packed(left, key, "item_id", "_items").repartition(tasks), _packed(right, key, "rule_id", "_rules").repartition(tasks)
        return (a.join(b, key) if key else a.crossJoin(b)).select(F.lit(scope).alias("scope"), "_items", "_rules")

    met = meet("global", [], items.select("item_id"), every).union(meet("title", ["title_id"], titled, title)).repartition(tasks)
    pairs = met.select("scope", "_rules", F.explode("_items").alias("item_id")).select("item_id", F.explode("_rules").alias("rule_id"), "scope")
    return pairs.union(items.select("item_id").join(own, "item_id").select("item_id", "rule_id", F.lit("item").alias("scope")))


def rule_labels(rules: DataFrame, titles: DataFrame, items: DataFrame) -> DataFrame:
    """``rules`` with ``label``: the name of the title or item that a rule is for, or what it was if it is gone; null for global rules."""
    t = titles.select(F.col("title_id").alias("scope_id"), F.lit("title").alias("scope"), F.col("title").alias("_t"))
    i = items.select(F.col("item_id").alias("scope_id"), F.lit("item").alias("scope"), F.col("label").alias("_i"))
    named = rules.join(t, ["scope", "scope_id"], "left").join(i, ["scope", "scope_id"], "left")
    gone = F.concat_ws(" ", F.col("scope"), F.col("scope_id").cast("string"))
    label = F.when(F.col("scope").isin("title", "item") & F.col("scope_id").isNotNull(), F.coalesce("_t", "_i", gone))
    return named.select(*rules.columns, label.alias("label"))


def catalogue_filter(titles: DataFrame, kind: str | None = None, enabled: bool | None = None, q: str = "") -> DataFrame:
    """``titles`` (kind, enabled, title, ...) of a kind, enabled or not, whose title holds ``q`` in any case; what is None or empty isn't asked."""
    if kind is not None:
        titles = titles.where(F.col("kind") == kind)
    if enabled is not None:
        titles = titles.where(F.col("enabled") == enabled)
    return titles.where(F.lower("title").contains(q.lower())) if q else titles


def profile_usage(profiles: DataFrame, titles: DataFrame) -> DataFrame:
    """(profile_id, titles): how many titles name each profile; none: 0."""
    used = titles.where("profile_id is not null").groupBy("profile_id").agg(F.count("*").alias("titles"))
    return profiles.select("profile_id").join(used, "profile_id", "left").select("profile_id", F.coalesce("titles", F.lit(0)).alias("titles"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(reason, n, queued) of a batch of requests with a ``reason`` each; ``queued``: whether such a request made a run."""
    return outcomes.groupBy("reason").agg(F.count("*").alias("n")).withColumn("queued", F.col("reason").isin("created", "superseded"))


def group_episode_files(episodes: DataFrame) -> DataFrame:
    """Episodes of one file as one row: the lowest (season, episode) names it, titles joined in order."""
    return episodes.groupBy("file_id").agg(
        F.min(F.struct("season", "episode")).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("season", "episode", "title"))), lambda x: x["title"]), " + ").alias("title"),
        F.array_sort(F.collect_list("episode")).alias("episodes"),
    ).select("file_id", "first.season", "first.episode", "title", "episodes")


def needs_cleaning(items: DataFrame, runs: DataFrame, retries: int = 2) -> DataFrame:
    """Items to clean: enabled, not stale, not skipped; clean ones only if their last run is unknown or was made for
    another fingerprint; failed ones only while the same content failed less than ``retries`` times."""
    failed = runs.where("state = 'failed'").groupBy("item_id", "fingerprint").agg(F.count("*").alias("failures"))
    last = runs.select(F.col("run_id").alias("last_run_id"), F.col("fingerprint").alias("last_fingerprint"))
    joined = items.join(failed, ["item_id", "fingerprint"], "left").join(last, "last_run_id", "left")
    clean = F.col("status").isin("clean", "already_clean")
    want = F.when(clean, ~F.col("fingerprint").eqNullSafe(F.col("last_fingerprint"))).otherwise(F.coalesce("failures", F.lit(0)) < retries)
    return joined.where(F.col("enabled") & (F.col("status") != "stale") & ~F.col("skip") & want).select("item_id")


def mapping_mismatch(items: DataFrame, remote: DataFrame, now: Column | None = None, delay: int = 3600, oldest: int = 86_400) -> DataFrame:
    """(item_id, reason) where the remote side lacks the item or has another path or size; a size of 0 or null is none and tells nothing. With ``now`` only items cleaned between
    ``oldest`` and ``delay`` seconds ago: later ones the remote side may not have seen yet."""
    if now is not None:
        age = now.cast("double") - F.col("cleaned_at").cast("double")
        items = items.where(age.between(delay, oldest))
    joined = items.join(remote.select("item_id", F.col("path").alias("r_path"), F.col("size").alias("r_size")), "item_id", "left")
    reason = F.when(F.col("r_path").isNull(), "missing").when(F.col("path") != F.col("r_path"), "path").when((F.col("size") != F.col("r_size")) & (F.col("size") != 0) & (F.col("r_size") != 0), "size")
    return joined.select("item_id", reason.alias("reason")).where("reason is not null")


def purge_candidates(backups: DataFrame, today: Column, root: str, ids: DataFrame | None = None) -> DataFrame:
    """(backup_id, outcome): kept or orphaned backups that are due or orphaned, or with ``ids`` (backup_id) those asked for; a date that is
    missing is never due. Paths that don't lie under the root, or lead out of it again, are refused."""
    held = backups.where(F.col("state").isin("kept", "orphaned"))
    if ids is None:
        held = held.where((F.col("purge_after") <= today) | (F.col("state") == "orphaned"))
    else:
        held = held.join(ids.select("backup_id").distinct(), "backup_id", "left_semi")
    inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return held.select("backup_id", F.when(inside, "purge").otherwise("refused").alias("outcome"))


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """New rules that have no row with the same scope, id, word and mode yet; the context isn't part of the key."""
    key = ["scope", "scope_id", "canonical", "mode"]
    same = [new[k].eqNullSafe(rules[k]) for k in key]
    return new.join(rules, same, "left_anti").dropDuplicates(key)


def mapping_conflicts(path_rules: DataFrame) -> DataFrame:
    """(app, side, prefix) used more than once."""
    sides = [path_rules.groupBy("app", F.col(c).alias("prefix")).agg(F.count("*").alias("n")).where("n > 1").select("app", F.lit(c).alias("side"), "prefix") for c in ("from_prefix", "to_prefix")]
    return sides[0].union(sides[1])


#: States in which a run is over.
FINISHED = ("done", "failed", "already_clean", "stale", "cancelled")


def dedupe_requests(requests: DataFrame, runs: DataFrame, within: int = 60) -> DataFrame:
    """What becomes of ``requests`` (request_id, item_id, at, supersede): request_id, item_id, reason. At most one run of an item is live.

    Against the item's newest unfinished one of ``runs`` (item_id, state, created): without one the request is ``created``;
    with ``supersede`` it takes that run's place (``superseded``); a run that has been waiting for no more than ``within``
    seconds makes it ``deduped``, any other ``already_active``. Requests of one item follow each other by (at, request_id): a run that
    an earlier request made is a waiting one from then on.
    """
    live = runs.where(~F.col("state").isin(*FINISHED)).groupBy("item_id").agg(F.max_by(F.struct("state", "created"), "created").alias("_live"))
    earlier = Window.partitionBy("item_id").orderBy("at", "request_id")
    asked = requests.withColumn("supersede", F.coalesce("supersede", F.lit(False))).join(live, "item_id", "left")
    # A request makes a run if it is an item's first without a live run, or supersedes one.
    first = F.row_number().over(earlier) == 1
    makes = F.col("supersede") | (first & F.col("_live").isNull())
    asked = asked.withColumn("_made", F.when(makes, F.col("at")))
    asked = asked.withColumn("_before", F.last("_made", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    waiting = F.when(F.col("_before").isNotNull(), F.lit("queued")).otherwise(F.col("_live.state"))
    age = F.col("at").cast("double") - F.coalesce(F.col("_before"), F.col("_live.created")).cast("double")
    reason = (
        F.when(waiting.isNull(), "created").when(F.col("supersede"), "superseded")
        .when((waiting == "queued") & (F.coalesce(age, F.lit(0.0)) <= within), "deduped").otherwise("already_active")
    )
    return asked.select("request_id", "item_id", reason.alias("reason"))


def map_paths(df: DataFrame, path: str, rules: list[tuple[str, str]], back: bool = False) -> DataFrame:
    """``df`` with ``mapped``: the longest prefix that ends at a separator is exchanged; others pass through. The rules
    are a list as a user keeps it, so they are tried in place, longest first. ``back``: from the second prefix to the first."""
    rules = [(b, a) for a, b in rules] if back else rules
    p = F.regexp_replace(F.col(path), r"[/\\]+$", "")
    out = p
    for old, new in sorted(rules, key=lambda r: len(r[0])):
        old, new = old.rstrip("/\\"), new.rstrip("/\\")
        out = F.when((p == old) | p.startswith(old + "/") | p.startswith(old + "\\"), F.concat(F.lit(new), F.substr(p, F.lit(len(old) + 1)))).otherwise(out)
    return df.withColumn("mapped", out)


def change_feed(moves: DataFrame, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """(path, change) for replaced files: Modified, or Created and Deleted when the name changed. ``rules`` map local paths to
    those of the other side."""
    for c in ("old_path", "new_path"):
        moves = map_paths(moves, c, list(rules)).drop(c).withColumnRenamed("mapped", c)
    one = F.array(F.struct(F.col("new_path").alias("path"), F.lit("Modified").alias("change")))
    two = F.array(F.struct(F.col("new_path").alias("path"), F.lit("Created").alias("change")), F.struct(F.col("old_path").alias("path"), F.lit("Deleted").alias("change")))
    return moves.select(F.explode(F.when(F.col("old_path") == F.col("new_path"), one).otherwise(two)).alias("c")).select("c.path", "c.change")


def resolve_profile(items: DataFrame, titles: DataFrame, profiles: DataFrame, default_categories: list[str]) -> DataFrame:
    """(item_id, profile_id, categories): the title's profile, else the default one, else the built-in categories."""
    default = profiles.where("is_default").agg(F.min("profile_id").alias("default_id"))  # one row
    joined = items.join(titles.select("title_id", "profile_id"), "title_id", "left").crossJoin(F.broadcast(default))
    named = joined.withColumn("profile_id", F.coalesce("profile_id", "default_id")).drop("default_id")
    wide = named.join(profiles.select("profile_id", "categories"), "profile_id", "left")
    base = F.array(*[F.lit(c) for c in default_categories])
    return wide.select("item_id", "profile_id", F.when(F.col("categories").isNull() | (F.size("categories") == 0), base).otherwise(F.col("categories")).alias("categories"))


def mirror_children(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Children of titles made equal to the feed: keys, fields and ``outcome`` (inserted, updated, same, deleted).
    A null in the feed keeps the old value; deleted rows are listed with their old values."""
    a = old.select(*keys, *fields, F.lit(True).alias("_o")).alias("a")
    b = new.select(*keys, *fields, F.lit(True).alias("_n")).alias("b")
    changed = F.lit(False)
    for c in fields:
        changed = changed | (F.col(f"b.{c}").isNotNull() & ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")))
    outcome = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "deleted").when(changed, "updated").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in fields], outcome.alias("outcome"))


def audit_candidates(items: DataFrame, audits: DataFrame, longest: float = 4 * 3600, retries: int = 2) -> DataFrame:
    """Items to listen to in full: clean, enabled, last run windowed, original kept, short enough, no finished audit of
    the same content and rules, fewer than ``retries`` failed ones. ``items``: item_id, status, enabled, mode,
    original_kept, duration, content, rules, cleaned; ``audits``: item_id, content, rules, state. In order of ``cleaned``."""
    key = ["item_id", "content", "rules"]
    failed = audits.where("state = 'failed'").groupBy(*key).agg(F.count("*").alias("failures"))
    able = (F.col("status") == "clean") & F.col("enabled") & (F.col("mode") == "windowed") & F.col("original_kept") & (F.col("duration") < longest)
    open_ = items.where(able).join(audits.where("state = 'done'").select(*key), key, "left_anti").join(failed, key, "left")
    return open_.where(F.coalesce("failures", F.lit(0)) < retries).select("item_id", "cleaned").orderBy("cleaned", "item_id")


def audits_to_promote(audits: DataFrame, items: DataFrame, evidence: DataFrame, runs: DataFrame, findings: DataFrame, floor: float = 0.0, newest: int = 50, most: int | None = None) -> DataFrame:
    """Of the ``newest`` finished audits (run_id, item_id, created) those worth a run of their own: of items that are clean and have evidence, which is
    another run; that no later finished real run (``runs``: item_id, dry_run, state, created) has overtaken; and that found something new that is muted,
    not whitelisted and as sure as ``floor`` or of no told confidence. ``findings``: run_id, outcome, muted, whitelisted, confidence; what is only improved doesn't count."""
    top = audits.orderBy(F.desc("created"), F.desc("run_id")).limit(newest)
    other = top.join(items.where("status = 'clean'").select("item_id"), "item_id", "left_semi").join(evidence, "item_id").where("evidence_run_id != run_id")
    later = runs.where(~F.col("dry_run") & (F.col("state") == "done")).groupBy("item_id").agg(F.max("created").alias("last_real"))
    current = other.join(later, "item_id", "left").where("last_real is null or last_real <= created")
    sure = F.col("confidence").isNull() | (F.col("confidence") >= floor)
    new = findings.where((F.col("outcome") == "new") & F.col("muted") & ~F.coalesce("whitelisted", F.lit(False)) & sure).select("run_id")
    good = current.join(new, "run_id", "left_semi")
    if most is not None:
        good = good.orderBy(F.desc("created"), F.desc("run_id")).limit(most)
    return good.select("run_id", "item_id")


def defer_existing(items: DataFrame, runs: DataFrame) -> DataFrame:
    """``items`` with ``skip`` set for those of series (``pre_existing``) that never ran and weren't marked yet."""
    ran = runs.select("item_id").distinct().withColumn("_ran", F.lit(True))
    mark = F.col("pre_existing") & F.col("_ran").isNull() & F.col("skip").isNull()
    return items.join(ran, "item_id", "left").withColumn("skip", F.when(mark, True).otherwise(F.coalesce("skip", F.lit(False)))).drop("_ran")


def orphan_backups(backups: DataFrame, gone: DataFrame, today: Column, days: int) -> DataFrame:
    """``backups``: kept ones of items that are gone become orphans, due after ``days``, or never with 0."""
    marked = backups.join(gone.select("item_id").distinct().withColumn("_gone", F.lit(True)), "item_id", "left")
    hit = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("state") == "kept")
    due = F.date_add(today, days) if days else F.lit(None).cast("date")
    return marked.withColumn("purge_after", F.when(hit, due).otherwise(F.col("purge_after"))).withColumn("state", F.when(hit, "orphaned").otherwise(F.col("state"))).drop("_gone")
