"""Results of queries whose steps were made to grow with their input only, and of SQL that said something else."""

import datetime as dt

from cuelake.plans.registry import ORACLE_SQL, QUERIES


def test_a_span_that_no_range_touches_is_not_covered(spark, tmp_path):
    """``least`` and ``greatest`` leave out nulls in DuckDB, so the SQL had a span without ranges covered whole."""
    import duckdb

    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, 7, "view", 0.0, "{}"), (2, at + dt.timedelta(hours=9), 7, "view", 60.0, "{}"), (3, at, 8, "view", 0.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.covered for r in QUERIES["range_coverage"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(con.sql(ORACLE_SQL["range_coverage"]).fetchall()) == {1: 0.0, 2: 600 / 7200, 3: 0.0}


ODD = ["of", "the", "--", "Of’", "(THE)", "", "ﬁne", "of\x1cthe", "¨", "rewh!", "*", "“Straße”", "REWH", "of", "...", "the", "of", "the", "İnoran", "x\u0085y", "a b", "hehely"]


def test_hits_in_lists_of_words(spark):
    """Without a row or a shuffle for each word, and what the joined rows of words say."""
    from pyspark.sql import functions as F

    from cuelake.functions import text
    from cuelake.operators import lexicon
    from cuelake.plans import fixtures as fx

    lists = spark.createDataFrame([(1, ODD), (2, []), (3, ["--"]), (4, None), (5, ["of", None, "the", "of", "the"]), (6, ODD[::-1] * 300)], "item_id long, words array<string>")
    rows = lists.select("item_id", F.posexplode("words").alias("word_index", "word"))
    norms = rows.select("item_id", "word_index", F.coalesce(text.fold(text.strip_wrappers(F.col("word"))), F.lit("")).alias("norm"))
    folded = lists.select("item_id", F.posexplode(text.folded_lists(F.col("words"))).alias("word_index", "norm"))
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert plain(folded.select("item_id", "word_index", F.coalesce("norm", F.lit("")))) == plain(norms)
    joined = lexicon.join_tokens(norms)
    hits = lexicon.match_lexicon(joined.select("item_id", "joined"), "joined", fx.LEXICON).drop("joined")
    want = lexicon.span_to_tokens(hits, joined)
    got = lexicon.list_hits(lists, "words", fx.LEXICON)
    assert plain(got) == plain(want.select(*got.columns)) and got.count() > 900
    assert "Exchange" not in got._jdf.queryExecution().optimizedPlan().toString() and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rules_in_scope_travel_in_packs(spark, monkeypatch):
    from cuelake.operators import catalog

    monkeypatch.setattr(catalog, "_PACK", 3)
    items = [(i, i % 3 if i % 5 else None) for i in range(40)] + [(7, 1)]
    rules = [(r, ("global", "title", "item")[r % 3], None if r % 3 == 0 else r % 4 if r % 3 == 1 else r) for r in range(50)] + [(99, "title", None), (1, "title", 1)]
    got = catalog.rules_in_scope(spark.createDataFrame(items, "item_id long, title_id long"), spark.createDataFrame(rules, "rule_id long, scope string, scope_id long"))
    want = [(i, r, s) for i, t in items for r, s, k in rules if s == "global" or k is not None and k == {"title": t, "item": i}[s]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan
    assert not catalog.rules_in_scope(spark.createDataFrame(items, "item_id long, title_id long"), spark.createDataFrame([], "rule_id long, scope string, scope_id long")).count()


def test_rules_in_scope_are_dealt_evenly(spark, monkeypatch):
    """Whichever side is small, and whichever is broadcast: pairs are spread over tasks, and nulls are told as SQL tells them."""
    from pyspark.sql import functions as F

    from cuelake.operators import catalog

    monkeypatch.setattr(catalog, "_PACK", 16)
    items = [(i, 1) for i in range(3000)] + [(None, 2)]
    rules = [(r, "global" if r % 2 else "title", None if r % 2 else 1) for r in range(40)] + [(None, "title", 2)]
    got = catalog.rules_in_scope(spark.createDataFrame(items, "item_id long, title_id long"), spark.createDataFrame(rules, "rule_id long, scope string, scope_id long"))
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 3001 * 20 + 3000 * 20 + 1 and max(parts) < 0.15 * sum(parts)
    assert sorted((r.rule_id or -1 for r in got.where("item_id is null").collect())) == [-1, *range(1, 40, 2)]


def test_only_what_may_matter_leaves_the_lists(spark):
    """Pieces where the phrase may stand, and words like its own; of long lists without them nothing."""
    from pyspark.sql import functions as F

    from cuelake.functions import text
    from cuelake.operators import lexicon
    from cuelake.plans import fixtures as fx

    phrase = [fx.LEXICON[4]]
    far = ["of", *["x"] * 20, "the"]
    lists = spark.createDataFrame([(1, ["x"] * 500 + ["Of", "The,"] + ["x"] * 500), (2, far * 9), (3, ["thé", "then", "--", "of", "--", "the"]), (4, ["of\x01the", "of", "the"]), (5, ["oF", "the"] * 3), (6, []), (7, None)], "item_id long, words array<string>")
    told = lists.select("item_id", lexicon.hit_pieces("words", phrase).alias("p"), text.resembling(F.col("words"), ["of the", "of", "the"], 85.0).alias("w")).collect()
    assert {r.item_id: [(x["at"], x["joined"].split(" ")[:2]) for x in r.p] for r in told if r.item_id < 3} == {1: [(1000, ["of", "the"])], 2: []}
    assert {r.item_id: [tuple(x) for x in r.w] for r in told if r.item_id in (1, 3)} == {1: [(500, "of"), (501, "the")], 3: [(1, "then"), (3, "of"), (5, "the")]}
    assert max(len(x["index"]) for r in told for x in r.p or []) < 20
    # A control character between the words is no gap, whatever else the list holds.
    got = sorted(tuple(r) for r in lexicon.list_hits(lists, "words", phrase).select("item_id", "char_start", "first_word", "last_word").collect())
    assert got == [(1, 1000, 500, 501), (4, 7, 1, 2), (5, 0, 0, 1), (5, 7, 2, 3), (5, 14, 4, 5)]


def test_folded_words_all_at_once():
    import random

    import pyarrow as pa

    from cuelake.functions import text

    random.seed(1)
    said = ["".join(random.choice("aB'-–—’ʼ‘‑ \t\x1c\x00.,“”*$ﬁß¨İſKς\x85…ÉØ×«¿́") for _ in range(random.randint(0, 6))) for _ in range(5000)]
    assert text._fold_words(pa.array([*ODD, *said])).to_pylist() == [text._fold_word(w) for w in [*ODD, *said]]
