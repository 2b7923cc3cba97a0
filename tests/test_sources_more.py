"""Word lists as files, runs in versions, alignment of probes, hits of transcripts: against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import align
from cuelake.sources import readers, run_table


def lists(path, **files):
    for name, doc in files.items():
        (path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    return str(path)


def test_word_lists(spark, tmp_path):
    mild = {"category": "mild", "entries": [
        {"canonical": "darn", "forms": ["darning", "darn", "darnin'"], "compounds": [{"canonical": "darnfool", "forms": ["darn-fool"]}]},
        {"canonical": "oh dear me", "is_phrase": True, "focus": ["dear"]}, {"canonical": "heck", "enabled": False, "note": "too mild"}]}
    strong = {"category": "strong", "entries": [{"canonical": "blast"}]}
    rows = {r.canonical: r for r in readers.read_word_lists(spark, lists(tmp_path, mild=mild, strong=strong)).collect()}
    assert set(rows) == {"darn", "darnfool", "oh dear me", "heck", "blast"}
    assert rows["darn"].forms == ["darnin'", "darning", "darn"] and rows["darnfool"].parent == "darn" and rows["darnfool"].forms == ["darn-fool", "darnfool"]
    assert rows["oh dear me"].is_phrase and rows["oh dear me"].focus == ["dear"] and not rows["heck"].enabled and rows["heck"].note == "too mild"
    assert rows["blast"].category == "strong" and rows["blast"].parent is None


@pytest.mark.parametrize(
    ("entry", "says"),
    [({"canonical": "x", "enabled": False}, "without a note"), ({"canonical": "x", "is_phrase": True}, "contradicts"), ({"canonical": "x", "forms": ["a b"]}, "several words"),
     ({"canonical": "x", "focus": ["x"]}, "focus on a word"), ({"canonical": "x y", "focus": ["z"]}, "aren't part"), ({"canonical": "y", "compounds": [{"canonical": "y"}]}, "given twice")],
)
def test_bad_word_lists(spark, tmp_path, entry, says):
    with pytest.raises(Exception, match=says):
        readers.read_word_lists(spark, lists(tmp_path, mild={"category": "mild", "entries": [entry]})).collect()


def test_runs_in_versions(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/runs"
    make = lambda *rows: spark.createDataFrame(list(rows), "run_id long, start long, end long, canonical string")
    rows = lambda: sorted((r.run_id, r.idx, r.start, r.canonical) for r in run_table.read_runs(spark, path).collect())
    first = run_table.write_run_version(make((1, 5, 6, "b"), (1, 2, 3, "a"), (1, 2, 3, "A"), (2, 0, 1, "c")), path)
    old = rows()
    assert old == [(1, 0, 2, "A"), (1, 1, 2, "a"), (1, 2, 5, "b"), (2, 0, 0, "c")]
    reader = run_table.read_runs(spark, path)
    with monkeypatch.context() as m:
        m.setattr(run_table.F, "unix_micros", lambda c: F.raise_error(F.lit("disk full")).cast("long"))
        with pytest.raises(Exception, match="disk full"):
            run_table.write_run_version(make((1, 9, 9, "new"), (2, 9, 9, "new")), path)
    assert rows() == old and run_table.obsolete_versions(spark, path).count() == 0
    second = run_table.write_run_version(make((1, 7, 8, "z")), path)
    assert rows() == [(1, 0, 7, "z"), (2, 0, 0, "c")] and run_table.obsolete_versions(spark, path).count() == 0
    # A reader from before sees what was there then.
    assert sorted((r.run_id, r.idx, r.start, r.canonical) for r in reader.collect()) == old
    third = run_table.write_run_version(make((2, 1, 1, "q"), (1, 1, 1, "q")), path, keep=F.col("run_id") == 2)
    assert rows() == [(2, 0, 1, "q")]
    assert {r.version for r in run_table.obsolete_versions(spark, path).collect()} == {first, second} and third not in (first, second)


def pairs(a, b):
    cost = [[max(i, j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@pytest.mark.parametrize("cells", [50, 1 << 22])
def test_probes_in_batches(spark, monkeypatch, cells):
    monkeypatch.setattr(align, "_CELLS", cells)
    rng = random.Random(3)
    said = lambda: [(rng.choice(["a", "bb", "ccc", "dddd", "eee", None]), rng.randrange(5000)) for _ in range(rng.choice([0, 1, 4, 9, 20]))]
    rows = [(k % 3, k, said(), said()) for k in range(120)]
    word = "array<struct<word:string,start_ms:long>>"
    got = {r.probe: (r.deltas, r.coverage) for r in align.align_probe(spark.createDataFrame(rows, f"item_id long, probe int, sub {word}, stt {word}")).collect()}
    for _, k, sub, stt in rows:
        met = pairs([w for w, _ in sub], [w for w, _ in stt])
        assert got[k][0] == [stt[j][1] - sub[i][1] for i, j in met if sub[i][0] and len(sub[i][0]) >= 3]
        assert got[k][1] == pytest.approx(len(met) / len(sub) if sub else 0.0)


def test_transcript_hits(spark):
    from test_rules_of_record import ENTRIES

    said = [("oh", 0.5), ("god", 0.4), ("darn", 0.8), ("", None), ("god", 0.9), ("", None), ("darn", None), ("kickback", 0.7), ("darning", 0.25)]
    rows = [(1, i, w, i * 1000, i * 1000 + 500, p) for i, (w, p) in enumerate(said)] + [(1, 20, "git", None, None, 0.5), (2, 0, "git", 0, 10, 0.5), (3, 0, "git", 0, 10, 0.5)]
    words = spark.createDataFrame(rows, "item_id long, word_index int, norm string, start_ms long, end_ms long, probability double")
    found = spark.createDataFrame([(1, "darn", 6500, 6600), (1, "god", 7000, 7600), (2, "git", 10, 20)], "item_id long, canonical string, d0 long, d1 long")
    rules = spark.createDataFrame([("git", "item", 3, None, "suppress"), ("kickback", "global", None, "nowhere", "suppress")], "canonical string, scope string, scope_id long, context_text string, mode string")
    got = sorted(tuple(r) for r in align.transcript_hits(words, ENTRIES, found, rules).collect())
    assert got == [
        (1, "darn", "mild", "darning", 8000, 8500, 0.25), (1, "god", "religious", "god", 4000, 4500, 0.9), (1, "god darn", "religious", "god darn", 1000, 2500, 0.6), (1, "kickback", "strong", "kickback", 7000, 7500, 0.7),
    ]
    assert len(align.transcript_hits(words, ENTRIES, found).collect()) == 5


def test_what_is_told_of_a_file(spark):
    body = {"streams": [{"codec_type": "video"}, {"codec_type": "attachment"}, {"codec_type": "attachment"}], "format": {"tags": {"X_HASH": "abc"}}}
    df = spark.createDataFrame([("f", json.dumps(body)), ("g", json.dumps({"streams": [{"codec_type": "audio"}]}))], "doc string, body string")
    told = lambda **more: {(r.doc, r.attachments, r.already_clean) for r in readers.explode_media_streams(df, **more).collect()}
    assert told(hash_tag="x_hash", profile="abc") == {("f", 2, True), ("g", 0, False)}
    assert told(hash_tag="x_hash", profile="abd") == told() == {("f", 2, False), ("g", 0, False)}
