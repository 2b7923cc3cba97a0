"""Columns with an operator's own names come back as they were; records of many chunks stay whole over small splits."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuelake.llm import warc
from cuelake.llm.exact_dedup import drop_copies
from cuelake.llm.ngram_jaccard import drop_near_copies
from cuelake.llm.packing import pack
from cuelake.llm.token_files import read_token_files, write_token_files
from cuelake.llm.url_filter import judge_urls

from . import brute

OWN = ("_row", "_doc", "_text", "_gone", "_gone_digest", "_digest", "_cl_share", "_cl_rank", "_cl_base", "_judged", "c0", "id", "digest", "n", "run", "row", "`x.y`")


def with_own_names(df, seed=0):
    plain = [c.strip("`") for c in OWN if c.strip("`") not in df.columns]
    return df.withColumns({c: F.lit(seed + k) for k, c in enumerate(plain)}), plain


TEXTS = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v w x"), (None, "a b c d e f g"), (4, None), (5, "")]


A, Q = TEXTS[0][1], TEXTS[3][1]


@pytest.mark.parametrize(
    ("drop", "texts", "stays"),
    [
        (drop_copies, TEXTS, [(2, A), (3, Q), (5, "")]), (drop_near_copies, TEXTS, [(None, A), (1, A), (3, Q), (4, None), (5, "")]),
        (drop_near_copies, [t for t in dict.fromkeys(TEXTS) if t[0]], [(1, A), (3, Q), (4, None), (5, "")]),
    ],
)
def test_rows_stay_as_they_were(spark, drop, texts, stays):
    wide, names = with_own_names(spark.createDataFrame(texts, "doc_id long, text string"))
    out = drop(wide)
    assert out.columns == wide.columns
    rows = out.collect()
    assert {tuple(r[2:]) for r in rows} == {tuple(range(len(names)))}
    assert sorted((r[:2] for r in map(tuple, rows)), key=repr) == sorted(stays, key=repr)


def test_stages_take_any_names(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    docs, _ = with_own_names(base)
    ids = {r.doc_id for r in base.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "near_dedup":  # above
            got = stage(spark, docs, "/root/testdata/sf0.001")
            rows = got.collect()
            assert got.columns == docs.columns and len({tuple(r)[len(base.columns) :] for r in rows}) == 1
            assert {r.doc_id for r in rows} <= ids and (name == "quality" or len(rows) == len(ids) or name == "exact_dedup")
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, "/root/testdata/sf0.001").collect()} == ids


def test_pieces_and_urls_keep_their_columns(spark):
    pieces, names = with_own_names(spark.createDataFrame([(1, 0, 9), (2, 0, 3), (2, 1, 4)], "id long, piece int, length long"), 50)
    out = pack(pieces, 10)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    assert sorted(tuple(r)[:-2] for r in out.collect()) == sorted(map(tuple, pieces.collect()))
    urls, names = with_own_names(spark.createDataFrame([(1, "http://a.org/en"), (2, None)], "page_id long, url string"))
    out = judge_urls(urls)
    assert out.columns == [*urls.columns, "host", "path", "rule", "verdict", "n_candidates"]
    assert sorted(tuple(r)[: len(urls.columns)] for r in out.collect()) == sorted(map(tuple, urls.collect()))


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_long_payloads_over_small_splits(spark, broadcast):
    rng = random.Random(6)
    pages = [(k, f"http://h/{k}", rng.randbytes(rng.choice([0, 10, 90_000, 200_000])).hex()) for k in range(24)]
    pages += [(100 + k, None, pages[2][2]) for k in range(5)] + [(7, "again", "x" * 150_000)]
    conf = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.shuffle.partitions": "2"}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = {k: spark.conf.get(k, None) for k in conf}
    hadoop.set("parquet.block.size", "65536")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        got = warc.read_warc(warc.write_warc(df, archive_bytes=1 << 16, chunk=4096)).collect()
    finally:
        hadoop.unset("parquet.block.size")
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    once = [p for p in pages if p[0] != 7]
    seen = sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.record_id != 7), key=repr)
    assert seen == sorted(brute.warc(once), key=repr) and sum(r.record_id == 7 for r in got) == 2


def test_one_id_on_many_rows_is_many_files(spark):
    import public_tokenizers

    rows = [(None if k % 2 else 5, f"text {k % 40} of many words") for k in range(400)] + [(k, "x") for k in range(6)]
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), file_bytes=256)
    assert manifest.count() > 4
    got = sorted(((r.id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == [None] * 200 + sorted(i for i in ids if i is not None)
    want = brute.token_files([(k, t) for k, t in rows if k is not None] + [(-1, t) for k, t in rows if k is None])
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == sorted((w[0], w[2], w[3]) for w in want)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]


def test_rules_as_a_table(spark, monkeypatch):
    from cuelake.llm import url_filter

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "http://Casino.example.org/es/\nx?y"), (-3, "http://a.casino.net/b/wp-login.php")], "page_id long, url string"))
    more = [(f"host{k}.com", f"/p{k}/", "block") for k in range(300)]
    rules, patterns = url_filter.CONTRACT_RULES + more, url_filter.DEFAULT_PATTERNS
    got = url_filter.judge_urls_by_table(pages.withColumn("_row", F.lit(5)), url_filter.rule_table(spark, rules, patterns))
    want = url_filter.judge_urls(pages, rules, patterns)
    columns = ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, want.select(*columns).collect()), key=repr)
    assert {r._row for r in got.select("_row").collect()} == {5} and got.where("n_candidates > 20").count() == 0
    monkeypatch.setattr(url_filter, "MOST_RULES", 10)
    with pytest.raises(ValueError, match="by_table"):
        url_filter.judge_urls(pages, rules, patterns)
