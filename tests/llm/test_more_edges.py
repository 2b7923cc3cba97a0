"""Repeated and missing ids, clashing names, odd characters, and groups whose members part."""

import random

from pyspark.sql import functions as F

from cuelake.llm import bpe, ngram_jaccard, packing, token_files, url_filter, warc

from . import brute


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_groups_whose_members_part(spark):
    """Three texts of one size and one prefix, of which only two link, both ways round, and copies of them."""
    rng = random.Random(3)
    pool = [f"p{i}" for i in range(60)]
    first, second = pool[:17], pool[20:37]
    third = [*second[:-1], pool[40]]
    for order in ((first, second, third), (third, second, first)):
        rows = [(i + 1, " ".join(["a", "b", "c", *words])) for i, words in enumerate(order)]
        rows += [(7, rows[1][1]), (8, rows[2][1])]
        rows += [(20 + i, " ".join(rng.sample(pool, 25))) for i in range(30)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = sorted(brute.near(rows, 1, 9, 10), key=repr)
        assert got(ngram_jaccard.near_documents(df, n=1, similarity=(9, 10)), "id", "n_shingles", "component_id") == want
        assert len({t for i, _, t in want if i in (1, 2, 3)}) == 2


def test_many_chunks_and_buckets(spark, monkeypatch):
    """Texts of several chunks per task meet in the same lists, and one text may be a chunk."""
    monkeypatch.setattr(ngram_jaccard, "CHUNK_TOKENS", 40)
    hot_tokens = ngram_jaccard._hot_tokens
    told = []

    def hot(placed, n):
        # Every text is a sample, and what three texts share is often.
        monkeypatch.setattr(ngram_jaccard, "HOT_FROM", 3)
        told.append(hot_tokens(placed.withColumn("place", F.col("place") * 64), n))
        return told[-1]

    monkeypatch.setattr(ngram_jaccard, "_hot_tokens", hot)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(90)}" for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(60):
        words = list(base[i % 4])
        words[rng.randrange(30)] = f"v{i % 7}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ngram_jaccard.near_documents(df, n=2, similarity=(8, 10)), "id", "n_shingles", "component_id") == sorted(brute.near(rows, 2, 8, 10), key=repr)
    assert len(told[0]) > 50


def test_pieces_of_repeated_and_missing_ids(spark):
    rows = [(None, "a b"), (None, "a b"), (None, None), (3, "x " * 5000), (3, "x " * 5000), (3, "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sequence_id int")
    out = packing.packed_documents(df)
    want = brute.pieces(rows)
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == want
    assert out.select("sequence_id").distinct().count() == brute.best_fit([w[3] for w in want])


def test_bpe_of_repeated_rows(spark):
    rows = [(1, "it's a<|endoftext|> b  c\n"), (1, "it's a<|endoftext|> b  c\n"), (None, "  lead"), (2, "trail "), (3, "no break  wide"), (4, "a" * 3000), (5, " \t x"), (6, "é" * 500 + " ünï")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("id", F.lit(9))
    assert got(bpe.encode_decode(df, path()), "id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.round_trip(rows)
    back = {r.id: r.decoded for r in bpe.encode_decode(df.where("doc_id > 1"), path(), with_ids=True).collect()}
    assert back == {i: t for i, t in rows if i and i > 1}


def test_token_files_dealt_to_many(spark):
    """More ranges than documents, and files of a few bytes."""
    rng = random.Random(1)
    rows = [(i * 3, " ".join(f"t{rng.randrange(99)}" for _ in range(rng.randrange(80)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = token_files.write_token_files(df, path(), file_bytes=100)
    assert manifest.count() > 10
    assert sorted(map(tuple, token_files.read_token_files(manifest).collect())) == brute.token_files(rows)


def test_urls_with_breaks_and_names(spark):
    df = spark.createDataFrame([(1, "http://example.org/es/\nx"), (2, "http://a.org\n/en"), (1, "http://example.org/es/\nx")], "page_id long, url string").withColumns({c: F.lit("mine") for c in ("_url", "_judged", "token", "verdict")})
    rows = url_filter.judge_urls(df).collect()
    assert [(r.page_id, r.rule, r._url, r.token) for r in sorted(rows, key=lambda r: r.page_id)] == [(1, "example.org/es/", "mine", "mine")] * 2 + [(2, None, "mine", "mine")]


def test_warc_of_clashing_names(spark):
    pages = [(1, "u", "x" * 10), (2, None, "x" * 10), (3, "u", ""), (4, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(5) for c in ("row", "digest", "record_id", "last", "bytes", "share", "first")})
    out = warc.read_warc(warc.write_warc(df, chunk=3))
    assert got(out, "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(brute.warc(pages), key=repr)
    small = warc.read_warc(warc.write_warc(df, min_revisit_bytes=11))
    assert {r.record_type for r in small.collect()} == {"response"}
