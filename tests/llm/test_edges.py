"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.llm import bpe, embedding_dedup, exact_dedup, ngram_jaccard, packing, quality, suffix_dedup, token_files, url_filter, warc

from . import brute

DOCS = "doc_id long, text string, source string, lang string, rank int, row int, mark string"


def table(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "x<|endoftext|>", "it's", "42", "--", "zeta\n"]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(9000))
    passage = " ".join(f"w{rng.randrange(1000)}" for _ in range(40))
    texts = [None, "", " ", "a", "a", "A a", passage, passage + " end", "start " + passage, long, long + " tail", "é" * 150, "é" * 151, "ab" * 200, "\t\n", passage]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(20)]
    return [(i, t, "s", "en", 1, 2, "m") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), DOCS)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in table()]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_packing(docs, plain):
    out = packing.packed_documents(docs)
    want = brute.pieces(plain)
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == want
    assert out.select("sequence_id").distinct().count() == brute.best_fit([w[3] for w in want])


def test_token_files(docs, plain):
    import public_tokenizers

    out = token_files.read_token_files(token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))
    assert sorted(map(tuple, out.collect())) == brute.token_files(plain)


def test_bpe(docs, plain):
    import public_tokenizers

    assert got(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")), "id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.round_trip(plain)


def test_exact(spark, docs, plain):
    twice = docs.union(docs.where("doc_id = 6"))
    out = exact_dedup.digest_groups(twice)
    rows = plain + [plain[6]]
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    want = sorted(((d, max(groups[t or ""]), len(groups[t or ""])) for d, t in rows), key=repr)
    assert got(out, "id", "keep_id", "group_size") == want
    kept = exact_dedup.drop_copies(twice)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10), (2, 1, 2)])
def test_near(docs, plain, n, num, den):
    assert got(ngram_jaccard.near_documents(docs, n=n, similarity=(num, den)), "id", "n_shingles", "component_id") == sorted(brute.near(plain, n, num, den), key=repr)


def test_near_groups_of_variants(spark):
    """Many variants of a few texts, which must stay in their components whatever the order of the rounds."""
    rng, rows = random.Random(5), []
    bases = [[f"w{rng.randrange(60)}" for _ in range(80)] for _ in range(3)]
    for i in range(90):
        words = list(bases[i % 3])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(80)] = f"v{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_jaccard.near_documents(df, n=2, similarity=(9, 10)), "id", "n_shingles", "component_id") == sorted(brute.near(rows, 2, 9, 10), key=repr)


def test_near_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "x y z w"), (5, "x y z w"), (None, "a b c d")], "doc_id long, text string")
    assert got(ngram_jaccard.near_documents(df, n=2), "id", "component_id") == sorted([(1, 1), (1, 1), (5, 1), (None, None)], key=repr)


@pytest.mark.parametrize(("size", "crowd"), [(200, 8192), (30, 8192), (12, 1), (2, 3)])
def test_repeats(docs, plain, size, crowd):
    short = [(d, None if t is None else t[:3000]) for d, t in plain]
    df = docs.withColumn("text", F.substring("text", 1, 3000))
    found = suffix_dedup.find_repeats(df, min_bytes=size, crowd=crowd)
    out = found.table.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("_cl_spans").alias("spans"))
    out = out.mapInArrow(suffix_dedup._kept, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert got(out, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(short, size)
    found.close()


def test_drop_repeats_keeps_rows(docs):
    out = suffix_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_quality(spark, docs):
    labels = spark.createDataFrame([(3, 0, 0), (4, 0, None), (None, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    heads = quality.fit(docs, labels, quality.TARGETS)
    out = quality.judge(docs, heads, F.col("source"), F.concat_ws("/", "source", "lang"))
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
    assert out.where("kept is null").count() == 0
    heads = quality.fit(docs, labels.limit(0), quality.TARGETS)
    assert quality.judge(docs, heads, F.col("source"), F.col("lang")).where("not kept").count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where("doc_id % 4 != 0")
    heads = quality.fit(docs, known, quality.TARGETS)
    held = docs.join(labels.where("doc_id % 4 = 0"), "doc_id")
    out = quality.judge(held, heads, F.col("source"), F.concat_ws("/", "source", "lang")).select("quality", "toxic", "kept").toPandas()
    clean = (out.quality == 1) & (out.toxic == 0)
    assert out[clean].kept.mean() > 0.98
    assert out[out.quality == 0].kept.mean() < 0.05


def test_vectors(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in base[i % 12]], i % 3 % 2) for i in range(150)]
    rows += [(200 + i, base[0], 0) for i in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, base[0], None), (304, [None] * 16, 0), (305, [], 0), (306, base[0][:8], 0), (307, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got(embedding_dedup.near_vectors(df), "id", "n_links", "component_id") == sorted(brute.vectors(stored, 0.98), key=repr)


def test_urls(spark):
    urls = [None, "", "nohost", "http://", "HTTP://A.ORG/x", "http://example.org/es/1", "http://www.example.org/en/19?x#y", "http://example.com/fr/a", "http://x.com/de/#/", "http://org", "http://org/",
            "http://notorg/", "http://spam-farm.example.net/", "http://a.com/fr", "x://y://z.org/é", "http://example.org/es/1"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert len(out) == len(urls)
    assert out[0] == ("", "", None, "allow") and out[2] == ("", "", None, "allow")
    assert out[4] == ("a.org", "/x", "org/", "allow") and out[5] == ("example.org", "/es/1", "example.org/es/", "block")
    assert out[6] == ("www.example.org", "/en/19", "example.org/en/1", "block")
    assert out[7][2:] == ("com/fr/", "allow") and out[8] == ("x.com", "/de/", "com/de/", "block")
    assert out[9] == ("org", "", None, "allow") and out[10][2:] == ("org/", "allow") and out[11][2] is None
    assert out[12][2:] == (None, "block") and out[13][2:] == (None, "allow") and out[14][0] == "y:"


def test_warc(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\n", None), (4, "", ""), (5, "u", "é\r\n\r\n" * 500_000), (6, "u", "WARC/1.0\r\n"), (7, "v", "é\r\n\r\n" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.read_warc(warc.write_warc(df))
    assert got(out, "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(brute.warc(rows), key=repr)


def test_empty_tables(spark, docs):
    import public_tokenizers

    none = docs.limit(0)
    assert packing.packed_documents(none).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert exact_dedup.digest_groups(none).count() == 0
    assert ngram_jaccard.near_documents(none).count() == 0
    assert suffix_dedup.drop_repeats(none).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages).count() == 0 and warc.read_warc(warc.write_warc(pages)).count() == 0
