"""Queries over a whole small table against plain versions."""

import pytest

from cuelake.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name, columns):
    return sorted((tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()), key=repr)


def test_op1(spark, docs):
    got = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    want = brute.pieces(docs)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == want
    assert len({r.sequence_id for r in got}) == brute.best_fit([w[3] for w in want])
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_op2(spark, docs):
    got = [tuple(r) for r in QUERIES["op2_token_files"](spark, SF).orderBy("doc_id").collect()]
    assert got == brute.token_files(docs)


def test_op3(spark, docs):
    assert rows(spark, "op3_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == brute.round_trip(docs)


def test_op6(spark, docs):
    assert rows(spark, "op6_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.repeats(docs, 200)


def test_op10(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows(spark, "op10_warc", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == sorted(brute.warc(pages), key=repr)
