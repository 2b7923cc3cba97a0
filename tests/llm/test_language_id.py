"""Language identification: exact code lengths, held-out accuracy, odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from cuelake.llm.language_id import code_lengths, identify, learn, op13_language_id

SF = "/root/testdata/sf0.001"
ORDER, CONTEXTS = 3, 400


def words_of(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}).lower().encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


def plain_tree(texts):
    counts = defaultdict(Counter)
    for text in texts:
        for word in words_of(text):
            for at in range(0, len(word), 64):
                padded = b" " + word[at : at + 64] + b" "
                for i in range(1, len(padded)):
                    for j in range(min(ORDER, i) + 1):
                        counts[padded[i - j : i]][padded[i]] += 1
    key = lambda c: (len(c) << 48) | int.from_bytes(c, "big")
    kept = sorted(counts, key=lambda c: (-sum(counts[c].values()), key(c)))[:CONTEXTS]
    return {c: counts[c] for c in kept}


def plain_bits(tree, word):
    bits = 0.0
    for at in range(0, len(word), 64) or [0]:
        padded = b" " + word[at : at + 64] + b" "
        for i in range(1, len(padded)):
            symbol, excluded = padded[i], set()
            context = next(padded[i - j : i] for j in range(min(ORDER, i), -1, -1) if padded[i - j : i] in tree)
            while True:
                left = {s: n for s, n in tree[context].items() if s not in excluded}
                whole = sum(left.values()) + len(left)
                if symbol in left:
                    bits -= math.log2(left[symbol] / whole)
                    break
                if left:
                    bits -= math.log2(len(left) / whole)
                excluded |= set(left)
                if not context:
                    bits += math.log2(256 - len(excluded))
                    break
                context = context[1:]
    return bits


def test_code_lengths_are_those_of_a_plain_model(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    model = learn(spark.createDataFrame(rows, "lang string, text string"), order=ORDER, contexts=CONTEXTS)
    assert model.langs == sorted({r[0] for r in rows})
    trees = {lang: plain_tree([t for x, t in rows if x == lang]) for lang in model.langs}
    words = sorted({w for _, t in rows for w in words_of(t)})[::7] + ["qüx".encode(), "中文".encode(), b"x" * 150]
    got = code_lengths(pa.array(words, pa.binary()), model)
    for i, word in enumerate(words):
        for k, lang in enumerate(model.langs):
            assert got[i, k] == pytest.approx(plain_bits(trees[lang], word), rel=1e-9), (word, lang)


def test_held_out_documents(spark):
    got = {r.doc_id: r for r in op13_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = total = 0
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if not re.search(r"[^\W\d_]", d.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out:
            total, right = total + 1, right + (r.lang_pred == d.lang)
    assert right / total > 0.95


def test_odd_rows(spark):
    teach = spark.createDataFrame([("en", "the cat sat"), ("de", "die Katze saß"), (None, "x"), ("fr", None), ("", "zzz zzz")], "lang string, text string")
    model = learn(teach)
    assert model.langs == ["", "de", "en"]
    odd = [(1, None, "a"), (1, "", "b"), (None, "12 - 34 – !", "c"), (2, "the cat", "d"), (2, "the cat", "d"), (3, "die Katze " * 200_000, "e"), (4, "zz", "f"), (5, "K" * 100_000, "g")]
    got = identify(spark.createDataFrame(odd, "id int, text string, score string").withColumnRenamed("text", "a b"), model, text_col="a b")
    assert got.columns == ["id", "a b", "lang_pred", "score"]
    assert [r.lang_pred for r in got.collect()][:7] == ["und", "und", "und", "en", "en", "de", ""]
    assert identify(spark.createDataFrame([], "text string"), model).count() == 0
    none = identify(spark.createDataFrame([("abc",)], "text string"), learn(teach.where("false")))
    assert [tuple(r) for r in none.collect()] == [("abc", "und", 0.0)]
