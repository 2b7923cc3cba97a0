"""Tables in which ids repeat or are missing while the rows differ."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from cuelake.llm import embedding_dedup, exact_dedup, ngram_jaccard, token_files, warc

from . import brute

KINDS = "doc_id long, text string, mark int"


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_copies_go_by_row(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (1, "unique", 2), (2, "a", 3), (3, "", 4), (3, None, 5)], KINDS)
    assert left(exact_dedup.drop_copies(df).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))) == [(1, "unique"), (2, "a"), (3, "")]
    df = spark.createDataFrame([(None, "a", 0), (5, "a", 1), (None, "b", 2), (None, "c", 3), (None, "c", 4)], KINDS)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert left(kept) == sorted([(5, "a"), (None, "b"), (None, "c")], key=repr)


def test_near_copies_go_by_row(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    df = spark.createDataFrame([(7, near, 0), (9, near + " end", 1), (9, "some other text that links with nothing at all", 2), (7, "one more of that id and nothing like it here", 3), (7, near, 4), (None, near, 5), (4, None, 6), (4, "", 7)], KINDS)
    out = ngram_jaccard.drop_near_copies(df, n=3, similarity=(8, 10))
    assert out.columns == df.columns
    marks = {r.mark for r in out.collect()}
    assert marks - {0, 4} == {2, 3, 5, 6, 7} and len(marks & {0, 4}) == 1


def test_near_copies_of_single_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    df = spark.createDataFrame([(7, near, 0), (9, near + " end", 1), (8, "another text of some words", 2), (None, near, 3)], KINDS)
    assert {r.mark for r in ngram_jaccard.drop_near_copies(df, n=3, similarity=(8, 10)).collect()} == {0, 2, 3}


def test_warc_records_of_repeated_and_missing_ids(spark):
    big = "é\r\n" * 600_000
    pages = [(1, "a", "x"), (1, "b", "other"), (2, "c", "x"), (None, "d", "x"), (None, "e", "only here"), (None, None, None), (3, "f", big), (3, "g", big + "!"), (1, "h", "x")]
    out = warc.read_warc(warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string")))
    rows = []
    for i, u, h in pages:
        data = (h or "").encode()
        of_text = [j for j, _, t in pages if (t or "") == (h or "") and j is not None]
        again = i is not None and min(of_text) < i
        rows.append((i, u, "revisit" if again else "response", min(of_text) if again else None, len(data), warc.base32_digest(hashlib.sha1(data).digest())))
    assert sorted((tuple(r) for r in out.select("record_id", "target", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()), key=repr) == sorted(rows, key=repr)


def test_token_files_of_repeated_and_missing_ids(spark):
    """Documents of several blocks side by side, two of one id and two without an id."""
    import public_tokenizers

    def long(word):
        return " ".join(f"{word}{k}" for k in range(30_000))

    docs = [(5, long("a")), (5, long("b")), (None, long("c")), (None, long("d")), (None, None), (-(2**63), "least id"), (7, "last")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_files.read_token_files(token_files.write_token_files(spark.createDataFrame(docs, "doc_id long, text string"), path)).orderBy("start").collect()
    want = []
    for i, text in docs:
        (row,) = brute.token_files([(0, text)])
        want.append((i, *row[2:]))
    assert max(w[1] for w in want) > token_files.BLOCK_IDS
    assert sorted(((r.id, r.n_tokens, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    assert [r.id for r in out] == [None] * 3 + [-(2**63), 5, 5, 7]
    assert [r.start for r in out] == [sum(r.n_tokens for r in out[:k]) for k in range(len(out))]


def test_vectors_of_repeated_and_missing_ids(spark):
    """One id on two vectors and on two labels, and vectors without ids, against all pairs of rows."""
    near, far, other = [1.0, 0.0, 0.01], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, near, 0), (1, far, 0), (1, near, 1), (2, [1.0, 0.0, 0.02], 0), (2, near, 0), (3, [0.0, 1.0, 0.01], 0), (4, near, 1), (None, near, 0), (None, other, 0), (6, [0.0, 0.01, 1.0], 0), (None, far, 2), (None, [0.01, 1.0, 0.0], 2)]

    def links(a, b):
        dot = sum(x * y for x, y in zip(a[1], b[1]))
        return a[2] == b[2] and dot / math.sqrt(sum(x * x for x in a[1]) * sum(x * x for x in b[1])) >= 0.98

    want = []
    for i, row in enumerate(rows):
        reached, at = {i}, [i]
        while at:
            k = at.pop()
            more = {j for j in range(len(rows)) if j not in reached and links(rows[k], rows[j])}
            reached |= more
            at += more
        want.append((row[0], sum(j != i and links(row, rows[j]) for j in range(len(rows))), min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)))
    out = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((tuple(r) for r in out.select("id", "n_links", "component_id").collect()), key=repr) == sorted(want, key=repr)


def test_every_link_inside_components(spark):
    """Variants of a few texts, with copies, repeated and missing ids: every pair of rows, not only what connects them."""
    rng, rows = random.Random(5), [(1, None), (2, "")]
    bases = [[f"w{rng.randrange(60)}" for _ in range(80)] for _ in range(2)]
    for i in range(50):
        words = list(bases[i % 2])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = f"v{rng.randrange(5)}"
        rows.append((None if i % 9 == 0 else i % 20, " ".join(words)))
    rows += rows[10:14]
    links, members = ngram_jaccard.near_links(spark.createDataFrame(rows, "doc_id long, text string"), n=2, similarity=(9, 10))
    sets = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in ((t or "").split() for _, t in rows)]
    want = Counter()
    for a in range(len(rows)):
        n = sum(1 for b in range(len(rows)) if a != b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]))
        want[rows[a][0], len(sets[a]), n] += 1
    pairs, of = [tuple(r) for r in links.collect()], members.collect()
    assert len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs)
    size, degree = Counter(r["class"] for r in of), Counter()
    for a, b in pairs:
        degree[a] += size[b]
        degree[b] += size[a]
    assert Counter((r.id, r.n_shingles, 0 if r["class"] is None else size[r["class"]] - 1 + degree[r["class"]]) for r in of) == want
    assert len(pairs) > len(size)
