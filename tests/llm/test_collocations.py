"""Collocations against a plain version; automata against counters."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import collocations as col

LOW = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=10, inside=50, top=2000):
    counts, out = {}, []
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            c = counts.setdefault("und" if lang is None else lang, Counter())
            c.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {part for p, a in cand.items() if len(p) == 3 for part in (p[:2], p[1:]) if part in cand and 100 * a >= inside * cand[part]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def got(spark, rows, **more):
    return sorted(tuple(r) for r in col.collocations(spark.createDataFrame(rows, "lang string, text string"), **more).collect())


def test_odd_rows_small_shards_and_many_ranges(spark, monkeypatch):
    for name, value in (("SHARD_WORDS", 37), ("STRETCH", 10), ("SLICE", 400), ("RANGE", 16), ("_ARCS", 50)):
        monkeypatch.setattr(col, name, value)
    rows = [("en", "The cat sat. The cat\tsat on; a mat, the cat sat on a mat!"), ("en", None), (None, "a b a b a b"), ("en", ""), ("", "x y z x y z"), ("fr", "éa éa éa éa éa\néa éa"), ("fr", "a\x01 b a b a\x01 b a b a\x01 b")] * 4
    rows += [("en", "the cat sat on " * 60)]
    assert got(spark, rows, least=3) == plain(rows, 3)
    assert got(spark, rows, least=2, inside=100, top=3) == plain(rows, 2, 100, 3)


def test_empty_tables_and_clashing_names(spark):
    assert got(spark, []) == []
    assert got(spark, [("en", None), ("en", "one two")]) == []
    odd = spark.createDataFrame([("en", "a b " * 12, 3, 4)], "lang string, `x.y` string, shard int, row int")
    assert sorted(tuple(r) for r in col.collocations(odd, text_col="x.y").collect()) == plain([("en", "a b " * 12)])


GRAMS = st.dictionaries(st.tuples(*[st.integers(0, 4)] * 3), st.integers(1, 3), max_size=40)


def automaton(triples):
    pairs = Counter()
    for (x, y, _), n in triples.items():
        pairs[x << 32 | y] += n
    keys = np.array(sorted(pairs), np.uint64)
    order = sorted(triples)
    of = np.searchsorted(keys, np.array([x << 32 | y for x, y, _ in order], np.uint64)).astype(np.int64)
    return col.CountTransducer.build(keys, np.array([pairs[int(k)] for k in keys], np.int64), of, np.array([z for *_, z in order], np.int64), np.array([triples[t] for t in order], np.int64))


def grams(t):
    of, third, n = t.triples()
    pairs = [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in t.pairs()]
    return {(*pairs[i], int(z)): int(k) for i, z, k in zip(of, third, n)}, dict(zip(pairs, t.second_n.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(GRAMS, min_size=1, max_size=4), st.integers(1, 4))
def test_automata_are_minimal_and_add_up(parts, least):
    made = [col.CountTransducer.from_bytes(automaton(p).to_bytes()) for p in parts]
    for part, t in zip(parts, made):
        assert grams(t)[0] == part
        states = [tuple(zip(t.third[a:b].tolist(), t.third_n[a:b].tolist())) for a, b in zip(t.state_at[:-1], t.state_at[1:])]
        assert len(set(states)) == len(states)
    total = sum((Counter(p) for p in parts), Counter())
    pairs = Counter()
    for (x, y, _), n in total.items():
        pairs[x, y] += n
    want = ({t: n for t, n in total.items() if n >= least}, {p: n for p, n in pairs.items() if n >= least})
    whole = col.union(made, least)
    assert grams(whole) == want
    asked = [(x, y) for x in range(5) for y in range(5)]
    at = whole.places(np.array([x << 32 | y for x, y in asked], np.uint64))
    assert [int(whole.second_n[i]) if i >= 0 else None for i in at] == [want[1].get(p) for p in asked]
