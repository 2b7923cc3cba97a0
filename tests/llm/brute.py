"""Plain versions of the operators, for small tables held in memory."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def pieces(rows, capacity=4096):
    t, out = tokenizer("word_bpe_49k.json"), []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            out.append((doc, k // capacity, k, len(ids[k : k + capacity]), crc(ids[k : k + capacity])))
    return sorted(out, key=repr)


def best_fit(lengths, capacity=4096):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def token_files(rows):
    t, out, at = tokenizer("byte_bpe_50k.json"), [], 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def round_trip(rows):
    t, out = tokenizer("byte_bpe_50k.json"), []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), sha256(np.array(ids, "<u4").tobytes()), sha256(t.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out, key=repr)


def components(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near(rows, n, num, den):
    sets = {doc: shingle_set(text, n) for doc, text in rows}
    ids, links = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common * den >= (len(sets[a]) + len(sets[b]) - common) * num:
                    links.append((a, b))
    top = components(ids, links)
    return [(i, len(sets[i]), top[i]) for i in ids]


def repeats(rows, size):
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    count = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    out = []
    for doc, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out.append((doc, len(t), int(gone.sum()), spans, sha256(kept)))
    return sorted(out, key=repr)


def warc(rows):
    data = {page: (html or "").encode() for page, _, html in rows}
    first = {}
    for page in sorted(data):
        first.setdefault(data[page], page)
    return [
        (p, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if first[d] == p else "revisit", None if first[d] == p else first[d])
        for p, d in sorted(data.items())
    ]


def vectors(rows, threshold):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, np.float64))
    links, ids = [], sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (la, x), (lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and (np.array_equal(x, y) or x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold):
                links.append((a, b))
    top = components([r[0] for r in rows], links)
    n = Counter(i for pair in links for i in pair)
    return sorted((i, n[i], top[i]) for i in top)
