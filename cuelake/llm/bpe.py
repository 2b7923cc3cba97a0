"""BPE by dynamic programming over prefixes, and decoding.

Every prefix of a word has exactly one BPE encoding, and so one last token. For each prefix, from
short to long, the automaton of the vocabulary names the tokens that end there. Such a token is the
last one of the prefix if it may follow the last token of the shorter prefix that it leaves. Following
the last tokens back from the end of the word gives its ids.

Two tokens may stand side by side if merging their text keeps the border between them. Going by rank,
the border falls when the piece then right of it and the piece then left of it have a merge of a rank at
which both are still there.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import SLICE, Memo, Pool, byte_letters, encode_batch, pieces_of, stretches
from .hashing import text_slices

#: Fixed value: the pattern of public byte-level vocabularies that cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 62


class PrefixBpe:
    """A byte-level vocabulary with its automaton and merge table."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # Other files cut or prepare their texts in other ways, which would give other ids.
        cut = file.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or file.get("normalizer"):
            raise ValueError(f"{path} is no byte-level file with the usual pattern and no normalizer")
        if any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file["added_tokens"]):
            raise ValueError("added tokens with spaces or with stripping rules aren't provided for")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = file["model"]["vocab"]
        self.text = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        marks = {t["id"]: t["content"] for t in file["added_tokens"]}
        self.mark_ids = {s: i for i, s in marks.items()}
        self.text |= {i: s.encode() for i, s in marks.items()}
        self.mark = regex.compile("|".join(regex.escape(s) for s in sorted(self.mark_ids, key=len, reverse=True))) if marks else None
        #: (left, right) -> rank, and for each token the rank that made it and its two parts.
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[left + right]
            self.merge_rank[vocab[left], vocab[right]] = rank
            self.parts.setdefault(made, (rank, vocab[left], vocab[right]))
        #: Texts of the ids from 0 to the largest; numbers between that are no ids have none.
        self.texts = Pool([self.text.get(i, b"") for i in range(max(self.text, default=0) + 1)], "u1")
        self.size = {i: len(t) for i, t in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i not in marks and (len(t) == 1 or i in self.parts):
                self.automaton.add_word(self.text[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.words = regex.compile(PATTERN)
        self.edges = Memo(self._edges, 120_000)
        self.fits = _Pairs(self)
        self.word_ids = Memo(self._word, 500_000)
        self.piece_ids = Memo(self._piece, 500_000)

    def _edges(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(piece, rank at which it is used up) at the right and at the left edge of a token, at every time."""
        out = []
        for side in (2, 1):
            edge, now, until = [], token, _NEVER
            while True:
                edge.append((now, until))
                made = self.parts.get(now)
                if made is None:
                    break
                now, until = made[side], made[0]
            out.append(edge)
        return out[0], out[1]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the border between the two tokens outlives every merge. At equal ranks the merge
        further left comes first: inside ``left`` before the border, the border before ``right``."""
        for a, a_until in self.edges[left][0]:
            for b, b_until in self.edges[right][1]:
                rank = self.merge_rank.get((a, b), _NEVER)
                if rank < a_until and rank <= b_until and rank < _NEVER:
                    return False
        return True

    def _word(self, word: str) -> list[int]:
        """Ids of one word, written one letter per byte (latin-1)."""
        last, size, fits = [-1] * (len(word) + 1), self.size, self.fits
        for end, token in self.automaton.iter(word):
            if last[end + 1] < 0:
                start = end + 1 - size[token]
                if start == 0 or (last[start] >= 0 and fits[last[start] << 24 | token]):
                    last[end + 1] = token
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        ids.reverse()
        return ids

    def _piece(self, piece: str) -> bytes:
        out: list[int] = []
        spans = [(piece, None)]
        if self.mark is not None and (found := list(self.mark.finditer(piece))):
            spans, at = [], 0
            for m in found:
                spans += [(piece[at : m.start()], None), ("", self.mark_ids[m[0]])]
                at = m.end()
            spans.append((piece[at:], None))
        for text, mark in spans:
            for word in self.words.findall(text):
                out += self.word_ids[word.encode().decode("latin-1")]
            if mark is not None:
                out.append(mark)
        return array.array("I", out).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, little-endian, 4 bytes each. Texts of added tokens become those tokens."""
        if not text:
            return b""
        of = self.piece_ids.__getitem__
        return b"".join(b"".join(map(of, pieces_of(part))) for part in stretches(text))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the borders between texts."""
        return encode_batch(texts, lambda word: self.piece_ids[" " + word], self.encode, "<u4")

    def decode(self, ids: bytes) -> str:
        """Text of the ids, with added tokens shown; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.text.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")

    def decode_batch(self, ids: np.ndarray, borders: np.ndarray) -> list[str]:
        """Texts of the ids between the borders, as ``decode`` gives them."""
        raw, ends = self.texts.put(ids)
        at = np.concatenate([[0], ends])[borders].tolist()
        raw = raw.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


class _Pairs(dict):
    def __init__(self, bpe: PrefixBpe, limit: int = 700_000):
        super().__init__()
        self.bpe, self.limit = bpe, limit

    def __missing__(self, key: int) -> bool:
        if len(self) >= self.limit:
            self.clear()
        out = self[key] = self.bpe.may_follow(key >> 24, key & 0xFFFFFF)
        return out


@functools.lru_cache(maxsize=2)
def bpe_of(path: str) -> PrefixBpe:
    """A vocabulary that a worker keeps from task to task, with the words that it has met."""
    return PrefixBpe(path)


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = bpe_of(path)
    names, kinds = ["id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        for part, _, _ in text_slices(batch, size=SLICE):
            flat, borders = bpe.encode_batch(part.column("text"))
            back, raw = bpe.decode_batch(flat, borders), memoryview(flat.tobytes())
            cut = [raw[4 * a : 4 * b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
            columns = [part.column("id"), pa.array(np.diff(borders)), pa.array(list(map(sha, cut)), kinds[2]), pa.array([sha(t.encode()) for t in back], kinds[3])]
            more = [pa.array(list(map(bytes, cut)), pa.binary()), pa.array(back, pa.string())] if with_ids else []
            yield pa.record_batch([*columns, *more], names=[*names, *(["ids", "decoded"] if with_ids else [])])


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row: id, n_tokens, ids_sha256, decoded_sha256, and on wish ids (binary, 4 bytes each) and decoded.

    ``tokenizer`` is a byte-level tokenizers file. Null and empty texts have no ids. Rows that repeat are
    each encoded; an empty table gives no rows. No row depends on another, so nothing is shuffled.
    """
    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _round_trip(b, tokenizer, with_ids), kinds)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
