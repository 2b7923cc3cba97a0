"""Exact tokenizer ids of whole texts at the cost of a dictionary look-up for most words.

A text is cut before every space that a non-space follows. Neither tokenizer lets a token cross
such a place, and what stands on one side doesn't change the ids of the other, so the ids of a text
are the ids of its pieces one after another. Pieces recur, so each worker keeps the ids of those it
has met; the tokenizer itself encodes the others. Arrow cuts a whole batch of texts into words and tells the
distinct ones; Python sees only these, and the ids of all texts are then gathered at once.
"""

from __future__ import annotations

import array
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD_SPACE = re.compile(r" \s|\A | \Z")
_CUT = re.compile(r"(?= \S)")
#: Texts that can't be cut at each space alone: a space at an end or before any other white space.
_NOT_PLAIN = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]|\A | \z"
#: Units of plain Latin text. What _STRANGE finds is left to the tokenizer's own rules.
_RUNS = re.compile(r" ?[^\W\d_]+| ?[0-9]+| ?[^\w\s]+|.", re.S)
_STRANGE = re.compile(r"['_\t\r\x0b\x0c\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]|\n\n|.<\||\A<\||\n |. \Z")
#: Longer texts are cut into stretches of about so many characters, to bound the list of pieces.
STRETCH = 1 << 20
LIMIT = 1_200_000
#: Bytes of text whose words are told at a time.
SLICE = 8 << 20


def pieces_of(text: str) -> list[str]:
    """Pieces of a text; all but the first begin with a space."""
    if _ODD_SPACE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if rest else [first]


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Stretches of a long text, cut where pieces_of() cuts."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Memo(dict):
    """Results of ``make`` by key, forgotten all at once when ``limit`` keys are held."""

    def __init__(self, make: Callable, limit: int = LIMIT):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        out = self.make(key)
        if not isinstance(key, str) or len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = out
        return out


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Encoder:
    """Ids of a tokenizers file as little-endian bytes of ``width`` 2 or 4."""

    def __init__(self, path: str, width: int = 4):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.code = {2: "H", 4: "I"}[width]
        self.dtype = {2: "<u2", 4: "<u4"}[width]
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not all(m.startswith("<|") for m in marks):
            raise ValueError("added tokens that don't start with <| aren't provided for")
        self.letters = byte_letters()
        #: What the tokenizer does to a plain Latin word before its model sees it, told by two probes.
        self.lowers = self._encode("A") == self._encode("a")
        self.spaced = self._encode(" a") != self._encode("a")
        #: Letters and their leading space, runs of punctuation, and words with a space before them.
        self.runs = Memo(self._run)
        self.tail = _Words(self)

    def _pack(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def _encode(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        """A plain Latin word is one unit of every step before the model, which is asked directly."""
        word = run[1:] if run[:1] == " " else run
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            word = word.lower() if self.lowers else word
            word = " " + word if self.spaced and run[0] == " " else word
            # Letters of ASCII are shown as themselves.
            shown = word.replace(" ", self.letters[32]) if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            return self._pack([t.id for t in self.model.tokenize(shown)])
        return self._encode(run)

    def piece(self, piece: str) -> bytes:
        """Letters and punctuation part, as they recur far more often than what they make together."""
        if not _STRANGE.search(piece):
            return b"".join(map(self.runs.__getitem__, _RUNS.findall(piece)))
        return self._encode(piece)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, as tokenizer.encode(text, add_special_tokens=False) gives them."""
        if not text:
            return b""
        out = []
        for part in stretches(text):
            if _ODD_SPACE.search(part):
                out.extend(map(self.piece, _CUT.split(part)))
            else:
                first, *rest = part.split(" ")
                out.append(self.piece(first))
                out.extend(map(self.tail.__getitem__, rest))
        return b"".join(out)

    def batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id`` if there is one, and the borders between texts."""
        end = b"" if end_id is None else self._pack([end_id])
        return encode_batch(texts, self.tail.__getitem__, self.encode, self.dtype, end)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, width: int) -> Encoder:
    """An encoder that a worker keeps from task to task, with the words that it has met."""
    return Encoder(path, width)


class _Words(dict):
    """Ids of a word with a space before it. Words of letters are held, also with a mark at their end."""

    def __init__(self, encoder: Encoder, limit: int = LIMIT):
        super().__init__()
        self.encoder, self.limit = encoder, limit

    def __missing__(self, word: str) -> bytes:
        encoder, end = self.encoder, word[-1:]
        if word.isalpha():
            out = encoder._run(" " + word)
        elif end in ".,!|" and word[:-1].isalpha():
            out = self[word[:-1]] + encoder.runs[end]
        else:
            return encoder.piece(" " + word)
        if len(word) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``pool`` that ``wanted`` numbers, one after another, and where each ends."""
    size = sizes[wanted]
    ends = np.cumsum(size)
    at = np.repeat(starts[wanted] - (ends - size), size)
    at += np.arange(len(at))
    return pool[at], ends


class Pool:
    """Parts of bytes, to be put together by number."""

    def __init__(self, parts: list[bytes], dtype: str):
        self.flat = np.frombuffer(b"".join(parts), dtype)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(dtype).itemsize
        self.starts = np.cumsum(self.sizes) - self.sizes

    def put(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gathered(self.flat, self.starts, self.sizes, wanted)


def encode_batch(texts: pa.Array, after_space: Callable[[str], bytes], whole: Callable[[str], bytes], dtype: str, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each followed by ``end``, and the borders between texts.

    ``after_space`` gives the ids of a word with a space before it, ``whole`` those of any text. Null texts are empty.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _NOT_PLAIN)
    lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    words = lists.flatten().dictionary_encode()
    codes, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
    # The first word of a text has no space before it; a text that can't be cut at each space is one part.
    n = len(texts)
    odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    heads = [names[c] for c in codes[offsets[:-1]]] if len(codes) else []
    for i in odd_rows:
        heads[i] = texts[int(i)].as_py()
    inner = np.ones(len(codes), bool)
    inner[offsets[:-1]] = False
    used = np.unique(codes[inner])
    parts = [b""] * len(names)
    for u in used.tolist():
        parts[u] = after_space(names[u])
    pool = Pool([*parts, *map(whole, heads), end], dtype)
    # A slot more for each text, for its end.
    wanted = np.empty(len(codes) + n, np.int64)
    wanted[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(offsets))] = codes
    wanted[offsets[:-1] + np.arange(n)] = len(names) + np.arange(n)
    wanted[offsets[1:] + np.arange(n)] = len(names) + n
    flat, ends = pool.put(wanted)
    borders = np.concatenate([[0], ends[offsets[1:] + np.arange(n)]]) if n else np.zeros(1, np.int64)
    return flat, borders
