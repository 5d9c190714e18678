"""BPE encoding and decoding.

Encoding keeps the symbols of a word in a doubly linked list and the possible merges in a
priority queue ordered by (merge rank, place); an entry whose symbols have changed since it
was pushed is stale and skipped. Decoding joins the vocabulary's strings.

The word-ended vocabulary file gives vocabulary, merges, end-of-word mark and special
strings. A null text counts as empty and has no tokens; a text of any length is encoded
whole; words are kept with their tokens in a dictionary of bounded size, since words repeat.

Letters, numbers, lower case and composition are those of the library's own Unicode tables, which are not
Python's: the driver asks the library for what differs (`unicode_tables`) and sends it to the tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dunlin.llm.common import bounded_batches, text_slices

#: Words kept with their tokens by a worker.
CACHE_WORDS = 1_000_000
# The split pattern of the word-ended vocabulary, and its classes for lower-cased Latin-1 texts.
CLIP_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
LATIN_LETTERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_BLANKS = r"\x09-\x0d \x85\xa0"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Tables(NamedTuple):
    letters: str  # ranges, as in a character class
    numbers: str
    lower: dict[int, str]  # lower case where it is not Python's
    newer: str  # ranges that Python's composition may not know


def _ranges(points: list[int]) -> str:
    a = np.array(sorted(points))
    cut = np.flatnonzero(np.diff(a) > 1)
    first, last = a[np.append(0, cut + 1)], a[np.append(cut, len(a) - 1)]
    return "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in zip(first.tolist(), last.tolist()))


@lru_cache
def unicode_tables() -> Tables:
    """Character classes and lower case as the library has them, found by asking it for all code points in question."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    known = "".join(regex.findall(r"[\p{L}\p{N}]", every))

    def of(kind: str) -> list[int]:
        parts = pre_tokenizers.Split(Regex(rf"[^\p{{{kind}}}]+"), "removed").pre_tokenize_str(known)
        return [ord(c) for part, _ in parts for c in part]

    lower = normalizers.Lowercase().normalize_str
    cased = regex.findall(r"[\p{Lu}\p{Lt}\p{Other_Uppercase}]", every)
    unlike = {ord(c): lower(c) for c in cased if lower(c) != c.lower()} | {0x3A3: "\u03c3"}  # no final sigma
    newer = [ord(c) for c in regex.findall(r"\P{Cn}", every) if unicodedata.category(c) == "Cn"]
    return Tables(_ranges(of("L")), _ranges(of("N")), unlike, _ranges(newer) if newer else "")


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, tables: Tables | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.mark: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for s, i in (*self.vocab.items(), *self.special.items()):
            self.strings[i] = s.encode()
        #: left << 20 | right, as tokens, to rank << 32; and the token that each rank makes
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = rank << 32
            self.made.append(self.vocab[a + b])
        letters = byte_letters()
        self.first = [self.vocab.get(x, -1) for x in letters]
        self.last = [self.vocab.get(x + self.mark, -1) for x in letters]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        t = tables or unicode_tables()
        self.lower, self.newer = t.lower, re.compile(f"[{t.newer}]").search if t.newer else lambda text: None
        self.unlike = re.compile(f"[{_ranges([*t.lower])}]").search
        blanks = "".join(map(re.escape, filter(str.isspace, map(chr, range(0x3001))))).translate({c: None for c in range(0x1C, 0x20)})
        if split == CLIP_SPLIT:
            self.find = re.compile(f"[{t.letters}]+|{CONTRACTION}|[{t.numbers}]|[^{blanks}{t.letters}{t.numbers}]+").findall
            self.find_latin = re.compile(f"[{LATIN_LETTERS}]+|{CONTRACTION}|[{LATIN_NUMBERS}]|[^{LATIN_LETTERS}{LATIN_NUMBERS}{LATIN_BLANKS}]+").findall
        else:
            self.find = self.find_latin = regex.compile(split.replace(r"\p{L}", t.letters).replace(r"\p{N}", t.numbers).replace(r"\s", blanks)).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.words = _Words(self, cache_words)

    def merge(self, word: str) -> list[int]:
        """The tokens of one word.

        A queue entry is rank * 2**32 + place; it is stale if the symbols that now stand at its
        place do not merge with its rank. Absorbed symbols stay in the list as -1.
        """
        raw = word.encode("utf-8")
        ids = [*map(self.first.__getitem__, raw[:-1]), self.last[raw[-1]]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        n, merge = len(ids), self.merges.get
        if n < 2:
            return ids
        queue = [m | k for k, m in enumerate([merge(a << 20 | b) for a, b in zip(ids, ids[1:])]) if m is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push, new_of = heapq.heappop, heapq.heappush, self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            k = entry & 0xFFFFFFFF
            right = after[k]
            if right >= n or ids[k] < 0 or merge(ids[k] << 20 | ids[right]) != entry - k:
                continue
            ids[k] = new = new_of[entry >> 32]
            ids[right] = -1
            after[k] = nxt = after[right]
            if nxt < n:
                before[nxt] = k
                m = merge(new << 20 | ids[nxt])
                if m is not None:
                    push(queue, m | k)
            prev = before[k]
            if prev >= 0:
                m = merge(ids[prev] << 20 | new)
                if m is not None:
                    push(queue, m | prev)
        return [i for i in ids if i >= 0]

    def packed(self, text: str | None) -> bytes:
        """The tokens of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_special and "<|" in text:
            out = []
            for k, part in enumerate(self.split_special(text)):
                out.append(self.special[part].to_bytes(4, "little") if k % 2 else self._plain(part))
            return b"".join(out)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if self.newer(text):
                from tokenizers import normalizers

                text = normalizers.NFC().normalize_str(text)
            else:
                text = unicodedata.normalize("NFC", text)
            if self.unlike(text):
                text = text.translate(self.lower)
        text = text.lower()
        find = self.find_latin
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                find = self.find
        self.words.age()
        return b"".join(map(self.words.__getitem__, find(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        return self.decoded(ids).decode("utf-8", "replace")

    def decoded(self, ids) -> bytes:
        """The vocabulary's strings, joined by blanks, as UTF-8."""
        return b" ".join(map(self.strings.__getitem__, ids))


class _Words(dict):
    """Word to packed tokens, made when first asked for; two generations, so frequent words stay."""

    def __init__(self, bpe: Bpe, most: int):
        super().__init__()
        self.bpe, self.most, self.older = bpe, most // 2, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = np.array(self.bpe.merge(word), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = out
        return out

    def age(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


_loaded: dict[str, Bpe] = {}


def loaded(path: str, tables: Tables | None = None) -> Bpe:
    """The file's encoder, one for each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path, tables=tables)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Tokens of every text: id, n_tokens, and token_ids (array) with decoded text, or their SHA-256 digests.

    Rows keep their count: a repeated id gives a row each time. A narrow map: no shuffle.
    """
    bounded_batches(docs.sparkSession)
    path, tables = vocabulary or default_vocabulary(), unicode_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, tables)
        for whole in batches:
            for batch in text_slices(whole, text_col):
                packed = [bpe.packed(text) for text in batch.column(text_col).to_pylist()]
                ids = [np.frombuffer(p, "<u4") for p in packed]
                decoded = [bpe.decoded(i.tolist()) for i in ids]
                counts = np.array([len(i) for i in ids], np.int64)
                if digests:
                    made = [pa.array([hashlib.sha256(x).hexdigest() for x in c], pa.string()) for c in (packed, decoded)]
                else:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    flat = pa.array(np.concatenate(ids).astype(np.int32))
                    made = [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())]
                names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("token_ids", "decoded"))]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(counts), *made], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded string"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {rest}")
