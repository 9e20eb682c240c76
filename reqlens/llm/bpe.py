"""BPE encoding and decoding with word ends, merged on a contiguous rank array per word.

A word of n symbols is held as n + 1 part boundaries and, beside each boundary, the rank of merging the part that
starts there with the next one. The smallest rank is found by scanning, its right boundary is deleted, and only the
ranks of the merged part and of its left neighbour are computed anew. Words are short, so that a scan over a small
contiguous array is cheaper than a heap; each distinct word is merged once and kept. For the rare word of more than
LONG_WORD symbols, where scans would add up to the square of its length, a heap holds the ranks; the merges are the same.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from reqlens.llm.common import ship

#: Rows of an output batch, and characters of text after which a batch ends early.
BATCH_ROWS, BATCH_CHARS = 512, 4_000_000
#: Words kept with their pieces, for each Python worker.
KEPT_WORDS = 200_000
#: Symbols of a word from which on the ranks are held in a heap, and the word is not kept.
LONG_WORD = 256
_NONE = 1 << 60

#: Letters whose lower case the vocabulary's library knows and Python 3.13 (Unicode 15.1) doesn't. Fixed values.
_NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7DC: 0x19B}
_NEWER_LOWER |= {c: c + 1 for c in (0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}
_NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}

#: First and last letters of the ranges that Unicode 16 added, which the vocabulary's library knows; it knows none later. Fixed values.
_LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CC, 0xA7CD), (0xA7DA, 0xA7DB), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)


def _unassigned(c: str) -> bool:
    """Neither in Unicode 15.1 nor a letter of Unicode 16: if a letter to the regex module, then none to the library."""
    return unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in _LETTERS_16)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


def merge_parts(symbols: list[str], rank_of) -> list[str]:
    """Merge adjacent symbols, smallest rank first and leftmost among equals, until no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    if n > LONG_WORD:
        return _merge_long(symbols, rank_of)
    joined = "".join(symbols)
    bounds, at = [0] * (n + 1), 0
    for i, s in enumerate(symbols):
        at += len(s)
        bounds[i + 1] = at
    ranks = [_NONE] * n  # ranks[i]: of the part at boundary i with the next part

    def rank(i: int) -> int:
        if i + 2 >= len(bounds):
            return _NONE
        return rank_of((joined[bounds[i] : bounds[i + 1]], joined[bounds[i + 1] : bounds[i + 2]]), _NONE)

    for i in range(n - 1):
        ranks[i] = rank(i)
    while True:
        least = min(ranks)
        if least == _NONE:
            return [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        i = ranks.index(least)
        del bounds[i + 1], ranks[i + 1]
        ranks[i] = rank(i)
        if i:
            ranks[i - 1] = rank(i - 1)


def _merge_long(symbols: list[str], rank_of) -> list[str]:
    """The merges of `merge_parts` with the pairs in a heap, by rank and place; pairs that have changed since are passed over."""
    parts: list[str | None] = list(symbols)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank_of((parts[i], parts[i + 1]), _NONE)) != _NONE]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        j = after[i]
        if parts[i] is None or j == n or rank_of((parts[i], parts[j]), _NONE) != r:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := rank_of((parts[a], parts[b]), _NONE)) != _NONE:
                heappush(heap, (r, a))
    return [p for p in parts if p is not None]


class WordBPE:
    """A vocabulary file of the tokenizers library: NFC, white space, lower case; words; byte symbols; merges; no decoder."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)))
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self.symbols = byte_symbols()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split).findall
        self.newer = regex.compile("[" + "".join(map(chr, _NEWER_LOWER)) + "]")
        self.pattern = split
        self.beyond = regex.compile(r"[^\x00-\u0557]")
        self.letter = regex.compile(r"\p{L}").match
        self.newer_words: dict[frozenset, object] = {}
        self.ids = _Pieces(self, kept)
        self.decoded = _Decoded(self)

    def pieces(self, word: str) -> list[int]:
        """Ids of one normalised word; symbols that the vocabulary lacks are dropped, as the library does without an unknown token."""
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        return [self.vocab[p] for p in merge_parts(symbols, self.ranks.get) if p in self.vocab]

    def normalised(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            if self.newer.search(text):
                text = text.translate(_NEWER_LOWER)
            text = text.replace("Σ", "σ")  # each character by itself: no final sigma
        return text.lower()

    def split(self, text: str) -> list[str]:
        text = self.normalised(text)
        if not text.isascii() and self.beyond.search(text) and (late := frozenset(c for c in set(text) if c > "\u0557" and _unassigned(c) and self.letter(c))):
            return self._without(late)(text)
        return self.words(text)

    def _without(self, late: frozenset):
        """The words with some letters taken for signs."""
        import regex

        if late not in self.newer_words:
            own = "[" + "".join(sorted(late)) + "]"
            pattern = self.pattern.replace(r"[\p{L}]", rf"[\p{{L}}--{own}]").replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{own}]")
            self.newer_words = {late: regex.compile(pattern, regex.V1).findall}
        return self.newer_words[late]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return b"".join(map(self.ids.__getitem__, self.split(text)))
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [*map(self.ids.__getitem__, self.split(text[at : m.start()])), np.uint32(self.specials[m[0]]).tobytes()]
            at = m.end()
        out += map(self.ids.__getitem__, self.split(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Without a decoder in its file, the library joins the tokens with one space; special tokens stay."""
        return " ".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    def __init__(self, bpe: WordBPE, most: int):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, word: str) -> bytes:
        value = np.array(self.bpe.pieces(word), "<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


class _Decoded(dict):
    def __init__(self, bpe: WordBPE):
        super().__init__()
        self.token = bpe.token

    def __missing__(self, i: int) -> str:
        value = self[i] = self.token.get(i, "")
        return value


_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """One vocabulary for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encode every whole text; a narrow operation, no shuffle.

    Returns id_col, `n_tokens` long and the outputs asked for: `ids` array<int>, `ids_le` binary (the ids as
    little-endian unsigned 32-bit integers) and `decoded` string (the text decoded again from its ids). Null and empty
    texts have no ids and decode to ''. Rows are neither dropped nor merged, whatever their id (null, repeated); other
    columns of docs, whatever their names, are not read. The file at `path` must be there on every executor.
    """
    kinds = {"ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "ids_le": (T.BinaryType(), pa.binary()), "decoded": (T.StringType(), pa.string())}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(k, kinds[k][0]) for k in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            keys, texts, start = batch.column(0), batch.column(1), 0
            while start < len(batch):
                packed, chars, stop = [], 0, start
                while stop < len(batch) and stop - start < BATCH_ROWS and chars < BATCH_CHARS:
                    text = texts[stop].as_py() or ""
                    packed.append(bpe.encode(text))
                    chars += len(text)
                    stop += 1
                sizes = np.array([len(x) // 4 for x in packed], np.int64)
                columns = [keys.slice(start, stop - start), pa.array(sizes, pa.int64())]
                for k in outputs:
                    if k == "ids":
                        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                    else:
                        columns.append(pa.array(packed if k == "ids_le" else map(bpe.decode, packed), kinds[k][1]))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", *outputs])
                start = stop

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of arrays of ids: the tokens joined by one space. Null arrays decode to ''; null ids and ids without a token to nothing, not even a space."""
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [" ".join(t for i in x or [] if (t := bpe.decoded[i])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    ship(encoded.sparkSession)
    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
