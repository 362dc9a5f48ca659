"""Byte-pair encoding and decoding of whole texts with a public word-end vocabulary.

Each distinct short word is merged once per worker: its parts lie in one
contiguous list beside the list of ranks of adjacent pairs; the smallest rank is
searched by a scan, the boundary at it goes, and the two ranks beside it are
looked up anew. Words above ``LONG`` parts would make those scans quadratic, so
a heap over linked positions, with the same order of merges, does them.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.staging import released, small_batches, spare_names, without

LONG = 200
NO_RANK = 1 << 60
ID = (1 << 20) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _ambiguous() -> str:
    """Characters that ``re`` and Unicode's categories may class unlike: other numbers, controls that ``re`` takes for space, high planes."""
    chars = [c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) in ("No", "Nl")]
    return re.escape("".join(chars)) + "\x1c-\x1f\U00010000-\U0010ffff"


class WordBPE:
    """A tokenizer file of the shape: lower-casing, words by a pattern, byte-level symbols, word-end suffix."""

    def __init__(self, path: str, max_cached: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.ids = pa.array(list(self.tokens), pa.int32())
        self.strings = pa.array(list(self.tokens.values()), pa.string())
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        # (left << 20 | right) -> (rank << 20 | merged): one integer each, so that a minimum of ranks also names the result
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.exact_words = regex.compile(pattern).findall
        # the same words for texts without ambiguous characters, several times as fast
        self.plain_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
        self.ambiguous = re.compile(f"[{_ambiguous()}]").search
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.max_cached = max_cached
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form of sigma
        text = text.lower()
        return self.exact_words(text) if self.ambiguous(text) else self.plain_words(text)

    def merge(self, word: str) -> list[int]:
        """The ids of one word."""
        raw = word.encode()
        parts = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if len(parts) > LONG:
            return self._merge_long(parts)
        look = self.pairs.get
        ranks = [look(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = new = low & ID
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = look(new << 20 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = look(parts[i - 1] << 20 | new, NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        look = self.pairs.get
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := look(a << 20 | b))]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i] = low & ID
            parts[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := look(parts[x] << 20 | parts[y])):
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _bytes(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = array("i", self.merge(word)).tobytes()
            if len(word) <= 40:
                if len(self.known) >= self.max_cached:
                    self.known.clear()
                self.known[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as consecutive 32-bit integers."""
        known, word_bytes = self.known.get, self._bytes
        out = []
        for k, piece in enumerate(self.cut_special(text)):
            if k % 2:
                out.append(np.array([self.special[piece]], np.int32).tobytes())
            elif piece:
                out += [known(w) or word_bytes(w) for w in self.words(piece)]
        return b"".join(out)

    def encode_batch(self, texts: pa.Array, rows: int = 256) -> pa.ListArray:
        parts, sizes = [], [0]
        for a in range(0, len(texts), rows):
            for text in texts.slice(a, rows).to_pylist():
                got = self.encode(text) if text else b""
                parts.append(got)
                sizes.append(len(got) // 4)
        ids = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(parts))])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), ids)

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """Null lists decode to the empty text, unknown ids to nothing."""
        flat = ids.flatten()
        known = pc.index_in(flat, self.ids)
        if known.null_count:
            return pa.array([" ".join(self.tokens[i] for i in row or () if i in self.tokens) for row in ids.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.strings.take(known)), " ")


@cache
def _tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def bpe_encode(text: Column, path: str) -> Column:
    """Ids of each whole text as array<int>; null and empty texts have none. Strings of special tokens become their ids."""

    @F.arrow_udf("array<int>")
    @released
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _tokenizer(path)
        for texts in batches:
            yield tok.encode_batch(texts)

    return encode(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text of each id list: token strings joined by spaces, as a vocabulary without a decoder gives it."""

    @F.arrow_udf("string")
    @released
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _tokenizer(path)
        for lists in batches:
            yield tok.decode_batch(lists)

    return decode(ids)


def bpe_round_trip(text: Column, path: str) -> Column:
    """struct<ids, decoded>: both of the above in one worker, so that its tables are held once."""

    @F.arrow_udf("ids array<int>, decoded string")
    @released
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _tokenizer(path)
        for texts in batches:
            ids = tok.encode_batch(texts)
            yield pa.StructArray.from_arrays([ids, tok.decode_batch(ids)], ["ids", "decoded"])

    return both(text)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>) and decoded (string) of every whole text.

    Null texts count as empty: no ids, empty decoded text. Texts of any length
    are encoded whole, repeated rows each. Input columns named ids or decoded, in
    any case, are replaced. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    coded = bpe_round_trip(F.col(text_col), path)
    names = without(docs.columns, "ids", "decoded")
    (both,) = spare_names(names, "coded")
    kept = [F.col(f"`{c}`") for c in names]
    return docs.select(*kept, coded.alias(both)).select(*kept, f"{both}.ids", f"{both}.decoded")
