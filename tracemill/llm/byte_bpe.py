"""Byte-level encoding and decoding of whole texts with a table of ranks.

A piece of text that is no token itself is cut by backtracking instead of by
merging. Its bytes are mapped to Latin-1 characters, so that one Aho-Corasick
automaton over the vocabulary finds every token in it; from each position the
longest match is tried first, then its shorter prefixes. Two tokens may stand
side by side if merging their joint bytes gives just these two again; a sequence
of tokens is what the merges give for the whole piece if and only if all its
neighbours may. That encoding is unique for each prefix of the piece, so a
position from which no token goes on is dead for good, and every position is
left at most once for each of its matches: linear time, whatever the length.
Compatibilities are remembered, and so are the ids of short pieces.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.staging import released, small_batches, spare_names, without

#: fixed value: the pattern that splits text before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = 1 << 60


def _characters(which: Callable[[str], object]) -> str:
    """A character class's ranges of all characters below U+10000 that ``which`` takes."""
    ranges: list[list[int]] = []
    for c in filter(lambda c: which(chr(c)), range(0x10000)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


def _plain_pattern() -> str:
    """:data:`PATTERN` for texts below U+10000, three times as fast: classes as tables, the commonest alternative first."""
    letter, number = (_characters(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    space = _characters(regex.compile(r"\s").match)
    return f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{letter}{number}{space}]+|[{space}]+(?![^{space}])|[{space}]+"


class ByteBPE:
    """A file of lines ``base64(token) rank``; ranks are the ids, and every byte is a token."""

    def __init__(self, path: str, pattern: str = PATTERN, max_cached: int = 400_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.ids = pa.array(list(self.tokens), pa.uint32())
        self.strings = pa.array(list(self.tokens.values()), pa.binary())
        self.exact_pieces = regex.compile(pattern).findall
        self.plain_pieces = re.compile(_plain_pattern()).findall if pattern == PATTERN else self.exact_pieces
        self.has_high = re.compile("[\U00010000-\U0010ffff]").search
        self.automaton = ahocorasick.Automaton()
        self.sizes, self.shorter = [0] * (max(self.tokens) + 1), [-1] * (max(self.tokens) + 1)
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.sizes[rank] = len(token)
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.max_cached = max_cached

    def pieces(self, text: str) -> list[str]:
        return self.exact_pieces(text) if not text.isascii() and self.has_high(text) else self.plain_pieces(text)

    def merged(self, raw: bytes) -> list[int]:
        """The ids that merging gives, lowest rank first and leftmost among equals; for short strings, as it takes quadratic time."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        look = self.ranks.get
        ranks = [look(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < NO_RANK:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = look(parts[i] + parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = look(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[p] for p in parts]

    def compatible(self, key: int) -> bool:
        """Whether merging the joint bytes of two tokens gives both; ``key`` is ``left << 32 | right``, or ``~right`` for a first token."""
        pair = [key >> 32, key & 0xFFFFFFFF] if key >= 0 else [~key]
        if len(self.fits) >= self.max_cached:
            self.fits.clear()
        got = self.fits[key] = self.merged(b"".join(self.tokens[i] for i in pair)) == pair
        return got

    def backtrack(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        n, sizes, shorter, remembered = len(raw), self.sizes, self.shorter, self.fits.get
        longest = [-1] * n  # matches come by their ends, so that the last one of a start is its longest
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + sizes[token]
            if not dead[end]:
                key = out[-1] << 32 | token if at else ~token
                fits = remembered(key)
                if self.compatible(key) if fits is None else fits:
                    out.append(token)
                    if end == n:
                        break
                    at, token = end, longest[end]
                    continue
            token = shorter[token]
            while token < 0:  # nothing goes on from here: give the last token up
                dead[at] = 1
                last = out.pop()
                at -= sizes[last]
                token = shorter[last]
        return out

    def _bytes(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            got = array("I", (whole,) if whole is not None else self.backtrack(raw)).tobytes()
            if len(piece) <= 40:
                if len(self.known) >= self.max_cached:
                    self.known.clear()
                self.known[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as consecutive unsigned 32-bit integers, little-endian."""
        known, piece_bytes = self.known.get, self._bytes
        return b"".join([known(p) or piece_bytes(p) for p in self.pieces(text)])

    def encode_batch(self, texts: pa.Array, rows: int = 256) -> pa.Array:
        return pa.array((self.encode(t) if t else b"" for a in range(0, len(texts), rows) for t in texts.slice(a, rows).to_pylist()), pa.binary())

    def decode_batch(self, ids: pa.Array) -> pa.Array:
        """Bytes of each row of ids; null rows decode to no bytes, unknown ids to nothing."""
        rows = [r or b"" for r in ids.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])
        flat = pa.array(np.frombuffer(b"".join(r[: len(r) // 4 * 4] for r in rows), "<u4"))
        strings = pc.fill_null(self.strings.take(pc.index_in(flat, self.ids)), b"")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), b"")


@cache
def _tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def byte_bpe_encode(text: Column, path: str) -> Column:
    """Ids of each whole text as binary: unsigned 32-bit integers, little-endian; null and empty texts have none."""

    @F.arrow_udf("binary")
    @released
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _tokenizer(path)
        for texts in batches:
            yield tok.encode_batch(texts)

    return encode(text)


def byte_bpe_decode(ids: Column, path: str) -> Column:
    """The bytes of each row of ids (binary, as :func:`byte_bpe_encode` gives them); ids cut inside a character give bytes that are no text."""

    @F.arrow_udf("binary")
    @released
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _tokenizer(path)
        for lists in batches:
            yield tok.decode_batch(lists)

    return decode(ids)


def byte_bpe_round_trip(text: Column, path: str) -> Column:
    """struct<ids, decoded>: both of the above in one worker, so that its tables are held once."""

    @F.arrow_udf("ids binary, decoded binary")
    @released
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _tokenizer(path)
        for texts in batches:
            ids = tok.encode_batch(texts)
            yield pa.StructArray.from_arrays([ids, tok.decode_batch(ids)], ["ids", "decoded"])

    return both(text)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (binary: unsigned 32-bit, little-endian) and decoded (binary: bytes in UTF-8) of every whole text.

    Null texts count as empty: no ids, no bytes. Strings of special tokens are
    ordinary text. Texts of any length are encoded whole, repeated rows each.
    Input columns named ids or decoded, in any case, are replaced. An empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    coded = byte_bpe_round_trip(F.col(text_col), path)
    names = without(docs.columns, "ids", "decoded")
    (both,) = spare_names(names, "coded")
    kept = [F.col(f"`{c}`") for c in names]
    return docs.select(*kept, coded.alias(both)).select(*kept, f"{both}.ids", f"{both}.decoded")
