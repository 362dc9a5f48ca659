"""Token counts of whole texts under a SentencePiece model.

The text is cut at safe boundaries, encoded in batches of about equal bytes,
and only lengths leave the Python workers. A cut before a space mark that
follows another character is safe when no piece of the vocabulary holds a space
mark after another character: then no merge can reach over the cut, so the
counts of the parts add up to the count of the text. The vocabulary is tested
for that when it is loaded; where it fails, whole texts are encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.staging import released, small_batches

SPACE = "▁"
_WITH_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceCounter:
    """Counts pieces of texts; remembers the counts of short parts, at most ``max_cached`` of them."""

    def __init__(self, model_path: str, batch_bytes: int = 4 << 20, max_cached: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.batch_bytes = batch_bytes
        self.max_cached = max_cached
        self.known: dict[str, int] = {}
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.separable = not any(SPACE in p[1:] and p.strip(SPACE) for p in pieces) and self._adds_prefix()

    def _adds_prefix(self) -> bool:
        """Whether spaces are kept as they are and one is put before each text, as the cuts assume."""
        joined = ((x, "".join(self.model.encode(x, out_type=str))) for x in ("a", " a", "a  a", "a "))
        return all(got == SPACE + x.replace(" ", SPACE) for x, got in joined)

    def parts(self, text: str) -> list[str]:
        """Parts between safe cuts, without the space mark that the model itself puts first."""
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p[1:] for p in _WITH_RUNS.findall(SPACE + text.replace(" ", SPACE))]

    def learn(self, parts: set[str]) -> None:
        """Encodes unseen parts in batches of about ``batch_bytes``."""
        batch: list[str] = []
        size = 0
        for part in parts:
            batch.append(part)
            size += len(part)
            if size >= self.batch_bytes:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        if batch:
            self.known.update(zip(batch, map(len, self.model.encode(batch, num_threads=1))))

    def count(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        split = [self.parts(t) if t else [] for t in texts]
        if len(self.known) > self.max_cached:
            self.known.clear()
        self.learn({p for parts in split for p in parts if p not in self.known})
        self.known[""] = 1  # a space mark alone
        known = self.known.__getitem__
        return [sum(map(known, parts)) for parts in split]


@cache
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def byte_batches(sizes: np.ndarray, batch_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``batch_bytes`` each; a row above that is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > batch_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def token_count(text: Column, model_path: str, batch_bytes: int = 4 << 20) -> Column:
    """Pieces of each text without begin and end marks; null and empty texts have none."""

    @F.arrow_udf("long")
    @released
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(model_path)
        for texts in batches:
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            out: list[int] = []
            for a, b in byte_batches(sizes, batch_bytes):
                out += counter.count([t or "" for t in texts.slice(a, b - a).to_pylist()])
            yield pa.array(out, pa.int64())

    return lengths(text)


def count_tokens(
    docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096, batch_bytes: int = 4 << 20
) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Null texts count as empty: 0 bytes, 0 tokens, not over. Repeated rows are
    counted each, texts of any length whole. Input columns with the three output
    names are replaced. Any other columns pass through and never reach Python. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"),
            "n_tokens": token_count(F.col(text_col), model_path, batch_bytes),
        }
    )
    return docs.withColumn("over_limit", F.col("n_tokens") > limit)
