"""Byte-level encoding against the library, against plain merging, and on odd tables."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tracemill.llm import byte_bpe  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "Hello  World", "hello world", "l'été À Σίσυφος ²½ 中文 😀", "a<|endoftext|> b", "ab " * 3000, "x" * 5000 + " y", "  lead", "trail  ", "tab\tnew\n\nline",
    "can't they'll 123", "\x1c\x85\x00", "hello world", " 　x", "é", "Ⅷ १२",
]


@pytest.fixture(scope="module")
def lib():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBPE(PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pattern_is_the_given_one():
    assert byte_bpe.PATTERN == P.PATTERN


def test_documents_equal_library(spark, lib):
    rows = [(i if i != 3 else None, t, "n", b"x") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, Decoded binary")
    out = byte_bpe.encode_documents(docs, PATH)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and len(got) == len(rows)
    for r in got:
        want = lib.encode_ordinary(r["text"] or "")
        assert ids(r["ids"]) == want and bytes(r["decoded"]) == lib.decode_bytes(want) == (r["text"] or "").encode()
    assert byte_bpe.encode_documents(docs.where("false"), PATH).count() == 0


def test_encode_and_decode_apart(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    back = rows.select("text", byte_bpe.byte_bpe_decode(byte_bpe.byte_bpe_encode(F.col("text"), PATH), PATH).alias("b")).collect()
    assert all(bytes(r["b"]).decode() == (r["text"] or "") for r in back)
    odd = spark.createDataFrame([(None,), (bytearray(np.array([71, 4_000_000_000], "<u4").tobytes()),)], "b binary")
    assert [bytes(r[0]) for r in odd.select(byte_bpe.byte_bpe_decode(F.col("b"), PATH)).collect()] == [b"", byte_bpe.ByteBPE(PATH).tokens[71]]


def test_random_strings_equal_library(lib, own):
    pick = random.Random(7)
    signs = ["a", "b", "e", "é", " ", "  ", "\n", "1", "²", "中", "😀", "\x1c", "\x85", "'s", "'", "ll", "_", "-", "́", "the", "ing", "　", "Σ", "\x00", "xx", "tion"]
    for _ in range(3000):
        text = "".join(pick.choices(signs, k=pick.randint(0, 40)))
        assert ids(own.encode(text)) == lib.encode_ordinary(text)


def test_backtracking_equals_merging_also_where_the_longest_match_is_wrong(own):
    pick = random.Random(3)
    words = ["".join(pick.choices("aeinorstl", k=pick.randint(1, 30))).encode() for _ in range(4000)]
    greedy_fails = 0
    for w in words:
        got = own.backtrack(w)
        assert got == own.merged(w)
        first = max((t for t in own.ranks if w.startswith(t)), key=len) if greedy_fails < 5 else b""
        greedy_fails += bool(first) and own.tokens[got[0]] != first
    assert greedy_fails >= 5


def test_small_memories_change_nothing(lib):
    tight = byte_bpe.ByteBPE(PATH, max_cached=3)
    for text in TEXTS:
        assert ids(tight.encode(text or "")) == lib.encode_ordinary(text or "")


@pytest.mark.parametrize("unit", ["x", " ", "ab", "é", "中文", "-="])
def test_long_pieces_take_linear_time(own, lib, unit):
    for n in (1000, 60_000):
        text = unit * n
        assert ids(own.encode(text)) == lib.encode_ordinary(text)


def test_digests_of_the_query(spark, tmp_path, lib):
    from tracemill.llm import queries

    spark.createDataFrame([(1, "Hello World é", "en"), (2, None, None)], "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, f"file://{tmp_path}").collect()}
    for doc, text in ((1, "Hello World é"), (2, "")):
        want = np.array(lib.encode_ordinary(text), "<u4")
        assert (rows[doc]["n_tokens"], rows[doc]["ids_sha256"]) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
