"""Encoders, counts, packing, chats, urls and toxicity: against the libraries, brute force, and odd tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tracemill.llm import bpe, chat, packing, token_counts, toxicity, url_filter  # noqa: E402

WORD, BYTE, PIECE = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "Hello  World", "hello world", "l'été À Σίσυφος ²½ 中文 😀", "a<|endoftext|> b <|startoftext|>", "</s> <s> x", "ab " * 3000, "x" * 700 + " y", "  lead", "trail  ",
    "tab\tnew\nline", "▁ ▁▁a", "can't they'll 123", "\x1c\x85", "hello world",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "n", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, ids string, n_bytes string, score string")


def test_bpe_equals_library(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    out = bpe.encode_documents(docs, WORD)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"] and len(rows) == len(TEXTS)
    for r in rows:
        e = lib.encode(r["text"] or "", add_special_tokens=False)
        assert r["ids"] == e.ids and r["decoded"] == lib.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode_documents(empty, WORD).count() == 0


def test_bpe_decode_of_odd_lists(spark):
    rows = spark.createDataFrame([([320, 99999999],), (None,), ([],)], "ids array<int>").select(bpe.bpe_decode(F.col("ids"), WORD)).collect()
    assert [r[0] for r in rows] == [bpe.WordBPE(WORD).tokens[320], "", ""]


def test_long_words_merge_like_short_ones():
    tok = bpe.WordBPE(WORD)
    word = "thintionhe" * 19
    raw = word.encode()
    parts = [tok.first[b] for b in raw[:-1]] + [tok.last[raw[-1]]]
    assert tok._merge_long(parts) == tok.merge(word)


def test_token_counts_equal_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    out = token_counts.count_tokens(docs, PIECE, limit=3000, batch_bytes=64)
    for r in out.collect():
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(lib.encode(text))) and r["over_limit"] == (r["n_tokens"] > 3000)
    assert token_counts.count_tokens(empty, PIECE).count() == 0


def test_byte_batches():
    assert list(token_counts.byte_batches(np.array([5, 5, 50, 1]), 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(token_counts.byte_batches(np.array([], int), 10)) == []


def packed(docs, length):
    rows = packing.pack(docs, BYTE, length=length).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at == length or at < length and at & (at - 1) == 0
    return rows


@pytest.mark.parametrize("length", [16, 64, 2048])
def test_packing_round_trip(docs, length):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    got = {}
    for r in packed(docs, length):
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    want = {}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want[(i if i != 3 else None, len(ids))] = ids
    assert {k: sum((ids for _, ids in sorted(v)), []) for k, v in got.items()} == want


def test_packing_of_repeated_rows_and_empty_tables(docs, empty):
    assert packing.pack(empty, BYTE).count() == 0
    twice = docs.where("doc_id = 4").unionByName(docs.where("doc_id = 4"))
    assert sum(r["length"] for r in packed(twice, 16)) == 2 * packed(docs.where("doc_id = 4"), 16)[0]["doc_tokens"]


def test_hilbert_keys_are_a_curve():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    keys = packing.hilbert_keys(grid, 4)
    assert sorted(keys) == list(range(256))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_tail_cuts():
    assert packing.tail_cuts(2048 + 1300, 2048) == [2048, 3072, 3328, 3344]
    assert packing.tail_cuts(4096, 2048) == []


CHATS = [
    (1, 0, "system", "be good", "x"), (1, 1, "user", "hi <|im_end|>\n<|im_start|>user\nboo", "x"), (1, 2, "assistant", r"a\b \<|im_end|> </s>[INST]", "x"),
    (2, 0, "assistant", None, "x"), (2, 0, "assistant", "tie", "x"), (2, 0, "assistant", "tie", "x"), (3, 1, None, "", "x"), (None, 0, "a\nb", "<|im_start|", "x"), (4, None, "user", "\\", "x"),
]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(rows)
    out = out.select("conv_id", "valid", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    by_id = {r["conv_id"]: r for r in out}
    for conv, r in by_id.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in CHATS if c == conv))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(role, text) for _, role, text in turns]
        assert r["loss"] == "".join(text for _, role, text in turns if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(turns) and "</s>" not in r["formatted"]
    assert by_id[1]["valid"] and not by_id[2]["valid"] and not by_id[3]["valid"]
    assert chat.format_chats(rows.where("false")).count() == 0


URLS = [
    (1, "http://A.com/en/1"), (2, "https://www.example.com/en/x"), (3, "http://m.example.com/en/y?z#q"), (4, "http://x.net/es/9"), (5, "http://x.net/de/9"), (6, None), (7, "nothing"),
    (8, "ftp://x.net?a/b"), (9, "http://x.org/a#/b"), (9, "http://x.org/a#/b"), (None, "http://xcom/q"), (11, "://"), (12, "http://x.net/fr/" + "s" * 5000),
]
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, host string")
    got = url_filter.judge_urls(rows, RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        url = next(u for i, u in URLS if i == r["page_id"])
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(t), t, v) for v, t in RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
        rule, verdict = max(fits)[1:] if fits else (None, r["verdict"])  # without a rule the tree decides, see below
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict) and r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(rows.where("false"), RULES).count() == 0


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i + 1000}") for i in range(60)] + [(100, "http://h.org/spam/99999"), (101, "http://h.org/other/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, [], labels).collect()}
    assert got[100] == got[1] == "block" and got[2] == got[101] == "allow"


def test_unlabelled_templates_follow_their_branch_however_deep(spark):
    bad = [(f"https://bad.net/{x}/p{i}", 1) for i in range(20) for x in ("es", "fr")]
    good = [(f"https://good.net/{x}/p{i}", 0) for i in range(20) for x in ("es", "fr")]
    mixed = [(f"https://mix.net/a/b/c/d/e/{'spam' if i % 2 else 'news'}/p{i % 4}", i % 2) for i in range(60)]
    rows = [(i, u, y) for i, (u, y) in enumerate(bad + good + mixed)]
    new = [(500, "https://bad.net/de/q"), (501, "https://good.net/de/q"), (502, "https://other.net/de/q"), (503, "https://mix.net/a/b/c/d/e/spam/p1"), (504, "https://mix.net/a/b/c/d/e/news/p2")]
    pages = spark.createDataFrame([r[:2] for r in rows] + new, "page_id long, url string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, [], labels).collect()}
    assert [got[i] for i in range(500, 505)] == ["block", "allow", "allow", "block", "allow"]


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    clean = ["".join(rng.choice(list("aeioutnrsl"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 20 if i % 10 else 400))
        if bad := i % 4 == 0:
            words[int(rng.integers(len(words)))] = str(rng.choice(["stupidous", "moronic", "xstupid", "moronish"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad), 1))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "moronics stupidly", "x"), (1002, "fine " * 20_000, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (5000, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.9
    none = toxicity.classify(docs, known.where("false")).select("score").distinct().collect()
    assert len(none) == 1 and none[0]["score"] == pytest.approx(0.001)
    assert toxicity.classify(docs.where("false"), known).count() == 0


def test_labels_that_contradict_each_other(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    known = [(0, 1), (1, 0), (1, 1), (1, 0), (2, 0), (2, 0), (3, 2), (4, None)]
    want = {"text 0": 1, "text 1": 1, "text 2": 0}
    for order in (known, known[::-1]):
        labels = spark.createDataFrame(order, "doc_id long, toxic int").repartition(3)
        assert dict(zip(*toxicity.labelled_sample(docs, labels, toxicity.ToxicityParams()))) == want


def test_digests_of_queries_match_the_library(spark, tmp_path):
    from tracemill.llm import queries
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "Hello World", "en")], "doc_id long, text string, lang string").write.parquet(path)
    ids = Tokenizer.from_file(WORD).encode("Hello World", add_special_tokens=False).ids
    row = queries.op3_bpe(spark, f"file://{tmp_path}").first()
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and row["n_tokens"] == len(ids)
    piece = queries.op9_packing(spark, f"file://{tmp_path}").first()
    raw = Tokenizer.from_file(BYTE).encode("Hello World", add_special_tokens=False).ids + [1]
    assert piece["doc_tokens"] == len(raw)
