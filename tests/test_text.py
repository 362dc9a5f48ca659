import pytest
from pyspark.sql import functions as F

from tracemill.functions import picks
from tracemill.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("text", "expected"),
    [("  Foo_Bar—Baz!  ", "foo bar baz"), (None, ""), ("É x", "é x"), ("", ""), ("__", "")],
)
def test_normalize_text(spark, text, expected):
    assert value(spark, T.normalize_text(lit(text))) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1. Locate the box", "Locate the box"), ("Step 10) x", "x"), ("• bullet", "bullet"), ("- item;", "item"),
        ("2.5 million units", "5 million units"), ("3-4 items", "4 items"),
    ],
)
def test_clean_chunk(spark, text, expected):
    assert value(spark, T.clean_chunk(lit(text))) == expected


def test_segment(spark):
    text = "I see a header, then I read INV-7; The total is 12, so the answer is 12. done"
    assert value(spark, T.segment(lit(text), "free")) == ["I see a header", "then I read INV-7", "The total is 12", "so the answer is 12. done"]
    assert value(spark, T.segment(lit("1. A b.\n2. C d. E f."), "canonical")) == ["A b.", "C d. E f."]
    assert value(spark, T.segment(lit("1. A b.\n2. C d. E f."), "light")) == ["A b.", "C d.", "E f."]
    assert value(spark, T.segment(lit("One. Two."), "canonical")) == ["One.", "Two."]
    assert value(spark, T.segment(lit("  \n "), "free")) == []
    assert value(spark, T.segment(lit("x"), "other")) is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [("The reason is clear.", "The reason is clear."), ("So it is 5.", "still it is 5."), ("It is red.", "It is red This suggests a different conclusion."), ("Therefore so be it.", "however so be it.")],
)
def test_mutate_inference(spark, text, expected):
    assert value(spark, T.mutate_inference(lit(text))) == expected


@pytest.mark.parametrize(
    ("text", "expected"), [("cup left of plate", "cup right of plate"), ("cup on plate.", "cup on plate using a different relation."), ("Before before", "after before")]
)
def test_mutate_relation(spark, text, expected):
    assert value(spark, T.mutate_relation(lit(text))) == expected


@pytest.mark.parametrize(
    ("text", "bench", "expected"),
    [("Look at the thread", "docvqa", "locate"), ("the discount", "gqa", "count"), ("a thread", "gqa", "extract"), ("a thread", "docvqa", "read"), ("zzz", "gqa", "derive")],
)
def test_step_type(spark, text, bench, expected):
    assert value(spark, T.step_type(lit(text), lit(bench))) == expected


@pytest.mark.parametrize(("text", "expected"), [("foo\nAnswer: yes", "yes"), ("Answer: a\nrest", None), ("x\u0085Answer: b.", "b"), ("Thus the answer is 4 .", "4")])
def test_extracted_answer(spark, text, expected):
    assert (value(spark, T.extracted_answer(lit(text))) or None) == expected


def test_answer_of_last_step(spark):
    assert value(spark, T.extracted_answer(lit("Answer: a\nrest"), lit("so the answer is 7"))) == "7"


def test_refs(spark):
    got = lambda x: value(spark, T.scene_ref(lit(x))).asDict()
    assert got("relation:on:1:2") == {"kind": "relation", "ids": None, "relation": "on", "source": "1", "target": "2"}
    assert got("objects:1, 2,")["ids"] == ["1", "2"]
    assert got("foo:1")["kind"] == got("relation:on:1")["kind"] == "unknown"
    assert got("")["kind"] == got(None)["kind"] == "empty"
    assert value(spark, T.element_ref(lit("elements:a, b")))["ids"] == ["a", "b"]
    assert value(spark, T.format_ref(F.array(F.lit("1"), F.lit("2")), "object")) == "objects:1,2"
    assert value(spark, T.last_part(lit("ocr_span:ocr_word:3"))) == "3"


def test_json_object(spark):
    assert value(spark, T.json_object(lit('x ```json\n{"a": {"b": 1}}\n``` y'))) is not None
    assert value(spark, T.json_object(lit("[1]"))) is None
    assert value(spark, T.json_object(lit("{broken"))) is None


def test_take_and_pick(spark):
    values = F.array(*map(F.lit, "abc"))
    assert value(spark, picks.pick(F.array().cast("array<string>"), F.lit(1))) is None
    assert value(spark, picks.take(values, F.lit(4), F.lit(1))) is None
    got = value(spark, picks.take(values, F.lit(2), F.lit(1)))
    assert got == sorted(got) and len(set(got)) == 2
    assert value(spark, picks.pick(values, F.lit(1))) == value(spark, picks.pick(values, F.lit(1)))
