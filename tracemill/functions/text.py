"""String, regex and JSON functions as Spark columns; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that open a clause
DISCOURSE_MARKERS = (
    "first", "second", "third", "next", "then", "after that", "because",
    "therefore", "thus", "so", "however", "finally", "overall",
)
# fixed values: phrases and what they turn into; the order decides
RELATION_SWAPS = (
    ("left of", "right of"), ("right of", "left of"), ("before", "after"), ("after", "before"),
    ("above", "below"), ("below", "above"), ("front of", "behind"), ("behind", "front of"),
    ("header", "footer"), ("footer", "header"),
)
INFERENCE_SWAPS = (("therefore", "however"), ("thus", "instead"), ("so", "still"))
# fixed values: the first rule with a substring of the text names its step type
STEP_TYPE_RULES = (
    ("locate", ("locate", "find", "look at", "header", "field")),
    ("read", ("read", "extract", "text says", "shows")),
    ("count", ("count", "number of")),
    ("relate", ("left of", "right of", "behind", "front of", "relation")),
    ("derive", ("click", "tap", "select", "press", "open")),
    ("answer", ("therefore", "thus", "so the answer", "final answer")),
    ("reason", ("because", "implies", "means")),
)
# fixed values: how numbering, sentence ends and answers look
NUMBERING = r"(?iU)^\s*(?:step\s*\d+\s*[:.)-]?|\d+\s*[:.)-]|[-*•])\s*"
SENTENCE_END = r"(?U)(?<=[.!?;])\s+(?=[A-Z0-9])"
CLAUSE_START = r"(?iU),\s+(?=(?:" + "|".join(DISCOURSE_MARKERS) + r")\b)"
ANSWERS = (r"(?idU)(?:final answer|answer)\s*[:\-]\s*(.+)$", r"(?idU)(?:therefore|thus|so)\s+the\s+answer\s+is\s+(.+)$")
FENCED_JSON = r"(?sU)```(?:json)?\s*(\{.*\})\s*```"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it may use many times: as the variable of a lambda it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; ``trim`` knows spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.get(F.array_remove(F.array(strip(text.cast("string"))), ""), F.lit(0))  # nullif would evaluate the text twice


def first_filled(*columns: Column) -> Column:
    """The first column with something but white space in it."""
    return F.coalesce(*(filled(c) for c in columns))


def normalize_text(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space; null as the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), r"(?U)[\W_]+", " ")), F.lit(""))


def normalize_space(text: Column) -> Column:
    """Unix line ends, single spaces, at most one blank line, stripped."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def clean_chunk(text: Column) -> Column:
    """Without numbering, with single spaces, without punctuation at the ends."""
    text = F.regexp_replace(strip(text), NUMBERING, "")
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" -;:,"))


def _cleaned(chunks: Column) -> Column:
    return F.filter(F.transform(chunks, clean_chunk), lambda c: c != "")


def split_lines(text: Column) -> Column:
    return _cleaned(F.split(normalize_space(text), r"\R"))


def split_sentences(text: Column) -> Column:
    return _cleaned(F.split(normalize_space(text), SENTENCE_END))


def split_clauses(text: Column) -> Column:
    return _cleaned(F.flatten(F.transform(split_sentences(text), lambda s: F.split(s, CLAUSE_START))))


def segment(text: Column, mode: Column | str) -> Column:
    """Steps of a text: by lines (canonical), by sentences within lines (light) or by clauses (free); null for other modes."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    sentences = split_sentences(text)

    def by_lines(lines: Column) -> Column:
        fine = F.when(mode == "light", F.flatten(F.transform(lines, split_sentences))).otherwise(lines)
        return F.when(F.size(lines) >= 2, fine).otherwise(sentences)

    # the lines are a variable of a lambda, so that they are split once
    lined = F.get(F.transform(F.array(split_lines(text)), by_lines), F.lit(0))
    return F.when(mode.isin("canonical", "light"), lined).when(mode == "free", split_clauses(text))


def step_type(text: Column, benchmark: Column) -> Column:
    """The type that the first matching rule of :data:`STEP_TYPE_RULES` names; scenes are extracted, pages read."""
    lowered = F.lower(text)
    out = F.lit("derive")
    for name, words in reversed(STEP_TYPE_RULES):
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        value = F.when(benchmark.isin("docvqa", "visualwebbench"), "read").otherwise("extract") if name == "read" else F.lit(name)
        out = F.when(hit, value).otherwise(out)
    return out


def strip_fences(text: Column) -> Column:
    """The object inside a fenced block, or the whole text, stripped."""
    inner = F.regexp_extract(text, FENCED_JSON, 1)
    return strip(F.when(inner != "", inner).otherwise(text))


def json_object(text: Column) -> Column:
    """The VARIANT of a text that is one JSON object, fenced or not; else null."""
    value = F.try_parse_json(strip_fences(text))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def extracted_answer(text: Column, last_step: Column | None = None) -> Column:
    """What follows an answer phrase in the last line of the text, or else of its last step."""
    found = [F.regexp_extract(t, p, 1) for t in (text, last_step) if t is not None for p in ANSWERS]
    return F.btrim(F.coalesce(*(F.nullif(f, F.lit("")) for f in found)), F.lit(" ."))


def replace_words(text: Column, swaps: tuple[tuple[str, str], ...]) -> Column:
    """The first phrase of ``swaps`` that occurs as words is replaced where it occurs first."""

    def replaced(text: Column) -> Column:
        out = text
        for source, target in reversed(swaps):
            found = text.rlike(rf"(?iU)\b{source}\b")
            out = F.when(found, F.regexp_replace(text, rf"(?isU)^(.*?)\b{source}\b", f"$1{target}")).otherwise(out)
        return F.when(text.rlike(rf"(?iU)\b(?:{'|'.join(source for source, _ in swaps)})\b"), out).otherwise(text)

    return once(text, replaced)  # a text may be an expression itself, and is read a dozen times


def mutate_relation(text: Column) -> Column:
    """The opposite relation, or a note that another one is used."""

    def mutated(text: Column) -> Column:
        other = F.concat(F.rtrim(text, F.lit(".")), F.lit(" using a different relation."))
        return once(replace_words(text, RELATION_SWAPS), lambda swapped: F.when(swapped != text, swapped).otherwise(other))

    return once(text, mutated)


def mutate_inference(text: Column) -> Column:
    """A conclusion turned around; a text that holds its letters only inside other words stays as it is."""

    def mutated(text: Column) -> Column:
        has = once(F.lower(text), lambda lowered: lowered.contains("therefore") | lowered.contains("thus") | lowered.contains("so"))
        return F.when(has, replace_words(text, INFERENCE_SWAPS)).otherwise(
            F.concat(F.rtrim(text, F.lit(".")), F.lit(" This suggests a different conclusion."))
        )

    return once(text, mutated)


def last_part(ref: Column) -> Column:
    return F.element_at(F.split(ref, ":"), -1)


def _id_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def scene_ref(ref: Column, hold: Callable[[Column, Callable[[Column], Column]], Column] = once) -> Column:
    """struct<kind, ids, relation, source, target> of ``object:1``, ``objects:1,2`` or ``relation:on:1:2``; kinds empty and unknown for others.

    ``object:`` names one blank id; a relation with a blank part is unknown.
    ``hold`` gives parts that are used many times; see :func:`tracemill.functions.picks.held`.
    """

    def parsed(text: Column) -> Column:
        objects = F.when(text.startswith("object:"), F.array(strip(F.substring(text, 8, 1 << 20)))).when(
            text.startswith("objects:"), _id_list(F.substring(text, 9, 1 << 20))
        )
        # name, source and target; null unless the text is a whole relation
        named = hold(F.transform(F.split(text, ":", 4), strip), lambda p: F.when((F.size(p) == 4) & F.forall(F.slice(p, 2, 3), lambda x: x != ""), p))
        relation = F.when(text.startswith("relation:"), named)
        return hold(F.struct(objects.alias("ids"), relation.alias("parts")), lambda found: of_kind(text, found))

    def of_kind(text: Column, found: Column) -> Column:
        kind = F.when(text == "", "empty").when(found["ids"].isNotNull(), "objects").when(found["parts"].isNotNull(), "relation").otherwise("unknown")
        part = lambda i: F.get(found["parts"], F.lit(i))
        return F.struct(kind.alias("kind"), found["ids"].alias("ids"), part(1).alias("relation"), part(2).alias("source"), part(3).alias("target"))

    return hold(strip(F.coalesce(ref, F.lit(""))), parsed)


def element_ref(ref: Column) -> Column:
    """struct<kind, ids> of ``element:a`` or ``elements:a,b``."""
    text = strip(F.coalesce(ref, F.lit("")))
    ids = F.when(text.startswith("element:"), F.array(strip(F.substring(text, 9, 1 << 20)))).when(
        text.startswith("elements:"), _id_list(F.substring(text, 10, 1 << 20))
    )
    return F.struct(F.when(text == "", "empty").when(ids.isNotNull(), "elements").otherwise("unknown").alias("kind"), ids.alias("ids"))


def format_ref(ids: Column, singular: str) -> Column:
    """``object:1`` for one id, ``objects:1,2`` for more."""
    return F.concat(F.when(F.size(ids) == 1, singular + ":").otherwise(singular + "s:"), F.array_join(ids, ","))


def last(items: Column) -> Column:
    """The last item of an array that is costly to find; null where there is none."""
    return once(items, lambda found: F.get(found, F.size(found) - 1))


def described(item: Column) -> Column:
    """First two attributes and name of an object, stripped, without blank parts."""
    parts = F.transform(F.slice(F.coalesce(item["attributes"], F.array().cast("array<string>")), 1, 2), strip)
    return F.concat_ws(" ", F.filter(parts, lambda p: p != ""), filled(item["name"]))


def attribute_summary(objects: Column, ids: Column) -> Column:
    """:func:`described` of each object, in the order of ``ids``; unknown ids are skipped, the last object of an id counts."""
    of_id = lambda i: last(F.filter(objects, lambda o: (strip(o["object_id"]) == i) & (i != "")))
    return F.array_join(F.filter(F.transform(ids, lambda i: once(of_id(i), described)), lambda s: s != ""), ", ")


def image_path(root: Column, name: Column) -> Column:
    """Absolute paths and URLs as they are, others under ``root``."""
    return F.when(name.startswith("/") | name.rlike("^https?://") | F.coalesce(root == "", F.lit(True)), name).otherwise(
        F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), name)
    )


def image_name(name: Column) -> Column:
    """The name with ``.jpg`` where it has no suffix."""
    return F.when(name.rlike(r"[^/.][^/]*\.[^/.]+$"), name).otherwise(F.concat(name, F.lit(".jpg")))


def serialize_steps(steps: Column) -> Column:
    """One line per step: number, type, text, grounding and evidence."""

    def line(s: Column) -> Column:
        none = lambda c: F.coalesce(filled(c), F.lit("none"))
        return F.concat(
            s["step_id"].cast("string"), F.lit(". ["), s["step_type"], F.lit("] "), strip(F.coalesce(s["step_text"], F.lit(""))),
            F.lit(" | grounding_ref="), none(s["grounding_ref"]), F.lit(" | evidence="), none(s["evidence_value"]),
        )

    return F.array_join(F.transform(steps, line), "\n")
