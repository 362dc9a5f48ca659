"""Deterministic corruptions of clean traces: one changed step, marked as wrong.

A table of recipes says for each benchmark and family which steps may be hit and
how the hit step changes. All recipes of a suite are columns over one row, so a
trace fans out without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.functions.picks import generator, held, pick, take

Edit = Callable[[Column, Column], dict[str, Column]]
#: an edit's ``choose(step, seed)`` gives the other item; its edit is then called with that item in the place of the seed


def _with_choice(choose: Callable[[Column, Column], Column], seen: Callable[[Column], Column] | None = None):
    """``seen`` makes of the choice, once it is a column, what the edit gets in its place."""

    def add(edit: Edit) -> Edit:
        edit.choose, edit.seen = choose, seen
        return edit

    return add


@dataclass(frozen=True)
class Recipe:
    """``prefer``: step types to hit if there are any. ``edit`` gives the changed fields of a step, or a null ``ok`` to skip the trace."""

    family: str
    edit: Edit
    prefer: tuple[str, ...] = ()
    grounded: bool = False
    backwards: bool = False
    salt: str = ""
    wrong_use: str | None = None
    seed_shift: int = 0


def _dotless(text: Column) -> Column:
    return F.rtrim(text, F.lit("."))


def _says(step: Column, more: str) -> Column:
    return F.concat(_dotless(step["step_text"]), F.lit(" " + more))


def _other(salt: str) -> Callable[[Column, Column], Column]:
    """Another item (span or element) whose normalised text differs from that of the item the step refers to.

    Reads the column ``__items`` that :func:`corrupt` adds: each item with its normalised text and its id.
    """

    def choose(step: Column, seed: Column) -> Column:
        ref = F.coalesce(step["grounding_ref"], F.lit(""))
        named = lambda ids: F.filter("__items", lambda i: (ref != "") & F.array_contains(ids, i["id"]))
        now = F.coalesce(held(F.array(ref, T.last_part(ref)), lambda ids: F.get(named(ids), F.lit(0)))["norm"], F.lit(""))
        others = lambda now: F.filter("__items", lambda i: (i["id"] != "") & (i["norm"] != now))
        return held(now, lambda now: pick(others(now), seed, F.col("example_id"), ref, F.lit(salt)))["item"]

    return choose


_span = _element = _other


def _objects(salt: str):
    def choose(step: Column, seed: Column) -> Column:
        ref = step["scene"]
        free = F.filter(F.transform("__items", lambda i: i["id"]), lambda i: (i != "") & ~F.array_contains(ref["ids"], i))
        ids = take(free, F.size(ref["ids"]), seed, F.col("example_id"), F.array_join(ref["ids"], ","), F.lit(salt))
        return F.when(ref["kind"] == "objects", ids)

    return choose


def _kind(step: Column) -> Column:
    return step["scene"]["kind"]


def _swap_item(choose, ref: Callable[[Column], Column] | None = None, value: Callable[[Column, Column], Column] | None = None, text: str | None = None, need_ref: bool = False, need_other: bool = True) -> Edit:
    """Fields from another item: its reference, its text, or both."""

    @_with_choice(choose)
    def edit(step: Column, other: Column) -> dict[str, Column]:
        ok = other.isNotNull() if need_other else F.lit(True)
        if need_ref:
            ok = ok & (F.coalesce(step["grounding_ref"], F.lit("")) != "")
        out = {"ok": ok}
        if ref:
            out["grounding_ref"] = ref(other)
        if value:
            out["evidence_value"] = value(step, other)
        if text == "inference":
            out["step_text"] = T.mutate_inference(step["step_text"])
        elif text:
            out["step_text"] = _says(step, text)
        return out

    return edit


def _text_edit(change: Callable[[Column], Column]) -> Edit:
    return lambda step, seed: {"ok": F.lit(True), "step_text": change(step["step_text"])}


def _span_ref(other: Column) -> Column:
    return F.concat(F.lit("ocr_span:"), other["span_id"])


def _element_ref(other: Column) -> Column:
    return F.concat(F.lit("element:"), other["element_id"])


def _own_text(step: Column, other: Column) -> Column:
    return F.coalesce(T.strip(other["text"]), F.lit(""))


def _own_text_or(default: str):
    return lambda step, other: F.coalesce(T.filled(other["text"]), F.lit(default))


def _item_of(object_id: Column) -> Column:
    """The last object of an id."""
    return T.last(F.filter("__items", lambda i: (i["id"] == object_id) & (object_id != "")))["item"]


def _described(ids: Column) -> Column:
    """What :func:`tracemill.functions.text.attribute_summary` says of the row's objects, null for nothing."""
    says = F.array_join(F.filter(F.transform(ids, lambda i: T.once(_item_of(i), T.described)), lambda s: s != ""), ", ")
    return F.get(F.array_remove(F.array(says), ""), F.lit(0))


def _summary(step: Column, ids: Column) -> Column:
    return F.coalesce(_described(ids), step["evidence_value"])


def _not(value: Column) -> Column:
    return T.strip(F.concat(F.lit("not "), F.coalesce(value, F.lit(""))))


def _scene_value(salt: str, cross: bool = False) -> Edit:
    """A value of other objects, a changed relation, or a negation, by the kind of the reference."""

    @_with_choice(_objects(salt), lambda ids: F.struct(F.size(ids).alias("n"), _described(ids).alias("says")))
    def edit(step: Column, chosen: Column) -> dict[str, Column]:
        kind = _kind(step)
        other = F.coalesce(chosen["says"], step["evidence_value"] if cross else chosen["n"].cast("string"))
        ok = (kind != "objects") | (chosen["n"] >= 0)
        if cross:
            wrong = F.when(kind == "objects", other).otherwise(_not(step["evidence_value"]))
            return {"ok": ok, "evidence_value": wrong, "step_text": F.concat(_dotless(step["step_text"]), F.lit(" The evidence may read as "), wrong, F.lit("."))}
        wrong = F.when(kind == "objects", other).when(kind == "relation", step["evidence_value"]).otherwise(_not(step["evidence_value"]))
        return {"ok": ok, "evidence_value": wrong, "step_text": F.when(kind == "relation", T.mutate_relation(step["step_text"])).otherwise(step["step_text"])}

    return edit


@_with_choice(lambda step, seed: F.get(F.split(T.mutate_relation(step["scene"]["relation"]), r"\s+"), F.lit(0)))
def _scene_relation(step: Column, name: Column) -> dict[str, Column]:
    """The opposite relation in the text, and in the reference where the source has an edge of that name."""
    ref = step["scene"]
    edge = F.coalesce(F.exists(_item_of(ref["source"])["relations"], lambda r: T.strip(r["name"]) == name), F.lit(False))
    swapped = F.concat_ws(":", F.lit("relation"), name, ref["source"], ref["target"])
    return {"ok": F.lit(True), "step_text": T.mutate_relation(step["step_text"]), "grounding_ref": F.when(edge, swapped).otherwise(step["grounding_ref"])}


def _scene_intermediate(step: Column, seed: Column) -> dict[str, Column]:
    ids = step["scene"]["ids"]
    wrong = F.when(step["step_type"] == "count", F.greatest(F.lit(0), F.size(ids) - 1).cast("string")).otherwise("different object set")
    value = F.when(_kind(step) == "objects", wrong).otherwise(step["evidence_value"])
    return {"ok": F.lit(True), "evidence_value": value, "step_text": T.mutate_inference(step["step_text"])}


def _value_says(choose, value) -> Edit:
    """Another item's text as the evidence, and a sentence that reads it out."""

    @_with_choice(choose)
    def edit(step: Column, other: Column) -> dict[str, Column]:
        wrong = value(step, other)
        text = F.concat(_dotless(step["step_text"]), F.lit(" The evidence may read as "), wrong, F.lit("."))
        return {"ok": other.isNotNull(), "evidence_value": wrong, "step_text": text}

    return edit


def _object_ref(ids: Column) -> Column:
    return T.format_ref(ids, "object")


READ, REASON = ("locate", "read", "extract"), ("reason", "derive", "compute", "locate")
INTERMEDIATE = ("read", "extract", "reason", "derive")
RELATION_USE = "wrong_relation_composition"

MAIN: dict[str, list[Recipe]] = {
    "docvqa": [
        Recipe("wrong_region", _swap_item(_span("wrong_region"), ref=_span_ref), READ, grounded=True),
        Recipe("wrong_value", _swap_item(_span("wrong_value"), value=_own_text, need_ref=True), ("read", "extract", "compute")),
        Recipe("wrong_relation", _text_edit(T.mutate_relation), REASON, wrong_use=RELATION_USE),
        Recipe("irrelevant_evidence", _swap_item(_span("irrelevant_evidence"), _span_ref, _own_text), READ),
        Recipe(
            "wrong_intermediate_evidence",
            _swap_item(_span("wrong_intermediate"), value=lambda s, o: F.when(o.isNotNull(), _own_text(s, o)).otherwise(s["evidence_value"]), text="inference", need_other=False),
            INTERMEDIATE,
        ),
    ],
    "gqa": [
        Recipe("wrong_region", _swap_item(_objects("wrong_region"), ref=_object_ref), ("identify", "count", "relate", "extract"), grounded=True),
        Recipe("wrong_value", _scene_value("wrong_value"), ("identify", "count", "extract", "compute")),
        Recipe("wrong_relation", _scene_relation, ("relate", "reason", "derive"), grounded=True, wrong_use=RELATION_USE),
        Recipe("irrelevant_evidence", _swap_item(_objects("irrelevant_evidence"), _object_ref, _summary), ("identify", "extract", "count")),
        Recipe("wrong_intermediate_evidence", _scene_intermediate, ("identify", "count", "reason", "derive")),
    ],
    "visualwebbench": [
        Recipe("wrong_region", _swap_item(_element("wrong_region"), ref=_element_ref), READ, grounded=True),
        Recipe("wrong_value", _swap_item(_element("wrong_value"), value=_own_text_or("different element"), need_ref=True), ("read", "extract", "compute")),
        Recipe("wrong_relation", _text_edit(T.mutate_relation), REASON, wrong_use=RELATION_USE),
        Recipe("irrelevant_evidence", _swap_item(_element("irrelevant_evidence"), _element_ref, _own_text), READ),
        Recipe(
            "wrong_intermediate_evidence",
            _swap_item(
                _element("wrong_intermediate"),
                value=lambda s, o: F.when(o.isNotNull(), _own_text(s, o)).otherwise(F.coalesce(F.nullif(s["evidence_value"], F.lit("")), F.lit("different UI cue"))),
                text="inference",
                need_other=False,
            ),
            INTERMEDIATE,
        ),
    ],
}

_CROSS_TEXT = (_text_edit(lambda t: T.mutate_relation(T.mutate_inference(t))), _text_edit(T.mutate_inference))


def _cross(benchmark: str) -> list[Recipe]:
    region, value, other = {
        "docvqa": (
            _swap_item(_span("cross_wrong_region"), ref=_span_ref, text="I may be referring to a nearby field."),
            _value_says(_span("cross_wrong_value"), _own_text),
            _swap_item(_span("cross_irrelevant"), _span_ref, _own_text, "I also consider a nearby but less relevant field."),
        ),
        "gqa": (
            _swap_item(_objects("cross_wrong_region"), ref=_object_ref, text="I focus on another object set."),
            _scene_value("cross_wrong_value", cross=True),
            _swap_item(_objects("cross_irrelevant"), _object_ref, _summary, "I also inspect another object group."),
        ),
        "visualwebbench": (
            _swap_item(_element("cross_wrong_region"), ref=_element_ref, text="I may be looking at a different control."),
            _value_says(_element("cross_wrong_value"), _own_text_or("different UI element")),
            _swap_item(_element("cross_irrelevant"), _element_ref, _own_text, "I also consider another nearby interface element."),
        ),
    }[benchmark]
    return [
        Recipe("wrong_region", region, grounded=True, backwards=True, salt="cross_wrong_region"),
        Recipe("wrong_value", value, backwards=True, salt="cross_wrong_value"),
        Recipe("wrong_relation", _CROSS_TEXT[0], backwards=True, salt="cross_wrong_relation"),
        Recipe("irrelevant_evidence", other, backwards=True, salt="cross_irrelevant"),
        Recipe("wrong_intermediate_evidence", _CROSS_TEXT[1], backwards=True, salt="cross_wrong_intermediate"),
    ]


def _wrong_use(benchmark: str) -> list[Recipe]:
    value, relation = MAIN[benchmark][1], MAIN[benchmark][2]
    return [
        Recipe("wrong_value", value.edit, value.prefer, value.grounded, wrong_use="wrong_attribute_readout", seed_shift=11),
        Recipe("wrong_relation", relation.edit, relation.prefer, relation.grounded, wrong_use=RELATION_USE, seed_shift=23),
        Recipe(
            "wrong_intermediate_evidence", _text_edit(T.mutate_inference), ("reason", "derive", "compute"),
            salt="wrong_use_inference", wrong_use="wrong_inference_from_correct_facts", seed_shift=37,
        ),
    ]


def recipes(suite: str, benchmark: str) -> list[Recipe]:
    return {"main": lambda b: MAIN[b], "cross": _cross, "wrong_use": _wrong_use}[suite](benchmark)


def target_step(recipe: Recipe, seed: int) -> Column:
    """The step to hit: not an answer, grounded if asked, of a preferred type if there is one."""

    def open_(s: Column) -> Column:
        fits = F.coalesce(s["step_type"] != "answer", F.lit(True))
        return fits & (F.coalesce(s["grounding_ref"], F.lit("")) != "") if recipe.grounded else fits

    def one_of(steps: Column) -> Column:
        return pick(F.reverse(steps) if recipe.backwards else steps, F.lit(seed), F.col("trace_id"), F.lit(recipe.salt or recipe.family), F.lit("step"))

    def preferred(steps: Column) -> Column:
        liked = F.filter(steps, lambda s: s["step_type"].isin(*recipe.prefer))
        return held(liked, lambda liked: one_of(F.when(F.size(liked) > 0, liked).otherwise(steps)))

    steps = F.filter("steps", open_)
    return held(steps, preferred) if recipe.prefer else one_of(steps)


def corrupt(traces: DataFrame, benchmark: str, suite: str = "main", seed: int = 0, families: list[str] | None = None, rng: str = "md5", source_steps: bool = False) -> DataFrame:
    """Up to one corrupted trace per recipe, for rows with steps and the evidence columns spans, objects or elements.

    Adds suite, family, source_trace_id, target_step_id, wrong_use_type and
    noop_corruption (the step reads as before); trace_id, label and error_type of
    the hit step change. Ids are unique within a suite only. ``rng`` chooses by
    md5, or by Python's generator in Arrow batches (:func:`tracemill.functions.picks.generator`).
    ``source_steps`` keeps the steps as they were, under that name.
    """
    with generator(rng):
        return _corrupt(traces, benchmark, suite, seed, families, source_steps)


def _corrupt(traces: DataFrame, benchmark: str, suite: str, seed: int, families: list[str] | None, source_steps: bool) -> DataFrame:
    chosen = [r for r in recipes(suite, benchmark) if families is None or r.family in families]
    if unknown := set(families or ()) - {r.family for r in recipes(suite, benchmark)}:
        raise ValueError(f"unknown families {sorted(unknown)}")
    name = "cross" if suite == "cross" else "main"
    fields = ("step_text", "grounding_ref", "evidence_value")
    rows = traces
    listed, key = {"docvqa": ("spans", "span_id"), "gqa": ("objects", "object_id"), "visualwebbench": ("elements", "element_id")}[benchmark]
    norm = (lambda i: []) if benchmark == "gqa" else lambda i: [T.normalize_text(i["text"]).alias("norm")]
    item = lambda i: F.struct(i.alias("item"), *norm(i), F.coalesce(T.strip(i[key]), F.lit("")).alias("id"))
    rows = rows.withColumn("__items", F.transform(listed, item))
    # targets, other items and changes as columns of their own, one after the other, so that nothing is evaluated anew where it is used twice
    rows = rows.withColumns({f"__t{k}": target_step(r, seed + r.seed_shift) for k, r in enumerate(chosen)})
    if benchmark == "gqa":  # the parts of the target's reference, which edits read as its field ``scene``
        rows = rows.withColumns({f"__t{k}": F.col(f"__t{k}").withField("scene", T.scene_ref(F.col(f"__t{k}")["grounding_ref"], held)) for k in range(len(chosen))})
    picks = {f"__a{k}": r.edit.choose(F.col(f"__t{k}"), F.lit(seed + r.seed_shift)) for k, r in enumerate(chosen) if hasattr(r.edit, "choose")}
    rows = rows.withColumns(picks) if picks else rows
    if seen := {f"__a{k}": r.edit.seen(F.col(f"__a{k}")) for k, r in enumerate(chosen) if getattr(r.edit, "seen", None)}:
        rows = rows.withColumns(seen)
    changes = {}
    for k, r in enumerate(chosen):
        step = F.col(f"__t{k}")
        change = r.edit(step, F.col(f"__a{k}") if f"__a{k}" in picks else F.lit(seed + r.seed_shift))
        ok = step.isNotNull() & F.coalesce(change["ok"], F.lit(False))
        changes[f"__c{k}"] = F.when(ok, F.struct(*(change.get(f, step[f]).cast("string").alias(f) for f in fields)))
    rows = rows.withColumns(changes)
    options = []
    for k, r in enumerate(chosen):
        step, change = F.col(f"__t{k}"), F.col(f"__c{k}")
        step = step.dropFields("scene") if benchmark == "gqa" else step
        options.append(F.struct(F.lit(r.family).alias("family"), F.lit(r.wrong_use).cast("string").alias("wrong_use_type"), step.alias("step"), change.alias("change")))
    rows = rows.withColumn("__o", F.explode(F.filter(F.array(*options), lambda o: o["change"].isNotNull())))
    o = F.col("__o")
    step, change, noop, edited = o["step"], o["change"], F.lit(True), o["step"]
    for f in fields:
        noop = noop & change[f].eqNullSafe(step[f])
        edited = edited.withField(f, change[f])
    edited = edited.withField("label", F.lit(0)).withField("error_type", o["family"])
    steps = F.transform("steps", lambda s: F.when(s["step_id"] == step["step_id"], edited).otherwise(s))
    keep = [c for c in traces.columns if c not in ("trace_id", "steps")]
    return rows.select(
        F.concat_ws("__", "trace_id", F.lit(name), o["family"], F.concat(F.lit("s"), step["step_id"].cast("string"))).alias("trace_id"),
        *keep, steps.alias("steps"), F.lit(suite).alias("suite"), o["family"].alias("family"), F.col("trace_id").alias("source_trace_id"),
        step["step_id"].alias("target_step_id"), o["wrong_use_type"].alias("wrong_use_type"), noop.alias("noop_corruption"),
        *([F.col("steps").alias("source_steps")] if source_steps else []),
    )


def first_difference(better: Column, worse: Column) -> Column:
    """1-based place of the first step whose labels differ; 1 if none does."""
    differs = F.zip_with(better, worse, lambda a, b: F.coalesce(a["label"] != b["label"], F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(differs, F.lit(True)), F.lit(0).cast("long")), F.lit(1).cast("long")).cast("int")


def prefix_corruption(steps: Column, step_id: int = 2, prefix: str = "wrong_") -> Column:
    """The small generator's corruption: reference and evidence of one step get a prefix and label 0."""
    hit = lambda s: (
        s.withField("grounding_ref", F.concat(F.lit(prefix), s["grounding_ref"]))
        .withField("evidence_value", F.concat(F.lit(prefix), s["evidence_value"]))
        .withField("label", F.lit(0))
    )
    return F.transform(steps, lambda s: F.when(s["step_id"] == step_id, hit(s)).otherwise(s))
