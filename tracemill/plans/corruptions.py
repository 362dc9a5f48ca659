"""Queries of the corruptions of scene and web traces, each beside its DuckDB twin; they join the catalogue's.

The twins spell out every recipe, so that a wrong type, salt or sentence shows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import corrupt
from tracemill.plans import frames
from tracemill.plans.catalogue import d_draw, d_inference, d_list, d_norm, d_relation, query
from tracemill.plans.frames import STEPS_SQL
from tracemill.schemas import STEP

# --- traces: an order's steps refer to its lines, as objects of a scene or as elements of a page ---
_TYPE = {"gqa": "CASE step_type WHEN 'locate' THEN 'count' WHEN 'read' THEN 'identify' WHEN 'derive' THEN 'relate' ELSE step_type END", "visualwebbench": "step_type"}
_REF = {
    "gqa": "CASE WHEN grounding_ref = '' THEN '' WHEN grounding_ref = 'ocr_span:99' THEN 'objects:1,9' WHEN grounding_ref = 'ocr_span:2' THEN 'relation:left of:2:1' "
    "WHEN grounding_ref = 'ocr_span:3' THEN 'relation:above:3:1' WHEN grounding_ref = 'ocr_span:6' THEN 'scene:6' WHEN grounding_ref = 'ocr_span:5' THEN 'objects:5,1' WHEN grounding_ref = 'ocr_span:4' THEN 'objects:' "
    "ELSE replace(grounding_ref, 'ocr_span:', 'object:') END",
    "visualwebbench": "replace(grounding_ref, 'ocr_span:', 'element:b')",
}
_EDGE = "CASE WHEN length(p_name) % 2 = 0 THEN 'right' ELSE 'below' END"
_SHOWN = "CASE WHEN p_name LIKE 's%' THEN ' ' ELSE p_name END"


def _traces(spark, sf_dir, benchmark: str) -> DataFrame:
    step = f"""named_struct('step_id', s.step_id, 'step_text', s.step_text, 'step_type', {_TYPE[benchmark].replace('step_type', 's.step_type')},
        'grounding_ref', {_REF[benchmark].replace('grounding_ref', 's.grounding_ref')}, 'evidence_value', s.evidence_value, 'label', s.label, 'error_type', s.error_type)"""
    items = {
        "gqa": f"""transform(spans, i -> named_struct('object_id', i.span_id, 'name', concat(' ', split(i.text, ' ')[0], ' '),
            'attributes', if(i.span_id = '1', array(' ', concat(split(i.text, ' ')[1], ' '), 'unread'), slice(split(i.text, ' '), 2, 9)),
            'relations', array(named_struct('name', {_EDGE.replace('p_name', 'i.text')}, 'target_object_id', '1'))))""",
        "visualwebbench": f"transform(spans, i -> named_struct('element_id', 'b' || i.span_id, 'text', {_SHOWN.replace('p_name', 'i.text')}))",
    }[benchmark]
    rows = frames.traces(spark, sf_dir)
    return rows.withColumns(
        {
            "steps": F.expr(f"transform(steps, s -> {step})").cast(f"array<{STEP}>"),
            {"gqa": "objects", "visualwebbench": "elements"}[benchmark]: F.expr(items),
            "benchmark": F.lit(benchmark),
        }
    ).drop("spans")


def _corrupted(benchmark: str, suite: str):
    def run(spark, sf_dir):
        rows = corrupt.corrupt(_traces(spark, sf_dir, benchmark), benchmark, suite)
        hit = F.get(F.filter("steps", lambda s: s["step_id"] == F.col("target_step_id")), F.lit(0))
        changed = (hit[f].alias(f) for f in ("step_text", "grounding_ref", "evidence_value", "label", "error_type"))
        return rows.select("trace_id", "suite", "family", "wrong_use_type", "target_step_id", "noop_corruption", *changed)

    return run


# --- the twins ---
class _Hit(NamedTuple):
    """One recipe in SQL: which step (types preferred, drawn by seed and salt), then its new fields where ``ok``; ``alt`` is drawn by ``other``."""

    family: str
    prefer: tuple[str, ...]
    salt: str
    other: str
    grounded: bool = False
    backwards: bool = False
    seed: int = 0
    text: str = "step_text"
    ref: str = "grounding_ref"
    value: str = "evidence_value"
    ok: str = "alt IS NOT NULL"
    wrong_use: str = ""


def _says(more: str) -> str:
    return f"rtrim(step_text, '.') || ' {more}'"


_REL, _INF = d_relation("step_text"), d_inference("step_text")
_BOTH = d_relation(f"({_INF})")
_COMPOSITION, _READOUT, _INFERENCE = "wrong_relation_composition", "wrong_attribute_readout", "wrong_inference_from_correct_facts"
_LAST = _Hit("wrong_intermediate_evidence", ("reason", "derive", "compute"), "wrong_use_inference", "", seed=37, text=_INF, ok="true", wrong_use=_INFERENCE)

# pages: an alternate element is {id, text}
_E_REF, _E_TEXT = "'element:' || alt.id", "trim(alt.text)"
_E_OR, _E_ALSO = f"coalesce(nullif({_E_TEXT}, ''), 'different element')", f"coalesce(nullif({_E_TEXT}, ''), 'different UI element')"
_E_VALUE = _Hit("wrong_value", ("read", "extract", "compute"), "wrong_value", "wrong_value", value=_E_OR, ok="alt IS NOT NULL AND grounding_ref <> ''")
_E_RELATION = _Hit("wrong_relation", ("reason", "derive", "compute", "locate"), "wrong_relation", "", text=_REL, ok="true", wrong_use=_COMPOSITION)
_WEB = {
    "main": [
        _Hit("wrong_region", ("locate", "read", "extract"), "wrong_region", "wrong_region", grounded=True, ref=_E_REF),
        _E_VALUE,
        _E_RELATION,
        _Hit("irrelevant_evidence", ("locate", "read", "extract"), "irrelevant_evidence", "irrelevant_evidence", ref=_E_REF, value=_E_TEXT),
        _Hit(
            "wrong_intermediate_evidence", ("read", "extract", "reason", "derive"), "wrong_intermediate_evidence", "wrong_intermediate", text=_INF, ok="true",
            value=f"CASE WHEN alt IS NOT NULL THEN {_E_TEXT} ELSE coalesce(nullif(evidence_value, ''), 'different UI cue') END",
        ),
    ],
    "cross": [
        _Hit("wrong_region", (), "cross_wrong_region", "cross_wrong_region", True, True, ref=_E_REF, text=_says("I may be looking at a different control.")),
        _Hit("wrong_value", (), "cross_wrong_value", "cross_wrong_value", False, True, value=_E_ALSO, text=f"{_says('The evidence may read as ')} || {_E_ALSO} || '.'"),
        _Hit("wrong_relation", (), "cross_wrong_relation", "", False, True, text=_BOTH, ok="true"),
        _Hit("irrelevant_evidence", (), "cross_irrelevant", "cross_irrelevant", False, True, ref=_E_REF, value=_E_TEXT, text=_says("I also consider another nearby interface element.")),
        _Hit("wrong_intermediate_evidence", (), "cross_wrong_intermediate", "", False, True, text=_INF, ok="true"),
    ],
    "wrong_use": [_E_VALUE._replace(seed=11, wrong_use=_READOUT), _E_RELATION._replace(seed=23), _LAST],
}

# scenes: alternates are as many ids as the step names
_O_REF = "CASE WHEN len(alt) = 1 THEN 'object:' ELSE 'objects:' END || array_to_string(alt, ',')"
_O_TEXT = "nullif(array_to_string(list_filter(list_transform(alt, lambda x: list_filter(items, lambda o: o.id = x)[-1].says), lambda s: s <> ''), ', '), '')"
_O_OR, _NOT = f"coalesce({_O_TEXT}, evidence_value)", "trim('not ' || evidence_value)"
_O_OK, _IS_REL = "ids IS NULL OR alt IS NOT NULL", "starts_with(grounding_ref, 'relation:')"
_O_WRONG = f"CASE WHEN ids IS NOT NULL THEN {_O_OR} ELSE {_NOT} END"
_O_VALUE = _Hit(
    "wrong_value", ("identify", "count", "extract", "compute"), "wrong_value", "wrong_value", ok=_O_OK, text=f"CASE WHEN {_IS_REL} THEN {_REL} ELSE step_text END",
    value=f"CASE WHEN ids IS NOT NULL THEN coalesce({_O_TEXT}, CAST(len(alt) AS VARCHAR)) WHEN {_IS_REL} THEN evidence_value ELSE {_NOT} END",
)
_PARTS = "string_split(grounding_ref, ':')"
_NAME = f"string_split({d_relation(f'{_PARTS}[2]')}, ' ')[1]"
_O_RELATION = _Hit(
    "wrong_relation", ("relate", "reason", "derive"), "wrong_relation", "", True, text=_REL, ok="true", wrong_use=_COMPOSITION,
    ref=f"CASE WHEN {_IS_REL} AND coalesce(list_filter(items, lambda o: o.id = {_PARTS}[3])[-1].edge = {_NAME}, false) THEN 'relation:' || {_NAME} || ':' || {_PARTS}[3] || ':' || {_PARTS}[4] ELSE grounding_ref END",
)
_SCENE = {
    "main": [
        _Hit("wrong_region", ("identify", "count", "relate", "extract"), "wrong_region", "wrong_region", True, ref=_O_REF),
        _O_VALUE,
        _O_RELATION,
        _Hit("irrelevant_evidence", ("identify", "extract", "count"), "irrelevant_evidence", "irrelevant_evidence", ref=_O_REF, value=_O_OR),
        _Hit(
            "wrong_intermediate_evidence", ("identify", "count", "reason", "derive"), "wrong_intermediate_evidence", "", text=_INF, ok="true",
            value="CASE WHEN ids IS NULL THEN evidence_value WHEN step_type = 'count' THEN CAST(greatest(0, len(ids) - 1) AS VARCHAR) ELSE 'different object set' END",
        ),
    ],
    "cross": [
        _Hit("wrong_region", (), "cross_wrong_region", "cross_wrong_region", True, True, ref=_O_REF, text=_says("I focus on another object set.")),
        _Hit("wrong_value", (), "cross_wrong_value", "cross_wrong_value", False, True, ok=_O_OK, value=_O_WRONG, text=f"{_says('The evidence may read as ')} || {_O_WRONG} || '.'"),
        _Hit("wrong_relation", (), "cross_wrong_relation", "", False, True, text=_BOTH, ok="true"),
        _Hit("irrelevant_evidence", (), "cross_irrelevant", "cross_irrelevant", False, True, ref=_O_REF, value=_O_OR, text=_says("I also inspect another object group.")),
        _Hit("wrong_intermediate_evidence", (), "cross_wrong_intermediate", "", False, True, text=_INF, ok="true"),
    ],
    "wrong_use": [_O_VALUE._replace(seed=11, wrong_use=_READOUT), _O_RELATION._replace(seed=23), _LAST],
}

_IDS = "CASE WHEN starts_with(grounding_ref, 'object:') THEN [substr(grounding_ref, 8)] WHEN starts_with(grounding_ref, 'objects:') THEN list_filter(string_split(substr(grounding_ref, 9), ','), lambda i: i <> '') END"
_ITEM = {
    "gqa": f"{{'id': CAST(l_linenumber AS VARCHAR), 'says': concat_ws(' ', string_split(p_name, ' ')[2], CASE WHEN l_linenumber <> 1 THEN string_split(p_name, ' ')[3] END, string_split(p_name, ' ')[1]), 'edge': {_EDGE}}}",
    "visualwebbench": f"{{'id': 'b' || l_linenumber, 'text': {_SHOWN}}}",
}


def _d_alternate(benchmark: str, hit: _Hit) -> str:
    if benchmark == "gqa":
        drawn = d_draw(str(hit.seed), "'e' || l_orderkey", "array_to_string(ids, ',')", f"'{hit.other}'", "v")
        ranked = f"list_sort(list_transform(free, lambda v: {{'d': {drawn}, 'v': v}}))"
        return f"""SELECT *, CASE WHEN len(free) >= len(ids) THEN list_sort(list_transform({ranked}[1:len(ids)], lambda s: s.v)) END AS alt
            FROM (SELECT *, list_distinct(list_filter(list_transform(items, lambda o: o.id), lambda x: NOT list_contains(ids, x))) AS free FROM (SELECT *, {_IDS} AS ids FROM hit))"""
    now = f"coalesce(list_filter(items, lambda z: grounding_ref <> '' AND z.id = {_PARTS}[-1])[1].text, '')"
    drawn = d_draw(str(hit.seed), "'e' || l_orderkey", "grounding_ref", f"'{hit.other}'")
    return f"""SELECT *, CASE WHEN len(others) > 0 THEN others[1 + {drawn} % greatest(len(others), 1)] END AS alt
        FROM (SELECT *, list_filter(items, lambda i: {d_norm('i.text')} <> {d_norm(now)}) AS others FROM hit)"""


def _d_corrupted(benchmark: str, suite: str, hits: list[_Hit]) -> str:
    parts = []
    for h in hits:
        liked = f"step_type IN ({d_list(h.prefer)})" if h.prefer else "false"
        parts.append(
            f"""SELECT 't' || l_orderkey || '__{'cross' if suite == 'cross' else 'main'}__{h.family}__s' || step_id AS trace_id, '{suite}' AS suite, '{h.family}' AS family,
            nullif('{h.wrong_use}', '') AS wrong_use_type, step_id AS target_step_id, new_text = step_text AND new_ref = grounding_ref AND new_value = evidence_value AS noop_corruption,
            new_text AS step_text, new_ref AS grounding_ref, new_value AS evidence_value, CAST(0 AS INTEGER) AS label, '{h.family}' AS error_type
            FROM (WITH hit AS (
                SELECT c.*, items FROM (
                    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY step_id {'DESC' if h.backwards else ''}) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n
                    FROM (SELECT *, {liked} AS liked, bool_or({liked}) OVER (PARTITION BY l_orderkey) AS any_liked FROM steps WHERE step_type <> 'answer' {"AND grounding_ref <> ''" if h.grounded else ''})
                    WHERE liked OR NOT any_liked
                ) c JOIN item_lists USING (l_orderkey) WHERE k = {d_draw(str(h.seed), "'t' || l_orderkey", f"'{h.salt}'", "'step'")} % n
            ) SELECT *, {h.text} AS new_text, {h.ref} AS new_ref, {h.value} AS new_value FROM ({_d_alternate(benchmark, h)}) WHERE {h.ok})"""
        )
    lines = STEPS_SQL + " JOIN orders ON o_orderkey = l_orderkey"
    steps = f"SELECT * REPLACE ({_TYPE[benchmark]} AS step_type, {_REF[benchmark]} AS grounding_ref) FROM lines"
    lists = f"SELECT l_orderkey, list({_ITEM[benchmark]} ORDER BY step_id) AS items FROM lines GROUP BY l_orderkey"
    return f"WITH lines AS MATERIALIZED ({lines}), steps AS MATERIALIZED ({steps}), item_lists AS MATERIALIZED ({lists}) " + " UNION ALL ".join(parts)


for _kind, _benchmark, _suites in (("scene", "gqa", _SCENE), ("web", "visualwebbench", _WEB)):
    for _suite, _hits in _suites.items():
        _run = _corrupted(_benchmark, _suite)
        _run.__name__ = f"q_corrupt_{_kind}_{_suite}"
        query(_d_corrupted(_benchmark, _suite, _hits))(_run)
