"""Benchmark payloads (any JSON) to manifest rows.

Records are pulled out of lists, named lists or dictionaries as VARIANT columns
in file order; named alternatives are tried in turn. Rows without a required
field go to a second table with the reason, so one bad record does not stop a
load; :func:`strict` turns them into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as T


def _fields(**values: Column) -> Column:
    """A struct whose names are literals; aliases inside lambdas over VARIANT values get lost."""
    return F.named_struct(*(x for name, value in values.items() for x in (F.lit(name), value)))


def _open(v: Column | str) -> Column:
    """The fields of an object by name, null for other values: a name that is missing costs no search of the VARIANT."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _get(m: Column, name: str, kind: str = "string") -> Column:
    """A field of an opened object."""
    return F.try_variant_get(m[name], "$", kind)


def _list(m: Column, name: str) -> Column:
    return F.coalesce(_get(m, name, "array<variant>"), F.array().cast("array<variant>"))


def any_of(m: Column, *names: str) -> Column:
    """The first named field of an opened object with something in it, as text."""
    return T.first_filled(*(_get(m, n) for n in names))


def _begins(text: Column, mark: str) -> Column:
    """Whether the text is JSON, of the kind that ``mark`` opens."""
    return F.coalesce(F.ltrim(text, F.lit(" \t\r\n")).startswith(mark) & F.try_parse_json(text).isNotNull(), F.lit(False))


def _is_list(text: Column) -> Column:
    return _begins(text, "[")


def _is_object(text: Column) -> Column:
    return _begins(text, "{")


def _items(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def records(files: DataFrame, list_keys: tuple[str, ...], grouped: bool = False) -> DataFrame:
    """(path, pos, key, raw, record) from a list, the first named list, or a dictionary (its keys in file order).

    ``grouped`` also opens dictionaries of lists: each element carries its list's
    key. ``raw`` is the record's own text, which keeps the order of its keys.
    Records that :func:`tracemill.sources.splitting.read_records` read are taken as they are.
    """
    if "record" in files.columns:
        return files
    files = files.withColumns({f"__n{i}": F.get_json_object("raw", f"$.{k}") for i, k in enumerate(list_keys)})
    named = [F.col(f"__n{i}") for i in range(len(list_keys))]
    lists = F.coalesce(F.when(_is_list(F.col("raw")), F.col("raw")), *(F.when(_is_list(n), n) for n in named))
    plain = F.transform(_items(lists), lambda r: _fields(key=F.lit(None).cast("string"), raw=r))
    inner = F.coalesce(*(F.when(_is_object(n), n) for n in named), F.col("raw"))
    keyed = F.transform(F.map_entries(F.from_json(inner, "map<string,string>")), lambda e: _fields(key=e["key"], raw=e["value"]))
    if grouped:
        opened = F.transform(keyed, lambda e: F.when(_is_list(e["raw"]), F.transform(_items(e["raw"]), lambda r: _fields(key=e["key"], raw=r))).otherwise(F.array(e)))
        keyed = F.flatten(opened)
    keyed = F.filter(keyed, lambda e: _is_object(e["raw"]))
    # of a plain explode the planner would infer a filter that evaluates the rows once more
    out = files.select("path", "payload", F.posexplode_outer(F.coalesce(plain, keyed)).alias("pos", "row")).where("pos is not null")
    return out.select("path", "payload", "pos", "row.key", "row.raw", F.try_parse_json("row.raw").alias("record"))


def _boxes(m: Column) -> Column:
    """The box of a list, or of an object with x, y and w, h or width, height; empty if any number is missing or none."""

    def sides(box: Column) -> Column:
        # zero sizes give way to the longer names
        found = [_get(box, k, "double") for k in ("x", "y")]
        found += [F.coalesce(F.nullif(_get(box, k, "double"), F.lit(0.0)), _get(box, long, "double")) for k, long in (("w", "width"), ("h", "height"))]
        whole = found[0].isNotNull() & found[1].isNotNull() & found[2].isNotNull() & found[3].isNotNull()
        return F.when(whole, F.array(*found))

    def of(name: str) -> Column:
        return F.when(m[name].isNotNull(), F.coalesce(_get(m, name, "array<double>"), T.once(_open(m[name]), sides)))

    return T.once(F.coalesce(of("bbox"), of("boundingBox")), lambda box: F.when(F.forall(box, lambda x: x.isNotNull()), box).otherwise(F.array().cast("array<double>")))


def _span(m: Column, made: Column, own_id: bool) -> Column:
    """A span of an opened entry; null for a blank text."""

    def named(text: Column) -> Column:
        return T.once(T.normalize_text(text), lambda norm: _fields(
            span_id=(F.coalesce(any_of(m, "span_id"), made) if own_id else made), text=text, normalized_text=norm,
            bbox=_boxes(m), page=_get(m, "page", "int"), tokens=F.split(norm, " ")))

    return T.once(any_of(m, "text", "value"), lambda text: F.when(text.isNotNull(), named(text)))


def _listed(m: Column, name: str, prefix: Column, own_id: bool = False) -> Column:
    """Spans of a list; positions count blank entries, which are dropped."""
    opened = F.transform(_list(m, name), _open)
    return F.filter(F.transform(opened, lambda x, i: _span(x, F.concat(prefix, F.lit(":"), i.cast("string")), own_id)), lambda s: s.isNotNull())


def first_by(items: Column, key: str) -> Column:
    """The first element of each key, in order."""
    among = lambda xs, keys: F.filter(xs, lambda s, i: F.array_position(keys, s[key]) == i + 1)
    return T.once(items, lambda xs: T.once(F.transform(xs, lambda s: s[key]), lambda keys: among(xs, keys)))


def ocr_spans(v: Column) -> Column:
    """Spans, words, lines and per-page lines and words of one OCR entry; of equal ids the first stays, so words of a page that collide with its lines are lost."""

    def page(p: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("ocr_page"), i.cast("string"))
        return F.concat(_listed(p, "lines", prefix), _listed(p, "words", prefix))

    def spans(m: Column) -> Column:
        pages = F.transform(F.transform(_list(m, "recognitionResults"), _open), page)
        words, lines = (_listed(m, name, F.lit(prefix)) for name, prefix in (("words", "ocr_word"), ("lines", "ocr_line")))
        return F.concat(_listed(m, "ocr_spans", F.lit("ocr_span"), True), words, lines, F.flatten(pages))

    return first_by(T.once(_open(v), spans), "span_id")


def ocr_lookup(files: DataFrame) -> DataFrame:
    """(lookup_key, spans): every id or image name of an OCR entry; the last entry of a key wins."""
    rows = records(files, ("data", "ocr_results", "documents", "annotations")).withColumn("__m", _open("record"))
    names = ("questionId", "question_id", "id", "image", "image_filename", "document")
    keys = F.array_distinct(F.array_compact(F.array(*(any_of(F.col("__m"), n) for n in names))))
    keyed = rows.select("path", "pos", ocr_spans(F.col("record")).alias("spans"), F.explode_outer(keys).alias("lookup_key")).where("lookup_key is not null")
    return keyed.groupBy("lookup_key").agg(F.max_by("spans", F.struct("path", "pos")).alias("spans"))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _fallback_id(pos: Column) -> Column:
    return pos.cast("string")


def docvqa_manifest(files: DataFrame, ocr: DataFrame | None, image_root: str = "", split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, rejected) of document questions; spans are looked up by question id, then by image name."""
    return _accepted(docvqa_rows(files, ocr, image_root, split), _DOCVQA)


def docvqa_rows(files: DataFrame, ocr: DataFrame | None, image_root: str = "", split: str | None = None) -> DataFrame:
    """The rows of both tables of :func:`docvqa_manifest` in one, with their ``problem`` (null: accepted)."""
    rows = records(files, ("data", "dataset", "questions")).withColumn("__m", _open("record"))
    r = F.col("__m")
    answers = F.filter(F.transform(F.coalesce(_get(r, "answers", "array<string>"), F.array(_get(r, "answer"))), T.strip), lambda a: a != "")
    base = rows.select(
        F.coalesce(any_of(r, "questionId", "question_id", "id"), _fallback_id(F.col("pos"))).alias("question_id"),
        any_of(r, "image", "image_path", "image_filename", "document").alias("image_name"), any_of(r, "question").alias("question"), answers.alias("answers"),
        F.coalesce(F.lit(split), F.try_variant_get("payload", "$.split", "string"), _stem(F.col("path"))).alias("split"), "pos",
    )
    if ocr is None:
        base = base.withColumn("spans", F.array().cast("array<struct<span_id string, text string, normalized_text string, bbox array<double>, page int, tokens array<string>>>"))
    else:
        by_id, by_image = (ocr.select(F.col("lookup_key").alias(k), F.col("spans").alias(s)) for k, s in (("question_id", "__a"), ("image_name", "__b")))
        base = base.join(by_id, "question_id", "left").join(by_image, "image_name", "left").withColumn("spans", F.coalesce("__a", "__b")).drop("__a", "__b")
    base = base.withColumns(
        {
            "example_id": F.concat_ws("_", F.lit("docvqa"), "split", "question_id"), "benchmark": F.lit("docvqa"),
            "image_path": T.image_path(F.lit(image_root), F.col("image_name")), "answer": F.get("answers", F.lit(0)),
        }
    )
    return _marked(base)


_DOCVQA = ["question_id", "image_name", "answers", "split", "spans", "pos"]
_GQA = ["question_id", "image_id", "split", "objects", "pos"]
_WEB = ["source_id", "image_name", "elements", "verification_mode", "split", "group", "pos"]


def _marked(base: DataFrame) -> DataFrame:
    required = ("example_id", "image_path", "question", "answer")
    return base.withColumn("problem", F.coalesce(*(F.when(T.filled(F.col(c)).isNull(), F.lit(f"missing_{c}")) for c in required)))


def _accepted(marked: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    good = marked.where("problem is null").select("example_id", "benchmark", "image_path", "question", "answer", *extra)
    return good, marked.where("problem is not null").select("example_id", "problem")


def _attributes(m: Column) -> Column:
    many = _get(m, "attributes", "array<string>")
    one = T.filled(_get(m, "attributes"))
    return F.filter(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")), lambda a: T.filled(a).isNotNull())


def scene_objects(v: Column, raw: Column) -> Column:
    """Objects of a scene, given as a list or keyed by id in file order."""

    def one(o: Column, key: Column) -> Column:
        number = lambda *ns: F.coalesce(*(F.nullif(_get(o, n, "double"), F.lit(0.0)) for n in ns), F.lit(0.0))
        box = _get(o, "bbox", "array<double>")
        links = F.transform(
            F.transform(_list(o, "relations"), _open),
            lambda r: _fields(name=any_of(r, "name", "relation"), target_object_id=any_of(r, "object", "target", "object_id", "target_object_id")),
        )
        return _fields(
            object_id=F.coalesce(key, any_of(o, "object_id", "id")), name=F.coalesce(any_of(o, "name", "label"), F.lit("")),
            attributes=_attributes(o),
            bbox=F.coalesce(box, F.array(number("x"), number("y"), number("w", "width"), number("h", "height"))),
            relations=F.filter(links, lambda r: r["name"].isNotNull() & r["target_object_id"].isNotNull()))

    found = T.once(_open(v), lambda m: F.transform(_get(m, "objects", "array<variant>"), _open))
    listed = F.transform(found, lambda o, i: one(o, F.coalesce(any_of(o, "object_id", "id"), i.cast("string"))))
    entries = F.map_entries(F.from_json(F.get_json_object(raw, "$.objects"), "map<string,string>"))
    opened = F.transform(entries, lambda e: _fields(key=e["key"], m=_open(F.try_parse_json(e["value"]))))
    keyed = F.transform(opened, lambda e: one(e["m"], e["key"]))
    return F.coalesce(listed, keyed, F.array().cast("array<struct<object_id string, name string, attributes array<string>, bbox array<double>, relations array<struct<name string, target_object_id string>>>>"))


def scene_lookup(files: DataFrame) -> DataFrame:
    """(image_id, objects) of every scene, by its key, id or file name; also of a list under ``scenes``. The last scene of a key wins."""
    rows = records(files, ("scenes",)).withColumn("__m", _open("record"))
    r = F.col("__m")
    keys = F.array_distinct(F.array_compact(F.array("key", any_of(r, "image_id", "imageId", "id"), any_of(r, "image_filename"))))
    out = rows.select("path", "pos", scene_objects(F.col("record"), F.col("raw")).alias("objects"), F.explode_outer(keys).alias("image_id")).where("image_id is not null")
    return out.groupBy("image_id").agg(F.max_by("objects", F.struct("path", "pos")).alias("objects"))


def gqa_manifest(files: DataFrame, scenes: DataFrame | None, image_root: str = "", split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, rejected) of scene questions with the objects of their image."""
    return _accepted(gqa_rows(files, scenes, image_root, split), _GQA)


def gqa_rows(files: DataFrame, scenes: DataFrame | None, image_root: str = "", split: str | None = None) -> DataFrame:
    """The rows of both tables of :func:`gqa_manifest` in one, with their ``problem`` (null: accepted)."""
    rows = records(files, ("questions", "data")).withColumn("__m", _open("record"))
    r = F.col("__m")
    image = any_of(r, "imageId", "image_id", "image", "image_filename", "imageFilename")
    base = rows.select(
        F.coalesce(any_of(r, "questionId", "question_id", "id"), F.col("key"), _fallback_id(F.col("pos"))).alias("question_id"), image.alias("image_id"),
        any_of(r, "question").alias("question"), any_of(r, "answer", "fullAnswer").alias("answer"),
        F.coalesce(F.lit(split), F.try_variant_get("payload", "$.split", "string"), _stem(F.col("path"))).alias("split"), "pos",
    )
    base = base.withColumn("objects", F.lit(None).cast("string")) if scenes is None else base.join(scenes, "image_id", "left")
    base = base.withColumns(
        {
            "example_id": F.concat_ws("_", F.lit("gqa"), "split", "question_id"), "benchmark": F.lit("gqa"),
            "image_path": T.image_path(F.lit(image_root), T.image_name(F.col("image_id"))),
        }
    )
    return _marked(base)


def page_elements(v: Column) -> Column:
    """Elements of five list names, objects or plain values; a box or description alone makes one called ``target``.

    Elements without an id are named by their list and their place in it; blank
    plain values and nulls count for the place only.
    """

    def listed(m: Column, name: str) -> Column:
        def one(e: Column, i: Column) -> Column:
            made = F.concat(F.lit(f"{name}_"), i.cast("string"))
            o = e["m"]  # null for plain values
            text = F.coalesce(F.when(o.isNotNull(), any_of(o, "text", "label", "description", "elem_desc", "content")).otherwise(T.filled(e["plain"])), F.lit(""))
            element = lambda text: _fields(
                element_id=F.coalesce(any_of(o, "element_id", "elem_id", "id", "target_id"), made), text=text,
                normalized_text=T.normalize_text(text), bbox=_boxes(o), role=F.coalesce(any_of(o, "role", "type", "tag"), F.lit("")))
            return T.once(text, lambda text: F.when(o.isNotNull() | (text != ""), element(text)))

        opened = F.transform(_list(m, name), lambda e: _fields(m=_open(e), plain=F.try_variant_get(e, "$", "string")))
        return F.filter(F.transform(opened, one), lambda e: e.isNotNull())

    def elements(m: Column) -> Column:
        found = F.concat(*(listed(m, k) for k in ("elements", "candidate_elements", "page_elements", "ui_elements", "targets")))
        told = F.coalesce(any_of(m, "elem_desc", "element_description", "target_description"), F.lit(""))
        target = lambda told: _fields(element_id=F.lit("target"), text=told, normalized_text=T.normalize_text(told), bbox=_boxes(m), role=F.lit("target"))
        lone = lambda told: (told != "") | F.coalesce(F.schema_of_variant(m["bbox"]) != "VOID", F.lit(False))
        alone = T.once(told, lambda told: F.when(lone(told), F.array(target(told))))
        return T.once(found, lambda found: F.when(F.size(found) == 0, F.coalesce(alone, found)).otherwise(found))

    return T.once(_open(v), elements)


def web_manifest(files: DataFrame, image_root: str = "", split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, rejected) of page tasks; without elements only weak answers can be verified."""
    return _accepted(web_rows(files, image_root, split), _WEB)


def web_rows(files: DataFrame, image_root: str = "", split: str | None = None) -> DataFrame:
    """The rows of both tables of :func:`web_manifest` in one, with their ``problem`` (null: accepted)."""
    rows = records(files, ("data", "items", "examples"), grouped=True).withColumn("__m", _open("record"))
    r = F.col("__m")
    asked = any_of(r, "question", "instruction", "prompt", "query", "task")
    told = F.concat_ws(" on ", any_of(r, "task_type"), any_of(r, "website"))
    base = rows.select(
        F.coalesce(any_of(r, "id", "example_id", "question_id", "sample_id"), _fallback_id(F.col("pos"))).alias("source_id"),
        any_of(r, "image", "image_path", "image_filename", "screenshot", "screenshot_path", "file_name").alias("image_name"),
        F.coalesce(asked, F.nullif(told, F.lit(""))).alias("question"), any_of(r, "answer", "target_action", "action", "label", "target").alias("answer"),
        page_elements(F.col("record")).alias("elements"), F.coalesce(F.lit(split), F.try_variant_get("payload", "$.split", "string"), _stem(F.col("path"))).alias("split"), F.col("key").alias("group"), "pos",
    )
    base = base.withColumns(
        {
            "example_id": F.concat_ws("_", F.lit("visualwebbench"), "split", "source_id"), "benchmark": F.lit("visualwebbench"),
            "image_path": T.image_path(F.lit(image_root), F.col("image_name")),
            "verification_mode": F.when(F.size("elements") > 0, "element").otherwise("weak_answer"),
        }
    )
    return _marked(base)


def strict(manifest: DataFrame, rejected: DataFrame) -> DataFrame:
    """The manifest, or an error if anything was rejected."""
    bad = rejected.first()
    if bad:
        raise ValueError(f"{bad['example_id']}: {bad['problem']}")
    return manifest


def build_manifests(splits: dict[str, tuple[DataFrame, DataFrame]], limits: dict[str, int] | None = None, optional: tuple[str, ...] = ("val",)) -> dict[str, DataFrame]:
    """Manifests by split from (manifest, rejected) pairs.

    A rejected row is an error, but leaves an ``optional`` split empty: test sets
    often have no answers. A limit keeps a split's first rows in the order of its file.
    """
    out = {}
    for split, (manifest, rejected) in splits.items():
        if split in optional and rejected.first():
            manifest = manifest.limit(0)
        else:
            manifest = strict(manifest, rejected)
        limit = (limits or {}).get(split)
        out[split] = manifest.orderBy("pos").limit(limit) if limit else manifest
    return out
