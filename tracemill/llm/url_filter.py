"""URL verdicts from rules and from a learned tree of path templates.

Rules on host and path prefix come first. For the rest, the paths of each host
form a tree: segments that vary (ids, long slugs, rare children of wide
branches) become wildcards; siblings whose labelled share of bad pages does not
differ from their branch's merge, those without labels among them. The purity of
a node is its labelled share of bad pages, smoothed towards the purity of its
branch, the host's towards that of all pages; so a template without labels is
judged by its nearest labelled ancestor. A template is rejected if its purity is
high. Labels are given, or the verdicts of the rules.

The tree is learned on one row per host and path shape, pre-aggregated before
any shuffle, level by level with plain joins and aggregations; each level is
staged, so the plan grows with the levels and not with their power. The last
level holds all that is left of a path, however deep.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.staging import stage

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: segments that are ids, hashes or slugs by their looks
VARIABLE = r"[0-9]{3,}|^[0-9]+$|^[0-9a-f]{8,}$|^.{25,}$"


@dataclass(frozen=True)
class TemplateParams:
    #: levels of the tree; what lies deeper is one segment of the last level
    depth: int = 6
    #: a branch with more children is wide; children below this share of a wide branch are variable
    wide: int = 32
    rare_share: float = 0.05
    #: labelled shares within so many standard errors, plus the margin, are alike
    z: float = 1.96
    margin: float = 0.05
    #: weight of the branch's purity, and the purity that rejects
    prior_weight: float = 4.0
    reject_at: float = 0.8


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns({"host": ascii_lower(F.regexp_extract(url, HOST, 1)), "path": F.regexp_extract(url, PATH, 1)})


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest of ``rules`` (verdict, "host/path") that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(((t, v) for v, t in rules), key=lambda r: len(r[0])):
        rule_host, slash, rest = name.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(text)).otherwise(verdict)
    return rule, verdict


def learn_templates(shapes: DataFrame, overall: float, p: TemplateParams) -> DataFrame:
    """``shapes`` (host, o1..oN, n, labelled, bad) with the template s1..sN of each shape and its purity."""
    levels = [f"s{d}" for d in range(1, p.depth + 1)]
    smoothed = (F.col("t_bad") + p.prior_weight * F.col("purity")) / (F.col("t_labelled") + p.prior_weight)
    tree = shapes.withColumns({s: F.col("o" + s[1:]) for s in levels})
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad")).withColumn("purity", F.lit(float(overall)))
    tree = stage(tree.join(hosts.select("host", smoothed.alias("purity")), "host"), "url-tree")
    for d, seg in enumerate(levels):
        above = ["host", *levels[:d]]
        child = tree.groupBy(*above, seg).agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), F.max("purity").alias("purity"))
        parent = child.groupBy(*above).agg(
            F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
        )
        share, all_share = F.try_divide("bad", "labelled"), F.try_divide("all_bad", "all_labelled")
        alike = F.abs(share - all_share) <= p.z * F.sqrt(all_share * (1 - all_share) / F.col("labelled")) + p.margin
        new = (
            F.when(F.col(seg).isin("", "*"), F.col(seg))
            .when((F.col("children") > p.wide) & (F.col("n") < p.rare_share * F.col("all_n")), "*")
            .when((F.col("labelled") == 0) | alike, "~")
            .otherwise(F.col(seg))
        )
        moved = child.join(parent, above).withColumn("new", new)
        nodes = moved.groupBy(*above, "new").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad"), F.max("purity").alias("purity"))
        moved = moved.select(*above, seg, "new").join(nodes.select(*above, "new", smoothed.alias("own")), [*above, "new"])
        deeper = tree.join(moved, [*above, seg]).withColumns({seg: F.col("new"), "purity": F.col("own")}).drop("new", "own")
        tree = stage(deeper, "url-tree")
    return tree


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    labels: DataFrame | None = None,
    params: TemplateParams | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row.

    ``rules`` are (verdict, "host/path"); one fits its host and all subdomains
    if the path starts with its path, and the longest wins. ``labels`` (page_id,
    bad 0/1) teach the templates; without them the rules' verdicts do. Null urls
    and those without "://" have an empty host and path. Everything is allowed
    where nothing is labelled. Paths of any length are judged whole. Repeated
    rows are judged, and counted, each. Null ids are kept. Other columns are
    ignored; an empty table gives no rows.
    """
    p = params or TemplateParams()
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = with_host_and_path(base).drop("url")
    rule, rule_verdict = matching_rule(rules, F.col("host"), F.col("path"))
    segments = F.transform(F.split(F.ltrim(F.col("path"), F.lit("/")), "/"), lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))
    base = base.withColumns({"rule": rule, "rule_verdict": rule_verdict, "seg": segments})
    names = [f"o{d}" for d in range(1, p.depth + 1)]
    rest = F.array_join(F.slice("seg", p.depth, F.greatest(F.size("seg"), F.lit(1))), "/")
    base = base.withColumns({o: F.coalesce(F.get("seg", F.lit(d)) if d < p.depth - 1 else rest, F.lit("")) for d, o in enumerate(names)}).drop("seg")

    if labels is None:
        taught = base.withColumn("is_bad", F.when(F.col("rule").isNotNull(), (F.col("rule_verdict") == "block").cast("int")))
    else:
        known = labels.groupBy("page_id").agg(F.max("bad").cast("int").alias("is_bad"))
        taught = base.join(known, "page_id", "left")
    shapes = taught.groupBy("host", *names).agg(F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    shapes = stage(shapes, "url-shapes")
    overall = shapes.agg(F.try_divide(F.sum("bad"), F.sum("labelled"))).first()[0] or 0.0
    # the rejected shapes are few, and all others need no join partner
    rejected = learn_templates(shapes, overall, p).where(F.col("purity") >= p.reject_at).select("host", *names, F.lit(True).alias("rejected"))
    judged = base.join(rejected, ["host", *names], "left")
    verdict = F.coalesce("rule_verdict", F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def duckdb_sql(rules: list[tuple[str, str]], params: TemplateParams | None = None) -> str:
    """The same judgement, taught by the rules, as DuckDB SQL over the view ``pages``."""
    p = params or TemplateParams()
    rule, verdict = "NULL", "NULL"
    for name, text in sorted(((t, v) for v, t in rules), key=lambda r: len(r[0])):
        host, slash, rest = name.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{rest}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{name}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{text}' ELSE {verdict} END"
    o, s = ([f"{c}{d}" for d in range(1, p.depth + 1)] for c in "os")
    seg = f"list_transform(string_split(ltrim(path, '/'), '/'), lambda x: CASE WHEN regexp_matches(x, '{VARIABLE}') THEN '*' ELSE x END)"
    ctes = [
        "parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '" + HOST + "', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
        f"regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages)",
        f"cut AS (SELECT *, {seg} AS seg, {rule} AS rule, {verdict} AS rule_verdict FROM parsed)",
        "base AS (SELECT page_id, host, path, rule, rule_verdict, " + ", ".join(f"coalesce({f'seg[{d + 1}]' if d < p.depth - 1 else f"array_to_string(seg[{p.depth}:], '/')"}, '') AS {c}" for d, c in enumerate(o)) + " FROM cut)",
        f"shapes AS (SELECT host, {', '.join(o)}, count(*) AS n, count(rule) AS labelled, count(*) FILTER (rule_verdict = 'block') AS bad FROM base GROUP BY ALL)",
        "overall AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS overall FROM shapes)",
        "tree0 AS (SELECT shapes.*, " + ", ".join(f"{a} AS {b}" for a, b in zip(o, s)) + f", (sum(bad) OVER h + {p.prior_weight} * overall) / (sum(labelled) OVER h + {p.prior_weight}) AS purity "
        "FROM shapes, overall WINDOW h AS (PARTITION BY host))",
    ]
    for d, c in enumerate(s):
        above = ", ".join(["host", *s[:d]])
        ctes += [
            f"child{d} AS (SELECT {above}, {c}, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, max(purity) AS purity FROM tree{d} GROUP BY ALL)",
            f"wide{d} AS (SELECT *, count(*) OVER w AS children, sum(n) OVER w AS all_n, bad / nullif(labelled, 0) AS share, "
            f"sum(bad) OVER w / nullif(sum(labelled) OVER w, 0) AS all_share FROM child{d} WINDOW w AS (PARTITION BY {above}))",
            f"named{d} AS (SELECT {above}, {c}, labelled, bad, purity, CASE WHEN {c} IN ('', '*') THEN {c} WHEN children > {p.wide} AND n < {p.rare_share} * all_n THEN '*' "
            f"WHEN labelled = 0 OR abs(share - all_share) <= {p.z} * sqrt(all_share * (1 - all_share) / labelled) + {p.margin} THEN '~' ELSE {c} END AS new FROM wide{d})",
            f"moved{d} AS (SELECT {above}, {c}, new, (sum(bad) OVER w + {p.prior_weight} * purity) / (sum(labelled) OVER w + {p.prior_weight}) AS own FROM named{d} WINDOW w AS (PARTITION BY {above}, new))",
            f"tree{d + 1} AS (SELECT t.* REPLACE (new AS {c}, own AS purity) FROM tree{d} t JOIN moved{d} USING ({above}, {c}))",
        ]
    ctes += [f"verdicts AS (SELECT host, {', '.join(o)}, purity >= {p.reject_at} AS rejected FROM tree{p.depth})"]
    return (
        "WITH " + ", ".join(ctes) + " SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict "
        f"FROM base LEFT JOIN verdicts USING (host, {', '.join(o)})"
    )
