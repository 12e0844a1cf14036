"""URL filter: a tree of path templates per host, judged by the labels that rules give.

Going down the path, the segments below one template become a wildcard where they are numbers
or hold many values for the rows; literal branches whose block rates do not differ from their
siblings' by a two-proportion test, or that have no labels to differ by, are merged into one.
A template's share of blocked is smoothed towards that of the template above it, and so on up
to the host and all urls: a template with few labels of its own is judged by its neighbours. It
is rejected when the smoothed share is high.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predlens.session import durable

ANY, MERGED, END = "*", "~", ""
NUMBER = "^[0-9]+([.][a-z]+)?$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class TemplateTree:
    """A parent's segments are variable from ``values`` distinct ones on, if they make up at least
    the share ``variety`` of its rows. ``z``: largest statistic of branches that count as
    similar. ``strength`` labelled urls at the smoothed share of the template above are added to a
    template's own; it is rejected from the share ``reject`` of blocked urls on.
    """

    values: int = 8
    variety: float = 0.2
    z: float = 1.96
    strength: float = 5.0
    reject: float = 0.8


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host and path; both empty where the url is NULL or has no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.expr(f"substr(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.regexp_replace(rest, "^[^/?#]*", "")
    return df.withColumns(
        {
            "host": F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
            "path": F.regexp_extract(after, "^[^?#]*", 0),
        }
    )


def _rule(rules: tuple[Rule, ...], value) -> Column:
    """Of the rules that fit, the longest one's value."""

    def fits(rule: Rule) -> Column:
        host = F.col("host")
        return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)

    longest = sorted(rules, key=lambda rule: (-len(rule.text), rule.text))
    return F.coalesce(*[F.when(fits(rule), F.lit(value(rule))) for rule in longest])


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, tree: TemplateTree = TemplateTree()) -> DataFrame:
    """One row per page: host, path, rule, verdict, template, labelled urls of the template, purity.

    The urls that a rule decides are the labels. A url no rule decides is blocked where its
    host has labels and its template's purity, smoothed up the whole path, reaches
    ``tree.reject``. A host without labels has the overall share as its purity, and is allowed:
    other hosts do not judge it. Every segment of the path counts, at any depth; a segment that
    reads ``*`` or ``~`` is taken as a wildcard. NULL and malformed urls belong to the empty host;
    repeated rows count as often as they occur. Reads page_id and url.
    """
    parts = url_parts(pages.select("page_id", "url"))
    segments = F.filter(F.split("path", "/"), lambda s: s != END)
    blocked = _rule(rules, lambda rule: int(rule.verdict == "block"))
    rows = durable(
        parts.select(
            "page_id", "host", "path", _rule(rules, lambda rule: rule.text).alias("rule"), blocked.alias("blocked"),
            F.transform(segments, lambda s: F.when(s.rlike(NUMBER), ANY).otherwise(s)).alias("segments"),
        ),
        "urls",
    )
    paths = rows.groupBy("host", "segments").agg(F.count("*").alias("n"), *_labels(F.col("blocked")))
    judged = _templates(durable(paths, "paths"), tree)
    own = F.when(F.col("known") & (F.round("purity", 9) >= tree.reject), "block").otherwise("allow")
    return rows.join(judged, ["host", "segments"]).select(
        "page_id", "host", "path", "rule",
        F.when(F.col("blocked") == 1, "block").when(F.col("blocked") == 0, "allow").otherwise(own).alias("verdict"),
        "template", "labelled", "purity",
    )


def _labels(blocked: Column) -> list[Column]:
    return [F.count(blocked).alias("labelled"), F.coalesce(F.sum(blocked), F.lit(0)).alias("b")]


def _sums(*names: str) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def _templates(paths: DataFrame, tree: TemplateTree) -> DataFrame:
    """(host, segments, known, template, labelled, purity) of distinct paths with the counts n, labelled and b.

    One step per level of the tree, over the paths that still part there: where a template has a
    single path left, nothing below it can be generalised and the path is finished at once.
    """
    hosts = paths.groupBy("host").agg(*_sums("labelled", "b"))
    total = hosts.agg(*_sums("labelled", "b")).first()
    overall = total["b"] / total["labelled"] if total["labelled"] else 0.0
    roots = hosts.select("host", (F.col("labelled") > 0).alias("known"), _smoothed(tree, F.lit(overall)).alias("purity"))
    left = paths.join(roots, "host").withColumns({"template": F.col("host"), "rest": F.col("segments")})
    result = ["host", "segments", "known", "template", "labelled", "purity"]
    finished = []
    while True:
        step = durable(_descended(left, tree), "level")
        finished.append(step.where("done").select(*result[:4], F.col("node_labelled").alias("labelled"), "purity"))
        left = step.where("not done").drop("done", "node_labelled")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished)


def _smoothed(tree: TemplateTree, above: Column) -> Column:
    return (F.col("b") + F.lit(tree.strength) * above) / (F.col("labelled") + F.lit(tree.strength))


def _descended(left: DataFrame, tree: TemplateTree) -> DataFrame:
    """``left`` one segment further down: template and purity there, the rest of the path, whether it is done."""
    left = left.withColumn("own", F.coalesce(F.get("rest", F.lit(0)), F.lit(END)))
    mark = F.xxhash64("rest")
    children = durable(
        left.groupBy("template", "own").agg(
            *_sums("n", "labelled", "b"), F.max("purity").alias("purity"), F.min(mark).alias("low"), F.max(mark).alias("high")
        ),
        "branches",
    )
    literal = ~F.col("own").isin(ANY, END)
    above = children.groupBy("template").agg(
        F.count(F.when(literal, 1)).alias("values"), F.coalesce(F.sum(F.when(literal, F.col("n"))), F.lit(0)).alias("literal_n"),
        F.sum("labelled").alias("all_labelled"), F.sum("b").alias("all_b"), (F.min("low") == F.max("high")).alias("single"),
    )
    variable = (F.col("values") >= tree.values) & (F.col("values") >= tree.variety * F.col("literal_n"))
    segment = F.when(literal & variable, ANY).when(literal & _similar(tree.z), MERGED).otherwise(F.col("own"))
    branches = children.join(above, "template").withColumn("segment", segment)
    nodes = branches.groupBy("template", "segment").agg(*_sums("labelled", "b"), F.max("purity").alias("above"))
    nodes = nodes.select("template", "segment", F.col("labelled").alias("node_labelled"), _smoothed(tree, F.col("above")).alias("node_purity"))
    found = branches.select("template", "own", "segment", "single", "all_labelled", "all_b").join(nodes, ["template", "segment"])

    # A single path's labels are smoothed once per segment and once for its end: a geometric series.
    share = F.coalesce(F.col("all_b") / F.nullif(F.col("all_labelled"), F.lit(0)), F.col("purity"))
    shrunk = F.pow(F.lit(tree.strength) / (F.lit(tree.strength) + F.col("all_labelled")), F.size("rest") + 1)
    done = F.col("single") | (F.col("own") == END)
    return left.join(found, ["template", "own"]).select(
        "host", "segments", "known", "n", "labelled", "b",
        F.when(F.col("single"), F.concat_ws("/", "template", "rest"))
        .when(F.col("own") == END, F.col("template")).otherwise(F.concat_ws("/", "template", "segment")).alias("template"),
        F.when(F.col("single"), share + (F.col("purity") - share) * shrunk).otherwise(F.col("node_purity")).alias("purity"),
        F.when(done, F.array().cast("array<string>")).otherwise(F.slice("rest", F.lit(2), F.size("rest"))).alias("rest"),
        F.when(F.col("single"), F.col("all_labelled")).otherwise(F.col("node_labelled")).alias("node_labelled"), done.alias("done"),
    )


def _similar(most: float) -> Column:
    """Whether a branch's block rate is like that of its siblings together, or it has no labels and they have."""
    n, b = F.col("labelled"), F.col("b")
    rest, rest_b = F.col("all_labelled") - n, F.col("all_b") - b
    pooled = F.col("all_b") / F.nullif(F.col("all_labelled"), F.lit(0))
    variance = pooled * (1 - pooled) * (F.lit(1.0) / F.nullif(n, F.lit(0)) + F.lit(1.0) / F.nullif(rest, F.lit(0)))
    gap = b / F.nullif(n, F.lit(0)) - rest_b / F.nullif(rest, F.lit(0))
    return (rest > 0) & ((n == 0) | (variance == 0) | (gap * gap <= F.lit(most * most) * variance))


def sql_judged(rules: tuple[Rule, ...] = RULES, tree: TemplateTree = TemplateTree()) -> str:
    """The same judgement as one SQL statement over ``pages``."""
    longest = sorted(rules, key=lambda rule: (-len(rule.text), rule.text))
    fits = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in longest
    ]
    rule = "CASE " + " ".join(f"WHEN {test} THEN '{r.text}'" for test, r in fits) + " END"
    blocked = "CASE " + " ".join(f"WHEN {test} THEN {int(r.verdict == 'block')}" for test, r in fits) + " END"
    literal = "s NOT IN ('*', '')"
    return f"""WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
      named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
        regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
      marked AS (SELECT page_id, host, path, {rule} AS rule, {blocked} AS blocked,
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '{NUMBER}') THEN '*' ELSE x END) AS seg
        FROM named),
      o AS (SELECT COALESCE(AVG(blocked), 0) AS p FROM marked),
      rooted AS (SELECT marked.*, p, COUNT(blocked) OVER w AS l, COALESCE(SUM(blocked) OVER w, 0) AS b FROM marked, o WINDOW w AS (PARTITION BY host)),
      walk AS (
        SELECT page_id, host, path, rule, blocked, seg, 0 AS level, host AS template, l AS labelled, l > 0 AS known,
          (b + {tree.strength} * p) / (l + {tree.strength}) AS purity, false AS done FROM rooted
        UNION ALL
        SELECT page_id, host, path, rule, blocked, seg, level + 1, CASE WHEN s = '' THEN template ELSE template || '/' || m END,
          COUNT(blocked) OVER w, known, (COALESCE(SUM(blocked) OVER w, 0) + {tree.strength} * purity) / (COUNT(blocked) OVER w + {tree.strength}), s = ''
        FROM (SELECT *, CASE WHEN NOT {literal} THEN s WHEN v >= {tree.values} AND v >= {tree.variety} * ln THEN '*'
            WHEN al > l AND (l = 0 OR ab = 0 OR ab = al OR
              pow(b / l - (ab - b) / (al - l), 2) <= {tree.z * tree.z} * (ab / al) * (1 - ab / al) * (1.0 / l + 1.0 / (al - l))) THEN '~'
            ELSE s END AS m
          FROM (SELECT *, COUNT(DISTINCT CASE WHEN {literal} THEN s END) OVER t AS v, COUNT(CASE WHEN {literal} THEN 1 END) OVER t AS ln,
              COUNT(blocked) OVER t AS al, COALESCE(SUM(blocked) OVER t, 0) AS ab, COUNT(blocked) OVER c AS l, COALESCE(SUM(blocked) OVER c, 0) AS b
            FROM (SELECT *, COALESCE(seg[level + 1], '') AS s FROM walk WHERE NOT done)
            WINDOW t AS (PARTITION BY template), c AS (PARTITION BY template, s)))
        WINDOW w AS (PARTITION BY template, m))
      SELECT page_id, host, path, rule, CASE blocked WHEN 1 THEN 'block' WHEN 0 THEN 'allow'
          ELSE CASE WHEN known AND round(purity, 9) >= {tree.reject} THEN 'block' ELSE 'allow' END END AS verdict,
        template, labelled, round(purity, 9) AS purity
      FROM walk WHERE done"""
