"""Operator 5: URL filter with a path-template tree for each host.

Urls are counted as distinct (host, path) first, so a hot host is as large as its different paths.
The tree grows level by level, one pair of aggregations and one equi-join for each of ``DEPTH``
levels; what lies deeper is one last segment. At a level the children of a node (host, template so
far) are its distinct segments. Generalise: a segment that looks like an identifier (has a digit) or
has less than ``SUPPORT`` urls becomes a wildcard. Merge: a literal child whose share of bad labels is
statistically like that of its node (two-proportion z below ``Z``), or that has no label, joins the
wildcard. Judge: a template's purity is its share of bad labels, smoothed by ``PRIOR`` urls of its
parent's purity; templates above ``REJECT`` are blocked. Since hosts without labels exist, the parent
of a host's template is the urls of all hosts that start with the same segment, and theirs all urls.

Defined results: a url that is null or has no ``://`` has empty host and path and is judged like any
other; rules are exact and win over the tree; an empty table gives an empty result; repeated rows and
null ids give one row each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import stage, table
from tremor.llm.registry import query

#: (verdict, rule): host and its subdomains, then what the path starts with.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH = 6
SUPPORT = 5
Z = 1.96
PRIOR = 2.0
REJECT = 0.5
WILD = "*"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    """Segments of a path; those from DEPTH on are one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    tail = F.array_join(F.slice(parts, DEPTH, 1 << 20), "/")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(tail))).otherwise(parts)


def _lead() -> Column:
    """First segment of a path, identifiers as a wildcard."""
    first = F.element_at("segments", 1)
    return F.when(F.size("segments") == 0, F.lit("")).when(first.rlike("[0-9]"), F.lit(WILD)).otherwise(first)


def _level(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (host, template, segments, n, good, bad) with the k-th segment added to the template."""
    seg = F.element_at("segments", k)
    here = rows.where(F.size("segments") >= k).select("host", "template", seg.alias("seg"), "n", "good", "bad")
    child = here.groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    node = child.groupBy("host", "template").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    both = child.join(node, ["host", "template"])
    a, b = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
    told = (a > 0) & (b > 0) & (F.col("all_bad") > 0) & (F.col("all_good") > 0)
    pooled = F.col("all_bad") / F.when(told, a + b)
    z = F.abs(F.col("bad") / F.when(told, a) - (F.col("all_bad") - F.col("bad")) / F.when(told, b)) / F.sqrt(pooled * (1 - pooled) * (1 / F.when(told, a) + 1 / F.when(told, b)))
    literal = ~F.col("seg").rlike("[0-9]") & (F.col("n") >= SUPPORT) & F.coalesce(z >= Z, F.lit(False))
    kept = both.where(literal).select("host", "template", F.col("seg").alias("kept"))
    # only few children stay literal, so the join back is small on one side
    rows = rows.withColumn("seg", F.when(F.size("segments") >= k, seg))
    met = rows.join(kept.withColumnsRenamed({"host": "h", "template": "t"}), (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("seg") == F.col("kept")), "left")
    step = F.when(F.col("seg").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("kept", F.lit(WILD))))
    return met.select("host", "path", "segments", "n", "good", "bad", F.concat("template", step).alias("template"))


def templates(labelled: DataFrame) -> DataFrame:
    """(host, path, template) of a table (host, path, good, bad): url and label counts of each row."""
    grouped = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    rows = stage(grouped.select("host", "path", _segments(F.col("path")).alias("segments"), "n", "good", "bad", F.lit("").alias("template")), "url-paths")
    for k in range(1, DEPTH + 1):
        if k > 1 and not rows.where(F.size("segments") >= k).take(1):
            break
        rows = stage(_level(rows, k), "url-level")
    return rows.select("host", "path", "template", "n", "good", "bad", "segments")


def purity(rows: DataFrame) -> DataFrame:
    """(host, template, purity): smoothed share of bad labels of each template.

    A template of a host leans on the urls of all hosts with the same first literal-looking segment,
    and those on all urls.
    """
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    led = rows.withColumn("lead", _lead())
    total = rows.agg(*sums).select(((F.coalesce("bad", F.lit(0)) + PRIOR / 2) / (F.coalesce(F.col("good") + F.col("bad"), F.lit(0)) + PRIOR)).alias("p")).first()["p"]
    over = led.groupBy("lead").agg(*sums).select("lead", ((F.col("bad") + PRIOR * F.lit(total)) / (F.col("good") + F.col("bad") + PRIOR)).alias("over"))
    own = led.groupBy("host", "template", "lead").agg(*sums).join(over, "lead")
    return own.select("host", "template", "lead", ((F.col("bad") + PRIOR * F.col("over")) / (F.col("good") + F.col("bad") + PRIOR)).alias("purity"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity); urls that a rule decides are the labels."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules))
    bad = F.coalesce(F.col("decided.verdict") == "block", F.lit(False))
    labelled = rows.select("host", "path", (F.col("decided").isNotNull() & ~bad).cast("long").alias("good"), bad.cast("long").alias("bad"))
    tree = stage(templates(labelled), "url-templates")
    judged = tree.withColumn("lead", _lead()).join(purity(tree), ["host", "template", "lead"]).select(F.col("host").alias("h"), F.col("path").alias("p"), "template", "purity")
    done = rows.join(judged, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    method = F.when(F.col("purity") > REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return done.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce(F.col("decided.verdict"), method).alias("verdict"), "template", "purity")


@query("op5_url_tree")
def op5_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
