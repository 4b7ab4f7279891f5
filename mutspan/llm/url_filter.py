"""URL filter: explicit rules first, then a path-template tree per host.

The tree is grown level by level over all urls: below each (host, template) a
segment of MIN_ROWS rows or more stays as it is, all others become a wildcard
that keeps their file suffix. Branches then merge, deepest position
first: a template whose rate of bad labels does not differ from the pool of its
siblings joins the pool's template. A template is rejected where its share of
bad labels, smoothed towards the host's and that towards the corpus', reaches
the threshold; a template without labels is allowed.

Counts are aggregated before they meet, and small tables join the rows with a
salt, so that a host with a third of all rows is spread over many tasks.

Defined cases: a null url, or one without `://`, has empty host and path and is
allowed; labels may be null (unlabelled); repeated rows are judged alike and
count each; segments beyond MAX_DEPTH stay together as the last one; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutspan.llm.common import LOWER, UPPER, staged

MAX_DEPTH = 8
MIN_ROWS = 5
SIMILAR_Z = 2.0
SMOOTHING = 10.0
THRESHOLD = 0.5
SALTS = 32

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_order(rule: Rule) -> tuple:
    verdict, host, path = rule
    return (-len(host + path), -len(host), verdict != "block", host + path)


def matching_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits host and path; a list of rules is a parameter."""
    fits = lambda host, path: ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
    ordered = sorted(rules, key=rule_order)
    nothing = F.lit(None).cast("string")
    text = functools.reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.lit(r[1] + r[2])).otherwise(rest), reversed(ordered), nothing)
    verdict = functools.reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.lit(r[0])).otherwise(rest), reversed(ordered), nothing)
    return text, verdict


def wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z0-9]{1,5})$", 1))


def with_template(urls: DataFrame) -> DataFrame:
    """Adds `template`, an array of segments, to rows with host and path."""
    cells = F.split(F.replace(F.substr("path", F.lit(2)), F.lit("*"), F.lit("%2A")), "/", -1)
    tail = F.array_join(F.slice("cells", MAX_DEPTH, F.greatest(F.size("cells") - MAX_DEPTH + 1, F.lit(1))), "/")
    cut = F.when(F.size("cells") > MAX_DEPTH, F.concat(F.slice("cells", 1, MAX_DEPTH - 1), F.array(tail))).otherwise(F.col("cells"))
    rows = urls.withColumn("cells", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(cells)).withColumn("cells", cut)
    rows = staged(rows.withColumn("template", F.array().cast("array<string>")).withColumn("salt", F.expr(f"pmod(xxhash64(page_id, path), {SALTS})").cast("int")), "urls")
    depth = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    for d in range(depth):
        rows = rows.withColumn("segment", F.get("cells", F.lit(d)))
        here = rows.where(F.col("segment").isNotNull())
        counts = here.groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n"))
        literal = counts.where(F.col("n") >= MIN_ROWS).select("host", "template", "segment", F.lit(True).alias("stays"))
        met = salted_join(rows, literal, ["host", "template", "segment"])
        kept = F.when(F.col("stays"), F.col("segment")).otherwise(wildcard(F.col("segment")))
        grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.array(kept)))
        rows = staged(met.withColumn("template", grown).drop("segment", "stays"), "urls")
    return rows.drop("cells")


def salted_join(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join of salted rows with one row per key, copied to the salts that the key's rows have."""
    salts = rows.groupBy(*on).agg(F.collect_set("salt").alias("salt"))
    copies = small.join(salts, on).withColumn("salt", F.explode("salt"))
    return rows.join(copies, [*on, "salt"], "left")


def salted(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("salt", F.expr(f"pmod(xxhash64({key}), {SALTS})").cast("int"))


def verdicts(rows: DataFrame) -> DataFrame:
    """(host, template, merged, bad_rate, verdict) per template of rows with host, template and bad (0, 1 or null)."""
    leaves = staged(
        rows.groupBy("host", "template").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "templates"
    )
    corpus = leaves.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.max(F.size("template")).alias("depth")).first()
    prior = (corpus["bad"] / corpus["labelled"]) if corpus["labelled"] else 0.0
    tree = salted(leaves.withColumn("merged", F.col("template")), "template")
    sums = lambda rows, key, n, bad: rows.groupBy("host", key).agg(F.sum("labelled").alias(n), F.sum("bad").alias(bad))
    for d in range((corpus["depth"] or 0) - 1, -1, -1):
        pooled = F.transform("merged", lambda s, i: F.when(i == d, F.lit("*")).otherwise(s))  # noqa: B023
        groups = sums(tree.where(F.size("merged") > d), "merged", "labelled", "bad").withColumn("pooled", pooled)
        met = salted_join(salted(groups, "merged"), sums(groups, "pooled", "pn", "pb"), ["host", "pooled"])
        rate = F.col("pb") / F.greatest("pn", F.lit(1))
        gap = F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - rate)
        noise = SIMILAR_Z * F.sqrt(rate * (1 - rate) / F.greatest("labelled", F.lit(1)))
        similar = (F.col("labelled") == 0) | (gap <= noise)
        joins = met.where(similar).select("host", "merged", F.col("pooled").alias("joins"))
        tree = staged(salted_join(tree, joins, ["host", "merged"]).withColumn("merged", F.coalesce("joins", "merged")).drop("joins"), "templates")
    smoothed = lambda bad, n, towards: (bad + SMOOTHING * towards) / (n + SMOOTHING)
    hosts = tree.groupBy("host").agg(smoothed(F.sum("bad"), F.sum("labelled"), F.lit(prior)).alias("host_rate"))
    judged = salted_join(salted(sums(tree, "merged", "n", "b"), "merged"), hosts, ["host"])
    judged = judged.withColumn("bad_rate", smoothed(F.col("b"), F.col("n"), F.col("host_rate"))).drop("salt")
    judged = salted_join(tree, judged, ["host", "merged"])
    return judged.select("host", "template", "merged", "bad_rate", F.when((F.col("n") > 0) & (F.col("bad_rate") >= THRESHOLD), "block").otherwise("allow").alias("judged"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_rate) for pages (page_id, url, bad)."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad"))
    urls = urls.fillna("", ["host", "path"])
    rows = with_template(urls)
    met = salted_join(rows, verdicts(rows), ["host", "template"])
    text, verdict = matching_rule(rules)
    known = F.when(F.col("host") == "", F.lit("allow")).otherwise(F.coalesce("judged", F.lit("allow")))
    return met.select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, known).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "bad_rate",
    )

