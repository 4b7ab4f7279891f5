"""Sampling of mutants, random adequate test sets, and dominated test sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.text import safe
from ..session import cut_lineage

HASH_BUCKET_DIGITS = 3


def hashed(seed: str | Column, *parts: Column | str) -> Column:
    """Repeatable random order: equal inputs give equal positions on every run."""
    first = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.md5(F.concat_ws(":", first, *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def hash_uniform(seed: str, *parts: Column | str) -> Column:
    """Number in [0, 1) from the first eight hex digits of the hash."""
    digits = F.substring(hashed(seed, *parts), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**32))


def exact_sample(df: DataFrame, keys: list[str], id_column: str, share: float, seed: str) -> DataFrame:
    """Exactly floor(n x share + 0.5) rows per group, chosen by hash.

    Hash prefixes split every group into buckets. Bucket counts tell which
    buckets are in as a whole; only the bucket at the border is ranked.
    """
    group = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    hashed_rows = base.withColumn("_h", hashed(seed, id_column)).withColumn("_b", F.substring("_h", 1, HASH_BUCKET_DIGITS))
    counts = hashed_rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    plan = counts.select(
        *group,
        "_b",
        "_n",
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.floor(F.sum("_n").over(W.partitionBy(*group)) * F.lit(share) + F.lit(0.5)).alias("_need"),
    ).filter(F.col("_before") < F.col("_need"))
    whole = F.col("_before") + F.col("_n") <= F.col("_need")
    sure = hashed_rows.join(plan.filter(whole).select(*group, "_b"), [*group, "_b"], "left_semi")
    inside = W.partitionBy(*group, "_b").orderBy("_h", id_column)
    ranked = hashed_rows.join(plan.filter(~whole), [*group, "_b"]).withColumn("_r", F.row_number().over(inside))
    border = ranked.filter(F.col("_before") + F.col("_r") <= F.col("_need"))
    return sure.select(*df.columns).unionByName(border.select(*df.columns))


def without_marked(kills: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Kills of mutants without a mark: one that is judged (y, n) or doubtful (?) needs no test."""
    marked = marks.filter(F.lower(safe("mark")).isin(fixed.MUTANT_MARKS))
    return kills.join(marked.select(*keys, "mutant"), [*keys, "mutant"], "left_anti")


def adequate_sets(kills: DataFrame, keys: list[str], trials: int, seed: str = "cover") -> DataFrame:
    """One random adequate test set per trial and group.

    The reference order is sequential: take mutants in random order, and for each
    one that is not covered yet pick a random test that kills it. Here all
    mutants decide at once, round by round, with the same result: a mutant's
    pick is settled as soon as no earlier undecided mutant could pick a test
    that kills it. The number of rounds grows with the longest such chain, about
    the logarithm of the mutants. ``kills`` holds (keys, mutant, test) pairs.
    """
    edges = kills.select(*keys, "mutant", "test").distinct()
    scope = ["trial", *keys]
    node = [*scope, "mutant"]
    # number of trials is a parameter: one copy of the matrix per trial, as in repeated runs
    pending = (
        edges.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
        .withColumn("prio", F.concat_ws(":", hashed(seed, "trial", "mutant"), F.col("mutant").cast("string")))
        .withColumn("_t", F.concat_ws(":", hashed(seed, "trial", "mutant", "test"), F.col("test").cast("string")))
    )
    choice = pending.groupBy(*node).agg(F.min_by("test", "_t").alias("choice"))
    pending = cut_lineage(pending.drop("_t").join(choice, node))
    picked = None
    while not pending.isEmpty():
        wanted = pending.groupBy(*scope, F.col("choice").alias("test")).agg(F.min("prio").alias("_p"))
        earliest = pending.join(wanted, [*scope, "test"]).groupBy(*node, "prio", "choice").agg(F.min("_p").alias("_p"))
        settled = earliest.filter(F.col("_p") == F.col("prio")).select(*node, "prio", F.col("choice").alias("test"))
        settled = cut_lineage(settled)
        picked = settled if picked is None else picked.unionByName(settled)
        rule = settled.groupBy(*scope, "test").agg(F.min("prio").alias("_s"))
        covered = pending.join(rule, [*scope, "test"]).filter(F.col("_s") <= F.col("prio")).select(*node).distinct()
        pending = cut_lineage(pending.join(covered, node, "left_anti"))
    if picked is None:
        return edges.select(F.lit(0).alias("trial"), *keys, "mutant", "test").limit(0)
    return picked.select("trial", *keys, "mutant", "test")


def minimal_sets(sets: DataFrame) -> DataFrame:
    """Sets that do not strictly contain another set; equal sets stay once.

    A set can only contain another one if it holds that one's rarest test, so
    candidates meet on that test instead of every pair. The number of sets is
    the number of trials.
    """
    members = sets.select("set_id", "test").distinct()
    frequency = members.groupBy("test").agg(F.count(F.lit(1)).alias("_f"))
    described = (
        members.join(frequency, "test")
        .groupBy("set_id")
        .agg(F.array_sort(F.collect_set("test")).alias("tests"), F.min_by("test", F.struct("_f", "test")).alias("rarest"))
    )
    unique = described.groupBy("tests").agg(F.min("set_id").alias("set_id"), F.min("rarest").alias("rarest"))
    small = unique.select(F.col("rarest").alias("test"), F.col("tests").alias("_inner"))
    large = unique.select("set_id", "tests", F.explode("tests").alias("test"))
    dominated = (
        large.join(small, "test")
        .filter((F.size("tests") > F.size("_inner")) & (F.size(F.array_except("_inner", "tests")) == 0))
        .select("set_id")
    )
    return unique.join(dominated, "set_id", "left_anti").select("set_id", "tests")
