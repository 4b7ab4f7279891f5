"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share all
words; a target stops at `most` times the size of its source and the excess goes
to the others by weight. The level at which the open sources share is found from
grouped sums alone, one job a round, until no source is above its bound.

A source takes all its documents as often as its target holds them, and some of
them once more. Which lengths these have is fitted on the histogram of lengths:
each length first gives the same share of its documents, so that about `play`
words of the budget stay, and a bounded-knapsack table over these words then
picks the counts whose sum comes nearest to the budget. The table keeps, per sum, the
length that reached it first, so its memory grows with `play` and the longest
document, not with the source; a source whose budget is below `play` gets the
nearest sum that any choice gives.

Documents of a length are chosen by a seeded hash: whole hash buckets are in or
out, and only the border bucket of a length is ranked. Groups (source, length)
that hold more than a task's share of the rows are salted; there are fewer of
these than tasks.

Defined cases: a null or blank text has size 0 and is taken as 0 words; a null source is
a source of its own; a null doc_id is a value; rows equal in doc_id and text
are documents of their own and interchangeable; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutspan.llm.common import partitions, same_key_join, staged
from mutspan.operators.ordering import with_report_rows

WEIGHTS = (1, 2, 3)
MOST = 3
PLAY = 65_536  # words that the knapsack table decides on
BUCKET_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, h): words and a seeded hash of every document."""
    return docs.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
    )


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds `target` to rows (source, source_size), one per source."""
    placed = with_report_rows(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight.cast("decimal(38,0)")).withColumn("bound", (F.col("source_size") * most).cast("decimal(38,0)"))
    total, weighs = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return sources.withColumn("target", F.lit(None).cast("double"))
    level, full = (Decimal(total), weighs), 0
    while True:
        above = F.col("weight") * F.lit(level[0]) > F.col("bound") * F.lit(level[1])
        used, weighs, now = placed.agg(
            F.sum(F.when(above, F.col("bound")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)
        ).first()
        if now == full:  # a higher level only adds sources, so equal counts are equal sets
            break
        level, full = (total - used, weighs), now
    share = (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1]))
    return placed.withColumn("target", F.when(above, F.col("bound").cast("double")).otherwise(share)).select(*sources.columns, "target")


def fit(lengths: list[int], counts: list[int], budget: int, play: int = PLAY) -> list[int]:
    """How many documents of each length together come near to `budget` words.

    lengths ascend and are above 0; the budget is below all their words.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    spare = max(0, budget - play)
    taken = [c * spare // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken))
    for i in reversed(range(len(lengths))):
        if spare and left - lengths[i] >= play and taken[i] < counts[i]:
            taken[i] += 1
            left -= lengths[i]
    reached = np.zeros(2 * left + 1, bool)  # a sum beyond twice the rest is worse than none
    reached[0] = True
    by = np.zeros(2 * left + 1, np.int32)  # length that reached the sum first
    for i in reversed(range(len(lengths))):
        if reached[left]:
            break
        sums, more = np.flatnonzero(reached) + lengths[i], counts[i] - taken[i]
        while more and len(sums):
            sums = sums[sums < len(reached)]
            sums = sums[~reached[sums]]
            reached[sums] = True
            by[sums] = i
            sums, more = sums + lengths[i], more - 1
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - left).argmin()])
    while at:
        i = int(by[at])
        taken[i] += 1
        at -= lengths[i]
    return taken


def plans(histogram: DataFrame, aims: DataFrame, most: int = MOST, play: int = PLAY) -> DataFrame:
    """Adds whole (times that all documents are taken) and extra (documents once more) to (source, size, n)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        words, target = int(rows["source_size"][0]), float(rows["target"][0])
        whole = min(most, int(target // words)) if words else 0
        budget = min(words, max(0, round(target) - whole * words))
        if words and budget == words and whole < most:
            whole, budget = whole + 1, 0
        some = rows["size"] > 0
        extra = np.zeros(len(rows), np.int64)
        if budget and whole < most:
            extra[some] = fit(rows["size"][some].tolist(), rows["n"][some].tolist(), budget, play)
        return rows.assign(whole=whole, extra=extra)

    rows = same_key_join(histogram, aims, ["source"])
    schema = "source string, size long, n long, source_size long, target double, whole int, extra long"
    return rows.groupBy("source").applyInPandas(run, schema)


def looked_up(rows: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """Left join of rows (source, size, h) with one row per (source, size); hot ones, fewer than tasks, are salted."""
    tasks = partitions(rows.sparkSession)
    marks = F.broadcast(hot.select("source", "size", F.lit(True).alias("hot")))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    own = F.when(F.col("hot"), F.pmod("h", F.lit(tasks))).otherwise(0).cast("int")
    mark = lambda df, salt: same_key_join(df, marks, ["source", "size"], "left").withColumn("salt", salt).drop("hot")
    return same_key_join(mark(rows, own), mark(groups, F.explode(salts)), ["source", "size", "salt"], "left").drop("salt")


def mixed(docs: DataFrame, seed: int = 11, weights: Sequence[int] = WEIGHTS, most: int = MOST, play: int = PLAY) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document; copies: how often the mix takes it."""
    rows = staged(sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), seed), "sizes")
    histogram = staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    plan = staged(plans(histogram, targets(sources, weights, most), most, play), "plan")
    total = plan.agg(F.sum("n")).first()[0] or 0
    hot = plan.where(F.col("n") * partitions(docs.sparkSession) > F.lit(total))
    bucket = F.pmod(F.col("h"), F.floor(F.col("n") / BUCKET_ROWS) + 1)
    met = staged(looked_up(rows, plan, hot).withColumn("bucket", bucket), "planned")

    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    counts = met.where(some).groupBy("source", "size", "extra", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("source", "size").orderBy("bucket")
    ends = counts.withColumn("end", F.sum("rows").over(before)).where((F.col("end") >= F.col("extra")) & (F.col("end") - F.col("rows") < F.col("extra")))
    borders = staged(ends.select("source", "size", F.col("bucket").alias("border"), (F.col("extra") - F.col("end") + F.col("rows")).alias("need")), "borders")
    split = looked_up(met, borders, hot)

    on_border = F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))
    inside = Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")
    ranked = split.where(on_border).withColumn("in", F.row_number().over(inside) <= F.col("need"))
    decided = split.where(~on_border).withColumn("in", F.coalesce(F.col("bucket") < F.col("border"), F.col("extra") > 0))
    both = ranked.unionByName(decided)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("in").cast("int")).alias("copies"))
