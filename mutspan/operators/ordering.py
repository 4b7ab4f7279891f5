"""Latest, first, position and ordered text per key, without hot window partitions.

A key may hold a large share of all rows. Latest/first use aggregates, so every
map task sends one row per key. Positions split a key into blocks of the order
column: only block counts are summed per key, rows are numbered inside a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import safe
from ..session import cut_lineage

BLOCK_ROWS = 1_000_000


def _pick(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Whole row with the greatest order value per key."""
    return _pick(df, keys, order, F.max_by)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Whole row with the smallest order value per key."""
    return _pick(df, keys, order, F.min_by)


def block_of(order: str, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(order) / F.lit(rows))


def with_position(
    df: DataFrame, keys: list[str], order: str, name: str, block: Column | None = None, total: str | None = None
) -> DataFrame:
    """Add the 1-based position of each row inside its key by a numeric order column.

    ``block`` must not fall as ``order`` grows; its default cuts the order
    column into ranges. ``total`` names a column for the row count of the key.
    """
    blocked = df.withColumn("_block", block_of(order) if block is None else block)
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    extra = [F.sum("_rows").over(W.partitionBy(*keys)).alias(total)] if total else []
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), *extra)
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("long"))
        .select(*df.columns, name, *([total] if total else []))
    )


def ordered_text(
    df: DataFrame, keys: list[str], order: str, text: Column, separator: str, name: str, block: Column | None = None
) -> DataFrame:
    """Join the texts of a key in order: inside blocks first, then block by block.

    The joined text is itself the result row, so its length cannot be avoided;
    no task ever holds the separate rows of a key beyond one block.
    """
    pieces = (
        df.select(*keys, F.col(order).alias("_order"), text.alias("_text"), (block_of(order) if block is None else block).alias("_block"))
        .groupBy(*keys, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("_order", "_text"))).alias("_items"))
        .select(*keys, "_block", F.array_join(F.transform("_items", lambda x: x["_text"]), separator).alias("_piece"))
    )
    return pieces.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_block", "_piece"))), lambda x: x["_piece"]), separator
        ).alias(name)
    )


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: int, rank: str = "rank") -> DataFrame:
    """Top ``keep`` rows per key; the rank filter also cuts each map task's share."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= keep)


def with_report_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows 1..n in a total order without one task holding all rows.

    The rows are range-partitioned and sorted; partition sizes then give each
    partition its first number. ``order`` must be unique per row.
    """
    sorted_rows = df.orderBy(*order).withColumns(
        {"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id()}
    )
    sorted_rows = cut_lineage(sorted_rows)
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_first"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_in") - F.col("_first") + 1)
        .select(*df.columns, name)
    )


def match_in_tiers(
    left: DataFrame, right: DataFrame, tiers: list[tuple[list[Column], list[Column]]], payload: list[str], tier: str = "tier"
) -> DataFrame:
    """Look up ``payload`` of ``right`` by the first tier of keys that matches.

    Each tier is (keys of left, keys of right). The right side is cut to one row
    per key (smallest payload), so a tier never multiplies rows. A null key
    matches nothing. Rows without a match keep null payload and tier 0.
    """
    out = left
    for number, (left_keys, right_keys) in enumerate(tiers, start=1):
        names = [f"_k{number}_{i}" for i in range(len(left_keys))]
        lookup = (
            right.select(*[k.alias(n) for k, n in zip(right_keys, names)], F.struct(*payload).alias(f"_p{number}"))
            .dropna(subset=names)
            .groupBy(*names)
            .agg(F.min(f"_p{number}").alias(f"_p{number}"))
        )
        out = out.select("*", *[k.alias(f"{n}_l") for k, n in zip(left_keys, names)])
        condition = reduce(lambda a, b: a & b, [F.col(f"{n}_l") == F.col(n) for n in names])
        out = out.join(lookup, condition, "left").drop(*names, *[f"{n}_l" for n in names])
    found = [F.col(f"_p{i}") for i in range(1, len(tiers) + 1)]
    level = reduce(
        lambda acc, i: F.when(found[i].isNotNull(), F.lit(i + 1)).otherwise(acc),
        range(len(tiers) - 1, -1, -1),
        F.lit(0),
    )
    picked = F.coalesce(*found)
    return out.select(*left.columns, *[picked[c].alias(c) for c in payload], level.alias(tier))


def semi_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def anti_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def safe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: safe(c) for c in columns})
