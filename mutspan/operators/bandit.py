"""Contextual-bandit statistics, policy choice and linear upper-confidence scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.context import dimension, schema_version
from ..functions.text import first_match, safe
from .adequacy import hash_uniform

LEVELS = ["global", "coarse", "exact"]
COMBINE_WAYS = 32


def action_statistics(log: DataFrame) -> DataFrame:
    """Count and mean reward per action at global, coarse and exact level.

    ``log`` has action, reward, coarse_key and exact_key. One pass with three
    grouping sets; blank keys take part at the global level only.
    """
    rows = log.select(
        "action",
        F.col("reward").cast("double").alias("reward"),
        safe("coarse_key").alias("coarse_key"),
        safe("exact_key").alias("exact_key"),
    )
    sets = rows.groupingSets(
        [("action",), ("coarse_key", "action"), ("exact_key", "action")], "action", "coarse_key", "exact_key"
    ).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("reward").alias("mean_reward"),
        F.grouping("coarse_key").alias("_no_coarse"),
        F.grouping("exact_key").alias("_no_exact"),
    )
    return sets.select(
        first_match([(F.col("_no_exact") == 0, "exact"), (F.col("_no_coarse") == 0, "coarse")], "global").alias("level"),
        F.coalesce("exact_key", "coarse_key", F.lit("")).alias("bucket"),
        "action",
        "samples",
        "mean_reward",
    ).filter((F.col("level") == "global") | (F.col("bucket") != ""))


def action_rank(action):
    """Place of an action in the fixed order; it breaks ties."""
    return F.array_position(F.array(*map(F.lit, fixed.EVIDENCE_ACTIONS)), action).cast("int")


def best_actions(statistics: DataFrame) -> DataFrame:
    """Best action and sample count per level and bucket."""
    known = statistics.filter(F.col("action").isin(fixed.EVIDENCE_ACTIONS))
    return known.groupBy("level", "bucket").agg(
        F.sum("samples").alias("samples"),
        F.max_by("action", F.struct("mean_reward", -action_rank(F.col("action")))).alias("best_action"),
    )


def choose_actions(
    contexts: DataFrame, statistics: DataFrame, min_exact: int = 5, min_coarse: int = 5, warmup: str = "BASELINE",
    epsilon: float = 0.0, seed: str = "explore", id_column: str = "context_id",
) -> DataFrame:
    """Action per context: exact bucket with enough samples, else coarse, else global.

    With ``epsilon`` a repeatable share of the contexts explores instead.
    """
    best = best_actions(statistics)

    def level(name: str) -> DataFrame:
        return best.filter(F.col("level") == name).select(
            F.col("bucket").alias(f"{name}_key"), F.col("samples").alias(f"_{name}_n"), F.col("best_action").alias(f"_{name}")
        )

    overall = best.filter(F.col("level") == "global").agg(F.first("best_action", True)).scalar()
    joined = (
        contexts.withColumns({"exact_key": safe("exact_key"), "coarse_key": safe("coarse_key")})
        .join(level("exact"), "exact_key", "left")
        .join(level("coarse"), "coarse_key", "left")
        .withColumn("_global", overall)
    )
    exact = F.coalesce(F.col("_exact_n"), F.lit(0)) >= max(1, min_exact)
    coarse = F.coalesce(F.col("_coarse_n"), F.lit(0)) >= max(1, min_coarse)
    greedy_level = first_match(
        [(F.col("_global").isNull(), "WARMUP"), (exact, "EXACT"), (coarse, "COARSE")], "GLOBAL"
    )
    greedy = first_match(
        [(F.col("_global").isNull(), warmup), (exact, F.col("_exact")), (coarse, F.col("_coarse"))], F.col("_global")
    )
    explore = (hash_uniform(seed, id_column) < F.lit(epsilon)) & F.col("_global").isNotNull()
    actions = F.array(*map(F.lit, fixed.EVIDENCE_ACTIONS))
    place = F.floor(hash_uniform(seed + "-action", id_column) * F.lit(len(fixed.EVIDENCE_ACTIONS))).cast("int")
    return joined.select(
        *contexts.columns,
        greedy_level.alias("level"),
        F.when(explore, F.get(actions, place)).otherwise(greedy).alias("action"),
        F.coalesce(explore, F.lit(False)).alias("explored"),
    )


def policy_rows(log: DataFrame) -> DataFrame:
    """Rows that may teach the policy: visible code, no skip, no scaffold."""
    return log.filter(
        F.coalesce("visible_code", F.lit(False))
        & ~F.coalesce("skipped", F.lit(False))
        & ~F.coalesce("scaffold", F.lit(False))
    )


def vectors(column, dim: int) -> np.ndarray:
    """Rows of a column of vectors; another length than dim is an error, not cut."""
    found = np.stack(column.to_numpy()).astype(float)
    if found.shape[1] != dim:
        raise ValueError(f"vectors have {found.shape[1]} numbers, the model has {dim}")
    return found


def linear_statistics(log: DataFrame, dim: int, ridge: float = 1.0) -> DataFrame:
    """A = ridge I + sum w x x', b = sum w r x per action, as (action, row, col, value) rows.

    ``log`` has action, x (array of ``dim``), reward, weight. Each partition
    reduces its rows to one small matrix per action; these are summed in salted
    groups and then cell by cell, so nothing grows with the log.
    """
    layout = "action string, samples long, a array<double>, b array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for batch in batches:
            for action, part in batch.groupby("action", sort=False):
                x = vectors(part["x"], dim)
                w = np.maximum(0.0, part["weight"].to_numpy(dtype=float))
                r = part["reward"].to_numpy(dtype=float)
                cell = total.setdefault(action, [0, np.zeros((dim, dim)), np.zeros(dim)])
                cell[0] += len(part)
                cell[1] += (x * w[:, None]).T @ x
                cell[2] += x.T @ (w * r)
        if total:
            yield pd.DataFrame(
                [(name, n, a.ravel().tolist(), b.tolist()) for name, (n, a, b) in total.items()],
                columns=["action", "samples", "a", "b"],
            )

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "action": [part["action"].iloc[0]],
                "samples": [int(part["samples"].sum())],
                "a": [np.sum(np.stack(part["a"].to_numpy()), axis=0).tolist()],
                "b": [np.sum(np.stack(part["b"].to_numpy()), axis=0).tolist()],
            }
        )

    rows = log.select(
        "action", F.col("x").cast("array<double>").alias("x"), F.col("reward").cast("double").alias("reward"),
        F.col("weight").cast("double").alias("weight"),
    )
    partials = rows.mapInPandas(partial, layout).withColumn("_way", F.pmod(F.spark_partition_id(), F.lit(COMBINE_WAYS)))
    merged = partials.groupBy("action", "_way").applyInPandas(lambda p: combine(p), layout)
    cells = merged.select("action", F.posexplode("a").alias("pos", "value")).groupBy("action", "pos").agg(F.sum("value").alias("value"))
    matrix = cells.select(
        "action",
        F.lit("A").alias("part"),
        F.floor(F.col("pos") / F.lit(dim)).cast("int").alias("row"),
        (F.col("pos") % F.lit(dim)).cast("int").alias("col"),
        "value",
    ).withColumn("value", F.col("value") + F.when(F.col("row") == F.col("col"), F.lit(ridge)).otherwise(F.lit(0.0)))
    vector = (
        merged.select("action", F.posexplode("b").alias("row", "value"))
        .groupBy("action", "row")
        .agg(F.sum("value").alias("value"))
        .select("action", F.lit("b").alias("part"), F.col("row").cast("int").alias("row"), F.lit(0).alias("col"), "value")
    )
    return matrix.unionByName(vector)


def model_table(statistics: DataFrame, encoding: str, dim: int | None = None) -> DataFrame:
    """One row per action with the flattened matrix, for storage."""
    grouped = statistics.groupBy("action").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("part") == "A", F.struct("row", "col", "value")))), lambda c: c["value"]
        ).alias("a"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == "b", F.struct("row", "value")))), lambda c: c["value"]).alias("b"),
    )
    return grouped.withColumns(
        {
            "encoding": F.lit(encoding),
            "dimension": F.lit(dim or dimension(encoding)),
            "schema_version": F.lit(schema_version(encoding)),
        }
    )


def compatible_models(models: DataFrame, encoding: str, dim: int | None = None) -> DataFrame:
    """Stored models that fit the current vector layout; others are ignored."""
    size = dim or dimension(encoding)
    return models.filter(
        (F.col("encoding") == encoding)
        & (F.col("dimension") == size)
        & (F.col("schema_version") == schema_version(encoding))
        & (F.size("a") == size * size)
        & (F.size("b") == size)
    )


def solved_models(models: DataFrame, dim: int) -> DataFrame:
    """Adds theta = A^-1 b and root, the rows of L^-1 where A = L L', to models with a (flat) and b.

    L is a Cholesky factor: a fold over its rows, each a fold over the entries
    before it. With root = L^-1, x' A^-1 x is the squared length of root x. A is
    ridge I plus a sum of squares, so no pivot can vanish.
    """
    numbers = F.array().cast("array<double>")
    matrix = F.array().cast("array<array<double>>")
    upto = lambda n: F.sequence(F.lit(0), n)
    dot = lambda u, w: F.aggregate(F.zip_with(u, w, lambda x, y: x * y), F.lit(0.0), lambda t, z: t + z)

    def entry(lower: Column, row: Column, i: Column, j: Column) -> Column:
        other = F.when(i == j, row).otherwise(F.slice(F.get(lower, j), F.lit(1), F.size(row)))
        rest = F.get("a", i * dim + j) - dot(row, other)
        return F.when(i == j, F.sqrt(rest)).otherwise(rest / F.get(F.get(lower, j), j))

    def factor_row(lower: Column, i: Column) -> Column:
        return F.aggregate(upto(i), numbers, lambda row, j: F.concat(row, F.array(entry(lower, row, i, j))))

    def inverse_row(lower: Column, done: Column, i: Column) -> Column:
        unit = F.transform(upto(F.lit(dim - 1)), lambda k: F.when(k == i, F.lit(1.0)).otherwise(F.lit(0.0)))
        weights = F.slice(F.get(lower, i), F.lit(1), i)  # entries left of the diagonal, as many as rows are done
        pairs = F.arrays_zip(weights.alias("w"), done.alias("m"))
        rest = F.aggregate(pairs, unit, lambda row, p: F.zip_with(row, p["m"], lambda x, y: x - p["w"] * y))
        return F.transform(rest, lambda x: x / F.get(F.get(lower, i), i))

    rows = upto(F.lit(dim - 1))
    lower = models.withColumn("_lower", F.aggregate(rows, matrix, lambda done, i: F.concat(done, F.array(factor_row(done, i)))))
    inverse = lower.withColumn("root", F.aggregate(rows, matrix, lambda done, i: F.concat(done, F.array(inverse_row(F.col("_lower"), done, i)))))
    part = inverse.withColumn("_y", F.transform("root", lambda r: dot(r, F.col("b"))))
    theta = F.transform(rows, lambda j: dot(F.transform("root", lambda r: F.get(r, j)), F.col("_y")))
    return part.withColumn("theta", theta).drop("_lower", "_y")


def linear_scores(contexts: DataFrame, models: DataFrame, dim: int, alpha: float = 0.5, ridge: float = 1.0, id_column: str = "context_id") -> DataFrame:
    """Best action per context by x'theta + alpha sqrt(x' A^-1 x).

    The model table has one row per action (six) of fixed size; it is solved by
    `solved_models` and travels with the tasks. Actions without a model start at
    ridge I. The first action wins ties.
    """
    # at most one row per action of the fixed list, each dim x dim numbers
    solved = solved_models(models.filter(F.col("action").isin(fixed.EVIDENCE_ACTIONS)), dim).select("action", "theta", "root")
    stored = {r["action"]: (np.array(r["theta"]), np.array(r["root"])) for r in solved.collect()}
    new = np.zeros(dim), np.eye(dim) / np.sqrt(ridge)
    theta = np.stack([stored.get(action, new)[0] for action in fixed.EVIDENCE_ACTIONS])
    roots = [stored.get(action, new)[1] for action in fixed.EVIDENCE_ACTIONS]
    names = np.array(fixed.EVIDENCE_ACTIONS, dtype=object)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = vectors(batch["x"], dim)
            width = np.stack([((x @ root.T) ** 2).sum(axis=1) for root in roots], axis=1)
            values = x @ theta.T + alpha * np.sqrt(width)
            best = values.argmax(axis=1)
            yield pd.DataFrame({"id": batch["id"], "action": names[best], "score": values[np.arange(len(x)), best]})

    kind = dict(contexts.dtypes)[id_column]
    rows = contexts.select(F.col(id_column).alias("id"), F.col("x").cast("array<double>").alias("x"))
    return rows.mapInPandas(score, f"id {kind}, action string, score double").withColumnRenamed("id", id_column)
