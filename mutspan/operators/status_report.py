"""Status analysis of the run log: one row per mutant, then the report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed, status
from ..functions.compile_errors import coarse_compile_category, compile_error_summary
from ..functions.keys import id_part, operator_family
from ..functions.status import is_true
from ..functions.text import first_non_blank, ratio, safe
from ..session import cut_lineage
from .ordering import match_in_tiers, ordered_text, with_position
from .trajectory import LINE

ARROW = " → "


def mutant_status(df: DataFrame) -> DataFrame:
    """One row per mutant: its last record plus what its history says.

    The display round of a last record without a round is its occurrence
    index, which is the number of records; so no window is needed.
    """
    last = F.max_by(
        F.struct(
            "project", "class_name", "method", "operator", "target_status", "compile_success", "killed",
            "outer_loop_round", "failure_reason", LINE,
        ),
        LINE,
    )
    per_mutant = df.groupBy("mutant_id").agg(
        last.alias("r"),
        F.count(F.lit(1)).alias("records"),
        F.bool_or(status.is_compile_failure("target_status", "compile_success")).alias("ever_compile_failed"),
        F.count_if(status.is_non_executed("target_status")).alias("non_executed_records"),
        F.sum(F.coalesce("repair_rounds", F.lit(0))).alias("repair_rounds"),
        F.sum(F.coalesce("compile_calls", F.lit(0))).alias("compile_calls"),
        F.sum(F.coalesce("llm_calls", F.lit(0))).alias("llm_calls"),
    )
    return per_mutant.select(
        "mutant_id",
        "r.*",
        "records",
        "ever_compile_failed",
        "non_executed_records",
        "repair_rounds",
        "compile_calls",
        "llm_calls",
        status.final_category("r.target_status", "r.killed", "r.compile_success").alias("category"),
        F.when(F.col("r.outer_loop_round") > 0, F.col("r.outer_loop_round").cast("long"))
        .otherwise(F.col("records"))
        .alias("final_round"),
        operator_family("r.operator").alias("operator_family"),
    )


def _category_count(category: str) -> Column:
    return F.count_if(F.col("category") == category)


def category_rates(rows: DataFrame, key: str) -> DataFrame:
    """Counts and the three rates by one key, largest groups first."""
    counts = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        _category_count(fixed.CATEGORY_KILLED).alias("killed"),
        _category_count(fixed.CATEGORY_SURVIVED).alias("survived"),
        _category_count(fixed.CATEGORY_COMPILE_FAILED).alias("compile_failed"),
        _category_count(fixed.CATEGORY_OTHER).alias("other"),
    )
    compiled = F.col("killed") + F.col("survived")
    return counts.select(
        "*",
        ratio(compiled, F.col("total")).alias("compile_rate"),
        ratio(F.col("killed"), F.col("total")).alias("kill_rate"),
        ratio(F.col("killed"), compiled).alias("kill_rate_of_compiled"),
    ).orderBy(F.desc("total"), key)


def operator_rates(rows: DataFrame) -> DataFrame:
    return category_rates(rows, "operator_family")


def class_rates(rows: DataFrame) -> DataFrame:
    return category_rates(rows, "class_name")


def compile_error_categories(rows: DataFrame) -> DataFrame:
    """Count, share and first example per category of the mutants that never compiled."""
    failed = rows.filter(F.col("category") == fixed.CATEGORY_COMPILE_FAILED).select(
        compile_error_summary("failure_reason").alias("summary"),
        F.struct("class_name", "method", "operator", "mutant_id").alias("position"),
    )
    grouped = (
        failed.withColumn("error_category", coarse_compile_category("summary"))
        .groupBy("error_category")
        .agg(F.count(F.lit(1)).alias("mutants"), F.min_by("summary", "position").alias("example"))
    )
    total = grouped.agg(F.sum("mutants").alias("all_mutants")).scalar()
    return (
        grouped.select("error_category", "mutants", ratio(F.col("mutants"), total).alias("share"), "example")
        .orderBy(F.desc("mutants"), "error_category")
    )


def summary(rows: DataFrame) -> DataFrame:
    """Metric list and rates of the whole log from one global aggregate."""
    compiled = is_true("compile_success")
    recovered = F.col("ever_compile_failed") & compiled
    totals = rows.agg(
        F.sum("records").alias("records"),
        F.sum("repair_rounds").alias("repair_rounds"),
        F.sum("compile_calls").alias("compile_calls"),
        F.sum("llm_calls").alias("llm_calls"),
        F.count(F.lit(1)).alias("mutants"),
        _category_count(fixed.CATEGORY_KILLED).alias("killed"),
        _category_count(fixed.CATEGORY_SURVIVED).alias("survived"),
        _category_count(fixed.CATEGORY_COMPILE_FAILED).alias("compile_failed"),
        F.sum("non_executed_records").alias("non_executed_records"),
        F.count_if(F.col("non_executed_records") > 0).alias("non_executed_mutants"),
        F.count_if(compiled).alias("compiled"),
        F.count_if("ever_compile_failed").alias("ever_compile_failed"),
        F.count_if(recovered).alias("recovered"),
    )
    rates = {
        "compile_rate": ("compiled", "mutants"),
        "kill_rate": ("killed", "mutants"),
        "kill_rate_of_compiled": ("killed", "compiled"),
        "recovery_rate": ("recovered", "ever_compile_failed"),
    }
    metrics = [F.col(c).cast("double").alias(c) for c in totals.columns] + [
        ratio(F.col(a), F.col(b)).alias(name) for name, (a, b) in rates.items()
    ]
    wide = totals.select(*metrics)
    return wide.unpivot([], wide.columns, "metric", "value")


def kill_rounds(rows: DataFrame) -> DataFrame:
    killed = rows.filter(F.col("category") == fixed.CATEGORY_KILLED)
    return killed.groupBy("final_round").agg(F.count(F.lit(1)).alias("mutants")).orderBy("final_round")


def status_trie(df: DataFrame, block: Column | None = None, block_records: int = 100_000) -> DataFrame:
    """Status paths as a trie: one row per node, with its parent, the mutants through it and those that end there.

    A node stands for a prefix of a path and is known by its depth and by sums of
    hashes of (position, status). Sums need no order, so a mutant's prefixes come
    from sums of whole blocks plus running sums inside a block, and no row or
    task holds a path. Three sums of 31 bits each tell prefixes apart.
    """
    placed = with_position(df.select("mutant_id", LINE, safe("target_status").alias("status")), ["mutant_id"], LINE, "depth", block, "records")
    lanes = [f"_h{i}" for i in range(3)]
    hashes = {h: F.xxhash64(F.lit(i), "depth", "status").bitwiseAND(F.lit((1 << 31) - 1)) for i, h in enumerate(lanes)}
    hashed = placed.withColumn("_part", F.floor((F.col("depth") - 1) / block_records)).withColumns(hashes)
    sums = hashed.groupBy("mutant_id", "_part").agg(*[F.sum(h).alias(h) for h in lanes])
    before = W.partitionBy("mutant_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("mutant_id", "_part", *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"{h}_before") for h in lanes])
    inside = W.partitionBy("mutant_id", "_part").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = {f"{h}_to": F.col(f"{h}_before") + F.sum(h).over(inside) for h in lanes}
    met = hashed.join(offsets, ["mutant_id", "_part"]).withColumns(running)
    node = lambda depth, values: F.concat_ws("-", depth.cast("string"), *[v.cast("string") for v in values])
    ends = [F.col(f"{h}_to") for h in lanes]
    rows = met.select(
        node(F.col("depth"), ends).alias("node"),
        F.when(F.col("depth") > 1, node(F.col("depth") - 1, [F.col(f"{h}_to") - F.col(h) for h in lanes])).alias("parent"),
        "depth", "status", (F.col("depth") == F.col("records")).alias("last"),
    )
    return rows.groupBy("node", "parent", "depth", "status").agg(F.count(F.lit(1)).alias("mutants"), F.count_if("last").alias("ending"))


def trie_paths(trie: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, depth, status) of every step on the paths of the asked end nodes (node), from their end to the root."""
    steps = trie.select(F.col("node").alias("at"), "parent", "depth", "status")
    open_nodes = ends.select("node", F.col("node").alias("at"))
    found = None
    while not open_nodes.isEmpty():
        met = cut_lineage(open_nodes.join(steps, "at"))
        part = met.select("node", "depth", "status")
        found = part if found is None else found.unionByName(part)
        open_nodes = met.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("at"))
    return found if found is not None else trie.select("node", "depth", "status").limit(0)


def status_paths(df: DataFrame, block: Column | None = None) -> DataFrame:
    """Statuses of each mutant's records in order, joined by arrows."""
    return ordered_text(df, ["mutant_id"], LINE, safe("target_status"), ARROW, "pattern", block)


def status_patterns(df: DataFrame, block: Column | None = None) -> DataFrame:
    return (
        status_paths(df, block)
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("mutants"))
        .orderBy(F.desc("mutants"), "pattern")
    )


def record_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("records").agg(F.count(F.lit(1)).alias("mutants")).orderBy("records")


def skip_categories(df: DataFrame) -> DataFrame:
    return df.groupBy("skip_category").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "skip_category")


def match_index(records: DataFrame, index: DataFrame) -> DataFrame:
    """Index row of each record: by id, by the four key parts, by row number.

    Parts that a record lacks are taken from its id. A row number counts only
    when the row it names has the same four parts. A blank id, and a key of four
    blank parts, match nothing.
    """
    parts = ["project", "class_name", "method", "operator"]
    known_id = F.nullif(safe("mutant_id"), F.lit(""))

    def key(cells: list[Column]) -> list[Column]:
        return [F.when(F.concat(*cells) != "", cells[0]), *cells[1:]]

    left_parts = key([first_non_blank(c, id_part("mutant_id", i)) for i, c in enumerate(parts)])
    right_parts = key([safe(c) for c in parts])
    return match_in_tiers(
        records,
        index.withColumn("index_row", F.col("row_no")),
        [
            ([known_id], [known_id]),
            (left_parts, right_parts),
            ([F.col("task_row"), *left_parts], [F.col("row_no"), *right_parts]),
        ],
        ["index_row"],
    )
