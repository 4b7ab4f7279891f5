"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into 2^k runs by a hash of their id; a run is one partition, sorted
by digest, with one entry (digest, best id, count) per digest. Runs then exchange
entries in rounds of eight partners (three binomial rounds each): the partners'
numbers differ in the three bits of the round only, and each partner takes the
entries whose digest has its own number in these bits. What it receives is sorted
and merged by a sorted aggregation, which keeps the best identifier of each digest.
After the last round a digest has one entry, and all runs still hold equal shares.
The verdict walks back down the same rounds, so that a group which holds a third
of all rows is never in one task: a run meets at most eight entries of a digest in
a round, and the last step spreads the rows of a group over all runs. An entry is
verified by SHA-256, a second 64-bit hash and the byte length of the normalised
text, all of which must agree at every level.

Defined cases: null text counts as empty; a null id loses to any other; of rows
with equal text and equal id all have that id as keep_id, and all count as
kept (`without_copies` keeps the one with the largest hash of its columns); extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutspan.llm.common import lower_ascii, partitions, staged

DIGEST = ["text_sha256", "text_hash", "text_bytes"]
FAN_IN_BITS = 3


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *others: str) -> DataFrame:
    """(id, text_sha256, text_hash, text_bytes) of every row's normalised text, and other columns as they are."""
    text = docs.select(F.col(id_column), lower_ascii(F.col(text_column)).alias("text"), *others)
    return text.select(
        id_column,
        F.sha2("text", 256).alias("text_sha256"),
        F.xxhash64("text").alias("text_hash"),
        F.octet_length("text").alias("text_bytes"),
        *others,
    )


def run_bits(rows: DataFrame) -> int:
    """As many runs as shuffle partitions, at least 64: a power of eight."""
    bits = 2 * FAN_IN_BITS
    while 2**bits < partitions(rows.sparkSession):
        bits += FAN_IN_BITS
    return bits


def merge_levels(rows: DataFrame, bits: int, keep: str) -> list[DataFrame]:
    """Entries (slot, digest, best, group_size) after each round; rows have run, digest, id and tie.

    `best` is a struct (rank, id, tie); its maximum or minimum is the row that stays.
    """
    best, rank = (F.min, F.col("id").isNull()) if keep == "smallest" else (F.max, F.col("id").isNotNull())
    entries = rows.select(*DIGEST, F.col("run").alias("slot"), F.struct(rank.alias("rank"), "id", "tie").alias("best"), F.lit(1).cast("long").alias("group_size"))
    levels = []
    for done in range(0, bits + 1, FAN_IN_BITS):
        if done:
            entries = levels[-1].withColumn("slot", next_slot(done - FAN_IN_BITS))
        # partitioned by the run alone; a struct as aggregate makes Spark sort each run by digest and merge it in order
        levels.append(entries.repartition("slot").groupBy("slot", *DIGEST).agg(best("best").alias("best"), F.sum("group_size").alias("group_size")))
    return levels


def next_slot(done: int) -> Column:
    """The partner that takes an entry in the round after `done` bits: these bits of the run become the digest's."""
    mask = (2**FAN_IN_BITS - 1) << done
    return F.col("slot").bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("text_hash").bitwiseAND(F.lit(mask)).cast("int"))


def dealt(docs: DataFrame, bits: int, id_column: str, text_column: str, tie: Column) -> DataFrame:
    """(id, digest, tie, run) of every row, written once."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), tie.alias("tie"))
    found = digests(rows, "id", "text", "tie").withColumn("run", F.expr(f"pmod(xxhash64(id, 17), {2**bits})").cast("int"))
    return staged(found, "digests")


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of equal texts stays.
    """
    bits = run_bits(docs)
    rows = dealt(docs, bits, id_column, text_column, F.lit(0))
    levels = merge_levels(rows, bits, keep)
    verdict = levels[-1]
    for i in range(len(levels) - 2, -1, -1):
        below = levels[i].select(*DIGEST, F.col("slot").alias("own"), next_slot(i * FAN_IN_BITS).alias("slot"))
        verdict = below.join(verdict, [*DIGEST, "slot"]).drop("slot").withColumnRenamed("own", "slot")
    out = rows.join(verdict.withColumnRenamed("slot", "run"), [*DIGEST, "run"])
    return out.select(
        F.col("id").alias(id_column),
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, one of each text, with their columns; of rows with the chosen id the hash of their columns decides."""
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "struct", "array", "variant")]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    bits = run_bits(docs)
    chosen = merge_levels(dealt(docs, bits, "doc_id", "text", tie), bits, keep)[-1]
    stays = chosen.select(F.col("text_sha256").alias("sha"), F.col("best.tie").alias("tie"))
    rows = docs.select(F.struct("*").alias("row"), F.sha2(lower_ascii(F.col("text")), 256).alias("sha"), tie.alias("tie"))
    # rows that repeat all columns meet before the exchange, which the join reuses: each text moves once
    return rows.dropDuplicates(["sha", "tie"]).join(stays, ["sha", "tie"], "left_semi").select("row.*")
