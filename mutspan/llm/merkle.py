"""Merkle manifest of a dataset as postorder append logs.

Every key (language) has a tree over its rows in id order; the roots of the keys
form a tree of their own. Leaves are numbered through range-partitioned sorted
parts, so a key with most of the rows is spread evenly. Aligned builders take
2 ** RUN consecutive leaves each and append every node to their log at the
moment it is complete: a leaf, then each parent that it closes, and at the end
the nodes over incomplete runs. The builders' roots are the leaves of the next
tier, until one node is left.

In such a log a node that closes a full subtree stands at 2 * (e - 1) -
ones(e - 1) + level, where e leaves end with its subtree and ones counts set
bits; the nodes over incomplete runs follow after all of these, level by
level. So the siblings of a leaf are read from the log by address; a builder's
own siblings come first, then those of its root in the tier above.

Defined cases: null fields are `-`; a null key is a key of its own, before all
others; a null id comes first; equal ids are ordered by their leaf; equal rows
give equal leaves, each with a place of its own; only named fields are read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutspan.llm.common import partitions, same_key_join, staged
from mutspan.operators.ordering import with_report_rows

RUN = 8  # a builder takes 2 ** RUN leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEFT, RIGHT, NONE = b"LR-"


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field as byte count, colon and value, a null one as `-`."""
    texts = [c.cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def joined(*nodes: bytes) -> bytes:
    """Digest of nodes, taken as hex text one after the other."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """Nodes of the tree over `leaves`, in completion order, up to `height` levels above them."""
    log, waiting = [], []  # waiting: (level, node) of full subtrees without a right neighbour
    for node in leaves:
        level = 0
        log.append(node)
        while waiting and waiting[-1][0] == level:
            node = joined(waiting.pop()[1], node)
            level += 1
            log.append(node)
        waiting.append((level, node))
    level, node = waiting.pop()
    while level < height:
        node = joined(waiting.pop()[1], node) if waiting and waiting[-1][0] == level else joined(node)
        level += 1
        log.append(node)
    return log


def address(n: int, level: int, index: int) -> int:
    """Place in the log of the index-th node of a level, in a tree of n leaves."""
    end = (index + 1) << level
    if end <= n:
        return 2 * (end - 1) - (end - 1).bit_count() + level
    closed = (n & -n).bit_length() - 1  # levels whose last node is complete
    return 2 * n - n.bit_count() + level - closed - 1


def height_of(n: int, run: int = RUN) -> int:
    """Levels of a builder: up to the single root, or `run` where the tree has more builders."""
    return min(run, (n - 1).bit_length())


def siblings(log: bytes, n: int, height: int, leaf: int) -> tuple[bytes, bytes]:
    """(sides, siblings) of a leaf from its level upwards; side `-` has none."""
    sides, found = bytearray(), []
    for level in range(height):
        index = leaf >> level
        other = index ^ 1
        if other << level >= n:
            sides.append(NONE)
            continue
        sides.append(LEFT if other < index else RIGHT)
        at = 32 * address(n, level, other)
        found.append(log[at : at + 32])
    return bytes(sides), b"".join(found)


def fold(node: bytes, sides: bytes, others: bytes) -> bytes:
    """Root that a node and its siblings lead to."""
    at = 0
    for side in sides:
        if side == NONE:
            node = joined(node)
            continue
        other = others[at : at + 32]
        at += 32
        node = joined(other, node) if side == LEFT else joined(node, other)
    return node


@dataclass
class Forest:
    """Logs of some trees, tier by tier, and their roots (tree, root)."""

    tiers: list[DataFrame]  # tree, part, n (leaves of the tree in this tier), log, root, rows
    roots: DataFrame
    run: int


def grow(leaves: DataFrame, most: int, name: str, run: int = RUN) -> Forest:
    """Build all trees over leaves (tree, place, n, digest, ...); most: leaves of the largest one."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [append_log(nodes, height_of(n, run)) for n, nodes in zip(batch["n"].to_pylist(), batch["nodes"].to_pylist())]
            added = [pa.array([b"".join(x) for x in logs], pa.binary()), pa.array([x[-1] for x in logs], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["tree"], batch["part"], batch["n"], *added, batch["rows"]], names=["tree", "part", "n", "log", "root", "rows"])

    tiers, roots = [], None
    while True:
        others = [c for c in leaves.columns if c not in ("tree", "place", "n", "digest")]
        item = F.struct("place", "digest", *others)
        parts = leaves.groupBy("tree", F.shiftright("place", run).alias("part")).agg(F.min("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
        rows = F.transform("items", lambda x: F.struct(x["place"].alias("place"), *[x[c].alias(c) for c in others]))  # noqa: B023
        parts = parts.select("tree", "part", "n", F.transform("items", lambda x: x["digest"]).alias("nodes"), rows.alias("rows"))
        schema = parts.drop("nodes", "rows").withColumns({"log": F.lit(b""), "root": F.lit(b"")}).withColumn("rows", F.lit(None).cast(parts.schema["rows"].dataType)).schema
        tier = staged(parts.mapInArrow(build, schema), f"{name}-{len(tiers)}")
        tiers.append(tier)
        done = tier.where(F.col("n") <= 1 << run).select("tree", "root")
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1 << run:
            return Forest(tiers, roots, run)
        most = -(-most >> run)
        open_parts = tier.where(F.col("n") > 1 << run)
        leaves = open_parts.select("tree", F.col("part").alias("place"), F.ceil(F.col("n") / (1 << run)).alias("n"), F.col("root").alias("digest"))


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """(tree, place, rows, log, n, ...) parts of the lowest tier, each with the path of its root upwards.

    above: (tree, sides, others, ...) of each tree's root; further columns are carried.
    """
    carried = [c for c in above.columns if c not in ("tree", "sides", "others")]

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["tree", "part", "n", "log", "sides", "others"]).to_pylist()):
                size = min(1 << run, row["n"] - (row["part"] << run))
                steps = [siblings(row["log"], size, height_of(row["n"], run), leaf) for leaf in range(size)]
                first = row["part"] << run
                kept = [batch[c].take(pa.array([i] * size)) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * size, pa.int64()), pa.array(range(first, first + size), pa.int64()),
                        pa.array([s + row["sides"] for s, _ in steps], pa.binary()), pa.array([o + row["others"] for _, o in steps], pa.binary()), *kept,
                    ],
                    names=["tree", "part", "sides", "others", *carried],
                )

    run = forest.run
    known = None  # (tree, part, sides, others, ...) of open trees' parts in the tier at hand
    for tier in reversed(forest.tiers):
        last = tier.where(F.col("n") <= 1 << run).join(above, "tree")
        met = last if known is None else last.unionByName(tier.where(F.col("n") > 1 << run).join(known, ["tree", "part"]))
        schema = above.withColumn("part", F.lit(0).cast("long")).select("tree", "part", "sides", "others", *carried).schema
        known = met.drop("rows", "root").mapInArrow(descend, schema)
    return met


def numbered(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with tree, place and n; keys with tree): keys numbered in order, rows from 0 inside their key."""
    tasks = partitions(rows.sparkSession)
    split = rows.repartitionByRange(tasks, F.col(key).asc_nulls_first(), *order).sortWithinPartitions(F.col(key).asc_nulls_first(), *order)
    split = staged(split.withColumn("at", F.monotonically_increasing_id()), "sorted")
    task = F.shiftright("at", 33)
    sizes = split.groupBy(F.col(key), task.alias("task")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    keys = with_report_rows(sizes.groupBy(key).agg(F.sum("rows").alias("n")), [F.col(key).asc_nulls_first()], "tree")
    keys = staged(keys, "keys")
    before = Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first"))
    offsets = same_key_join(offsets.select(key, "task", "offset"), keys, [key])
    met = same_key_join(split.withColumn("task", task), offsets, [key, "task"])
    return met.select(*rows.columns, "tree", (F.col("at") + F.col("offset")).alias("place"), "n"), keys


@dataclass
class Manifest:
    """Trees of all keys, the tree over their roots, and each key's number and row count."""

    rows: Forest
    keys: Forest
    names: DataFrame


def manifest(leaves: DataFrame, key: str, ident: str, run: int = RUN) -> Manifest:
    """Manifest of rows (key, ident, digest, ...); further columns stay beside the leaves."""
    placed, names = numbered(leaves, key, [ident, "digest"])
    most, keys = names.agg(F.max("n"), F.count(F.lit(1))).first()
    rows = grow(placed.drop(key), most or 0, "rows", run)
    tops = rows.roots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"), F.lit(keys).cast("long").alias("n"), F.col("root").alias("digest"))
    return Manifest(rows, grow(tops, keys, "roots", run), names)


def proofs(made: Manifest) -> DataFrame:
    """Parts of the rows' trees, each with sides and siblings from its root to that of the dataset, subroot and root."""
    empty = F.lit(b"")
    start = made.keys.roots.select("tree", empty.alias("sides"), empty.alias("others"), "root")
    top = paths(made.keys, start.withColumnRenamed("root", "whole"))
    run = made.keys.run
    schema = "tree long, sides binary, others binary, subroot binary, whole binary"

    def of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = min(1 << run, row["n"] - (row["part"] << run))
                out = []
                for leaf in range(size):
                    sides, others = siblings(row["log"], size, height_of(row["n"], run), leaf)
                    at = 32 * address(size, 0, leaf)
                    out.append(((row["part"] << run) + leaf + 1, sides + row["sides"], others + row["others"], row["log"][at : at + 32], row["whole"]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["tree", "sides", "others", "subroot", "whole"])

    above = staged(top.select("part", "n", "log", "sides", "others", "whole").mapInArrow(of_keys, schema), "above")
    return paths(made.rows, above)


def verified(parts: DataFrame, ident: str, run: int = RUN) -> DataFrame:
    """(ident, leaf, subroot, root, proof_sha256, folded_root): each row's proof, and the root that its claimed leaf leads to.

    parts: result of `proofs` whose rows hold ident and claimed, a leaf that is checked in place of the row's own (null: the own).
    """
    kind = parts.schema["rows"].dataType.elementType[ident].dataType.simpleString()

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["part", "n", "log", "sides", "others", "subroot", "whole"]).to_pylist()):
                rows = batch["rows"][i].values
                size, height = len(rows), height_of(row["n"], run)
                upper = {}  # folds from this part's root on, by the node that reached it
                leaves, digests, roots = [], [], []
                for leaf, claimed in enumerate(rows.field("claimed").to_pylist()):
                    at = 32 * address(size, 0, leaf)
                    own = row["log"][at : at + 32]
                    sides, others = siblings(row["log"], size, height, leaf)
                    node = fold(claimed or own, sides, others)
                    if node not in upper:
                        upper[node] = fold(node, row["sides"], row["others"]).hex()
                    leaves.append(own.hex())
                    digests.append(hashlib.sha256((others + row["others"]).hex().encode()).hexdigest())
                    roots.append(upper[node])
                same = [[row[c].hex()] * size for c in ("subroot", "whole")]
                yield pa.RecordBatch.from_arrays(
                    [rows.field(ident), *[pa.array(c, pa.string()) for c in (leaves, *same, digests, roots)]],
                    names=[ident, "leaf", "subroot", "root", "proof_sha256", "folded_root"],
                )

    schema = f"{ident} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return parts.select("part", "n", "log", "sides", "others", "subroot", "whole", "rows").mapInArrow(run_parts, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, digest, claimed): leaves, and those of rows with one more character where 7 divides the id's crc32."""
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select("lang", "doc_id", leaf_digest(fields).alias("digest"), F.when(hit, leaf_digest(changed)).alias("claimed"))


def checked_documents(docs: DataFrame) -> DataFrame:
    """Every document with its leaf, proof and the root that the tampered table leads to."""
    made = manifest(staged(document_leaves(docs), "leaves"), "lang", "doc_id")
    return verified(proofs(made), "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))
