"""Packing of token pieces by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `capacity` ids. Only the histogram of
piece lengths (at most `capacity` rows) reaches the driver, which places lengths
longest first: each goes to the shortest packs that have room, else into new
packs that take as many of it as they hold, and counts of equal packing patterns are updated. A pattern's count and
lengths give rank intervals per length; pieces join them by their rank among
the pieces of that length. Ranks are counted in salted blocks, so a length that
a third of all pieces share is not numbered in one task.

Defined cases: null text counts as empty and is one end id; a document of n ids
gives ceil(n / capacity) pieces; repeated rows are packed each; extra columns of
a piece table are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutspan.llm.bpe import encoded_blocks
from mutspan.llm.common import binary_rows, partitions, staged

CAPACITY = 1024


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids binary) of all documents.

    ids holds little-endian unsigned 32-bit ids; a document ends with end_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, ends in encoded_blocks(batches, path):
            n = len(ends)
            closed = np.insert(ids, ends, end_id).astype("<u4")
            ends = ends + np.arange(1, n + 1)
            begins = np.concatenate([[0], ends[:-1]])
            tokens = ends - begins
            per_doc = -(-tokens // capacity)
            doc = np.repeat(np.arange(n), per_doc)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            start = nth * capacity
            length = np.minimum(tokens[doc] - start, capacity)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(tokens[doc]), binary_rows(closed, begins[doc] + start, length)],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in order, count) of all packing patterns."""
    open_packs: dict[int, list[tuple[list[int], int]]] = {}  # by room left
    full: list[tuple[list[int], int]] = []
    rooms = np.zeros(capacity + 1, np.int64)  # packs by room left

    def put(pattern: list[int], count: int, room: int) -> None:
        if room:
            open_packs.setdefault(room, []).append((pattern, count))
            rooms[room] += count
        else:
            full.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                # a new pack is the shortest one until it is full, so it takes as many copies as it holds
                copies = capacity // length
                for times, packs in ((copies, left // copies), (left % copies, 1)):
                    if times and packs:
                        put([length] * times, packs, capacity - times * length)
                break
            room = length + int(fits[-1])  # the shortest pack has the most room
            pattern, count = open_packs[room].pop()
            took = min(left, count)
            rooms[room] -= count
            if count > took:
                put(pattern, count - took, room)
            put([*pattern, length], took, room - length)
            left -= took
    return full + [p for packs in open_packs.values() for p in packs]


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, copies, first sequence, offset) of every run of equal lengths in every pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, count in patterns:
        offset = 0
        for length, run in itertools.groupby(lengths):
            copies = len(list(run))
            first = taken.get(length, 0)
            out.append((length, first, count * copies, copies, sequence, offset))
            taken[length] = first + count * copies
            offset += length * copies
        sequence += count
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds `rank`, from 0, among the pieces of the same length."""
    salts = max(64, partitions(pieces.sparkSession))
    salted = pieces.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, start), {salts})").cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "salt", before.alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    numbered = salted.withColumn("nth", F.row_number().over(order) - 1)
    return numbered.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth")).drop("salt", "nth", "before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a materialised table of pieces (doc_id, start, length, ...)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(place(histogram, capacity))
    schema = "length long, first_rank long, ranks long, copies long, first_sequence long, first_offset long"
    # its rows are bounded by the capacity alone: each length splits at most the patterns in being
    table = spark.createDataFrame(places, schema)
    row = ranked(pieces).join(F.broadcast(table), "length")
    hit = row.where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
    nth = F.col("rank") - F.col("first_rank")
    placed = hit.withColumn("sequence_id", F.col("first_sequence") + F.floor(nth / F.col("copies")))
    placed = placed.withColumn("offset", F.col("first_offset") + nth % F.col("copies") * F.col("length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Whole operator: cut, digest each piece's ids, pack."""
    pieces = cut(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(staged(pieces, "pieces"), capacity)
