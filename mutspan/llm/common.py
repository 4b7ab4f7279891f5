"""Helpers shared by the operators: staged tables, document blocks, hashes of words."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutspan.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes of text that one numpy pass looks at; a longer document is a block of its own.
BLOCK_BYTES = 4_000_000

_U = np.uint64
_MUL1, _MUL2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the folder that all executors share and read it back.

    Ends the lineage: later stages reread files instead of running df again, and
    a lost executor costs no more than the tasks that it ran.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"llm-{name}-{uuid.uuid4().hex[:8]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same_key_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join where two nulls are equal; the key columns come from the left."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in on})
    met = left.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], how)
    return met.drop(*[f"_{c}" for c in on])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _MUL1
    x = (x ^ (x >> _U(27))) * _MUL2
    return x ^ (x >> _U(31))


class Block:
    """Some whole documents of one Arrow batch, as bytes with offsets."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        cuts = self.offsets.tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut Arrow batches at document bounds into blocks of about `limit` bytes; null text is empty.

    text names a column, or a field of a struct column as `row.text`.
    """
    name, _, field = text.partition(".")
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        column = (pc.struct_field(column, field) if field else column).cast(pa.large_binary()).fill_null(b"")
        n = len(column)
        if not n:
            continue
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield Block(batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z in UTF-8 bytes."""
    return _FOLD[data]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block: byte bounds, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        gap = _SPACE[data]
        first = np.zeros(len(data) + 1, bool)  # of a document
        first[offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = gap[:-1]
        self.starts = np.flatnonzero(~gap & (before | first[:-1]))
        after = np.ones(len(data), bool)
        after[:-1] = gap[1:]
        self.ends = np.flatnonzero(~gap & (after | first[1:])) + 1
        self.ranges = np.searchsorted(self.starts, offsets)
        self.data, self.gap = data, gap

    def hashes(self) -> np.ndarray:
        """64 bits of each word, eight bytes a step; longer words take more steps."""
        lengths = self.ends - self.starts
        h = mix(lengths.astype(_U) * _STEP)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(_U), (len(self.data) + 1,), (1,))
        live, at = np.arange(len(h)), self.starts.copy()
        while len(live):
            left = self.ends[live] - at
            part = eight[at]
            short = left < 8
            part[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
            h[live] = mix((h[live] ^ part) * _MUL2 + _STEP)
            more = left > 8
            live, at = live[more], at[more] + 8
        return h


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for every range one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(ahead - starts, lengths)


def binary_rows(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrow binary column of the slices values[start:start+length]."""
    flat = values[spread_ranges(starts, lengths)]
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * values.itemsize, out=bounds[1:])
    return pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())]
    ).cast(pa.binary())
