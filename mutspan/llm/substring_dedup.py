"""Substring deduplication by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the
smallest hash among its GRAM-word grams (a function of the window's words
alone); consecutive windows whose minimisers have one value form a
super-k-mer, so a run of one word or phrase is a single one. Equal windows share
the minimiser's value, so:

1. every document sends (bucket, start, windows, several) per super-k-mer, no
   text; several: its minimiser stands at more than one position;
2. a bucket met only once, and not at several positions, holds no repeated
   window and goes no further;
3. the others travel as one packed string to their bucket, where sorting the
   windows counts them exactly, word by word;
4. a bucket with over HOT windows is not sent to one task: the distinct windows
   of each super-k-mer are counted by a grouped aggregate on the whole window
   instead, equally exact, and meet their counts in salted parts;
5. documents drop each word that a repeated window covers.

Documents are known by (doc_id, hash of the text): rows that agree in both get
the same answer, and each counts as an occurrence.

Defined cases: null text has no words; a document with fewer words than a
window keeps all; ties and repeated rows count as occurrences; extra columns
are carried by the caller; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutspan.llm.common import Block, Words, binary_rows, blocks, mix, spread_ranges, staged

_U = np.uint64
WINDOW = 35
GRAM = 4
#: Windows that one bucket sorts in memory.
HOT = 200_000
SALTS = 32
_LOW = _U((1 << 24) - 1)


def with_key(docs: DataFrame) -> DataFrame:
    """(row, text, key): the whole row as a struct, empty text for null."""
    text = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return text.withColumn("key", F.xxhash64("row.doc_id", "text", F.octet_length("text")))


class Packed:
    """Words of a block in a buffer that joins them by one blank."""

    def __init__(self, block: Block):
        words = Words(block.data, block.offsets)
        self.ranges, self.words = words.ranges, words
        lengths = words.ends - words.starts
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.ends = self.starts + lengths
        self.buffer = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
        self.buffer[spread_ranges(self.starts, lengths)] = block.data[spread_ranges(words.starts, lengths)]


def super_kmers(packed: Packed, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first window's word, number of windows, minimiser at several positions) of a block's super-k-mers; words count over the block."""
    h = packed.words.hashes()
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    value = np.zeros(n - gram + 1, _U)
    for j in range(gram):
        value = mix(value * _U(0x9E3779B97F4A7C15) + h[j : n - gram + 1 + j])
    # the position in the low bits makes the leftmost of equal values the smallest
    best = (value & ~_LOW) | (np.arange(len(value)).astype(_U) & _LOW)
    span, reach = window - gram + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        best = np.minimum(best[: len(best) - step], best[step:])
        reach += step
    first = np.arange(len(best))
    at = first + ((best - first.astype(_U)) & _LOW).astype(np.int64)
    ends = packed.ranges[1:]
    inside = first + window <= ends[np.searchsorted(ends, first, "right")] if len(ends) else np.zeros(0, bool)
    good = np.flatnonzero(inside)
    at = at[good]
    changed = np.ones(len(good), bool)
    changed[1:] = (value[at[1:]] != value[at[:-1]]) | (np.diff(good) > 1)
    begin = np.flatnonzero(changed)
    count = np.diff(np.append(begin, len(good)))
    return value[at[begin]].view(np.int64), good[begin], count, at[begin] != at[begin + count - 1]


def listed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(bucket, key, start, windows, several) per super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            packed = Packed(block)
            bucket, start, count, several = super_kmers(packed, window, gram)
            doc = np.searchsorted(packed.ranges, start, "right") - 1
            keys = block.rows.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(keys[doc], pa.int64()), pa.array((start - packed.ranges[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(several)],
                names=["bucket", "key", "start", "windows", "several"],
            )

    return docs.select("text", "key").mapInArrow(run, "bucket long, key long, start int, windows int, several boolean")


def packed_strings(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(bucket, key, start, packed) of the wanted super-k-mers, read from their documents."""
    lists = wanted.groupBy("key").agg(F.collect_set(F.struct("bucket", "start", "windows")).alias("list"))
    met = docs.select("key", "row").join(lists, "key")  # the same exchange of documents serves the last join

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "row.text"):
            packed = Packed(block)
            lists = block.rows.column(2)
            counts = lists.value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(block)), counts)
            part = lists.flatten()
            column = lambda name: part.field(name).to_numpy()  # noqa: B023, E731
            start, windows = column("start").astype(np.int64), column("windows").astype(np.int64)
            first = packed.ranges[doc] + start
            a, b = packed.starts[first], packed.ends[first + windows + window - 2]
            keys = block.rows.column(0).to_numpy()
            for cut in range(0, len(first), 20_000):
                some = slice(cut, cut + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column("bucket")[some]), pa.array(keys[doc[some]]), pa.array(start[some].astype(np.int32)), binary_rows(packed.buffer, a[some], (b - a)[some])],
                    names=["bucket", "key", "start", "packed"],
                )

    return met.mapInArrow(run, "bucket long, key long, start int, packed binary")


def windows_of(packed: bytes, window: int) -> Iterator[tuple[bytes, int]]:
    """(window, place) of every window of a packed string."""
    ends = np.flatnonzero(np.frombuffer(packed + b" ", np.uint8) == 0x20)
    begins = np.concatenate([[0], ends[:-1] + 1])
    for i, (a, b) in enumerate(zip(begins[: len(ends) - window + 1].tolist(), ends[window - 1 :].tolist())):
        yield packed[a:b], i


def grouped(windows: Iterable[tuple[bytes, int]], start: int) -> dict[bytes, list[int]]:
    """Starts of each distinct window."""
    places = defaultdict(list)
    for text, at in windows:
        places[text].append(start + at)
    return places


def repeated_in_bucket(rows: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int]]:
    """(key, start) of windows in (key, start, packed) rows of one bucket that occur twice or more."""
    found = sorted((text, key, start + i) for key, start, packed in rows for text, i in windows_of(packed, window))
    out = []
    for k, (text, key, start) in enumerate(found):
        if k and found[k - 1][0] == text or k + 1 < len(found) and found[k + 1][0] == text:
            out.append((key, start))
    return out


def repeated_windows(keyed: DataFrame, wanted: DataFrame, window: int, hot: int) -> DataFrame:
    """(key, start) of every repeated window of the wanted super-k-mers (bucket, n, key, start, windows); n: windows of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        keys, starts = [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32())], names=["key", "start"])
            keys.clear()
            starts.clear()
            return batch

        def close() -> None:
            for key, start in repeated_in_bucket(rows, window):
                keys.append(key)
                starts.append(start)

        for batch in batches:
            for b, key, start, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    close()
                    bucket, rows = b, []
                    if len(keys) > 50_000:
                        yield out()
                rows.append((key, start, packed))
        close()
        yield out()

    some = packed_strings(keyed, wanted.where(F.col("n") <= hot), window)
    sorted_buckets = some.repartition("bucket").sortWithinPartitions("bucket")
    in_buckets = sorted_buckets.mapInArrow(run, "key long, start int")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, packed in zip(*(c.to_pylist() for c in batch.columns)):
                found = windows_of(packed, window)
                while places := grouped(itertools.islice(found, 20_000), start):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(places), pa.int64()), pa.array(places.values(), pa.list_(pa.int32())), pa.array(places, pa.binary())],
                        names=["key", "starts", "text"],
                    )

    large = packed_strings(keyed, wanted.where(F.col("n") > hot), window).select("key", "start", "packed").mapInArrow(explode, "key long, starts array<int>, text binary")
    large = large.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    # a window may be in a third of all documents: counts meet first, then its rows in salted parts
    sums = large.groupBy("text", "salt").agg(F.sum(F.size("starts")).alias("n")).groupBy("text").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    twice = sums.where(F.col("n") > 1).select("text", F.explode("salts").alias("salt"))
    return in_buckets.union(large.join(twice, ["text", "salt"], "left_semi").select("key", F.explode("starts").alias("start")))


def repeated_starts(keyed: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(key, starts): first words of the repeated windows of each document that has any."""
    parts = listed(keyed, window, gram)
    # both are written: the join can then split a hot bucket, and what follows does not list again
    met = parts.groupBy("bucket").agg(F.sum("windows").alias("n"), F.count(F.lit(1)).alias("times"), F.bool_or("several").alias("again"))
    often = staged(met.where((F.col("times") > 1) | F.col("again")).select("bucket", "n"), "buckets")
    wanted = staged(parts.drop("several").join(often, "bucket"), "wanted")
    found = repeated_windows(keyed, wanted, window, hot)
    return found.groupBy("key").agg(F.collect_set("start").alias("starts"))


def cleaned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(row, n_words, n_removed, kept): each row as a struct, and its kept words joined by one blank."""
    keyed = with_key(docs)
    marked = keyed.select("key", "row").join(repeated_starts(keyed, window, gram, hot), "key", "left").select("row", "starts")
    kind = marked.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "row.text"):
            packed = Packed(block)
            n = len(packed.starts)
            gone = np.zeros(n + 1, np.int64)
            starts = block.rows.column(1)
            counts = starts.value_lengths().fill_null(0).to_numpy()
            first = np.repeat(packed.ranges[:-1], counts) + starts.flatten().to_numpy()
            np.add.at(gone, first, 1)
            np.add.at(gone, first + window, -1)
            keep = np.cumsum(gone)[:n] == 0
            # a kept word with its blank; each document's last blank goes
            lengths = packed.ends - packed.starts + 1
            flat = packed.buffer[np.repeat(keep, lengths)]
            ahead = np.concatenate([[0], np.cumsum(np.where(keep, lengths, 0))])[packed.ranges]
            size = np.maximum(np.diff(ahead) - 1, 0)
            kept_before = np.concatenate([[0], np.cumsum(keep)])[packed.ranges]
            words = np.diff(packed.ranges)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(words), pa.array(words - np.diff(kept_before)), binary_rows(flat, ahead[:-1], size).cast(pa.string())],
                names=["row", "n_words", "n_removed", "kept"],
            )

    return marked.mapInArrow(run, f"row {kind}, n_words long, n_removed long, kept string")
