"""Quality classifier: supervised subword embeddings trained with numpy SGD.

Words, their character n-grams and word pairs (hashed to two buckets: a word
repeated, or not) have learned vectors; a document is the average of the vectors
of all its features, followed by a softmax over the two labels. Training takes a
bounded sample of labelled rows (SAMPLE_ROWS rows and SAMPLE_BYTES of whole texts,
by hash of the id, over all sources alike); every document is scored whole. As
the last layer is linear, a trained model reduces to one number per feature, so
scoring a block hashes each distinct word once.

Defined cases: null and empty texts have no features and score the bias alone;
labels null or other than 0 and 1 are not learned; repeated labels of an id
count once, with the smallest label; without labels of both kinds the score is
the share of label 1 (0.5 without any label); extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutspan.llm.common import Words, blocks, mix, run_starts, spread_ranges, staged

_U = np.uint64
#: Labelled documents that training sees at most.
SAMPLE_ROWS = 4000
#: Bytes of their texts, at most; a text that would pass this bound is not learned from.
SAMPLE_BYTES = 64_000_000
BUCKETS = 1 << 18
DIM = 8
#: SGD steps, a document each: five rounds of a full sample, more of a small one.
STEPS = 20_000
RATE = 0.8
GRAMS = (3, 4, 5)
#: Buckets of the word bigrams: the same word twice, and any other pair.
SAME, OTHER = BUCKETS, BUCKETS + 1


@dataclasses.dataclass
class Model:
    """Logit of label 1: bias + mean of `weight` over a document's features (n-grams, words, word pairs)."""

    weight: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of some words, word by word, and how many each has."""
    lengths = ends - starts
    # <word>, one after the other
    framed_at = np.cumsum(lengths + 2) - (lengths + 2)
    framed = np.empty(int((lengths + 2).sum()) + 8, np.uint8)
    framed[-8:] = 0
    framed[framed_at] = ord("<")
    framed[framed_at + lengths + 1] = ord(">")
    framed[spread_ranges(framed_at + 1, lengths)] = data[spread_ranges(starts, lengths)]
    size = len(framed) - 8
    eight = np.lib.stride_tricks.as_strided(framed[:8].view(_U), (size + 1,), (1,))
    # characters: a first byte and the bytes 10xxxxxx behind it
    first = np.flatnonzero((framed[:size] & 0xC0) != 0x80)
    width = np.minimum(np.diff(np.append(first, size)), 7)
    char = eight[first] & ((_U(1) << (width.astype(_U) * _U(8))) - _U(1))
    char_at = np.searchsorted(first, framed_at)
    number = np.diff(np.append(char_at, len(first)))
    per_gram = [np.maximum(number + 1 - n, 0) for n in GRAMS]
    counts = 1 + sum(per_gram)
    at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    out[at] = (hashes % _U(BUCKETS)).astype(np.int32)
    at = at + 1
    gram = np.zeros(len(char), _U)
    for n in range(1, max(GRAMS) + 1):
        here = max(0, len(char) + 1 - n)
        gram = mix(gram[:here] * _U(31) + char[n - 1 :] + _U(n))  # of the n characters from here on
        if n in GRAMS:
            per = per_gram[GRAMS.index(n)]
            out[spread_ranges(at, per)] = (gram[spread_ranges(char_at, per)] % _U(BUCKETS)).astype(np.int32)
            at = at + per
    return out, counts


class Features:
    """Features of a block: distinct words with their buckets, and each document's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        hashes = words.hashes()
        order = np.argsort(hashes)
        runs = run_starts(hashes[order])
        self.word = np.empty(len(hashes), np.int64)
        self.word[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(hashes))))
        one = order[runs]
        self.buckets, self.counts = word_features(data, words.starts[one], words.ends[one], hashes[one])
        self.ranges = words.ranges
        again = np.zeros(len(self.word) + 1, np.int64)
        again[1:-1] = self.word[1:] == self.word[:-1]
        first = self.ranges[:-1][self.ranges[:-1] < self.ranges[1:]]
        again[first] = 0
        total = np.concatenate([[0], np.cumsum(again[:-1])])
        self.same = total[self.ranges[1:]] - total[self.ranges[:-1]]
        self.other = np.maximum(np.diff(self.ranges) - 1, 0) - self.same

    def sums(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document: sum of `weight` over its features, and their number."""
        n = len(self.ranges) - 1
        if not len(self.word):
            return np.zeros(n), np.zeros(n)
        at = np.cumsum(self.counts) - self.counts
        per_word = np.add.reduceat(weight[self.buckets], at)
        total = np.concatenate([[0.0], np.cumsum(per_word[self.word])])
        number = np.concatenate([[0], np.cumsum(self.counts[self.word])])
        sums = total[self.ranges[1:]] - total[self.ranges[:-1]] + weight[SAME] * self.same + weight[OTHER] * self.other
        return sums, number[self.ranges[1:]] - number[self.ranges[:-1]] + self.same + self.other


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Plain SGD, a document a step, with a rate that falls to zero."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        logit = 0.0 if not len(labels) else (8.0 if share == 1 else -8.0)
        return Model(np.zeros(BUCKETS + 2, np.float32), logit)
    docs = []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        f = Features(raw, np.array([0, len(raw)]))
        times = np.bincount(f.word, minlength=len(f.counts))
        buckets = np.append(f.buckets, [SAME, OTHER])
        every = np.concatenate([np.repeat(times, f.counts), f.same, f.other])
        order = np.argsort(buckets, kind="stable")
        runs = run_starts(buckets[order])
        sums = np.add.reduceat(every[order], runs)
        docs.append((buckets[order][runs], (sums / max(1, sums.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = ((rng.random((BUCKETS + 2, DIM), np.float32) - 0.5) * (2 / DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.array([np.log(1 - share), np.log(share)], np.float32)
    epochs = -(-STEPS // len(docs))
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            which, part = docs[i]
            rows = table[which]
            hidden = part @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            table[which] = rows - (rate * DIM) * np.outer(part, back)
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """At most `rows` labelled training documents of `size` bytes together, in id order; texts are whole."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` ids
    found = staged(texts.groupBy("doc_id", "quality").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), "sample")
    sizes = found.select("doc_id", F.octet_length("text").alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, out = 0, []
    for r in sizes:  # `rows` numbers at most
        if total + r["bytes"] <= size:
            total += r["bytes"]
        else:
            out.append(r["doc_id"])
    fitting = found.where(~F.col("doc_id").isin(out)).orderBy("doc_id").toPandas()
    return fitting["text"].tolist(), fitting["quality"].to_numpy(np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row as a struct, and the probability of label 1 for its whole text."""
    rows = docs.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "row.text"):
            total, number = Features(block.data, block.offsets).sums(model.weight)
            logit = np.clip(model.bias + total / np.maximum(number, 1), -30, 30)
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(1 / (1 + np.exp(-logit)))], names=["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, score) with a model trained on the labelled rows of docs."""
    return score(docs, train(*sample(docs, labels)))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Whole operator: (doc_id, held_out, score, predicted) per document."""
    scored = rated(docs, labels)
    return scored.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
