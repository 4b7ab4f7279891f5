"""Character features of the quality classifier, and its bounded sample, beside plain versions."""

import numpy as np
import pytest

from mutspan.llm import quality
from mutspan.llm.common import Words, mix


def plain_grams(word):
    framed = f"<{word}>"
    out = []
    for n in quality.GRAMS:
        for i in range(len(framed) + 1 - n):
            h = np.zeros(1, np.uint64)
            for j, c in enumerate(framed[i : i + n]):
                h = mix(h * np.uint64(31) + np.uint64(int.from_bytes(c.encode(), "little")) + np.uint64(j + 1))
            out.append(int(h[0]) % quality.BUCKETS)
    return out


@pytest.mark.parametrize("text", ["a", "naïve café", "日本語のテキスト x", "😀😀 ab", "  ", "", "word " * 9])
def test_grams_are_of_characters(text):
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]))
    buckets, counts = quality.word_features(data, words.starts, words.ends, words.hashes())
    at = 0
    assert len(counts) == len(text.split())
    for word, n in zip(text.split(), counts):
        assert buckets[at + 1 : at + n].tolist() == plain_grams(word)
        at += n


def test_sample_is_bounded_by_bytes_and_keeps_texts_whole(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(60)] + [(60, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    every, marks = quality.sample(docs, labels)
    some, _ = quality.sample(docs, labels, size=3000)
    assert len(every) == len(marks) and set(some) < set(every) and 0 < sum(map(len, some)) <= 3000
    assert all(len(t) % 10 == 0 for t in some)
    assert quality.sample(docs.limit(0), labels)[0] == []
