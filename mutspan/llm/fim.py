"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of at most FRAME_BYTES bytes,
each with the counts of units (lines) ended, characters and bytes before it. To cut at a unit, the
frame is found by its counts and only that frame is decompressed. The output is
again a list of frames: those between the cuts are copied as they are, the parts
of cut frames and the marks are compressed anew. Digests and the restored text
are streamed frame by frame in order, so a task holds one compressed text and
one frame of it.

Defined cases: a null text is empty; an empty text, one that holds a mark, and
one outside the rate stay plain; a null id counts as an empty one in the seed;
repeated ids are cut at the same shares; only doc_id and text are read; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutspan.llm.common import blocks, staged

FRAME_BYTES = 65_536
LEVEL = 3
SEED = 7
RATE = 100  # of 100 texts
SPM_RATE = 50  # of 100 transformed texts
PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
FRAME = "struct<units:long,chars:long,bytes:long,data:binary>"


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers below 2 ** 32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def count_chars(text: bytes) -> int:
    """Code points of UTF-8 bytes: all but continuation bytes."""
    return len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


def store(docs: DataFrame, seed: int = SEED, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, draws, n, n_chars, n_bytes, marked, frames) per document; marked: the text holds a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for block in blocks(batches):
            n, chars, sizes, marked, frames = [], [], [], [], []
            for text in block.texts():
                units = seen = 0
                kept = []
                for at in range(0, len(text), frame_bytes):
                    part = text[at : at + frame_bytes]
                    kept.append({"units": units, "chars": seen, "bytes": at, "data": press.compress(part)})
                    units += part.count(b"\n")
                    seen += count_chars(part)
                n.append(units + (text[-1:] not in (b"", b"\n")))
                chars.append(seen)
                sizes.append(len(text))
                marked.append(any(m in text for m in MARKS))
                frames.append(kept)
            kind = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [block.rows["doc_id"], block.rows["draws"], *[pa.array(c, pa.int64()) for c in (n, chars, sizes)], pa.array(marked, pa.bool_()), pa.array(frames, kind)],
                names=["doc_id", "draws", "n", "n_chars", "n_bytes", "marked", "frames"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, draws array<long>, n long, n_chars long, n_bytes long, marked boolean, frames array<{FRAME}>"
    return docs.select("doc_id", draws(F.col("doc_id"), seed).alias("draws"), "text").mapInArrow(run, schema)


class Text:
    """A stored text: its frames, found by the counts before them."""

    def __init__(self, row: dict):
        self.frames, self.n, self.n_chars = row["frames"], row["n"], row["n_chars"]
        self.open = zstandard.ZstdDecompressor()
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def frame(self, i: int) -> bytes:
        return self.open.decompress(self.frames[i]["data"])

    def seek(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, characters before) of the end of the unit-th unit."""
        if unit == 0:
            return 0, 0, 0
        if unit == self.n:
            return len(self.frames), 0, self.n_chars
        i = bisect.bisect_left(self.frames, unit, key=lambda f: f["units"]) - 1
        data, at = self.frame(i), -1
        for _ in range(unit - self.frames[i]["units"]):
            at = data.index(b"\n", at + 1)
        return i, at + 1, self.frames[i]["chars"] + count_chars(data[: at + 1])

    def between(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> list[bytes]:
        """Frames of the text from start to end; only cut frames are compressed anew."""
        (a, from_byte, _), (b, to_byte, _) = start, end
        if a == b:
            return [self.press.compress(self.frame(a)[from_byte:to_byte])] if from_byte < to_byte else []
        head = [self.press.compress(self.frame(a)[from_byte:])] if from_byte else [self.frames[a]["data"]]
        tail = [self.press.compress(self.frame(b)[:to_byte])] if to_byte else []
        return head + [f["data"] for f in self.frames[a + 1 : b]] + tail


def form_of(row: dict, rate: int, spm_rate: int) -> str:
    """plain, psm or spm."""
    if not row["n"] or row["marked"] or row["draws"][2] % 100 >= rate:
        return "plain"
    return "spm" if row["draws"][3] % 100 < spm_rate else "psm"


def rearranged(text: Text, first: int, last: int, form: str) -> tuple[list[bytes], int, int]:
    """(output frames, characters of the prefix, of the middle) for cuts after the first-th and last-th unit."""
    a, b = text.seek(first), text.seek(last)
    prefix, middle, suffix = text.between((0, 0, 0), a), text.between(a, b), text.between(b, text.seek(text.n))
    p, s, m = [[text.press.compress(mark)] for mark in MARKS]
    output = p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle
    return output, a[2], b[2] - a[2]


def transform(stored: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per stored text; output: zstandard frames in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                forms, prefixes, middles, outputs = [], [], [], []
                for row in part.select(["draws", "n", "n_chars", "marked", "frames"]).to_pylist():
                    form = form_of(row, rate, spm_rate)
                    if form == "plain":
                        found = [f["data"] for f in row["frames"]], None, None
                    else:
                        cuts = sorted(h % (row["n"] + 1) for h in row["draws"][:2])
                        found = rearranged(Text(row), *cuts, form)
                    for column, value in zip((outputs, prefixes, middles), found):
                        column.append(value)
                    forms.append(form)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["n"], pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.list_(pa.binary()))],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
    return stored.mapInArrow(run, schema)


def streamed(frames: list[bytes], start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Bytes start to end of the frames' text, a frame at a time; frames outside are not decompressed."""
    open_frame, at = zstandard.ZstdDecompressor(), 0
    for data in frames:
        size = zstandard.frame_content_size(data)
        if at + size > start and (end is None or at < end):
            yield open_frame.decompress(data)[max(0, start - at) : None if end is None else end - at]
        at += size


def mark_places(frames: list[bytes], marks: list[bytes]) -> list[int]:
    """Byte at which each mark first stands after the one before it."""
    places, tail, at = [], b"", 0
    for data in streamed(frames):
        text, base, found = tail + data, at - len(tail), 0
        while len(places) < len(marks) and (found := text.find(marks[len(places)], found)) >= 0:
            places.append(base + found)
            found += len(marks[len(places) - 1])
        if len(places) == len(marks):
            break
        tail, at = text[found if found > 0 else 0 :][-2:], at + len(data)
    return places


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text that an output was made from, by the output and its form alone."""
    if form == "plain":
        yield from streamed(frames)
        return
    order = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    places = mark_places(frames, order)
    ends = [*places[1:], None]
    parts = {mark: (place + len(mark), end) for mark, place, end in zip(order, places, ends)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from streamed(frames, *parts[mark])


def digest(parts: Iterator[bytes]) -> str:
    found = hashlib.sha256()
    for part in parts:
        found.update(part)
    return found.hexdigest()


def digests(made: DataFrame) -> DataFrame:
    """Rows of `transform` with output_sha256 and restored_sha256 in place of output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, back = [], []
            for frames, form in zip(batch["output"], batch["form"].to_pylist()):
                frames = frames.as_py()
                out.append(digest(streamed(frames)))
                back.append(digest(restored(frames, form)))
            kept = [c for c in batch.schema.names if c != "output"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(out, pa.string()), pa.array(back, pa.string())], names=[*kept, "output_sha256", "restored_sha256"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name != "output"]
    return made.mapInArrow(run, ", ".join([*fields, "output_sha256 string", "restored_sha256 string"]))


def transformed(docs: DataFrame) -> DataFrame:
    """Every document rearranged, from its stored frames."""
    return transform(staged(store(docs), "frames"))
