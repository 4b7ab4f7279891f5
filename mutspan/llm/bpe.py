"""Byte-level BPE encoding and decoding by a pair occurrence index.

The texts of a block are cut into pieces (the vocabulary's split pattern) with
numpy, equal pieces are kept once, and the symbols of all distinct pieces stand
in one array. An index maps each rank (a mergeable pair) to all its positions;
active ranks are applied in ascending order, and each merge updates the lists
of the pairs that it makes.

Defined cases: null text counts as empty and has no ids; a special token's own
string in a text is that token, as in the tokenizers library; repeated rows are
encoded each; extra columns stay untouched; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mutspan.llm.common import blocks, mix, run_starts, spread_ranges

_U = np.uint64
LETTER, NUMBER, SPACE, OTHER, END = range(5)
#: Text of one pair index; bounds what a worker holds.
BLOCK_BYTES = 3_000_000
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Vocabulary:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for text, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in text) if text not in self.special else text.encode()
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.of_byte = np.array([ids[c] for c in byte_letters()], np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in merges]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.known = Known()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where the pair is no merge."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    @functools.cached_property
    def classes(self) -> np.ndarray:
        """Letter, number, white space or other for every code point."""
        category = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((category.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.int8, 0x110000)
        out[WHITE_SPACE] = SPACE
        return out

    @functools.cached_property
    def unassigned(self) -> np.ndarray:
        """Code points that this Python's tables do not know; the library's tables may."""
        return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)

    def learn_classes(self, points: np.ndarray) -> None:
        """Ask the library's own splitter about code points that unicodedata leaves open."""
        from tokenizers import pre_tokenizers

        split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in points[self.unassigned[points]].tolist():
            self.unassigned[c] = False
            if split("a" + chr(c))[0][1] == (0, 2):
                self.classes[c] = LETTER
            elif split("1" + chr(c))[0][1] == (0, 2):
                self.classes[c] = NUMBER


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def piece_bounds(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Starts of pieces by the split pattern, given code points and their classes.

    A run of one class is a piece; one blank before a letter, number or other
    run belongs to it; the last white space before such a run else stands alone;
    an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    follows = np.append(kind[starts[1:]], END)
    white = (kind[starts] == SPACE) & (follows != END)
    last = ends[white] - 1  # of white space before something
    begin[last] = True
    joined = last[points[last] == 0x20]
    begin[joined + 1] = False
    # contractions
    mark = np.flatnonzero((points[:-1] == 0x27) & begin[:-1] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    one, two = points[mark + 1], points[np.minimum(mark + 2, n - 1)]
    two = np.where((mark + 2 < n) & (kind[np.minimum(mark + 2, n - 1)] == LETTER), two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for hit, length in ((short, 2), (long, 3)):
        at = mark[hit]
        begin[at + 1] = False
        after = at + length
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Pieces:
    """Distinct pieces of some texts (by a 64-bit hash) and each text's row of them."""

    def __init__(self, texts: list[str], vocab: Vocabulary):
        parts, marks, counts = [], [], []  # marks: special id that ends the part, or -1
        for text in texts:
            rest = split_special(text, vocab.special)
            counts.append(len(rest))
            for part, mark in rest:
                parts.append(part)
                marks.append(mark)
        joined = "\0".join([*parts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.raw = joined.encode()
        data = np.frombuffer(self.raw + bytes(8), np.uint8)
        byte_at = np.append(np.flatnonzero((data[: len(self.raw)] & 0xC0) != 0x80), len(self.raw))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1  # sentinel after each part
        rare = points[points >= 0x80]
        vocab.learn_classes(np.flatnonzero(np.bincount(rare)) if len(rare) else rare)
        kind = vocab.classes[points]
        kind[ends] = END
        starts = piece_bounds(points, kind)
        is_end = kind[starts] == END
        self.starts = byte_at[starts]
        self.ends = np.append(self.starts[1:], len(self.raw))
        h = self.hashes(data)
        h[is_end] = 0
        order = np.argsort(h)
        ordered = h[order]
        runs = run_starts(ordered)
        self.distinct = ordered[runs]
        self.sample = order[runs]  # one piece of each
        self.index = np.empty(len(h), np.int64)
        self.index[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(h))))
        # sentinels stand for the special token that ended the part, or for nothing
        marks = np.array(marks, np.int64)
        self.index[is_end] = np.where(marks >= 0, -1 - marks, -1 - vocab.size)
        closes = np.flatnonzero(is_end)
        self.text_ends = closes[np.cumsum(counts) - 1] + 1 if counts else np.zeros(0, np.int64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """64 bits of each piece, eight bytes a step."""
        eight = np.lib.stride_tricks.as_strided(data[:8].view(_U), (len(data) - 7,), (1,))
        h = mix((self.ends - self.starts).astype(_U) + _U(1))
        live, at = np.arange(len(h)), self.starts
        while len(live):
            left = self.ends[live] - at
            part = eight[at]
            short = left < 8
            part[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
            h[live] = mix((h[live] ^ part) * _U(0x9E3779B97F4A7C15) + _U(1))
            more = left > 8
            live, at = live[more], at[more] + 8
        return h

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        at = self.sample[which]
        return [self.raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


class Known:
    """Ids of pieces met before in this process, at most `limit` of them."""

    def __init__(self, limit: int = 250_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.lengths = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is new."""
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > self.limit:
            self.clear()
        if len(hashes) > self.limit:
            return
        starts = np.concatenate([self.starts, bounds[:-1] + len(self.ids)])
        lengths = np.concatenate([self.lengths, np.diff(bounds)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes)
        self.hashes, self.starts, self.lengths = hashes[order], starts[order], lengths[order]


def split_special(text: str, special: dict[str, int]) -> list[tuple[str, int]]:
    """Parts of a text and the special id after each (-1: none)."""
    out, rest = [], text
    while found := min(((rest.find(s), -len(s), s) for s in special if s in rest), default=None):
        out.append((rest[: found[0]], special[found[2]]))
        rest = rest[found[0] + len(found[2]) :]
    return [*out, (rest, -1)]


def distinct(positions: np.ndarray) -> np.ndarray:
    positions = np.sort(positions)
    return positions[run_starts(positions)]


def merge_pieces(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in one array, with bounds, by the pair occurrence index."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = vocab.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbols)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    right = np.arange(1, n + 1)  # next living symbol of the piece, n: none
    left = np.arange(-1, n - 1)
    bounds = np.cumsum(sizes)
    right[bounds[sizes > 0] - 1] = n
    left[(bounds - sizes)[sizes > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}

    def note(positions: np.ndarray) -> None:
        """Enter the pairs that begin at these positions."""
        ranks = vocab.ranks(symbols[positions], symbols[right[positions]])
        good = ranks >= 0
        positions, ranks = positions[good], ranks[good]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = run_starts(ranks).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(ranks)]):
            rank = int(ranks[a])
            if rank in index:
                index[rank].append(positions[a:b])
            else:
                index[rank] = [positions[a:b]]
                heapq.heappush(active, rank)

    active: list[int] = []
    alive = np.ones(n, bool)
    note(np.flatnonzero(right < n))
    left_of, right_of, made_of = vocab.left.tolist(), vocab.right.tolist(), vocab.made.tolist()
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
        a, b, made = left_of[rank], right_of[rank], made_of[rank]
        after = right[at]
        ok = (symbols[at] == a) & alive[at] & (after < n)
        ok &= symbols[np.where(ok, after, 0)] == b
        if not ok.all():
            at = at[ok]
            if not len(at):
                continue
            after = right[at]
        if a == b and len(at) > 1:
            # in a run of equal symbols every second pair merges, from the left
            chained = np.zeros(len(at), bool)
            chained[1:] = after[:-1] == at[1:]
            spot = np.arange(len(at))
            first = np.maximum.accumulate(np.where(chained, 0, spot))
            keep = (spot - first) % 2 == 0
            at, after = at[keep], after[keep]
        symbols[at] = made
        alive[after] = False
        beyond = right[after]
        right[at] = beyond
        inner = beyond < n
        left[beyond[inner]] = at[inner]
        before = left[at]
        before = before[before >= 0]
        touched = np.concatenate([before, at[inner]])
        if len(touched):
            note(distinct(touched))
    counts = np.bincount(owner[alive], minlength=len(pieces))
    return symbols[alive], np.concatenate([[0], np.cumsum(counts)])


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's ids end."""
    pieces = Pieces(texts, vocab)
    known = vocab.known
    place = known.find(pieces.distinct)
    new = np.flatnonzero((place < 0) & (pieces.distinct != 0))
    ids, bounds = merge_pieces(pieces.bytes_of(new), vocab)
    # after the known ids stand the new ones, all ids once (for special tokens), and an empty range
    base = len(known.ids)
    everything = np.concatenate([known.ids, ids.astype(np.int32), np.arange(vocab.size, dtype=np.int32)])
    starts, lengths = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    old = place >= 0
    starts[old], lengths[old] = known.starts[place[old]], known.lengths[place[old]]
    starts[new], lengths[new] = bounds[:-1] + base, np.diff(bounds)
    known.add(pieces.distinct[new], ids, bounds)
    ordinary = pieces.index >= 0
    which = np.where(ordinary, pieces.index, 0)
    starts = np.where(ordinary, starts[which], base + len(ids) - 1 - pieces.index)
    lengths = np.where(ordinary, lengths[which], pieces.index != -1 - vocab.size)
    total = np.concatenate([[0], np.cumsum(lengths)])
    return everything[spread_ranges(starts, lengths)], total[pieces.text_ends]


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    """Text of some ids; bytes that are no UTF-8 become the replacement character."""
    return b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) per row: every whole text encoded in Arrow batches, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_rows, ids, ends in encoded_blocks(batches, path, text_column):
            bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(ids))
            yield pa.RecordBatch.from_arrays([block_rows.column(0), lists], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def encoded_blocks(batches, path: str, text_column: str = "text"):
    vocab = vocabulary(path)
    for block in blocks(batches, text_column, BLOCK_BYTES):
        texts = [t.decode("utf-8", "replace") for t in block.texts()]
        ids, ends = encode_texts(texts, vocab)
        yield block.rows, ids, ends


def decode(encoded: DataFrame, path: str, ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace a column of ids by the decoded text; null ids give null."""
    keep = [f for f in encoded.schema.fields if f.name != ids_column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{ids_column}` array<int>", f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = batch.column(len(keep))
            texts = [None if not v.is_valid else decode_ids(v.values.to_pylist(), vocab) for v in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return encoded.select(*[f"`{f.name}`" for f in keep], f"`{ids_column}`").mapInArrow(run, schema)
