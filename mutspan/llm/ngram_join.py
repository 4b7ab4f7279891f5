"""Jaccard self-join on word shingles with a token-group matrix.

1. Blocks of documents send their shingles to token buckets, packed; buckets
   count in how many documents each token is and return the shared ones. A
   token that many documents of a block hold is sent once, with its count.
2. Under one order of all tokens (rare first) two similar documents share a
   token of their prefixes, n - ceil(n * 85 / 100) + 1 tokens long. Documents
   whose prefixes hold no shared token have no partner.
3. Documents with equal shingle sets are one class. A class joins the group of
   the prefix token that most classes hold: of many near copies nearly all hold
   the first such token, nearly all others the second, and so on, so they form
   a few groups. Groups are cut into chunks of bounded size; the token-group
   matrix holds each group's union of prefix tokens.
4. A class meets a group only through a token of the matrix. There its overlap
   with the group's whole union is bounded first, and only a group that can
   still reach the needed overlap is opened and compared member by member.
5. Links inside a group and one link to each linked part of another group give
   the same components as all links; labels then spread along these links.

Defined cases: null and empty texts have no shingles and are linked with
nothing; a text of fewer words than a shingle is one shingle; repeated rows are
equal texts; a null doc_id never is a component's id unless all ids are null;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutspan.llm.common import Words, blocks, fold_case, mix, partitions, run_starts, spread_ranges, staged

_U = np.uint64
GRAM = 4
PERCENT = 85
#: Classes of a group, about, and queries that one task holds against a group.
CHUNK = 512
QUERIES = 2048
_HOT = 65535
_KEY = "bucket int, block long, vals binary, docs binary, dfs binary, info binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their bounds."""
    words = Words(fold_case(data), offsets)
    h, ranges = words.hashes(), words.ranges
    size = np.diff(ranges)
    number = np.where(size >= gram, size - gram + 1, (size > 0).astype(np.int64))
    first = spread_ranges(ranges[:-1], number)
    out = np.full(len(first), _U(gram))
    short = np.repeat(np.where(size < gram, size, gram), number)
    for j in range(gram):
        live = short > j
        out[live] = mix(out[live] * _U(0x9E3779B97F4A7C15) + h[first[live] + j])
    out = mix(out + short.astype(_U))
    bounds = np.concatenate([[0], np.cumsum(number)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][number > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def set_digests(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two halves."""
    halves = []
    for salt in (0x632BE59BD9B4E019, 0x2545F4914F6CDD1D):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(sets ^ _U(salt)))])
        halves.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return halves[0], halves[1]


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles of a set of n that any similar set shares at least."""
    return -(-percent * n // 100)


def deal_tokens(batches: Iterator[pa.RecordBatch], buckets: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, vals, docs): tokens of a block for each bucket; and one row with its documents."""
    names = [c.split()[0] for c in _KEY.split(", ")]
    number = TaskContext.get().partitionId() << 32
    for block in blocks(batches):
        for cut in range(0, len(block), 30_000):
            rows = block.rows.slice(cut, 30_000)
            offsets = block.offsets[cut : cut + 30_001]
            sets, bounds = shingle_sets(block.data[offsets[0] : offsets[-1]], offsets - offsets[0], gram)
            d1, d2 = set_digests(sets, bounds)
            n = np.diff(bounds)
            order = np.lexsort((d2, d1))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
            own = np.sort(order[fresh])  # equal sets of a block count once
            own = own[n[own] > 0]
            tokens = sets[spread_ranges(bounds[own], n[own])]
            doc = np.repeat(own, n[own])
            cell = ((tokens & _U(0xFFFFFFFF)) % _U(buckets)) << _U(32) | tokens >> _U(32)
            order = np.argsort(cell, kind="stable")
            cell, doc = cell[order], doc[order]
            runs = run_starts(cell)
            times = np.diff(np.append(runs, len(cell)))
            hot = times >= max(16, len(own) // 8)
            hot_docs = {int(cell[r]): doc[r : r + t].astype(np.int32) for r, t in zip(runs[hot], times[hot])}
            keep = ~np.repeat(hot, times)
            cell = np.concatenate([cell[keep], cell[runs[hot]]])
            count = np.concatenate([np.zeros(int(keep.sum()), np.uint32), times[hot].astype(np.uint32)])
            doc = np.concatenate([doc[keep], np.full(int(hot.sum()), _HOT)])
            order = np.argsort(cell >> _U(32), kind="stable")
            cell, count, doc = cell[order], count[order], doc[order]
            which = (cell >> _U(32)).astype(np.int64)
            runs = run_starts(which)
            ends = np.append(runs[1:], len(which))
            low, doc = cell.astype(np.uint32), doc.astype(np.uint16)
            info = {
                "ids": rows.column(0).to_pylist(), "keys": rows.column(2).to_pylist(), "n": n, "d1": d1, "d2": d2, "own": own, "hot": hot_docs,
            }
            cuts = list(zip(runs.tolist(), ends.tolist()))
            counts = [count[a:b][doc[a:b] == _HOT].tobytes() for a, b in cuts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*which[runs].tolist(), number % buckets], pa.int32()),
                    pa.array([number] * (len(cuts) + 1), pa.int64()),
                    pa.array([*(low[a:b].tobytes() for a, b in cuts), None], pa.binary()),
                    pa.array([*(doc[a:b].tobytes() for a, b in cuts), None], pa.binary()),
                    pa.array([*counts, None], pa.binary()),
                    pa.array([*[None] * len(cuts), pickle.dumps(info)], pa.binary()),
                ],
                names=names,
            )
            number += 1


def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column one after the other, and how many each row has."""
    parts = [np.frombuffer(v.as_buffer(), kind) for v in column if v.is_valid]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def count_tokens(rows: pa.Table) -> pa.Table:
    """One bucket: each block gets back its tokens that two or more documents hold, with their number."""
    import pyarrow.compute as pc

    info = rows.filter(pc.is_valid(rows.column("info")))
    data = rows.filter(pc.is_null(rows.column("info")))
    if not data.num_rows:
        return info
    vals, sizes = joined(data.column("vals"), np.uint32)
    docs, _ = joined(data.column("docs"), np.uint16)
    hot_counts, _ = joined(data.column("dfs"), np.uint32)
    weight = np.ones(len(vals), np.int64)
    weight[docs == _HOT] = hot_counts
    order = np.argsort(vals)
    runs = run_starts(vals[order])
    df = np.empty(len(vals), np.int64)
    df[order] = np.repeat(np.add.reduceat(weight[order], runs), np.diff(np.append(runs, len(vals))))
    shared = df > 1
    row = np.repeat(np.arange(data.num_rows), sizes)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row[shared], minlength=data.num_rows))]).tolist()
    vals, docs, df = vals[shared], docs[shared], np.minimum(df[shared], 65535).astype(np.uint16)
    pieces = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
    out = pa.table(
        [data.column("bucket"), data.column("block"), pieces(vals), pieces(docs), pieces(df), pa.nulls(data.num_rows, pa.binary())],
        schema=rows.schema,
    )
    return pa.concat_tables([info, out])


def choose_prefixes(rows: pa.Table, percent: int) -> pa.Table:
    """One block: every document with its class and, where it can have partners, its prefix's shared tokens."""
    import pyarrow.compute as pc

    info = pickle.loads(rows.filter(pc.is_valid(rows.column("info"))).column("info")[0].as_py())
    data = rows.filter(pc.is_null(rows.column("info")))
    vals, sizes = joined(data.column("vals"), np.uint32)
    docs, _ = joined(data.column("docs"), np.uint16)
    dfs, _ = joined(data.column("dfs"), np.uint16)
    cell = np.repeat(data.column("bucket").to_numpy().astype(_U), sizes) << _U(32) | vals.astype(_U)
    hot = docs == _HOT
    lists = [info["hot"][c] for c in cell[hot].tolist()]
    counts = np.array([len(x) for x in lists], np.int64)
    doc = np.concatenate([docs[~hot].astype(np.int64), *lists])
    df = np.concatenate([dfs[~hot], np.repeat(dfs[hot], counts)])
    cell = np.concatenate([cell[~hot], np.repeat(cell[hot], counts)])
    order = np.lexsort((cell, df, doc))
    doc, cell = doc[order], cell[order].view(np.int64)
    n = info["n"]
    have = np.bincount(doc, minlength=len(n))
    take = np.maximum(n - needed(n, percent) + 1 - (n - have), 0)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(have) - have, have)
    chosen = place < take[doc]
    doc, cell = doc[chosen], cell[chosen]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])
    tokens = [cell[a:b] if b > a else None for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    return pa.table(
        {
            "doc_id": pa.array(info["ids"], pa.int64()), "key": pa.array(info["keys"], pa.int64()), "n": pa.array(n), "d1": pa.array(info["d1"]),
            "d2": pa.array(info["d2"]), "tokens": pa.array(tokens, pa.list_(pa.int64())),
        }
    )


def profiles(keyed: DataFrame, gram: int, percent: int) -> DataFrame:
    """(doc_id, key, n, d1, d2, tokens) of every document (doc_id, text, key)."""
    buckets = max(64, 4 * partitions(keyed.sparkSession))
    dealt = keyed.mapInArrow(lambda batches: deal_tokens(batches, buckets, gram), _KEY)
    counted = dealt.groupBy("bucket").applyInArrow(count_tokens, _KEY)
    schema = "doc_id long, key long, n long, d1 long, d2 long, tokens array<long>"
    return counted.groupBy("block").applyInArrow(lambda rows: choose_prefixes(rows, percent), schema)


def class_sets(keyed: DataFrame, classes: DataFrame, gram: int) -> DataFrame:
    """(cls, shingles binary) of each class, from its representative's text."""
    wanted = keyed.select("key", "text").join(classes.select("key", "cls"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets, bounds = shingle_sets(block.data, block.offsets, gram)
            parts = [sets[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([block.rows.column(2), pa.array(parts, pa.binary())], names=["cls", "shingles"])

    sets = wanted.select("key", "text", "cls").mapInArrow(run, "cls string, shingles binary")
    return sets.dropDuplicates(["cls"])


class Roots:
    """Union-find over the members of a group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, k: int) -> bool:
        i, k = self.find(i), self.find(k)
        self.up[max(i, k)] = min(i, k)
        return i != k


class Group:
    """Token-group matrix of one group: the union of its tokens with the members that hold each."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([np.zeros(0, _U), *sets])
        order = np.argsort(tokens, kind="stable")
        self.member = np.repeat(np.arange(len(sets)), self.sizes)[order]
        runs = run_starts(tokens[order])
        self.union = tokens[order][runs]
        self.starts, self.counts = runs, np.diff(np.append(runs, len(tokens)))

    def partners(self, tokens: np.ndarray) -> np.ndarray:
        """Members similar to a set; none without opening the group if its union overlaps too little."""
        if not len(self.union) or not len(tokens):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < needed(len(tokens), self.percent):
            return np.zeros(0, np.int64)
        both = np.bincount(self.member[spread_ranges(self.starts[at], self.counts[at])], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= self.percent * (len(tokens) + self.sizes - both))


def open_group(members: pa.Table, queries: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between classes: a spanning forest of the group, and one link per query and part."""
    names = members.column("cls").to_pylist()
    sets = [np.frombuffer(v.as_buffer(), _U) for v in members.column("shingles")]
    group, roots = Group(sets, percent), Roots(len(names))
    links = []
    for i, tokens in enumerate(sets):
        for k in group.partners(tokens).tolist():
            if k != i and roots.union(i, k):
                links.append((names[i], names[k]))
    for name, tokens in zip(queries.column("cls").to_pylist(), queries.column("shingles")):
        met = {roots.find(k): k for k in group.partners(np.frombuffer(tokens.as_buffer(), _U)).tolist()}
        links += [(name, names[k]) for k in met.values()]
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def with_groups(classes: DataFrame) -> DataFrame:
    """(cls, lead, tokens): the prefix token that most classes hold, and the tokens that others hold as well."""
    entry = classes.select("cls", F.explode("tokens").alias("token"))
    held = entry.groupBy("token").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > 1)
    popular = F.max_by("token", F.struct("classes", "token")).alias("lead")
    return entry.join(held, "token").groupBy("cls").agg(popular, F.collect_list("token").alias("tokens"))


def class_links(keyed: DataFrame, classes: DataFrame, gram: int, percent: int) -> DataFrame:
    """(a, b) links that connect the similar classes among `classes` (cls, key, tokens)."""
    grouped = staged(with_groups(classes), "grouped")
    per_lead = grouped.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    members = grouped.join(per_lead, "lead").withColumn("chunk", F.expr("pmod(xxhash64(cls), chunks)").cast("int"))
    members = staged(members.select("cls", "lead", "chunk", "chunks", "tokens"), "members")
    entry = members.select("cls", "lead", F.explode("tokens").alias("token"))
    matrix = entry.groupBy("token", "lead").agg(F.count(F.lit(1)).alias("n"))
    shared = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") > 1).select("token")
    several = matrix.join(shared, "token").select("token", F.col("lead").alias("other"))
    met = entry.join(several, "token").where(F.col("other") > F.col("lead")).select("cls", "other").distinct()
    across = met.join(per_lead.withColumnRenamed("lead", "other"), "other")
    across = across.select("cls", F.col("other").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    # other chunks of the own group
    beside = members.where(F.col("chunk") + 1 < F.col("chunks"))
    beside = beside.select("cls", "lead", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk"))
    asked = staged(across.union(beside), "asked")
    splits = asked.groupBy("lead", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("splits"))
    sets = staged(class_sets(keyed, classes.join(grouped.select("cls"), "cls", "left_semi"), gram), "sets")
    part = F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)).alias("part")
    held = members.drop("tokens").join(splits, ["lead", "chunk"], "left").select("cls", "lead", "chunk", part)
    asked = asked.join(splits, ["lead", "chunk"]).withColumn("part", F.expr("pmod(xxhash64(cls), splits)").cast("int"))
    cell = ["lead", "chunk", "part"]
    with_sets = lambda side: side.join(sets, "cls").select(*[F.col(c).alias(c) for c in (*cell, "cls", "shingles")])
    held, asked = with_sets(held), with_sets(asked)
    return (
        held.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(lambda m, q: open_group(m, q, percent), "a string, b string")
    )


def components(links: DataFrame) -> DataFrame:
    """(cls, root) of every linked class: smallest reachable class, by label spreading with pointer jumps."""
    links = staged(links, "links")
    both = staged(links.union(links.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "cls"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, F.col("cls") == F.col("a")).select("cls", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("cls").alias("low"), F.col("root").alias("beyond"))
        step = staged(low.join(jump, "low", "left").select("cls", F.col("root").alias("was"), F.least("low", "beyond").alias("root")), "labels")
        changed = step.where(F.col("root") != F.col("was")).limit(1).count()
        labels = step.drop("was")
        if not changed:
            return labels


def similar_documents(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = text.withColumn("key", F.xxhash64("doc_id", "text", F.octet_length("text")))
    rows = staged(profiles(keyed, gram, percent), "profiles")
    cls = F.concat(F.hex("d1"), F.lit("-"), F.hex("d2"))
    rows = rows.withColumn("cls", cls)
    classes = rows.where(F.col("n") > 0).groupBy("cls").agg(
        F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.first("tokens", ignorenulls=True).alias("tokens")
    )
    classes = staged(classes, "classes")
    links = class_links(keyed, classes.where(F.size("tokens") > 0), gram, percent)
    roots = components(links)
    linked = classes.select("cls", "first_id").join(roots, "cls")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = linked.join(least, "root").select("cls", "component_id")
    final = classes.select("cls", "first_id").join(labelled, "cls", "left").select("cls", F.coalesce("component_id", "first_id").alias("component_id"))
    out = rows.join(final, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
