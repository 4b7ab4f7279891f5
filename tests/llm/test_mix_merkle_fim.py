"""Mixing, the Merkle manifest and fill-in-middle beside brute force, with their defined cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import zstandard
from pyspark.sql import functions as F

from mutspan.llm import fim, merkle, mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, place long, n long, h string, output string, tree long, claimed string"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def documents(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 5, 6, 7, "x", "y", 8, "z") for r in rows], DOC).repartition(3)


def words_in(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# mixing


def shared_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated sharing, exactly."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = {s: Fraction(weight[s] * left, sum(w for t, w in weight.items() if t not in full)) for s in names if s not in full}
        above = {s for s, v in share.items() if v > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s] if s in full else share[s]) for s in names}
        full |= above


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_repeated_sharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: int(rnd.expovariate(1 / 400)) for s in ["", "Z", "a", "b", "ß", "語", "😀", "c", "d", None]}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(shared_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_fit_finds_the_nearest_sum():
    rnd = random.Random(2)
    for _ in range(300):
        lengths = sorted(rnd.sample(range(1, 30), rnd.randint(1, 4)))
        counts = [rnd.randint(1, 3) for _ in lengths]
        budget = rnd.randrange(sum(n * c for n, c in zip(lengths, counts)))
        taken = mixing.fit(lengths, counts, budget)
        sums = [sum(n * t for n, t in zip(lengths, choice)) for choice in itertools.product(*[range(c + 1) for c in counts])]
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert abs(sum(n * t for n, t in zip(lengths, taken)) - budget) == min(abs(s - budget) for s in sums)


def test_fit_gives_each_length_its_share_before_the_table_decides():
    rnd = random.Random(3)
    lengths = sorted(rnd.sample(range(5, 3000), 400))
    counts = [rnd.randint(1, 400) for _ in lengths]
    budget = sum(n * c for n, c in zip(lengths, counts)) // 3
    taken = mixing.fit(lengths, counts, budget, play=5000)
    assert sum(n * t for n, t in zip(lengths, taken)) == budget
    assert all(c // 3 - 2 <= t <= c for t, c in zip(taken, counts) if c > 60)


@pytest.mark.parametrize("bucket_rows", [4, 50_000])
def test_mix_of_sources(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 1, 2, 5, 9, 40])), "en", rnd.choice(["a", "b", "b", "b", "b", "ç", None]), 1) for i in range(400)]
    rows += [(1000, None, "en", "a", 1), (1001, "", None, "none", 0), (1002, " \n", "en", "b", None), (None, "null id", "en", "b", 1)]
    rows += [(7, "repeated row", "en", "c", 1)] * 9 + [(2000 + i, "x " * 20_000, "en", "d", 1) for i in range(2)]
    docs = documents(spark, rows)
    got = mixing.mixed(docs, play=30).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], words_in(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words_in(r[1])
    aims, taken = shared_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for source, aim in aims.items():
        assert abs(taken[source] - aim) <= {"d": 10_000, "c": 1}.get(source, 0.5)
    again = mixing.mixed(docs.repartition(5), play=30).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, got))


def test_mix_of_an_empty_table(spark):
    assert mixing.mixed(documents(spark, []).limit(0)).collect() == []
    assert [r.copies * r.size for r in mixing.mixed(documents(spark, [(1, None, None, None, None)])).collect()] == [0]


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def leaf_of(row, add=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + add, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = mine, levels_of([leaf_of(r) for r in mine])
    top = levels_of([trees[x][1][-1][0] for x in langs])
    out = []
    for nth, lang in enumerate(langs):
        mine, tree = trees[lang]
        for at, row in enumerate(mine):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, proof = leaf_of(row, int(hit)), []
            for levels, i in ((tree, at), (top, nth)):
                for level in levels[:-1]:
                    run = level[i // 2 * 2 : i // 2 * 2 + 2]
                    proof += [x for j, x in enumerate(run) if j != i % 2]
                    run[i % 2] = node
                    node, i = sha(*run), i // 2
            out.append((row[0], leaf_of(row), tree[-1][0], top[-1][0], sha(*proof), node, node == top[-1][0]))
    return sorted(map(repr, out))


def test_addresses_equal_the_order_of_completion():
    for n in range(1, 70):
        for height in {(n - 1).bit_length(), 8}:
            leaves = [bytes([i]) * 32 for i in range(n)]
            levels = [leaves]
            for _ in range(height):
                levels.append([merkle.joined(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
            log = merkle.append_log(leaves, height)
            assert len(log) == sum(map(len, levels))
            assert all(log[merkle.address(n, h, i)] == node for h, level in enumerate(levels) for i, node in enumerate(level))


def manifest_rows():
    rnd = random.Random(4)
    rows = [(i, f"text {i}\n" * (i % 3), rnd.choice(["en", "en", "en", "de", "ß", "😀"]), "s", i) for i in rnd.sample(range(10_000), 150)]
    rows += [(20_000 + i, "", f"lang{i}", None, None) for i in range(9)] + [(30_000 + i, None, None, None, -1) for i in range(4)]
    return rows + [(40_000, "same", "en", "s", 4)] * 3 + [(40_000, "other", "en", "s", 5), (None, "no id", "en", "s", 5), (40_002, "é" * 50_000, "de", "ö", 50_000)]


def checked(docs, run):
    made = merkle.manifest(merkle.document_leaves(docs), "lang", "doc_id", run)
    found = merkle.verified(merkle.proofs(made), "doc_id", run).withColumn("verified", F.col("folded_root") == F.col("root"))
    return sorted(repr(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("run", [2, 8])
def test_manifest_equals_brute_force(spark, run):
    rows = manifest_rows()
    assert checked(documents(spark, rows), run) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 17])
def test_manifest_of_one_key(spark, n):
    rows = [(i, "t", None, "s", 1) for i in range(n)]
    assert checked(documents(spark, rows), 2) == brute_manifest(rows)


def test_tampered_rows_alone_fail(spark):
    rows = merkle.checked_documents(documents(spark, manifest_rows())).collect()
    hit = {r[0] for r in manifest_rows() if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert hit and {r.doc_id for r in rows if not r.verified} == hit


def test_manifest_of_an_empty_table(spark):
    assert merkle.checked_documents(documents(spark, manifest_rows()).limit(0)).collect() == []


# fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    seed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(seed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < 50:
        return (doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def fim_rows():
    rnd = random.Random(6)
    texts = [None, "", "\n", "\n\n\n", "no line end", "a<P>b", "<S", "<\nS>\n<", "é😀\n語", "x" * 200_000 + "\n" + "y\n" * 50_000, "\r\n\x0b \n"]
    texts += ["".join(rnd.choice(["é", "😀", "a", "\n", "<", "P", ">", " "]) for _ in range(rnd.randint(1, 120))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(3, "repeated id\nother text\n"), (3, "repeated id\nother text\n"), (None, "a\nb\nc\nd"), (-5, "a\nb\nc")]
    return [(i, t, "en", "s", 1) for i, t in rows]


@pytest.mark.parametrize("frame_bytes", [7, fim.FRAME_BYTES])
def test_fim_equals_brute_force(spark, frame_bytes):
    rows = fim_rows()
    stored = fim.store(documents(spark, rows), frame_bytes=frame_bytes)
    if frame_bytes == 7:
        stored = stored.where("doc_id is null or doc_id <> 9")  # 43,000 frames of seven bytes prove nothing more
        rows = [r for r in rows if r[0] != 9]
    made = fim.transform(stored)
    open_frame = zstandard.ZstdDecompressor()
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, b"".join(open_frame.decompress(f) for f in r.output).decode()) for r in made.collect()]
    want = [brute_fim(r[0], r[1]) for r in rows]
    assert Counter(got) == Counter(want)
    assert {"plain", "spm", "psm"} == {w[2] for w in want}
    hashed = [tuple(r) for r in fim.digests(made).select("doc_id", "output_sha256", "restored_sha256").collect()]
    assert Counter(hashed) == Counter((r[0], sha(w[5]), sha(r[1] or "")) for r, w in zip(rows, want))


def test_only_cut_frames_are_decompressed(spark):
    text = "".join(f"line {i}\n" for i in range(5000))
    row = fim.store(documents(spark, [(1, text, "en", "s", 1)]), frame_bytes=1000).first().asDict(recursive=True)
    stored, opened = fim.Text(row), []
    whole = stored.frame
    stored.frame = lambda i: opened.append(i) or whole(i)
    frames, _, _ = fim.rearranged(stored, 1234, 4000, "psm")
    assert len(row["frames"]) > 40 and len(set(opened)) == 2
    assert b"".join(fim.restored(frames, "psm")).decode() == text


def test_fim_rate_and_empty_table(spark):
    docs = documents(spark, fim_rows())
    assert {r.form for r in fim.transform(fim.store(docs), rate=0).collect()} == {"plain"}
    assert fim.digests(fim.transformed(docs.limit(0))).collect() == []
