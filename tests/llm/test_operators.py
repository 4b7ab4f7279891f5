"""Operators beside brute force, exact round trips, and the cases that their docstrings define."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mutspan.llm import ball_tree, bpe, chat_format, exact_dedup, html_extract, ngram_join, packing, quality, substring_dedup, url_filter
from mutspan.llm.common import Words, vocabulary_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, vec_id long"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 1, 7, "x", 3) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def some_texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 90))) for _ in range(25)]
    passage = " ".join(rnd.choices(words, k=60))
    texts = [None, "", " \t\n", "One", "one two", "one  TWO\nthree", "a b c d", "A b C d", *base]
    texts += [f"{base[3]} {passage} {base[4]}", f"{passage}\n{base[5]}", base[6], base[6].upper(), base[6] + " ", "x " * 5000, "é" * 300]
    for k in range(30):  # near copies of one text
        w = base[7].split() * 3
        for _ in range(k % 4):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    return texts


def split_words(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]


def test_words_follow_the_pattern():
    texts = [" a\tbb\xa0c\n", "", "é x", "longer than eight bytes"]
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    data = b"".join(raw)
    found = [[data[a:b].decode() for a, b in zip(words.starts[i:j], words.ends[i:j])] for i, j in zip(words.ranges, words.ranges[1:])]
    assert found == [split_words(t) for t in texts]
    assert len(set(words.hashes().tolist())) == len({w for f in found for w in f})


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    rnd = random.Random(2)
    letters = "ab 's\n\t1!é <|>x'tremdvl日\0　"
    texts = [*some_texts(), "<|endoftext|>a<|endoftext|><|endoftext|> b ", "it's 'sx 're'll", "a" * 5000, "\U00010d4aꟚ"]
    texts += ["".join(rnd.choices(letters, k=rnd.randint(0, 50))) for _ in range(200)]
    rows = bpe.decode(bpe.encode(documents(spark, texts), path), path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(documents(spark, ["a"]).limit(0), path).count() == 0


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    texts = some_texts()
    rows = packing.packed_documents(documents(spark, texts), path, 256).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, want in ids.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [p.start for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces[:-1])]))
        assert sum(p.length for p in pieces) == len(want)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces[:-1])]))
        assert sum(p.length for p in pieces) <= 256


def test_patterns_hold_the_histogram_with_little_padding():
    rnd = random.Random(1)
    histogram = Counter(rnd.randint(1, 1024) for _ in range(50_000))
    patterns = packing.place(dict(histogram))
    placed = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 1024
        for length in lengths:
            placed[length] += count
    assert placed == histogram
    assert sum(n * c for n, c in histogram.items()) / (1024 * sum(c for _, c in patterns)) > 0.98
    assert packing.place({}) == []


@pytest.mark.parametrize("length", [1, 200, 512])
def test_patterns_hold_a_frequent_short_length_with_little_padding(length):
    assert packing.place({512: 1000}) == [([512, 512], 500)]
    rnd = random.Random(2)
    histogram = Counter(rnd.randint(1, 1024) for _ in range(20_000)) + Counter({length: 40_001})
    patterns = packing.place(dict(histogram))
    placed = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 1024
        for n in lengths:
            placed[n] += count
    assert placed == histogram
    assert sum(n * c for n, c in histogram.items()) / (1024 * sum(c for _, c in patterns)) > 0.95


def test_equal_pieces_share_sequences(spark):
    pieces = spark.range(1000).selectExpr("id AS doc_id", "0L AS start", "IF(id < 900, 3L, 5L) AS length")
    rows = packing.pack(pieces, 16).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    assert len(rows) == 1000 and len({r.doc_id for r in rows}) == 1000
    for found in by_sequence.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == list(np.cumsum([0, *(r.length for r in found[:-1])])) and sum(r.length for r in found) <= 16
    assert sorted(by_sequence) == list(range(len(by_sequence))) and len(by_sequence) <= 220


def test_chat_round_trip(spark):
    text = "a </s>\\</s> [INST] <sep>\\"
    rows = [
        (1, 2, "assistant", text, 0), (1, 0, "user", text, 0), (1, 1, "user", None, 0), (1, 3, "assistant", "B", 0), (1, 3, "assistant", "B", 0),
        (2, 0, None, None, 0), (2, 1, "t\no\\n<s>\\", "", 0), (None, None, "user", "é", 0),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(frame)).collect()}
    turns = lambda c: [tuple(t) for t in got[c].turns]
    assert turns(1) == [("user", text), ("user", ""), ("assistant", text), ("assistant", "B"), ("assistant", "B")]
    assert got[1].loss_text == text + "BB"
    assert got[1].formatted.count("[INST] user") == 1
    assert turns(2) == [("", ""), ("t\no\\n<s>\\", "")] and got[2].loss_text == ""
    assert turns(None) == [("user", "é")]
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    rows = spark.range(2000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text")
    )
    got = chat_format.read_back(chat_format.format_conversations(rows)).first()
    assert got.loss_text == "".join(f"t{i}" for i in range(2000) if i % 3)
    assert [t.text for t in got.turns] == [f"t{i}" for i in range(2000)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    texts = some_texts() + ["Same"] * 40 + ["sAME", "É", "é"]
    rows = exact_dedup.duplicate_groups(documents(spark, texts), keep=keep).collect()
    normal = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[normal(t)].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        group = groups[normal(texts[r.doc_id])]
        best = min(group) if keep == "smallest" else max(group)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(group), r.doc_id == best)
        assert r.text_sha256 == hashlib.sha256(normal(texts[r.doc_id]).encode()).hexdigest()
    left = exact_dedup.without_copies(documents(spark, texts), keep=keep)
    assert left.count() == len(groups) and left.columns == documents(spark, ["a"]).columns
    repeated = documents(spark, ["a", "A", "b"], [1, 1, None])
    assert exact_dedup.without_copies(repeated).count() == 2


def test_quality_learns_and_handles_edges(spark):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    good = lambda: " ".join(rnd.choices(words, k=30))
    bad = [lambda: good().upper() + "!!", lambda: " ".join(w + "%%%" for w in good().split()), lambda: " ".join([rnd.choice(words)] * 30)]
    texts = [good() if i % 3 else bad[i % 7 % 3]() for i in range(300)] + [None, "", "x " * 3000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i in range(300) if rows[i].held_out]
    assert sum(rows[i].predicted == int(i % 3 > 0) for i in held) >= 0.95 * len(held)
    assert rows[300].score == rows[301].score
    assert all(0 <= r.score <= 1 for r in rows.values())
    none = quality.classified(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def brute_removed(texts, window):
    counts = Counter(tuple(w[i : i + window]) for w in map(split_words, texts) for i in range(len(w) - window + 1))
    out = []
    for w in map(split_words, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_substring_dedup(spark, hot):
    texts = some_texts()
    want = brute_removed(texts, 12)
    rows = substring_dedup.cleaned(documents(spark, texts), 12, 4, hot).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == dict(enumerate(want))
    assert len(rows) == len(texts)
    # rows that agree in id and text still count as occurrences of each other
    twice = substring_dedup.cleaned(documents(spark, [texts[10] * 3, texts[10] * 3], [None, None]), 12).collect()
    assert [r.kept for r in twice] == ["", ""]
    assert substring_dedup.cleaned(documents(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [200_000, 1])
def test_substring_dedup_of_periodic_text(spark, hot):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    line = " ".join(rnd.choices(words, k=14))
    texts = ["again " * n for n in (5, 12, 13, 400)] + ["one two " * n for n in (3, 7, 300)] + [f"{line}\n" * n for n in (1, 2, 40)]
    texts += [" ".join(rnd.choices(words, k=20)) + f" {line} {line} " + " ".join(rnd.choices(words, k=20)) for _ in range(12)]
    texts += ["tick tock " * 60 + " ".join(rnd.choices(words, k=30)) for _ in range(12)]
    rows = substring_dedup.cleaned(documents(spark, texts), 12, 4, hot).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == dict(enumerate(brute_removed(texts, 12)))


def test_super_kmers_of_periodic_text_are_few(spark):
    texts = ["again " * 3000, "one two " * 1500, "a b c d e f g " * 400, " ".join(f"w{i}" for i in range(3000))]
    listed = substring_dedup.listed(substring_dedup.with_key(documents(spark, texts)), 35, 4).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("windows").alias("w"))
    by_key = {r.key: r for r in listed.collect()}
    keys = {r.row.doc_id: r.key for r in substring_dedup.with_key(documents(spark, texts)).collect()}
    assert [by_key[keys[i]].n for i in range(3)] == [1, 1, 1] and 100 < by_key[keys[3]].n < 400
    assert [by_key[keys[i]].w for i in range(4)] == [2966, 2966, 2766, 2966]


def brute_components(texts):
    lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    sets = []
    for w in map(split_words, lower):
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            if a and sets[k] and 100 * len(a & sets[k]) >= 85 * len(a | sets[k]):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("chunk", [512, 4])
def test_ngram_join(spark, chunk, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    texts = some_texts()
    rows = ngram_join.similar_documents(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)
    assert ngram_join.similar_documents(documents(spark, ["a"]).limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 8)) / 3
    v[50:60] = v[49]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    odd = [(1000, None, 0), (1100, [float("nan")] * 8, 0), (1200, [None] + [0.1] * 7, 0), (1300, [0.5] * 3, 0), (1400, [float("inf")] * 8, 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    found = ball_tree.top_k(frame, frame.where("vec_id % 100 = 0"), 10, rows_per_shard=200, rows_per_block=4).collect()
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(1024 * v.astype(np.float32).astype(np.float64)).astype(np.int64)
    for i in range(0, 900, 100):
        scores = q @ q[i]
        order = [k for k in np.lexsort((np.arange(900), -scores)) if k != i][:10]
        assert got[i] == [(k, scores[k]) for k in order]
    assert set(got) == set(range(0, 900, 100))
    assert ball_tree.top_k(frame.limit(0), frame.limit(0), 10).count() == 0


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="ad">buy</div>%s<div class="cookie-notice">c</div><footer>f</footer>"""


def test_html_extraction(spark):
    article = '<article class="post-12"><h1>Title &amp;  x</h1><p><b>one<br>two<p>three</p><form>name</form><div class="comments">no</div></article>'
    plain = "<div id=c><div class='story 7'><p>long text of the page</p><p>and more of it here</p></div><div>s</div></div>"
    sources = [PAGE % article, PAGE % plain, None, "", "<p>open", "a < b &lt; c", PAGE % article.replace("post-12", "post-99")]
    rows = [(i, f"http://h{i % 2}.org/{i}", s, "t") for i, s in enumerate(sources)] + [(9, None, "<p>x", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert got == {0: "Title & x\none two\nthree", 1: "long text of the page\nand more of it here\ns", 2: "", 3: "", 4: "open", 5: "a < b < c", 6: "Title & x\none two\nthree", 9: "x"}
    assert html_extract.extract(frame.limit(0)).count() == 0


def extracted(spark, *sources):
    """Texts of pages of one host."""
    frame = spark.createDataFrame([(i, f"http://h.org/{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(frame).orderBy("page_id").collect()]


def test_html_path_of_the_host_gives_way_to_the_pages_own_text(spark):
    body = "<html><body><div class=story>%s</div><div class=other>%s</div></body></html>"
    usual, long = "the usual text of this host " * 20, "all text of this page stands elsewhere "
    got = extracted(spark, *[body % (usual, "")] * 3, body % ("", long), body % ("teaser", long), body % ("<script>x</script>", f"<article>{long}</article>"))
    assert got == [*[usual.strip()] * 3, long.strip(), f"teaser\n{long.strip()}", long.strip()]


def test_html_keeps_all_articles(spark):
    one, other, last = "one text " * 40, "other text " * 30, "short one"
    got = extracted(spark, f"<body><div><article class=a>{one}</article><article class=b>{other}</article></div><p><main>{last}</main>")
    assert got == ["\n".join(t.strip() for t in (one, other, last))]
    got = extracted(spark, *[f"<body><article>{one}</article><div>x</div><article>{other}</article><article>{last}</article>"] * 2)
    assert got == ["\n".join(t.strip() for t in (one, other, last))] * 2


def test_html_descent_leaves_no_text_out(spark):
    a, b, c = "a" * 800, "b" * 75, "c" * 75
    assert extracted(spark, f"<body><div><div class=x><div class=y>{a}</div><p>{b}</p></div><p>{c}</p></div>") == [f"{a}\n{b}\n{c}"]


def test_html_names_hide_whole_words_only(spark):
    long = "the text of the article " * 20
    got = extracted(
        spark, f'<div class="layout has-sidebar"><article>{long}</article><div class="site-footer">no</div></div>', f'<div class="cookie-recipe"><p>{long}</p></div>',
        f'<article><div class="article-header"><h1>Title</h1></div>{long}</article>', f'<div class=sidebar><article>{long}</article></div>',
        f"<div id=comments><p>{long}</p></div>", f"<article>{long}</article><div class=sidebar><article>no</article></div><aside><main>no</main></aside>",
        f'<div class="postComments">no</div><p>{long}</p><div role=navigation>no</div><ul class="menu main"><li>no</ul>',
    )
    text = long.strip()
    assert got == [text, text, f"Title\n{text}", text, "", text, text]


def brute_page(rnd, depth=0):
    """(html, blocks of main text) of a made-up article whose boilerplate is marked."""
    out, text = "", []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.randrange(6)
        words = " ".join(rnd.choices(["alpha", "beta", "&amp;", "gamma", "<b>delta</b>", "\n"], k=rnd.randint(2, 9)))
        if kind < 2:
            out += f"<p>{words}</p>"
            text.append(" ".join(words.replace("&amp;", "&").replace("<b>", "").replace("</b>", "").split()))
        elif kind == 2:
            name = rnd.choice(["class=ad", 'class="site-footer x"', "id=comments", "role=navigation", "class='share links'"])
            out += f"<div {name}>{words}<p>{words}</p></div>"
        elif kind == 3:
            out += rnd.choice(["<nav>{}</nav>", "<script>{}</script>", "<aside>{}</aside>", "<!-- {} -->", "<form>{}</form>", "<footer>{}</footer>"]).format(words)
        elif depth < 4:
            inner, more = brute_page(rnd, depth + 1)
            out += rnd.choice(["<div class=part>{}</div>", "<section>{}</section>", '<div class="has-sidebar">{}</div>', "<blockquote>{}</blockquote>"]).format(inner)
            text += more
    return out, [t for t in text if t]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main class=m>{}</main>", "<div id=x>{}</div>"])
def test_html_extraction_of_made_up_pages(spark, wrap):
    rnd = random.Random(11)
    pages = [brute_page(rnd) for _ in range(60)]
    got = extracted(spark, *[f"<html><head><title>t</title></head><body><nav>menu</nav>{wrap.format(h)}<div class=ad>buy</div></body></html>" for h, _ in pages])
    assert got == ["\n".join(t) for _, t in pages]


def test_html_of_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    wide = "<body>" + "".join(f"<div class=c{i}><p>block {i}</p></div>" for i in range(20_000)) + "</body>"
    got = extracted(spark, deep, wide)
    assert got[0] == "deep text" and got[1].split("\n") == [f"block {i}" for i in range(20_000)]


def test_url_rules_and_templates(spark):
    from mutspan.llm.queries import RULES

    urls = [
        ("http://A.Example.org/es/1", "block", "example.org/es/"), ("http://example.org/en/12?x", "block", "example.org/en/1"), ("http://notexample.org/es/", "allow", "org/"),
        ("https://x.com/fr/9#a", "allow", "com/fr/"), ("https://x.com/de/", "block", "com/de/"), ("http://x.org", "allow", None), ("nothing", "allow", None), (None, "allow", None),
    ]
    rows = [(i, u, None) for i, (u, _, _) in enumerate(urls)]
    rows += [(100 + i, f"http://h.net/spam/{i}.html", 1) for i in range(60)] + [(200 + i, f"http://h.net/news/{i}", int(i % 20 == 0)) for i in range(60)]
    rows += [(300 + i, f"http://k.net/{'/'.join('abcdefghijkl')}/{i}", None) for i in range(8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_filter.judge(frame, RULES).collect()}
    assert len(got) == len(rows)
    for i, (_, verdict, rule) in enumerate(urls):
        assert (got[i].verdict, got[i].rule) == (verdict, rule)
    assert (got[0].host, got[0].path) == ("a.example.org", "/es/1") and (got[6].host, got[7].path) == ("", "")
    assert {got[100 + i].verdict for i in range(60)} == {"block"} and {got[200 + i].verdict for i in range(60)} == {"allow"}
    assert got[100].template == "/spam/*" and got[200].template == "/news/*"  # merged into their pools of siblings
    rate = (60 + 10 * host_rate(63, 120, 63 / 120)) / 70
    assert abs(got[100].bad_rate - rate) < 1e-9
    assert url_filter.judge(frame.limit(0), RULES).count() == 0


def test_each_of_many_sections_is_judged_by_itself(spark):
    rows = [(100 * s + i, f"http://h.net/s{s}/{i}", int(s < 10)) for s in range(30) for i in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(frame, []).collect()}
    assert got == {page: "block" if bad else "allow" for page, _, bad in rows}


def host_rate(bad, labelled, prior):
    return (bad + 10 * prior) / (labelled + 10)


def test_rows_are_not_needed_to_be_named(spark):
    """Null ids are carried, not dropped."""
    docs = documents(spark, ["a b c d e", None], [None, 5])
    assert {Row(*r) for r in ngram_join.similar_documents(docs).collect()} == {Row(None, 2, None), Row(5, 0, 5)}
    assert exact_dedup.duplicate_groups(docs).count() == 2
