"""Main-text extraction by consensus host paths.

Each page is read once for its vote: containers are scored by the text below
them outside boilerplate, and the deepest one with all of it votes, with
that text's length, for its generalised path (tags with classes, digits taken
out). Votes are summed per host and path in Spark, and the pages are read again
with their host's leading paths: the best-ranked path that holds a page's own
main text gives its text. A page with none of them uses its own container.

Boilerplate is known by tags, and by whole class words, ids and roles that
consist of boilerplate names and plain qualifiers (`ad`, `site-footer`; not
`has-sidebar` or `article-header`). Names never hide a page's only article or
main elements.

Defined cases: null html counts as empty and gives an empty text; unclosed tags
end with the page; a null url is a host of its own; rows with equal page_id are
extracted each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import collections
import dataclasses
import functools
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutspan.llm.common import staged
from mutspan.llm.url_filter import host_of

#: Paths kept for each host; a page that has none of them falls back to its own container.
HOST_PATHS = 8

CONTAINERS = frozenset("html body div section article main td center header footer nav aside form menu dialog".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption figure figcaption hr address details summary fieldset legend".split()
)
BOILERPLATE_TAGS = frozenset("head title nav header footer aside form menu dialog".split())
UNSEEN = "script|style|noscript|template|iframe|svg|canvas|object|select|button|textarea|option|audio|video|map"
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adbox advert adverts advertisement advertising banner sponsor sponsored"
    " promo cookie cookies consent notice notices alert popup modal overlay comment comments disqus reply replies respond share sharing social related"
    " newsletter subscribe subscription breadcrumb breadcrumbs widget form login signup search toolbar pagination pager copyright contentinfo complementary".split()
)
#: Parts that may stand beside boilerplate names in a class word.
QUALIFIERS = frozenset("site main page top bottom left right box container wrapper wrap list bar block section inner outer area link links post posts item items content".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({UNSEEN})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclasses.dataclass
class Page:
    """Containers (path step, parent, boilerplate by tag or by name) and text blocks (container, text) in page order."""

    steps: list[str]
    parents: list[int]
    by_tag: list[bool]
    by_name: list[bool]
    blocks: list[tuple[int, str]]
    hidden: list[bool] = dataclasses.field(default_factory=list)

    def settle(self) -> None:
        """Decide what is hidden: by tag, and by name unless that hides the page's only main elements."""
        self.hidden = self.spread(a or b for a, b in zip(self.by_tag, self.by_name))
        if self.focus(self.below()):
            return
        strict = self.spread(self.by_tag)
        for k, step in enumerate(self.steps):
            if is_main(step) and not strict[k]:
                at = k
                while at and not (at != k and is_main(self.steps[at])):
                    self.by_name[at] = False
                    at = self.parents[at]
        self.hidden = self.spread(a or b for a, b in zip(self.by_tag, self.by_name))

    def spread(self, own: Iterable[bool]) -> list[bool]:
        """Which containers are marked or lie within such a one."""
        found: list[bool] = []
        for k, mark in enumerate(own):
            found.append(mark or k > 0 and found[self.parents[k]])
        return found

    def path(self, k: int) -> str:
        steps = []
        while k:
            steps.append(self.steps[k])
            k = self.parents[k]
        return ">".join(reversed(steps))

    def on_path(self, path: str) -> list[bool]:
        """Which containers have this path."""
        steps = path.split(">") if path else []
        depth, fits = [0], [True]  # of each container; fits: its path begins the wanted one
        for k in range(1, len(self.steps)):
            up = self.parents[k]
            depth.append(depth[up] + 1)
            fits.append(fits[up] and depth[k] <= len(steps) and self.steps[k] == steps[depth[k] - 1])
        return [f and d == len(steps) for f, d in zip(fits, depth)]

    def below(self) -> list[int]:
        """Characters of shown text in each container and those within it."""
        total = [0] * len(self.steps)
        for at, text in self.blocks:
            total[at] += 0 if self.hidden[at] else len(text)
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        return total

    def focus(self, total: list[int]) -> list[int]:
        """Outermost article and main elements with shown text."""
        found, within = [], [False] * len(self.steps)
        for k, step in enumerate(self.steps):
            here = is_main(step) and not self.hidden[k]
            if here and total[k] and not within[self.parents[k]]:
                found.append(k)
            within[k] = here or within[self.parents[k]]
        return found

    def best(self) -> tuple[int, int]:
        """The container that votes, and its text's length."""
        total = self.below()
        focus = self.focus(total)
        if focus:
            # containers of one path are read together, others by the lowest container around them
            at = focus[0] if len({self.path(k) for k in focus}) == 1 else functools.reduce(self.around, focus)
            return at, max(total[at], sum(total[k] for k in focus))
        at = 0
        for k in range(1, len(self.steps)):
            if self.parents[k] == at and total[k] == total[0] > 0:
                at = k
        return at, total[at]

    def around(self, a: int, b: int) -> int:
        """Lowest container that holds both."""
        while a != b:
            a, b = (self.parents[a], b) if a > b else (a, self.parents[b])
        return a

    def inside(self, wanted: Iterable[bool]) -> list[bool]:
        """Which containers are wanted and not boilerplate, or within such a one."""
        return self.spread(own and not hidden for own, hidden in zip(wanted, self.hidden))

    def text(self, path: str) -> str:
        """Shown text of all containers with this path."""
        inside = self.inside(self.on_path(path))
        return "\n".join(text for at, text in self.blocks if inside[at] and not self.hidden[at])

    def main_text(self, paths: list[str]) -> str:
        """Text of the first path that holds the page's main text, else of the page's own container.

        It must hold all text of the article or main elements, or all text of a page without them.
        """
        total = self.below()
        focus = set(self.focus(total))
        main = self.inside(k in focus for k in range(len(self.steps))) if focus else [True] * len(self.steps)
        needed = sum(total[k] for k in focus) if focus else total[0]
        for path in paths:
            inside = self.inside(self.on_path(path))
            if sum(len(text) for at, text in self.blocks if main[at] and inside[at] and not self.hidden[at]) >= needed > 0:
                return self.text(path)
        return self.text(self.path(self.best()[0]))


def is_main(step: str) -> bool:
    return step.partition(".")[0] in ("article", "main")


def is_boilerplate(word: str) -> bool:
    """Whether a class word, id or role consists of boilerplate names and qualifiers, one name at least."""
    parts = set(_PARTS.findall(_CAMEL.sub(" ", word).lower()))
    return not parts.isdisjoint(BOILERPLATE_NAMES) and parts <= BOILERPLATE_NAMES | QUALIFIERS


@functools.lru_cache(1024)
def generalised(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Path step of a container, and whether it is boilerplate by its tag, and by its names."""
    words, classes = [], []
    for kind, a, b, c in _NAMES.findall(attributes):
        found = html.unescape(a or b or c).split()
        words += found
        if kind.lower() == "class":
            classes += sorted(re.sub(r"\d+", "", w.lower()).replace(">", "") for w in found)
    step = ".".join([tag, *dict.fromkeys(w for w in classes if w)])
    named = tag not in ("html", "body", "main", "article") and any(map(is_boilerplate, words))
    return step, tag in BOILERPLATE_TAGS, named


def read_page(source: str) -> Page:
    """Containers and blocks of a page; inline tags vanish, a line break is white space.

    A block such as a list or a paragraph is a container of its own if its names say boilerplate.
    """
    page = Page([""], [0], [False], [False], [])
    stack: list[tuple[str, int]] = [("", 0)]  # open containers
    opened: collections.Counter[str] = collections.Counter()  # their tags
    parts: list[str] = []

    def flush() -> None:
        if not parts:
            return
        text = "".join(parts)
        parts.clear()
        if text := " ".join((html.unescape(text) if "&" in text else text).split()):
            page.blocks.append((stack[-1][1], text))

    def enter(tag: str, attributes: str) -> None:
        step, by_tag, by_name = generalised(tag, attributes)
        page.steps.append(step)
        page.parents.append(stack[-1][1])
        page.by_tag.append(by_tag)
        page.by_name.append(by_name)
        stack.append((tag, len(page.steps) - 1))
        opened[tag] += 1

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at = 0
    for token in _TOKEN.finditer(source):
        if token.start() > at:
            parts.append(source[at : token.start()])
        at = token.end()
        _, closing, tag, attributes = token.groups()
        tag = (tag or "").lower()
        if tag == "br":
            parts.append("\n")
        if tag not in BLOCKS and tag not in BOILERPLATE_TAGS:
            continue
        flush()
        if closing:
            if opened[tag]:
                while leave() != tag:
                    pass
            continue
        if stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag:
            leave()  # ends where the next block begins
        if tag in CONTAINERS or tag in BOILERPLATE_TAGS or opened[tag] or attributes and generalised(tag, attributes)[2]:
            if not attributes.endswith("/"):
                enter(tag, attributes)
    if at < len(source):
        parts.append(source[at:])
    flush()
    page.settle()
    return page


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    keyed = pages.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, sizes = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = read_page(source.as_py())
                at, size = page.best()
                if size:
                    hosts.append(host)
                    paths.append(page.path(at))
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["host", "path", "size"])

    votes = keyed.select("host", "html").mapInArrow(vote, "host string, path string, size long")
    sums = votes.groupBy("host", "path").agg(F.sum("size").alias("size"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("size"), "path"))
    leading = sums.withColumn("rank", rank).where(F.col("rank") <= HOST_PATHS)
    winners = leading.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("w")).select("host", F.col("w.path").alias("paths"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, paths in zip(batch.column(2), batch.column(3).to_pylist()):
                texts.append(read_page(source.as_py()).main_text(paths or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    # the winners are written first, so that their size is known when Spark chooses the join
    met = keyed.join(staged(winners, "paths"), "host", "left").select("page_id", "url", "html", "paths")
    return met.mapInArrow(take, f"page_id {kind}, url string, text string")
