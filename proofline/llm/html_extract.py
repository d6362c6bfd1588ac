"""Main-text extraction: boosted trees over DOM nodes, decoded as one tree.

A page is parsed into its block elements. Statistics of each (how dense its text
is, how much of it is links, depth, place among its siblings, and what its tag
and attribute words were like in training) give, through boosted trees, the
log-odds that it holds main text. Node by node these could contradict each
other, so the tree is decoded as a whole: a dropped node drops all below it, and
among all such choices the likeliest is taken, by one pass from the leaves and
one from the root.

The trees are learned from pages that mark their parts: inside ``article``,
``main`` or an ``articleBody`` is main text, except for the parts whose tag or
attribute words say otherwise. As one site's pages hardly show all kinds of
boilerplate, the same texts are also set in other layouts, with containers
without such marks. At most ``max_pages`` pages, chosen by hash, are used.

Text of a block: character references decoded, each run of white space one
space, ends trimmed; a line break within is white space. Blocks are joined by a
blank line, in page order. A null or empty page has no text. Pages of any depth
are parsed without recursion, and read whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from proofline.llm.common import lowest_by_hash, stored

MAX_PAGES = 1500
BUCKETS = 4096

# Fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr br".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
# A start tag closes an open element of these, up to the nearest of the fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

MAIN_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav header footer aside form menu button select dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words that name boilerplate in class, id and role.
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent notice "
    "alert popup modal newsletter subscribe signup sidebar aside widget related recommended share sharing social "
    "comment comments reply replies respond discussion disqus nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead pagination pager form search login copyright legal toolbar tags".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    """A block element. Its own texts, with the places of its child blocks between them."""

    tag: str
    words: tuple[str, ...]
    parent: int
    depth: int
    parts: list  # str, or int for a child
    links: list  # one cell: characters of its own text inside links


def parse(html: str | None) -> list[Block]:
    """Block elements in page order; the first is the root. Parents come before children."""
    html = html or ""
    blocks = [Block("#root", (), -1, 0, [], [0])]
    stack = [("#root", 0)]  # open elements and the blocks their text belongs to
    opened: dict[str, list[int]] = {}  # where in the stack each tag is open, so no step walks the stack
    block_at = [0]  # where block elements are
    open_links = 0
    position = 0
    end = len(html)

    def text(piece: str) -> None:
        block = blocks[stack[-1][1]]
        block.parts.append(piece)
        if open_links:
            block.links[0] += len(piece)

    def close_to(depth: int) -> None:
        nonlocal open_links
        for tag, _ in stack[depth:]:
            open_links -= tag == "a"
            opened[tag].pop()
        del stack[depth:]
        while block_at[-1] >= depth:
            block_at.pop()

    def push(tag: str, block: int) -> None:
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, block))

    def nearest(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close_open(names, fence) -> None:
        k = nearest(names)
        if k and k >= nearest(fence):
            close_to(k)

    while m := _TOKEN.search(html, position):
        if m.start() > position:
            text(html[position : m.start()])
        position = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text(" ")
            elif tag in INLINE:
                # An inline element that was left open does not outlive its block.
                if nearest([tag]) > block_at[-1]:
                    close_to(nearest([tag]))
            elif nearest([tag]):
                close_to(nearest([tag]))
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, position)
                position = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        if tag in INLINE:
            push(tag, stack[-1][1])
            open_links += tag == "a"
            continue
        if tag in ENDS_P:
            close_open({"p"}, {"button", "td", "th", "table", "li", "dd"})
        if tag in CLOSES:
            close_open(*CLOSES[tag])
        words: list[str] = []
        for name, value in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            words += (w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", value)))
        above = stack[-1][1]
        blocks[above].parts.append(len(blocks))
        blocks.append(Block(tag, tuple(words), above, blocks[above].depth + 1, [], [0]))
        block_at.append(len(stack))
        push(tag, len(blocks) - 1)
    if position < end:
        text(html[position:])
    return blocks


def clean(pieces: Iterable[str]) -> str:
    return " ".join(unescape("".join(pieces)).split())


def runs(blocks: list[Block], keep) -> list[str]:
    """Texts of kept blocks in page order; a child block ends a stretch of text."""
    out: list[str] = []
    todo: list = [(0, 0)]
    while todo:
        at, i = todo.pop()
        pieces: list[str] = []
        parts = blocks[at].parts
        while i < len(parts) and isinstance(parts[i], str):
            pieces.append(parts[i])
            i += 1
        if pieces and keep[at] and (found := clean(pieces)):
            out.append(found)
        if i < len(parts):
            todo.append((at, i + 1))
            todo.append((parts[i], 0))
    return out


NAMES = [
    "depth", "own_chars", "own_link_share", "chars", "link_share", "blocks", "density", "paragraphs", "marks",
    "sibling", "siblings", "before_chars", "after_chars", "share_of_page", "share_of_parent", "parent_chars",
    "tag_odds", "word_odds_low", "word_odds_high", "above_odds_low", "above_odds_high", "is_text_tag",
]
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td figcaption".split())


def _bucket(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % BUCKETS


class Lexicon(NamedTuple):
    """Log-odds of main text by tag and attribute word, hashed to a fixed size."""

    tags: np.ndarray
    words: np.ndarray


def features(blocks: list[Block], lexicon: Lexicon, buckets: dict[str, int]) -> np.ndarray:
    n = len(blocks)
    parent = np.array([b.parent for b in blocks])
    own = np.array([sum(len(p) for p in b.parts if p.__class__ is str and not p.isspace()) for b in blocks], float)
    marks = np.array([sum(p.count(",") + p.count(".") for p in b.parts if p.__class__ is str) for b in blocks], float)
    own_links = np.array([b.links[0] for b in blocks], float)
    count, paragraphs = np.ones(n), np.array([b.tag == "p" for b in blocks], float)
    chars, links = own.copy(), own_links.copy()
    up = parent.tolist()
    # From the leaves: a child comes after its parent.
    for total in (chars, links, count, paragraphs, marks):
        values = total.tolist()
        for i in range(n - 1, 0, -1):
            values[up[i]] += values[i]
        total[:] = values
    sibling, siblings, seen = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        sibling[i] = seen[up[i]]
        seen[up[i]] += 1
    for i in range(1, n):
        siblings[i] = seen[up[i]]

    def bucket(w: str) -> int:
        at = buckets.get(w)
        if at is None:
            if len(buckets) > 100_000:
                buckets.clear()
            at = buckets[w] = _bucket(w)
        return at

    tag_odds = [float(lexicon.tags[bucket(b.tag)]) for b in blocks]
    low, high, above_low, above_high = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    running, titled, inside = (chars - links).tolist(), [b.tag == "h1" for b in blocks], [0] * n
    for i in range(n - 1, 0, -1):
        titled[up[i]] |= titled[i]
    for i, b in enumerate(blocks):
        inside[i] = i if b.tag in MAIN_TAGS and not inside[max(up[i], 0)] else inside[max(up[i], 0)]
        if b.words:
            odds = [float(lexicon.words[bucket(w)]) for w in b.words]
            low[i], high[i] = min(0.0, *odds), max(0.0, *odds)
            # A class word says nothing against long text that is the bulk of its main element, or of
            # the page and with its title.
            if running[i] >= 200 and 2 * running[i] >= running[inside[i]] and (inside[i] or titled[i]):
                low[i] = 0.0
        if i:
            j = up[i]
            above_low[i] = min(above_low[j], low[j], tag_odds[j])
            above_high[i] = max(above_high[j], high[j], tag_odds[j])
    p = np.maximum(parent, 0)
    page = max(1.0, chars[0])
    at_or_before = np.concatenate([[0.0], np.cumsum(own)])[:n]
    return np.column_stack([
        [b.depth for b in blocks], own, own_links / np.maximum(own, 1), chars, links / np.maximum(chars, 1), count,
        chars / count, paragraphs, marks / np.maximum(chars, 1), sibling, siblings, at_or_before / page,
        np.maximum(0, page - at_or_before - chars) / page, chars / page, chars / np.maximum(chars[p], 1), chars[p],
        tag_odds, low, high, above_low, above_high, [b.tag in _TEXT_TAGS for b in blocks],
    ])


class Trees(NamedTuple):
    """Boosted trees as arrays, evaluated for many nodes at once."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, bound, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            while (inner := left[at] >= 0).any():
                goes = np.where(x[rows, feature[at]] <= bound[at], left[at], right[at])
                at = np.where(inner, goes, at)
            total += weight * value[at]
        return 2 * total


def read_tree(debug_string: str):
    """Arrays of a tree model's printed form."""
    feature, bound, left, right, value = [], [], [], [], []
    open_: list[tuple[int, int]] = []

    def add(depth_under: int | None, side: str) -> int:
        at = len(feature)
        for a, x in ((feature, 0), (bound, 0.0), (left, -1), (right, -1), (value, 0.0)):
            a.append(x)
        if depth_under is not None:
            (left if side == "If" else right)[depth_under] = at
        return at

    under: tuple[int | None, str] = (None, "")
    for line in debug_string.splitlines():
        if m := re.match(r"(\s*)If \(feature (\d+) <= (\S+)\)", line):
            at = add(*under)
            feature[at], bound[at] = int(m[2]), float(m[3])
            open_.append((len(m[1]), at))
            under = (at, "If")
        elif m := re.match(r"(\s*)Else \(feature", line):
            while open_[-1][0] != len(m[1]):
                open_.pop()
            under = (open_[-1][1], "Else")
        elif m := re.match(r"\s*Predict: (\S+)", line):
            value[add(*under)] = float(m[1])
    return tuple(np.array(a) for a in (feature, bound, left, right, value))


def decode(parent: list[int], log_odds: np.ndarray, weight: np.ndarray) -> list[bool]:
    """The likeliest labels under which a dropped node drops all below it; the root stays."""
    n = len(parent)
    keep = (-np.logaddexp(0, -log_odds) * weight).tolist()
    drop = (-np.logaddexp(0, log_odds) * weight).tolist()
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] >= drop[i]
    return out


class Extractor(NamedTuple):
    lexicon: Lexicon
    trees: Trees

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main texts of some pages; their nodes are judged together."""
        parsed = [parse(h) for h in pages]
        buckets: dict[str, int] = {}
        x = [features(b, self.lexicon, buckets) for b in parsed]
        odds = self.trees.log_odds(np.concatenate(x)) if x else np.zeros(0)
        out, at = [], 0
        for blocks, f in zip(parsed, x):
            weight = 1 + np.log1p(f[:, 1])
            own = odds[at : at + len(blocks)]
            # A letter or two tell nothing; such a text block goes with the block it stands in.
            tiny = np.array([f[i, 3] < 4 and b.tag in _TEXT_TAGS and not b.words for i, b in enumerate(blocks)])
            own = np.where(tiny, np.maximum(own, 0), own)
            kept = decode([b.parent for b in blocks], own, weight)
            at += len(blocks)
            out.append("\n\n".join(runs(blocks, kept)))
        return out


def marked(blocks: list[Block]) -> list[bool] | None:
    """Which blocks hold main text, by the marks of a page that has them; else None.

    A part of the main element that holds half of its text or more is main text whatever
    its class words say, and so is a ``header`` in it that holds its heading and no menu.
    """
    n = len(blocks)
    size = [sum(len(p) for p in b.parts if isinstance(p, str) and not p.isspace()) for b in blocks]
    menus, heads = [b.tag in ("nav", "menu", "ul", "form") for b in blocks], [b.tag in HEADINGS for b in blocks]
    for i in range(n - 1, 0, -1):
        up = blocks[i].parent
        size[up] += size[i]
        menus[up] |= menus[i]
        heads[up] |= heads[i]
    main, other, whole = [False] * n, [False] * n, [0] * n
    for i, b in enumerate(blocks):
        if i:
            main[i], other[i], whole[i] = main[b.parent], other[b.parent], whole[b.parent]
        if b.tag in MAIN_TAGS or "articlebody" in "".join(b.words):
            main[i], whole[i] = True, whole[i] or size[i]
        by_tag = b.tag in OTHER_TAGS and not (b.tag == "header" and main[i] and heads[i] and not menus[i])
        by_word = not OTHER_WORDS.isdisjoint(b.words) and not (main[i] and 2 * size[i] >= whole[i])
        if (by_tag or by_word) and b.tag not in ("body", "html"):
            other[i] = True
    if not any(main):
        return None
    holds = [m and not o and any(isinstance(p, str) and p.strip() for p in b.parts) for b, m, o in zip(blocks, main, other)]
    for i in range(n - 1, 0, -1):
        if holds[i]:
            holds[blocks[i].parent] = True
    return holds


_CONTAINERS = [
    ("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("section", "entry-content"),
    ("div", "story"), ("div", "article-body"), ("div", "text"), ("div", ""), ("section", ""), ("td", ""),
]
# How an article sets its texts: elements around, the element of each text, and whether texts may be cut.
_SHAPES = [
    (("ul",), "li", True), (("ol",), "li", True), (("blockquote",), "p", False), ((), "blockquote", False),
    ((), "pre", False), (("table",), "td", True), (("table", "tbody"), "td", True), (("figure",), "figcaption", True), (("section",), "p", False),
    (("dl",), "dd", True), (("div",), "p", False), ((), "div", False), ((), "h3", True),
]
_ODD_WORDS = ["related", "notice", "share", "tags", "header", "form", "comment", "promo", "menu", "legal"]
_EXTRAS = [
    ("header", ""), ("nav", ""), ("aside", ""), ("footer", ""), ("form", ""), ("div", "ad"), ("div", "advert"),
    ("div", "banner"), ("div", "sidebar"), ("div", "cookie-notice"), ("div", "notice"), ("section", "comments"),
    ("div", "comment"), ("div", "menu"), ("ul", "menu"), ("div", "related"), ("div", "newsletter"), ("div", "promo"),
    ("div", "footer"), ("div", "header"), ("ol", "comment-list"), ("p", "copyright"), ("div", "share"),
    ("div", "popup"), ("div", "sponsored"), ("ul", "breadcrumbs"),
]


def relaid(blocks: list[Block], holds: list[bool], seed: int) -> tuple[list[Block], list[bool]]:
    """The texts of a marked page in another layout, and which blocks hold main text."""
    rng = random.Random(seed)
    main = [(b.tag, t) for b, h in zip(blocks, holds) if h and (t := clean(p for p in b.parts if isinstance(p, str)))]
    rest = [t for b, h in zip(blocks, holds) if not h and (t := clean(p for p in b.parts if isinstance(p, str)))]
    rest = rest or ["menu", "contact us"]
    out = [Block("#root", (), -1, 0, [], [0])]
    truth = [True]

    def add(tag: str, words: str, parent: int, text: str, is_main: bool, link: bool = False) -> int:
        at = len(out)
        out[parent].parts.append(at)
        names = tuple(w for w in words.split("-") if w)
        out.append(Block(tag, names, parent, out[parent].depth + 1, [text] if text else [], [len(text) if link else 0]))
        truth.append(is_main)
        return at

    def extra(parent: int) -> None:
        tag, words = rng.choice(_EXTRAS)
        top = add(tag, words, parent, "", False)
        if "comment" in words or rng.random() < 0.3:  # prose that is not the article
            for _ in range(rng.randint(1, 3)):
                text = rng.choice(main)[1] if main and rng.random() < 0.7 else rng.choice(rest)
                add(rng.choice(["p", "li", "div"]), "", top, text[: rng.randint(20, 400)], False)
        else:
            for _ in range(rng.randint(1, 6)):
                add(rng.choice(["li", "p", "div"]), "", top, rng.choice(rest), False, rng.random() < 0.7)

    above = add("body", "", 0, "", True)
    for _ in range(rng.randint(0, 2)):
        above = add("div", rng.choice(["", "page", "wrapper", "container"]), above, "", True)
    for _ in range(rng.randint(0, 3)):
        extra(above)
    tag, words = rng.choice(_CONTAINERS)
    if rng.random() < 0.2:  # names say little where the text says otherwise
        words = "-".join(filter(None, [words, rng.choice(_ODD_WORDS), rng.choice(["", "body", "page", "news"])]))
    body = add(tag, words, above, "", True)
    i = 0
    while i < len(main):
        if rng.random() < 0.08:
            extra(body)
        kind = rng.choice(_SHAPES) if rng.random() < 0.35 else ""
        tag, text = main[i]
        if tag in HEADINGS:
            at = add("header", "", body, "", True) if rng.random() < 0.3 else body
            add(tag, "", at, text, True)
            i += 1
        elif not kind:
            add(tag if tag in _TEXT_TAGS else "p", "", body, text, True)
            i += 1
        else:  # some of the next texts, or pieces of this one, as a list, a quote, a table ...
            outer, inner, pieces = kind
            some = [t for _, t in main[i : i + rng.randint(1, 3)]]
            i += len(some)
            if pieces and rng.random() < 0.6:
                cut = rng.choice([r"\S.{2,12}?(?:\s|$)", r"\S.{20,90}?(?:\s|$)"])
                some = [x for t in some for x in re.findall(cut, t)[:12]] or some
            at = body
            for name in outer:
                words = rng.choice(_ODD_WORDS) + "-of-birth" if name == "section" and rng.random() < 0.2 and len(some) * 2 > len(main) else ""
                at = add(name, words, at, "", True)
            for k, t in enumerate(some):
                if inner == "td" and k % 2 == 0:
                    row = add("tr", "", at, "", True)
                add("th" if inner == "td" and k < 2 else "dt" if inner == "dd" and k % 2 == 0 else inner, "", row if inner == "td" else at, t, True)
    for _ in range(rng.randint(0, 3)):
        extra(rng.choice([above, above, body]))
    return out, truth


def learn_extractor(
    pages: DataFrame, id: str = "page_id", html: str = "html", max_pages: int = MAX_PAGES, trees: int = 24, depth: int = 5
) -> Extractor:
    """Runs jobs. The driver gets the counts of a fixed number of word buckets."""
    rows = pages.select(F.col(id).alias("id"), F.col(html).alias("html"))
    rows = stored(lowest_by_hash(rows, "id", max_pages).where("html is not null").repartition(8), "pages")

    def examples(page: str | None, seed: int):
        blocks = parse(page)
        holds = marked(blocks)
        if holds is None:
            return
        yield blocks, holds
        for k in range(2):
            yield relaid(blocks, holds, 2 * seed + k)

    def count(batches):
        tags, words = np.zeros((BUCKETS, 2), np.int64), np.zeros((BUCKETS, 2), np.int64)
        for batch in batches:
            for seed, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for blocks, holds in examples(page, seed):
                    for b, h in zip(blocks, holds):
                        tags[_bucket(b.tag), int(h)] += 1
                        for w in set(b.words):
                            words[_bucket(w), int(h)] += 1
        for kind, counts in (("tag", tags), ("word", words)):
            at = np.flatnonzero(counts.sum(1))
            yield pa.RecordBatch.from_pydict({"kind": [kind] * len(at), "bucket": at, "no": counts[at, 0], "yes": counts[at, 1]})

    seeded = rows.select(F.pmod(F.xxhash64("html"), F.lit(1 << 30)).alias("seed"), "html")
    counts = seeded.mapInArrow(count, "kind string, bucket bigint, no bigint, yes bigint")
    odds = {"tag": np.zeros(BUCKETS), "word": np.zeros(BUCKETS)}
    for r in counts.groupBy("kind", "bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).collect():
        odds[r["kind"]][r["bucket"]] = np.log((r["yes"] + 1) / (r["no"] + 1))
    lexicon = Lexicon(odds["tag"], odds["word"])

    def nodes(batches):
        buckets: dict[str, int] = {}
        for batch in batches:
            for seed, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for blocks, holds in examples(page, seed):
                    x = features(blocks, lexicon, buckets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(holds, float)), *(pa.array(x[:, i].astype(float)) for i in range(len(NAMES)))],
                        names=["label", *NAMES],
                    )

    table = stored(seeded.mapInArrow(nodes, ", ".join(f"{n} double" for n in ["label", *NAMES])).repartition(4), "nodes")
    if table.select("label").distinct().count() < 2:
        return Extractor(lexicon, Trees([], []))
    flat = VectorAssembler(inputCols=NAMES, outputCol="features").transform(table).select("label", "features")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.3, minInstancesPerNode=10).fit(flat)
    return Extractor(lexicon, Trees([read_tree(t.toDebugString) for t in fitted.trees], list(fitted.treeWeights)))


def extract_text(pages: DataFrame, extractor: Extractor, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but ``html``, with ``text`` and ``n_chars`` (replaced if there).

    With nothing to learn from, the whole text of a page is its main text.
    """
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    pages = pages.select(*others, F.col(html).alias("html")) if html != "html" else pages.select(*others, html)
    model = pages.sparkSession.sparkContext.broadcast(extractor)
    fields = [f for f in pages.schema if f.name != "html"]
    schema = StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        extractor = model.value
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            texts: list[str] = []
            some, size = [], 0
            for i in range(len(html)):
                some.append(html[i].as_py())
                size += len(some[-1] or "")
                if size > 2_000_000:
                    texts += extractor.texts(some)
                    some, size = [], 0
            texts += extractor.texts(some) if some else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"],
            )

    return pages.mapInArrow(run, schema)
