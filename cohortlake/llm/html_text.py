"""Main text of web pages from the distribution of text over their lines."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One match per piece of markup: a comment, a declaration, an element whose content is no
# markup (up to its end tag), or a tag.  Quoted attribute values may hold a ">".
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|annotation|annotation-xml|iframe|select|object|canvas|xmp)"
    r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
# Elements that begin and end lines, those that hold no main text, and those without content.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
ASIDE = set("nav header footer aside form menu dialog button head fieldset label".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Names (class, id or role) of blocks beside the article: one of these words, alone or with
# words for the place or form of a block.  Only containers are judged by name.
BESIDE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "complementary contentinfo dialog disqus footer header masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification popup promo promoted related replies respond search share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
PLACES = set("area bar bottom box buttons container form group left links list main page right side site top wrap wrapper".split())
CONTAINERS = set("aside details div dl fieldset figure footer form header menu nav ol section span table td ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements that hold lines of one kind: text that belongs together stands in the same one.
BOXES = set("article blockquote body div main section td".split())
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
# Articles that are reader comments or pointers to other articles.
LESSER = re.compile(r"(?:^|[\s_-])(?:ad|advert|comments?|promo|promoted|related|repl(?:y|ies)|sponsored|teaser)(?:$|[\s_-])")
LINK_SHARE = 0.5
WINDOW = 3
SPACES = re.compile(r"\s+")
# Open elements that a new block of their kind ends.
SAME_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def is_beside(words: str) -> bool:
    """Whether one of the names says that a block stands beside the article."""
    for name in words.split():
        parts = set(re.split("[_-]+", name)) - {""}
        if parts & BESIDE and parts <= BESIDE | PLACES:
            return True
    return False


class Line(NamedTuple):
    """A line of a page with its markup gone: text, how much of it is links, whether it
    stands in an article and in a main element, which box holds it, whether it is a heading."""

    text: str
    linked: int
    article: bool
    main: bool
    box: int
    heading: bool


class Lines:
    """The lines of a page, one per block.

    A block beside the article (a menu, an advert) leaves an empty line when it ends: the
    gap at which the distribution dives.
    """

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.linked = 0
        # Open elements that matter (blocks, links, those beside the article): name, beside or
        # not.  ``names`` counts them by name, ``open`` those not beside, and all beside.
        self.stack: list[tuple[str, bool]] = []
        self.names: Counter = Counter()
        self.open: Counter = Counter()
        self.boxes, self.box = [0], 0
        last = 0
        for m in MARKUP.finditer(page):
            self.add(page[last : m.start()])
            last = m.end()
            if m["tag"] and m["close"]:
                self.end(m["tag"].lower())
            elif m["tag"]:
                self.start(m["tag"].lower(), m["rest"])
        self.add(page[last:])
        self.close(len(self.stack))
        self.flush()

    def add(self, text: str) -> None:
        if text and not self.open["beside"]:
            text = entities.unescape(text) if "&" in text else text
            self.pieces.append(text)
            self.linked += len(text.strip()) * (self.open["a"] > 0)

    def flush(self, gap: bool = False) -> None:
        text = SPACES.sub(" ", "".join(self.pieces)).strip()
        heading = bool(self.stack) and self.stack[-1][0] in HEADINGS
        where = self.open["article"] > 0, self.open["main"] > 0, self.boxes[-1], heading
        if text:
            self.lines.append(Line(text, self.linked, *where))
        if gap:
            self.lines.append(Line("", 0, *where))
        self.pieces, self.linked = [], 0

    def close(self, count: int) -> None:
        for _ in range(count):
            tag, beside = self.stack[-1]
            if tag in BLOCK or beside:
                self.flush(gap=beside)
            self.stack.pop()
            self.names[tag] -= 1
            if tag in BOXES:
                self.boxes.pop()
            self.open[tag] -= not beside
            self.open["beside"] -= beside

    def end(self, tag: str) -> None:
        depth = 0
        if self.names[tag]:
            depth = next(i for i, s in enumerate(reversed(self.stack), 1) if s[0] == tag)
        around = self.stack[len(self.stack) - depth + 1 :] if depth else []
        # The end tag of an inline element does not close blocks in it.
        if depth and (tag in BLOCK or not any(s[0] in BLOCK for s in around)):
            self.close(depth)
        elif tag in BLOCK:
            self.flush()

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.add(" ")
        if tag == "body" and self.names["head"]:
            self.end("head")
        if tag == "a" and self.names["a"]:
            self.end("a")
        if tag in BLOCK:
            # A block ends an open paragraph, and one of its own kind in the same list or table.
            ends = SAME_ENDS.get(tag, set()) | {"p"}
            for depth, s in enumerate(reversed(self.stack), 1):
                if s[0] in ends:
                    self.close(depth)
                if s[0] in BLOCK:
                    break
            self.flush()
        if tag in VOID or rest.endswith("/"):
            return
        words = " ".join(x for found in NAMES.findall(rest) for x in found).lower() if rest else ""
        if tag in ("article", "main"):
            beside = bool(words and LESSER.search(words))
        elif tag == "header" and self.open["article"]:
            beside = bool(words) and is_beside(words)  # an article's own head has its title
        else:
            beside = tag in ASIDE or tag in CONTAINERS and bool(words) and is_beside(words)
        if not (beside or tag in BLOCK or tag == "a"):
            return
        if beside:
            self.flush()
        self.stack.append((tag, beside))
        self.names[tag] += 1
        if tag in BOXES:
            self.box += 1
            self.boxes.append(self.box)
        self.open[tag] += not beside
        self.open["beside"] += beside


def surges(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of lines between a surge and a dive of the summed lengths.

    The sum over the window that starts at a line rises above nothing where text begins
    (the surge is its first line with text) and falls to nothing where text has ended (the
    dive is the line after its last).
    """
    if not len(lengths) or not lengths.any():
        return []
    padded = np.concatenate([lengths, np.zeros(window - 1, lengths.dtype)])
    sums = np.convolve(padded, np.ones(window, lengths.dtype), "valid")
    full = np.flatnonzero(sums > 0)
    breaks = np.flatnonzero(np.diff(full) > 1)
    found = []
    for a, b in zip(full[np.r_[0, breaks + 1]], full[np.r_[breaks, len(full) - 1]]):
        texts = a + np.flatnonzero(lengths[a : b + 1])
        found.append((int(texts[0]), int(texts[-1]) + 1))
    return found


def line_weights(lines: list[Line], window: int = WINDOW) -> tuple[np.ndarray, list[bool] | None]:
    """What every line weighs, and which lines stand in an article (or else main element)
    that has text; None if the page has neither.

    A line weighs its length.  In an article, links weigh nothing where ``window`` lines in
    a row, no headings, are mostly links (a menu, not a sentence that is a link), and lines
    outside weigh nothing; without an article no line that is mostly links weighs anything.
    """
    inside = [x.article for x in lines] if any(x.article and x.text for x in lines) else [x.main for x in lines]
    named = any(i and x.text for i, x in zip(inside, lines))
    links = np.array([x.linked > LINK_SHARE * len(x.text) and not x.heading for x in lines], bool)
    weights = np.array([len(x.text) for x in lines], np.int64)
    if named:
        ends = np.flatnonzero(np.diff(np.r_[False, links, False]))
        for a, b in zip(ends[::2], ends[1::2]):
            if b - a < window:
                links[a:b] = False
        weights[~np.array(inside, bool)] = 0
    some = np.where(links, 0, weights)
    return (some if some.any() else weights * named), inside if named else None


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The main text of one page: lines between surge and dive, joined by line ends.

    In an article (or else a main element) the text of all surges is kept.  Elsewhere the
    boxes decide: those with at least a fifth of the text of the largest are the page's own,
    and a surge reaches from its first line in one of them to its last.  So a short closing
    paragraph behind a list of links stays, and a line of its own below the text goes.
    Lines without weight stay where the kept text stands.
    """
    if not page:
        return ""
    lines = Lines(page).lines
    weights, inside = line_weights(lines, window)
    kept = inside
    if inside is None:
        sizes: Counter = Counter()
        for x, n in zip(lines, weights.tolist()):
            sizes[x.box] += n
        most = max(sizes.values(), default=0)
        kept = [5 * sizes[x.box] >= most > 0 for x in lines]
    out = []
    for a, b in surges(weights, window):
        own = [i for i in range(a, b) if kept[i] and weights[i]]
        for i in range(own[0], own[-1] + 1) if own else ():
            x = lines[i]
            if x.text and (weights[i] or kept[i] and (inside is None or x.linked <= LINK_SHARE * len(x.text))):
                out.append(x.text)
    return "\n".join(out)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW
) -> DataFrame:
    """``id_col, url_col, text, n_chars`` for every row of ``pages``.

    Whole pages are read.  A null or empty page, or one without main text, gives an empty
    text of length 0.  Repeated rows stay repeated; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, window) for p in batch.column(2).to_pylist()]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths],
                names=["id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
