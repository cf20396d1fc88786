"""Main text of web pages: flat text blocks, their neighbours, and a small decision tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import append
from tidewell.llm.labelled import PAGES

#: Bytes of pages in one batch.
BATCH_BYTES = 8 << 20

# Fixed values of the markup language: elements whose content is no text, and those that end a block.
SILENT = set("title script style noscript template iframe object embed svg math canvas audio video textarea select".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = set("area base br col hr img input link meta param source track wbr".split())
#: An element of the key closes an open element of these names that it directly meets.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements beside the article, and words of class, id and role that name such places.
BESIDE = set("nav aside footer form button fieldset dialog menu search".split())
BESIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search menu nav "
    "navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar social share sharing "
    "related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager "
    "copyright legal hidden complementary contentinfo form dialog".split()
)
#: Words that name the place of the article where no element does.
MAIN_WORDS = set("article content main post entry story".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    """A flat text block: its text, where it begins in the page, and what the tree looks at."""

    text: str
    at: int
    words: int
    linked: int
    beside: bool
    level: int
    heading: bool


def _named(attributes: str) -> tuple[set[str], bool]:
    """Words in class, id and role, and whether the element is hidden."""
    words, hidden = set(), bool(re.search(r"(?:^|\s)hidden(?=\s|=|/|$)", attributes))
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("class", "id", "role"):
            for one in value.split():
                own = {w.lower() for w in WORD.findall(one)}
                # Names as `no-sidebar` or `has-menu` speak of something else.
                words |= set() if own & {"no", "has", "with", "without"} else own
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
    return words, hidden


def _place(tag: str, attributes: str, level: int) -> tuple[bool, int]:
    """Whether an element lies beside the article, and how surely it holds it: 3 article, 2 main, 1 by name."""
    words, hidden = _named(attributes) if "=" in attributes or "hidden" in attributes else (set(), False)
    if tag in ("html", "body"):
        return False, 0
    if tag == "header" and not level:
        return True, 0
    if not level and words & {"header", "banner", "masthead"}:
        return True, 0
    if hidden or tag in BESIDE or (words & BESIDE_WORDS and tag != "main"):
        return True, 0
    named = 3 if tag == "article" else 2 if tag == "main" or "main" in words else 1 if words & MAIN_WORDS else 0
    return False, named


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order.

    Elements that stand for blocks end one; white space in a block, line breaks included, becomes one
    space. Text of scripts, styles, forms' fields and the head is none. Unclosed elements, stray ends, and a
    page that stops anywhere are taken as browsers take them, as far as blocks go.
    """
    found: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    at = position = linked = 0
    heading = False
    #: Depth at which an open link began.
    link: int | None = None
    lowered = None

    def end_block() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            _, beside, level = stack[-1] if stack else ("", False, 0)
            words = text.count(" ") + 1
            found.append(Block(text, at, words, min(linked, words), beside, level, heading))
        parts, linked = [], 0

    def take(text: str, start: int) -> None:
        nonlocal at, linked
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        if not parts:
            at = start
        parts.append(text)
        if link is not None:
            linked += len(text.split())

    while position < len(page):
        match = TOKEN.search(page, position)
        if match is None:
            take(page[position:], position)
            break
        take(page[position : match.start()], position)
        position = match.end()
        if match[2] is None:
            continue
        closing, tag = match[1], match[2].lower()
        if not page.endswith(">", 0, position):
            break  # the page stops inside a tag
        if tag in SILENT:
            if not closing and not match[3].endswith("/"):
                lowered = page.lower() if lowered is None else lowered
                end = lowered.find("</" + tag, position)
                if end < 0:
                    break
                position = end
            continue
        if tag == "a":
            link = None if closing or "href" not in match[3].lower() else len(stack)
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            end_block()
            if closing:
                names = [name for name, _, _ in stack]
                if tag in names:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]
            else:
                while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
                    stack.pop()
                if tag not in EMPTY:
                    _, beside, level = stack[-1] if stack else ("", False, 0)
                    own_beside, own_level = _place(tag, match[3], level)
                    stack.append((tag, beside or own_beside, max(level, own_level)))
            if link is not None and len(stack) < link:
                link = None
            heading = bool(stack) and re.fullmatch("h[1-6]", stack[-1][0]) is not None
    end_block()
    return found


#: What the tree may ask about a block.
FEATURES = ("outside", "inside", "words", "density", "words_before", "density_before", "words_after", "density_after", "heading")


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block, columns as `FEATURES`.

    A block is inside if it lies in the page's surest kind of container, and outside if it lies beside the
    article, or if the page has a container and the block is not in it. Where nothing is named, it is neither.
    """
    best = max((b.level for b in blocks if not b.beside), default=0)
    words = np.array([b.words for b in blocks], dtype=float)
    density = np.array([b.linked / b.words for b in blocks], dtype=float)
    within = np.array([not b.beside and 0 < best == b.level for b in blocks])
    outside = np.array([b.beside or b.level < best for b in blocks])
    heading = np.array([b.heading for b in blocks], dtype=float)
    # The neighbours are those that do not already stand outside.
    near = np.flatnonzero(~outside)
    before, after = np.zeros((2, len(blocks))), np.zeros((2, len(blocks)))
    rank = np.searchsorted(near, np.arange(len(blocks)))
    for i in range(len(blocks)):
        if rank[i] > 0:
            before[:, i] = words[near[rank[i] - 1]], density[near[rank[i] - 1]]
        next_at = rank[i] + (not outside[i])
        if next_at < len(near):
            after[:, i] = words[near[next_at]], density[near[next_at]]
    return np.column_stack([outside, within, words, density, before[0], before[1], after[0], after[1], heading])


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 4) -> tuple:
    """A decision tree by Gini impurity: (feature, border, tree of values up to it, tree of larger ones), or (label,).

    The border lies half way between two neighbouring values, with at least `least` rows on each side; the
    first of equally good splits wins.
    """
    share = labels.mean() if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (bool(share >= 0.5),)
    best = (share * (1 - share) * len(labels) - 1e-9, None, None)
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for border in (values[1:] + values[:-1]) / 2:
            left = rows[:, feature] <= border
            if min(left.sum(), (~left).sum()) < least:
                continue
            impurity = sum(labels[s].mean() * (1 - labels[s].mean()) * s.sum() for s in (left, ~left))
            if impurity < best[0]:
                best = (impurity, feature, border)
    _, feature, border = best
    if feature is None:
        return (bool(share >= 0.5),)
    left = rows[:, feature] <= border
    low, high = (grow(rows[s], labels[s], depth - 1, least) for s in (left, ~left))
    return low if low == high else (feature, float(border), low, high)


def decide(tree: tuple, rows: np.ndarray) -> np.ndarray:
    """The tree's verdict on every row."""
    if len(tree) == 1:
        return np.full(len(rows), tree[0])
    feature, border, low, high = tree
    return np.where(rows[:, feature] <= border, decide(low, rows), decide(high, rows))


def train(pages: list[list[tuple[bool, str]]]) -> tuple:
    """A tree from labelled pages: each a list of (belongs to the article, markup) in page order.

    The table is an argument of the caller's and small; the default one has `len(PAGES)` pages.
    """
    rows, labels = [], []
    for page in pages:
        blocks = blocks_of("".join(markup for _, markup in page))
        ends = np.cumsum([len(markup) for _, markup in page])
        rows.append(features(blocks))
        labels += [page[int(np.searchsorted(ends, b.at, side="right"))][0] for b in blocks]
    return grow(np.concatenate(rows), np.array(labels, dtype=float))


def main_text(page: str, tree: tuple) -> tuple[str, int, int]:
    """The article's blocks joined by line feeds, the number of all blocks and of those kept."""
    blocks = blocks_of(page)
    if not blocks:
        return "", 0, 0
    kept = [b.text for b, keep in zip(blocks, decide(tree, features(blocks)), strict=True) if keep]
    return "\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, labelled: list[list[tuple[bool, str]]] = PAGES, markup: str = "html") -> DataFrame:
    """All columns of `pages` with `text`, `n_chars` (code points of it), `n_blocks` and `n_kept`.

    Every page is split into flat text blocks; a decision tree trained on the small labelled table looks
    at the word count and link density of a block and of its neighbours, at the place that elements and their
    names give it, and says whether the block belongs to the article. Blocks are kept whole and in order.

    A null or empty page, and one without an article, has an empty text. Rows are handled each for itself,
    so repeated rows get equal results; no rows give no rows. Columns of the made names are replaced.
    """
    tree = train(labelled)

    def run(batch: pa.RecordBatch) -> list:
        made = [main_text(page or "", tree) for page in batch.column(markup).to_pylist()]
        texts = [text for text, _, _ in made]
        return [
            pa.array(texts, pa.string()),
            pa.array([len(text) for text in texts], pa.int64()),
            pa.array([n for _, n, _ in made], pa.int64()),
            pa.array([n for _, _, n in made], pa.int64()),
        ]

    return append(pages, "text string, n_chars bigint, n_blocks bigint, n_kept bigint", run, markup, BATCH_BYTES)
