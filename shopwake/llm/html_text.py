"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each has its number of words and its
share of words in links, those of its neighbours, and what it stands in. A
decision tree fitted on a small labelled table keeps or drops each block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import slices

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Elements that end a block, that hold others, that hold no text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDER = frozenset(
    "article aside blockquote details dialog div dl fieldset figure footer form head header main nav noscript ol section select table template ul button".split()
)
RAW = frozenset("script style textarea title iframe xmp noembed noframes svg math object video audio canvas".split())
APART = frozenset("aside button dialog footer form head header nav noscript select template".split())
# Words in class, id or role of what is not the article, and of what is.
APART_WORDS = frozenset(
    """ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie
    cookies dialog disqus feedback footer form gdpr header login masthead menu menubar modal nav navbar navigation navigations newsletter notice notices pager
    pagination popup promo promotion promotions recommended related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored
    sponsors subscribe subscription toolbar topbar widget widgets""".split()
)
# Those of them that never name a whole page.
PART_WORDS = frozenset(
    """ad ads advert advertisement advertising adverts breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus gdpr
    navbar newsletter newsletters pager pagination replies reply respond sidebars signup sponsors subscription""".split()
)
MAIN_WORDS = frozenset("article articlebody content entry post story".split())
# What follows them tells of other parts, not of the element itself.
ABOUT_OTHERS = frozenset("has no with without".split())

# Labelled blocks. Words and link share of the block, the one before and the
# one after; in an apart element; in an article; the page has an article; heading; label.
LABELLED = """
120 0.00 0 0.00 80 0.00 0 1 1 0 1
60 0.02 90 0.00 4 0.00 0 1 1 0 1
40 0.10 12 0.00 70 0.05 0 1 1 0 1
8 0.00 0 0.00 120 0.00 0 1 1 1 1
2 0.00 90 0.00 60 0.00 0 1 1 0 1
1 0.00 3 0.00 2 0.00 0 1 1 0 1
1 1.00 40 0.00 30 0.00 0 1 1 0 1
3 1.00 4 1.00 5 1.00 0 1 1 0 1
5 0.60 7 0.00 60 0.00 0 1 1 0 1
12 0.30 2 1.00 1 0.00 0 1 1 0 1
3 0.00 80 0.00 0 0.00 0 1 1 0 1
25 0.00 4 0.00 4 0.00 0 1 1 1 1
1 1.00 0 0.00 1 1.00 1 0 1 0 0
1 1.00 1 1.00 1 1.00 1 0 1 0 0
1 1.00 1 1.00 12 0.00 1 0 1 0 0
9 0.00 1 1.00 8 0.00 1 0 1 0 0
30 0.00 1 1.00 10 0.00 1 0 1 0 0
70 0.00 5 0.00 60 0.00 1 0 1 0 0
14 0.10 60 0.00 0 0.00 1 0 1 0 0
6 0.00 80 0.00 90 0.00 1 1 1 0 0
45 0.00 80 0.00 90 0.00 1 1 1 0 0
120 0.00 60 0.00 20 0.00 1 1 1 0 0
4 0.00 60 0.00 90 0.00 1 1 1 1 0
2 1.00 90 0.00 2 1.00 1 1 1 0 0
20 0.00 0 0.00 40 0.00 1 0 0 0 0
5 0.00 0 0.00 60 0.00 1 0 0 1 0
80 0.00 40 0.00 90 0.00 1 0 0 0 0
1 1.00 0 0.00 2 1.00 1 0 0 0 0
10 0.20 90 0.00 0 0.00 1 0 0 0 0
3 0.00 0 0.00 1 1.00 0 0 1 0 0
6 0.00 1 1.00 8 0.00 0 0 1 1 0
40 0.00 1 1.00 9 0.00 0 0 1 0 0
12 0.40 70 0.00 3 1.00 0 0 1 0 0
90 0.00 70 0.00 0 0.00 0 0 1 0 0
2 1.00 2 1.00 2 1.00 0 0 1 0 0
90 0.00 8 0.00 70 0.00 0 0 0 0 1
40 0.00 60 0.00 50 0.00 0 0 0 0 1
25 0.10 60 0.00 30 0.20 0 0 0 0 1
18 0.00 4 0.00 40 0.00 0 0 0 0 1
35 0.30 40 0.00 60 0.00 0 0 0 0 1
30 0.00 2 1.00 5 0.50 0 0 0 0 1
6 0.00 2 1.00 70 0.00 0 0 0 1 1
4 0.00 60 0.00 80 0.00 0 0 0 1 1
3 0.00 50 0.00 60 0.00 0 0 0 0 1
8 0.00 30 0.00 40 0.10 0 0 0 0 1
2 0.00 45 0.00 30 0.00 0 0 0 0 1
50 0.00 50 0.00 2 1.00 0 0 0 0 1
1000 0.00 0 0.00 0 0.00 0 0 0 0 1
60 0.00 1 1.00 1 1.00 0 0 0 0 1
25 0.05 3 1.00 0 0.00 0 0 0 0 1
45 0.00 5 0.00 4 0.80 0 0 0 0 1
90 0.20 20 1.00 9 0.90 0 0 0 0 1
5 0.00 90 0.00 2 1.00 0 0 0 0 0
4 0.00 2 1.00 3 1.00 0 0 0 0 0
3 0.00 1 1.00 2 0.00 0 0 0 0 0
2 1.00 40 0.00 3 1.00 0 0 0 0 0
4 1.00 3 1.00 30 0.00 0 0 0 0 0
12 0.80 10 1.00 9 0.90 0 0 0 0 0
30 0.70 20 0.80 25 0.60 0 0 0 0 0
9 0.50 4 0.00 3 0.00 0 0 0 0 0
6 0.00 8 0.90 7 1.00 0 0 0 1 0
7 0.00 4 0.00 0 0.00 0 0 0 0 0
120 0.00 90 0.00 80 0.00 1 1 0 0 1
60 0.05 120 0.00 40 0.00 1 1 0 0 1
35 0.00 50 0.00 60 0.10 1 1 0 0 1
25 0.10 6 0.00 40 0.00 1 1 0 0 1
12 0.00 40 0.00 60 0.00 1 1 0 0 1
4 0.00 0 0.00 90 0.00 1 1 0 1 1
5 0.00 60 0.00 80 0.00 1 1 0 1 1
300 0.00 0 0.00 0 0.00 1 1 0 0 1
2 1.00 3 1.00 2 1.00 1 1 0 0 0
6 0.90 40 0.00 5 1.00 1 1 0 0 0
20 0.80 12 0.90 15 0.80 1 1 0 0 0
40 0.70 30 0.80 20 0.90 1 1 0 0 0
1 1.00 90 0.00 2 1.00 1 1 0 0 0
3 0.00 2 1.00 4 1.00 1 1 0 0 0
50 0.00 50 0.00 2 1.00 1 1 0 0 1
90 0.10 60 0.00 1 1.00 1 1 0 0 1
2 1.00 2 1.00 0 0.00 1 1 0 0 0
3 1.00 2 1.00 40 0.00 1 1 0 0 0
2 1.00 60 0.00 0 0.00 1 1 0 0 0
2 0.00 1 1.00 60 0.00 1 1 0 1 1
3 0.00 2 1.00 80 0.00 1 1 0 1 1
2 0.00 60 0.00 50 0.00 1 1 0 1 1
2 0.00 50 0.00 60 0.00 1 1 0 0 1
120 0.00 90 0.00 80 0.00 1 0 1 0 0
120 0.00 90 0.00 80 0.00 1 0 0 0 0
120 0.00 90 0.00 80 0.00 1 1 1 0 0
60 0.05 120 0.00 40 0.00 1 0 1 0 0
60 0.05 120 0.00 40 0.00 1 0 0 0 0
60 0.05 120 0.00 40 0.00 1 1 1 0 0
35 0.00 50 0.00 60 0.10 1 0 1 0 0
35 0.00 50 0.00 60 0.10 1 0 0 0 0
35 0.00 50 0.00 60 0.10 1 1 1 0 0
25 0.10 6 0.00 40 0.00 1 0 1 0 0
25 0.10 6 0.00 40 0.00 1 0 0 0 0
25 0.10 6 0.00 40 0.00 1 1 1 0 0
12 0.00 40 0.00 60 0.00 1 0 1 0 0
12 0.00 40 0.00 60 0.00 1 0 0 0 0
12 0.00 40 0.00 60 0.00 1 1 1 0 0
300 0.00 0 0.00 0 0.00 1 0 1 0 0
300 0.00 0 0.00 0 0.00 1 0 0 0 0
300 0.00 0 0.00 0 0.00 1 1 1 0 0
50 0.00 50 0.00 0 0.00 1 0 1 0 0
50 0.00 50 0.00 0 0.00 1 0 0 0 0
50 0.00 50 0.00 0 0.00 1 1 1 0 0
4 0.00 0 0.00 90 0.00 1 0 1 1 0
4 0.00 0 0.00 90 0.00 1 0 0 1 0
4 0.00 0 0.00 90 0.00 1 1 1 1 0
5 0.00 60 0.00 80 0.00 1 0 1 1 0
5 0.00 60 0.00 80 0.00 1 0 0 1 0
5 0.00 60 0.00 80 0.00 1 1 1 1 0
"""

# The label holds as well where a holder is only named like an apart element. With 70 % of
# the page's plain words in it (0.3 apart) a block is labelled as in the open, with 55 % as apart.
NAMED = {0.0: 0.3, 1.0: 0.45}


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """Nested (feature, threshold, low branch, high branch), or a label."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = (np.inf, 0, 0.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, j] <= cut
            gini = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if gini < best[0] - 1e-12:
                best = (gini, j, float(cut))
    if best[0] == np.inf:
        return int(y.mean() >= 0.5)
    _, j, cut = best
    low = x[:, j] <= cut
    return j, cut, fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1)


@cache
def tree():
    table = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line])
    named = table.copy()
    named[:, 6] = [NAMED[v] for v in table[:, 6]]
    table = np.concatenate([table, named])
    return fit_tree(table[:, :-1], table[:, -1])


def _side(name: str, attributes: str) -> str:
    """What an element that holds blocks is: "apart" as such, "part" or "beside" if only its
    words say so (surely, or as they also name whole pages), "both" if others of them name the
    article, "main", or ""."""
    apart = main = part = False
    for m in ATTRIBUTE.finditer(attributes):
        others = False
        for token in (m[2] or m[3] or m[4] or "").split():
            own: set[str] = set()
            for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()):
                if word in ABOUT_OTHERS:
                    others = True
                elif not others:
                    own.add(word)
            if own or token.lower() not in ABOUT_OTHERS:
                others = False
            apart = apart or bool(own & APART_WORDS)
            part = part or bool(own & PART_WORDS)
            main = main or bool(own & MAIN_WORDS) and not own & APART_WORDS
    if name in APART:
        return "apart"
    if name == "main" or name == "article" and (main or not apart):
        return "main"
    return ("both" if main else "part" if part else "beside") if apart else "main" if main else ""


def blocks(page: str) -> list[tuple[str, int, int, float, bool, bool]]:
    """(text, words, words in links, how far apart, in an article, heading) in page order.

    What is apart by its words alone stays open where it holds the page's main
    elements, or, in a page without, its only article. Where its words may also name
    a whole page, and no article lies elsewhere, it is apart as far as the page's plain
    words lie outside it.
    """
    found: list[tuple[str, int, int, int, bool]] = []
    holders: list[tuple[str, str, int]] = []
    every: list[tuple[int, str]] = []  # the holder around each holder, and its side
    mains: list[int] = []  # main elements
    articles: list[int] = []  # articles that are in no other
    parts: list[tuple[str, bool]] = []
    heading = link = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
            found.append((text, len(text.split()), linked, holders[-1][2] if holders else -1, heading))
        parts.clear()

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            parts.append((page[at : m.start()], link))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name == "a":
            link = not closing
        elif name == "br":
            parts.append((" ", link))
        if name in BLOCK or name in HOLDER:
            flush()
            link = False
            heading = name[0] == "h" and name[1:].isdigit() and not closing
        if name in HOLDER:
            if not closing:
                side = _side(name, attributes)
                if side == "main" and name in ("main", "article") and not any(x == "apart" or n == name for n, x, _ in holders):
                    (mains if name == "main" else articles).append(len(every))
                every.append((holders[-1][2] if holders else -1, side))
                holders.append((name, side, len(every) - 1))
            elif name in (open_names := [n for n, _, _ in holders]):
                del holders[len(holders) - 1 - open_names[::-1].index(name) :]
        elif name == "body" and not closing:
            holders.clear()  # an open head ends here
    parts.append((page[at:], link))
    flush()
    stays = {-1}
    for k in mains or (articles if len(articles) == 1 else []):
        while k not in stays:
            stays.add(k)
            k = every[k][0]
    shut = {-1: False}  # in an element that is apart as such
    for k, (around, side) in enumerate(every):
        shut[k] = shut[around] or side == "apart"
    plain = dict.fromkeys(shut, 0)
    for _, words, linked, k, _ in found:
        plain[k] += 0 if shut[k] else words - linked
    for k in range(len(every) - 1, -1, -1):  # a holder's number is above that of the one around it
        plain[every[k][0]] += plain[k]
    named = {-1: False}  # in a holder that is apart, if only by its words
    main = {-1: False}
    for k, (around, side) in enumerate(every):
        named[k] = named[around] or side == "apart" or side in ("part", "beside", "both") and k not in stays
        main[k] = main[around] or side in ("main", "both")
    elsewhere = any(main[k] and not named[k] for *_, k, _ in found)  # the article is open to see
    apart = {-1: 0.0}
    for k, (around, side) in enumerate(every):
        apart[k] = apart[around]
        if shut[k] or side in ("part", "both") and k not in stays:
            apart[k] = 1.0
        elif side == "beside" and k not in stays:
            outside = 1.0 if elsewhere and not main[k] else 1 - plain[k] / max(plain[-1], 1)
            apart[k] = max(apart[k], outside)
    return [(text, words, linked, apart[k], main[k], is_heading) for text, words, linked, k, is_heading in found]


def kept_blocks(page: str) -> list[tuple[str, bool]]:
    """(text, kept) of every block."""
    found = blocks(page)
    any_main = max((1 - b[3] for b in found if b[4]), default=0)
    around = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    out = []
    for i, (text, words, linked, apart, main, heading) in enumerate(found):
        x = (words, linked / words, *around[i], *around[i + 2], apart, main, any_main, heading)
        node = tree()
        while not isinstance(node, int):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        out.append((text, bool(node)))
    return out


def main_text(page: str) -> str:
    return "\n\n".join(text for text, keep in kept_blocks(page) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("text", pa.string()), ("kept", pa.bool_())]))
    for batch in slices(batches, "html"):
        found = [[{"text": t, "kept": k} for t, k in kept_blocks(page or "")] for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, kind)], ["page_id", "url", "blocks"])


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, ``blocks`` (text and whether it is kept) and text.

    Character references are decoded, white space inside a block is one space,
    and kept blocks are joined in page order by an empty line. Very long pages are read
    whole. Null and empty
    pages have no blocks and an empty text; broken markup is read as far as it
    goes. Repeated rows give a row each; an empty table gives none; other columns are
    ignored.
    """
    kinds = dict(pages.dtypes)
    out = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, blocks array<struct<text:string,kept:boolean>>"
    )
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["kept"]), lambda b: b["text"]), "\n\n")
    return out.withColumn("text", text)
