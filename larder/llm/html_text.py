"""Main text of web pages by minimum cuts.

A page is read into blocks of text, each with the elements around it. A logistic classifier, fitted on blocks whose
elements name their part of the page, gives each block a cost of being content and one of being boilerplate: these are the
capacities of its edges from the source and to the sink. Blocks that follow each other, and blocks under one element, are
joined by edges whose capacity grows with their nearness in the tree. A maximal flow parts content from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Elements of the HTML standard by what they do to text, and names that pages give to their parts.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is not text of the page.
SILENT_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video textarea select button head title noframes datalist".split())
RAW_TAGS = frozenset("script style textarea title iframe noframes".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "thead": frozenset(["tr", "td", "th"]), "tbody": frozenset(["thead", "tr", "td", "th"]), "option": frozenset(["option"]),
}
CLOSE_UNTIL = frozenset("ul ol dl table tr tbody thead div section article nav aside main body form menu header footer blockquote".split())
PART_TAGS = frozenset("nav footer aside form menu dialog search".split())
MAIN_TAGS = frozenset(["article", "main"])
#: What may stand in a head: any other start tag, and text, ends a head whose end tag is left out.
HEAD_TAGS = frozenset("base basefont bgsound link meta title style script noscript noframes template object".split())
#: These hold whole pages, so that their names tell of no part.
PAGE_TAGS = frozenset(["html", "body"])
#: Frame elements that hold no main text of the page; a form may, where it is wrapped around all of it.
FIRM_TAGS = PART_TAGS - {"form"} | {"header"}
PART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs"
    " header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent notice notices alert popup modal overlay newsletter subscribe"
    " signup login search form comment comments reply replies respond disqus discussion pagination pager skip contentinfo complementary copyright legal disclaimer".split()
)
MAIN_NAMES = frozenset("article articlebody content entry main maincontent post postbody story text body".split())
TITLE_NAMES = frozenset("article content entry post story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
#: Names that tell what else the page has or lacks, as in has-sidebar.
_STATE = re.compile(r"(?:has|have|no|not|with|without|is|hide|show)[-_]")


def _words(name: str) -> set[str]:
    """The words in a name; the header of an article, as in entry-header, holds its title and is no part of the frame."""
    words = set(_NAME.findall(name))
    return words - {"header"} if words & TITLE_NAMES else words


@dataclass
class Piece:
    """A block: its text, the characters of it in links, the elements around it (serial number, tag) and hints in their names."""

    text: str
    linked: int
    path: tuple[int, ...]
    tag: str
    part: bool
    main: bool


def pieces_of(page: str) -> list[Piece]:
    """The blocks of text of a page in order, character references decoded and white space made one space."""
    out: list[Piece] = []
    # open elements: (serial, tag, part of the frame, part of the main text, silent, part by an element or a whole name)
    stack: list[tuple[int, str, bool, bool, bool, bool]] = [(0, "", False, False, False, False)]
    text: list[str] = []
    linked = 0
    serial, links, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                blocks = [s for s in stack if s[1] in BLOCK_TAGS]
                top = stack[-1]
                out.append(Piece(whole, min(linked, len(whole)), tuple(s[0] for s in blocks), blocks[-1][1] if blocks else "", top[2], top[3]))
            text.clear()
        linked = 0

    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if stack[-1][1] == "head" and end > at and not page[at:end].isspace():
            stack.pop()
        if end > at and not stack[-1][4]:
            text.append(page[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    if any(s[1] in BLOCK_TAGS for s in stack[k:]):
                        flush()
                    links -= sum(s[1] == "a" for s in stack[k:])
                    del stack[k:]
                    break
            continue
        if tag == "body" and any(s[1] == "head" for s in stack):
            del stack[next(k for k, s in enumerate(stack) if s[1] == "head") :]
        elif stack[-1][1] == "head" and tag not in HEAD_TAGS:
            stack.pop()
        if tag in BLOCK_TAGS:
            flush()
            shut = CLOSES.get(tag, frozenset(["p"]))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in shut:
                    links -= sum(s[1] == "a" for s in stack[k:])
                    del stack[k:]
                    break
                if stack[k][1] in CLOSE_UNTIL:
                    break
        elif tag == "br":
            text.append(" ")
        if tag in VOID_TAGS or m[3].endswith("/") and tag not in BLOCK_TAGS:
            continue
        _, _, part, main, silent, firm = stack[-1]
        whole = {w for x in _NAMES.findall(m[3]) for w in "".join(x).lower().split() if not _STATE.match(w)} if m[3] and tag not in PAGE_TAGS else frozenset()
        names = {w for x in whole for w in _words(x)}
        # an article or main element is no part because of a name that is but a piece of a wrapper's, like layout-sidebar; the main element never
        if tag in PAGE_TAGS or tag == "main":
            part = firm = False
        elif tag in MAIN_TAGS:
            part = firm
        if (tag in FIRM_TAGS and (tag != "header" or not main)) or PART_NAMES.intersection(whole):
            firm = True
        if firm or tag in PART_TAGS or PART_NAMES.intersection(names):
            part = True
        if tag in MAIN_TAGS or MAIN_NAMES.intersection(names):
            main = True
        serial += 1
        silent = silent or tag in SILENT_TAGS or "hidden" in m[3].lower().split()
        stack.append((serial, tag, part, main, silent, firm))
        links += tag == "a"
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            stack.pop()
    flush()
    return out


#: The first N_TEXT features tell of the text and its own element, the others of the names of the elements around it.
N_FEATURES, N_TEXT = 9, 7


def features(pieces: list[Piece]) -> np.ndarray:
    """Per block: what the classifier sees. The last two tell of the elements around it."""
    out = np.empty((len(pieces), N_FEATURES))
    for i, p in enumerate(pieces):
        n = len(p.text)
        words = p.text.count(" ") + 1
        stops = sum(p.text.count(c) for c in ".,;:!?")
        out[i] = (1.0, min(np.log1p(words), 5.0), p.linked / n, min(stops / words, 1.0), p.tag[:1] == "h" and p.tag[1:].isdigit(), p.tag == "p", p.tag in ("li", "td", "th", "dd", "dt"), p.main, p.part)
    return out


#: Weights before any page has been seen; fitting starts here and is held near them.
PRIOR = np.array([-0.5, 0.6, -4.0, 1.0, 1.0, 1.0, -0.5, 3.0, -6.0])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most_pages: int = 1000, seed: int = 11) -> np.ndarray:
    """The classifier's weights from a sample of about `most_pages` pages, chosen by the hash of their ids.

    A block counts as content when it lies in an article or main element and in nothing that names a part of the frame, as
    boilerplate when it lies in such a part; other blocks are left out. Only the weights of the text are fitted, to tenths of
    its features, of which there are some 50,000 different rows at most however long the pages are: the names are where the
    labels come from, so theirs stay as in PRIOR. Ridge logistic regression about PRIOR, by Newton steps.
    """
    share = min(1.0, most_pages / max(1, pages.count()))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = pages.filter(place < share).select(F.col(html_col).cast("string").alias("h")).filter("h is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                pieces = pieces_of(page)
                known = [p for p in pieces if p.part or p.main]
                if known:
                    x, y = np.round(features(known)[:, :N_TEXT], 1), np.array([not p.part for p in known], float)
                    yield pa.RecordBatch.from_pydict({"x": x.tolist(), "y": y})

    rows = chosen.mapInArrow(run, "x array<double>, y double")
    found = rows.groupBy("x", "y").agg(F.count("*").alias("n")).toPandas()
    prior = PRIOR[:N_TEXT]
    w = prior.copy()
    if len(found):
        found = found.sort_values(["y", "n"], kind="stable")
        x, y, n = np.array(found.x.tolist()), found.y.to_numpy(), found.n.to_numpy(float)
        n = n / n.sum() * 1000
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 2.0, x.T @ (n * (y - p)) - 2.0 * (w - prior))
            w = w + step
            if abs(step).max() < 1e-6:
                break
    return np.concatenate([w, PRIOR[N_TEXT:]])


#: Capacity of the edge between neighbours that share all their elements, and how it falls with each that they do not.
NEAR, FALL = 1.2, 0.5


def edges_of(pieces: list[Piece]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the next, and to the next but one where both lie right under one element."""
    out = []
    for i in range(len(pieces) - 1):
        for j in (i + 1, i + 2):
            if j < len(pieces):
                a, b = pieces[i].path, pieces[j].path
                shared = 0
                for x, y in zip(a, b, strict=False):
                    if x != y:
                        break
                    shared += 1
                apart = max(len(a), len(b)) - shared
                if j == i + 1 or apart <= 1:
                    out.append((i, j, NEAR * FALL ** max(0, apart - 1) / (j - i)))
    return out


def min_cut(scores: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes lie on the source's side of a minimum cut: scores are terminal capacities (to the source if above 0, else to the sink)."""
    n = len(scores)
    score = [float(s) for s in scores]
    side = [0] * n
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in edges:
        around[i].append((j, c))
        around[j].append((i, c))
    # a node whose own capacity outweighs all its open edges is settled, and its edges become capacities of its neighbours
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if not side[i] and abs(score[i]) > sum(c for j, c in around[i] if not side[j]):
            side[i] = 1 if score[i] > 0 else -1
            for j, c in around[i]:
                if not side[j]:
                    score[j] += c * side[i]
                    todo.append(j)
    rest = [i for i in range(n) if not side[i]]
    if rest:
        source, sink = n, n + 1
        flow: dict[int, dict[int, float]] = {i: {} for i in (*rest, source, sink)}
        for i in rest:
            a, b = (source, i) if score[i] > 0 else (i, sink)
            flow[a][b] = flow[a].get(b, 0.0) + abs(score[i])
            flow[b].setdefault(a, 0.0)
            for j, c in around[i]:
                if not side[j]:
                    flow[i][j] = flow[i].get(j, 0.0) + c
        while True:  # shortest augmenting paths
            before = {source: source}
            todo = deque([source])
            while todo and sink not in before:
                u = todo.popleft()
                for v, c in flow[u].items():
                    if c > 1e-12 and v not in before:
                        before[v] = u
                        todo.append(v)
            if sink not in before:
                break
            path, v = [], sink
            while v != source:
                path.append((before[v], v))
                v = before[v]
            least = min(flow[u][v] for u, v in path)
            for u, v in path:
                flow[u][v] -= least
                flow[v][u] = flow[v].get(u, 0.0) + least
        for i in rest:
            side[i] = 1 if i in before else -1
    return np.array([s > 0 for s in side], bool)


def main_text(page: str | None, weights: np.ndarray) -> str:
    pieces = pieces_of(page) if page else []
    if not pieces:
        return ""
    content = min_cut(features(pieces) @ weights, edges_of(pieces))
    return "\n\n".join(p.text for p, keep in zip(pieces, content, strict=True) if keep)


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, the main text and its number of code points.

    Null and empty html, and pages of boilerplate alone, give an empty text. Repeated rows are kept. weights: of fit(), which
    is called where they are not given.
    """
    w = fit(pages, id_col, html_col) if weights is None else weights
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h, w) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
