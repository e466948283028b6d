"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one per block of the page. A line weighs the length of its text without links;
markup only sets weights. Text of elements that never hold the article (menus, headers, footers,
sidebars, forms, scripts) and reader comments weigh nothing; other words of a class (adverts, notices)
leave a small share. Where the page marks its article, lines in it weigh more and those outside a share. Blank
lines stand where such a state changes.

Sums over sliding windows of lines then decide: a stretch begins at a surge (a window over the threshold)
and ends at a dive (windows that are empty again). All lines of a stretch are kept, short ones and lines
of links too; all others go. Pages that mark no article and are short take half of their heaviest window as threshold.

Defined results: null or empty html gives the empty text. What isn't closed ends with its parent; end tags
without a start and tags cut by the end of the page are skipped; a quote that is never closed ends
with its tag. Time is linear in the page, however deep elements are nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import load
from factweave.llm.tokens import slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style iframe textarea title noframes xmp".split())
P_ENDS_AT = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Which open elements a start tag closes, and what keeps them open.
SIBLINGS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
#: Elements whose text never is the article's.
NOT_ARTICLE = frozenset("nav header footer aside form button head menu dialog noscript template object svg canvas math select".split())
#: Words of class, id or role: reader comments, which can be as long as an article, and what may stand beside one.
COMMENTS = frozenset("comment comments reply replies responses discussion disqus respond".split())
BESIDE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead share sharing social related recommended newsletter subscribe login search toolbar widget tags disclaimer copyright complementary contentinfo".split())

#: Comments, sections and tags. A quote that never closes doesn't hide the end of its tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACES = re.compile(r"\s+")

WINDOW, THRESHOLD, OUTSIDE, BESIDE_SHARE = 3, 60, 0.2, 0.02


def _cue(attributes: str, inside: bool) -> tuple[int, bool]:
    """What an element's own words say: 2 reader comments, 1 something beside the article, 0 nothing; and whether they mark the article. Inside an article only whole class names count, so that a section named legal-history stays."""
    out, main = 0, False
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "role" and value.lower() == "main" or kind == "itemprop" and value.lower() == "articlebody":
            main = True
        elif kind != "itemprop":
            words = value.lower().split() if inside else re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            out = max(out, 2 if COMMENTS.intersection(words) else 1 if BESIDE.intersection(words) else 0)
    return out, main


class Line(NamedTuple):
    """A block's text, how many of its characters are link text, whether it stands beside the article (1 by its words, 2 by its element) and whether in the marked article."""

    text: str
    linked: int
    beside: int
    article: bool


class _Open:
    """Open elements. Each entry sums up those below it, and places are kept by name, so no step walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, int, int]] = []  # name, beside, article, blocks so far, blocks but p so far
        self.at: dict[str, list[int]] = {}

    def push(self, name: str, beside: int, article: bool) -> None:
        stack = self.stack
        _, _, _, blocks, others = stack[-1] if stack else ("", 0, False, 0, 0)
        if name not in INLINE:
            blocks, others = blocks + 1, others + (name != "p")
        if name in self.at:
            self.at[name].append(len(stack))
        else:
            self.at[name] = [len(stack)]
        stack.append((name, beside, article, blocks, others))

    def cut(self, depth: int) -> None:
        for name, *_ in reversed(self.stack[depth:]):
            self.at[name].pop()
        del self.stack[depth:]

    def last(self, name: str) -> int:
        places = self.at.get(name)
        return places[-1] if places else -1

    def state(self, depth: int | None = None) -> tuple[int, bool]:
        depth = len(self.stack) if depth is None else depth
        return self.stack[depth - 1][1:3] if depth else (0, False)

    def blocks(self, depth: int, k: int = 3) -> int:
        """Blocks (k = 4: other than p) from a depth on."""
        return self.stack[-1][k] - (self.stack[depth - 1][k] if depth else 0) if depth < len(self.stack) else 0


def lines(page: str) -> tuple[list[Line], bool]:
    """A line for each block with text, in page order, and whether the page marks an article."""
    made: list[Line] = []
    now = _Open()
    parts: list[str] = []
    linked = 0
    marked = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                made.append(Line(text, linked, *now.state()))
        parts.clear()
        linked = 0

    def text(x: str) -> None:
        nonlocal linked
        if x:
            parts.append(x)
            if now.last("a") >= 0:
                linked += len(x.strip())

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if at < m.start():
            text(page[at : m.start()])
        at, name = m.end(), (m[1] or m[3] or "").lower()
        if m[0].startswith("<![CDATA["):
            text(html.escape(m[0][9:].removesuffix("]]>")))
        if not name:
            continue
        if m[0][1] == "/":
            depth = now.last(name)
            if depth < 0:
                if name == "p":
                    flush()
                continue
            if now.blocks(depth) or now.stack[depth][1] != now.state(depth)[0]:
                flush()
            now.cut(depth)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "br" or name == "hr":
            flush()
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            if parts:
                flush()
            if name in P_ENDS_AT and (depth := now.last("p")) >= 0 and not now.blocks(depth, 4):
                now.cut(depth)
            for closes in SIBLINGS.get(name, ()):
                if (depth := now.last(closes)) > max(now.last(stop) for stop in STOPS[closes]):
                    now.cut(depth)
        beside, article = now.state()
        cue, main = _cue(m[2], article) if m[2] else (0, False)
        if name in ("html", "body", "main"):
            cue = 0
        if cue and name in INLINE:
            flush()
        drop = max(beside, 2 if name in NOT_ARTICLE else cue)
        if name in HEADINGS and beside and article and (head := now.last("header")) >= 0 and not now.state(head)[0]:
            drop = 0  # an article's own header holds its heading
        if name in ("article", "main") and drop == 1 and not cue and not marked:
            drop = 0  # a class of a wrapper says less than the page's first article
        if (name in ("article", "main") or main) and not drop:
            marked = article = True
        if not m[0].endswith("/>"):
            now.push(name, drop, article)
    flush()
    return made, marked


def weigh(got: list[Line], marked: bool) -> tuple[list[int], list[float]]:
    """Places of the lines among blank ones, and the weight of each place. Where the state changes, `WINDOW` blank lines part the blocks.

    A line weighs the length of its text that isn't linked. In a marked article it weighs all its text and a
    surge beside; outside it, on such pages, a share. Lines beside the article weigh a share by their words, nothing by their element.
    """
    at, out, before = [], [], None
    for x in got:
        state = (x.beside, x.article)
        if before not in (None, state):
            out += [0.0] * WINDOW
        before = state
        at.append(len(out))
        if x.beside == 2:
            w = 0.0
        elif x.article and not x.beside:
            w = float(THRESHOLD + len(x.text))
        else:
            w = max(0, len(x.text) - x.linked) * (OUTSIDE if marked else 1.0) * (BESIDE_SHARE if x.beside else 1.0)
        out.append(w)
    return at, out


def sums(weights: list[float], window: int) -> list[float]:
    """Sum of the window that starts at each line."""
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def stretches(weights: list[float], window: int, threshold: float) -> list[tuple[int, int]]:
    """[surge, dive) of each stretch: from a window over the threshold to where windows are empty, or the end; without lines of no weight at its ends."""
    block, n, out, i = sums(weights, window), len(weights), [], 0
    while i < n:
        if block[i] > threshold:
            j = i
            while j < n and block[j] > 0:
                j += 1
            lo, hi = i, j
            while not weights[lo]:
                lo += 1
            while not weights[hi - 1]:
                hi -= 1
            out.append((lo, hi))
            i = j
        else:
            i += 1
    return out


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    got, marked = lines(page or "")
    at, weights = weigh(got, marked)
    if not marked:  # a short page's own measure: half of its heaviest window of ordinary lines
        plain = [0.0] * len(weights)
        for i, x in zip(at, got, strict=True):
            plain[i] = 0.0 if x.beside else weights[i]
        if most := max(sums(plain, window), default=0):
            threshold = min(threshold, most / 2)
    place = dict(zip(at, got, strict=True))
    kept = (place[i] for lo, hi in stretches(weights, window, threshold) for i in range(lo, hi) if i in place)
    return "\n".join(x.text for x in kept if x.beside < 2)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 0):
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every page."""
    own = pages.select(F.col(f"`{page}`").alias("_html"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    schema = ", ".join([*(f"k{i} {own.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "text string, n_chars long"])
    out = own.mapInArrow(_extract, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def query(spark, sf_dir):
    return extract(load(spark, sf_dir, "pages"))
