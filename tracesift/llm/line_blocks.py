"""The main text of web pages, by the distribution of text over blocks of lines.

Markup is stripped so that every block element and every ``<br>`` ends a line; the page is then a list of lines.  Each line
weighs as many characters as it has of text; outside an article, links don't count.  Over a sliding window of ``WINDOW``
lines the weights are summed.  Text surges where a window's sum leaves zero, and dives where it comes back to zero.
Between a surge and its dive everything is kept, short lines too, if some window there holds ``SURGE`` characters, or a
``SHARE`` of the page's largest sum.  Menus, link lists and short remarks far from the text stay under both.

Stripping drops what markup calls something else than text: scripts, styles, comments, ``nav``, ``footer``, ``aside``,
``form`` (unless the article is in it), elements whose class, id or role names an advert, a notice, a menu, reader comments
and the like, and hidden ones.  ``header`` elements are dropped, but for the headings of one inside an article.  If the page has
``article`` elements with text, or else ``main``, the other lines weigh nothing, and articles are apart from each other
by a window of empty lines.

Tags are read as browsers do: optional end tags, stray ends, unclosed comments and tags, raw text in scripts.  Character
references are decoded, white space in a line becomes one space, and lines are joined by one space.

Inputs: a null page counts as empty, and has an empty text.  Pages are handled one by one: repeated keys and rows stay,
null keys are kept, other columns are ignored, whatever their names, and an empty table gives an empty table.  A page of
any length is read whole, in time that grows with its length.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesift.llm.common import chunks, frugal

#: Lines of a window; text between surge and dive counts from a window of so many characters on, or of such a share.
WINDOW, SURGE, SHARE = 3, 200, 0.2

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|</>|<[!?][^>]*+>?|</[^a-zA-Z>][^>]*+>?"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s>]+))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# The elements of HTML by what they do to lines.
RAW = _set("script style textarea title xmp iframe noembed noframes")
VOID = _set("area base br col embed hr img input link meta param source track wbr")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
BLOCKS = HEADINGS | _set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul"
)
CLOSES_P = BLOCKS - _set("body br button caption head html legend optgroup option select tbody td tfoot th thead title tr")
DROPPED = RAW | _set(
    "aside audio button canvas datalist dialog embed footer head map menu nav noscript object search select svg template video"
)
NEVER = _set("html body main")
#: What an element's start ends if it is open, and what keeps that from being looked for further out.
ENDS = {"p": _set("p"), "a": _set("a"), "li": _set("li"), "dt": _set("dt dd"), "dd": _set("dt dd"), "tr": _set("tr td th"), "td": _set("td th"), "th": _set("td th"), "option": _set("option")}
_CELL = _set("table td th caption button")
SCOPE = {"p": _CELL, "a": _CELL, "li": _set("ul ol menu"), "dt": _set("dl"), "dd": _set("dl"), "tr": _set("table"), "td": _set("table tr"), "th": _set("table tr"), "option": _set("select")}
#: Parts of class names and ids that say what an element is.
MARKS = _set(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle alert aside banner breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices overlay pager pagination popup promo promotion replies reply respond share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar"
)
NO_MARK_AFTER = _set("with has have no without is")
OWN_HEADER = _set("article entry post content section story")
ROLES = _set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar")

PLAIN, DROP, HEADER, FORM, ARTICLE, MAIN, HEADING, LINK = range(8)


def kind_of(name: str, attributes: str) -> int:
    if name in DROPPED:
        return DROP
    kind = {"article": ARTICLE, "main": MAIN, "header": HEADER, "form": FORM}.get(name, HEADING if name in HEADINGS else PLAIN)
    if not attributes or attributes.isspace():
        return kind
    values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        return DROP
    if name == "a" and "href" in values:
        return LINK
    if name in NEVER or name not in BLOCKS and name != "ins":
        return kind
    if values.get("role", "").lower() in ROLES:
        return DROP
    for label in f"{values.get('class', '')} {'' if kind == HEADING else values.get('id', '')}".split():
        parts = [p.lower() for p in PART.findall(label)]
        if parts and parts[0] in NO_MARK_AFTER:
            continue
        if not MARKS.isdisjoint(parts):
            return DROP
        if "header" in parts and parts[0] not in OWN_HEADER and kind == PLAIN:
            kind = HEADER
    return kind


class Lines:
    """The lines of a page: text, characters outside links, and the number of the article or main element around."""

    def __init__(self, html: str):
        self.rows: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.unlinked: list[str] = []
        self.open: list[tuple[str, int, int]] = []
        self.counts, self.names = [0] * 8, Counter()
        self.articles = self.mains = 0
        self.article = self.main = 0
        self.read(html)

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            found = TOKEN.search(html, at)
            if not found:
                self.text(html[at:])
                break
            self.text(html[at : found.start()])
            at = found.end()
            if name := found[2]:
                name = name.lower()
                if found[1]:
                    self.close(name)
                else:
                    self.start(name, found[3])
                    if name in RAW:
                        closing = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                        at = closing.start() if closing else end
        self.line()

    def text(self, piece: str) -> None:
        counts = self.counts
        if not piece or counts[DROP] or counts[FORM] or (counts[HEADER] and not ((self.article or self.main) and counts[HEADING])):
            return
        piece = unescape(piece) if "&" in piece else piece
        self.parts.append(piece)
        if not counts[LINK]:
            self.unlinked.append(piece)

    def line(self) -> None:
        """What stands since the last line is one."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.rows.append((text, len(" ".join("".join(self.unlinked).split())), self.article, self.main))
            self.parts, self.unlinked = [], []

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.line()
        if name in CLOSES_P:
            self.end_open(ENDS["p"], SCOPE["p"])
        if name in ENDS:
            self.end_open(ENDS[name], SCOPE[name])
        if name in VOID:
            return
        kind = kind_of(name, attributes)
        kept = self.counts[FORM] if kind in (ARTICLE, MAIN) else 0
        if kind == ARTICLE and not self.article and not self.counts[DROP]:
            self.articles += 1
            self.article = self.articles
        if kind == MAIN and not self.main and not self.counts[DROP]:
            self.mains += 1
            self.main = self.mains
        if kind in (ARTICLE, MAIN):
            self.counts[FORM] = 0  # a form around the whole page
        self.counts[kind] += 1
        self.names[name] += 1
        self.open.append((name, kind, kept))

    def end_open(self, names: frozenset[str], scope: frozenset[str]) -> None:
        if not any(self.names[n] for n in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                self.cut_back(i)
                return
            if self.open[i][0] in scope:
                return

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.line()
        if not self.names[name]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self.cut_back(i)
                return
            if name not in BLOCKS and self.open[i][0] in BLOCKS:
                return  # an inline end doesn't end blocks

    def cut_back(self, i: int) -> None:
        if any(name in BLOCKS for name, _, _ in self.open[i:]):
            self.line()
        while len(self.open) > i:
            name, kind, kept = self.open.pop()
            self.counts[kind] -= 1
            self.names[name] -= 1
            if kind in (ARTICLE, MAIN):
                self.counts[FORM] = kept
            if kind == ARTICLE and not self.counts[ARTICLE]:
                self.article = 0
            if kind == MAIN and not self.counts[MAIN]:
                self.main = 0


def weighed(rows: list[tuple[str, int, int, int]]) -> tuple[list[str], list[int]]:
    """Lines and their weights; empty lines stand between articles."""
    field = 2 if any(r[2] for r in rows) else 3 if any(r[3] for r in rows) else None
    if field is None:
        return [r[0] for r in rows], [r[1] for r in rows]
    texts, weights, last = [], [], 0
    for row in rows:
        if row[field] and row[field] != last:
            texts += [""] * WINDOW
            weights += [0] * WINDOW
            last = row[field]
        texts.append(row[0])
        weights.append(len(row[0]) if row[field] else 0)
    return texts, weights


def between(weights: list[int]) -> list[tuple[int, int]]:
    """The lines from each surge to its dive that are kept, as half-open ranges."""
    padded = [0] * (WINDOW - 1) + weights + [0] * (WINDOW - 1)
    sums, own = [], sum(padded[: WINDOW - 1])
    for i in range(len(padded) - WINDOW + 1):
        own += padded[i + WINDOW - 1]
        sums.append(own)  # of the window that ends with line i
        own -= padded[i]
    most = max(sums, default=0)
    kept, surge, peak = [], None, 0
    for i, total in enumerate([*sums, 0]):
        if total and surge is None:
            surge, peak = i, 0
        if total:
            peak = max(peak, total)
        elif surge is not None:
            if peak >= min(SURGE, SHARE * most):
                kept.append((surge, i - WINDOW + 1))  # the window before the dive began with the last line of text
            surge = None
    return kept


def main_text(html: str) -> str:
    texts, weights = weighed(Lines(html).rows)
    return " ".join(t for a, b in between(weights) for t in texts[a:b])


def _column(df: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def extract(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Every row's ``keys``, the ``text`` of its page and ``n_chars``, the characters of it."""
    rows = df.select(F.struct(*(_column(df, k).alias(f"k{i}") for i, k in enumerate(keys))).alias("keys"), _column(df, html).alias("html"))
    schema = T.StructType([rows.schema["keys"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("keys"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names
            )

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(f"keys.k{i}").alias(k) for i, k in enumerate(keys)), "text", "n_chars")
