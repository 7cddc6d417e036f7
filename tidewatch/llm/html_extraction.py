"""Main text of pages from streaming parser events.

The standard library's parser is fed the page; block tags cut its text into lines, and each line keeps its text, the tags
seen in it and the container it stands in. The text-to-tag ratio of the lines is smoothed with a Gaussian; lines above a
threshold (the ratios' standard deviation) form clusters, the content regions. The container with most clustered text
(article, main, or the closest common one) gives the bounds, so that short paragraphs between long ones stay; lines inside
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are never content.

Defined results: null and empty pages, and pages without content, give an empty text; markup that never ends is read as far
as it goes; character references are decoded as the parser does; repeated rows are extracted each by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import only

SIGMA, RADIUS = 1.5, 4
THRESHOLD = 1.0  # times the standard deviation of the smoothed ratios

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "math", "canvas", "nav", "aside", "footer", "form", "button", "select", "textarea", "dialog", "menu"}
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CONTENT = {"article", "main"}
OUTSIDE = {"header"}  # a page's header, not an article's
NAMES = set("ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments comentarios disqus replies share sharing social related recommended newsletter subscribe signup login search widget".split())
#: A class or id that ends in one of these is of content where what stands before tells what it is about.
OWN = {"story", "article", "post", "entry"}
ABOUT = {"search", "login", "signup", "subscribe", "alert", "notice", "notices", "social", "sharing", "share", "menu", "cookie", "cookies", "consent"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, whether it or one around it is left out, number of the container
        self.lines: list[tuple[str, int, bool, int]] = []  # text, tags, left out, container
        self.parents = [-1]
        self.kinds = ["page"]
        self.parts: list[str] = []
        self.tags = 0
        self.within = 0  # how many articles or mains are open

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            _, out, container = self.stack[-1] if self.stack else ("", False, 0)
            self.lines.append((text, self.tags, out, container))
        self.parts, self.tags = [], 0

    def left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in SKIP or tag in OUTSIDE and not self.within:
            return True
        if tag in CONTENT and not self.within or tag in ("body", "html"):
            return False
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id") and any(NAMES.intersection(w) and not (w[-1] in OWN and ABOUT.issuperset(NAMES.intersection(w))) for w in (re.findall("[a-z0-9]+", x) for x in value.split())):
                return True
            if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            if tag == "p" and any(t == "p" for t, _, _ in self.stack[-3:]):
                self.handle_endtag("p")
                self.tags -= 1
            self.cut() if tag != "br" else self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        _, out, container = self.stack[-1] if self.stack else ("", False, 0)
        out = out or self.left_out(tag, attrs)
        if tag in CONTENT or tag in ("div", "section", "td", "body"):
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.parents) - 1
        self.stack.append((tag, out, container))
        self.within += tag in CONTENT

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.within -= sum(t in CONTENT for t, _, _ in self.stack[i:])
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.parts.append(data)


def _smooth(x: np.ndarray) -> np.ndarray:
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    return np.convolve(x, kernel / kernel.sum(), "full")[RADIUS : RADIUS + len(x)]


def _closed(html: str) -> str:
    """A page whose comments and tags that nothing closes are text: the parser takes them so too, but looks for their end anew each time."""
    end = html.rfind("-->") + 3 if "-->" in html else 0
    html = html[:end] + re.sub("<!--(?!-?>)", "&lt;!--", html[end:])
    end = html.rfind(">") + 1
    return html[:end] + html[end:].replace("<", "&lt;")


def main_text(html: str | None) -> str:
    parser = _Lines()
    parser.feed(_closed(html or ""))
    parser.close()
    parser.cut()
    lines = [x for x in parser.lines if not x[2]]
    if not any(x[0] for x in lines):
        return ""
    ratio = _smooth(np.array([len(t) / max(1, tags) for t, tags, _, _ in lines]))
    chosen = ratio >= min(THRESHOLD * ratio.std(), ratio.max())
    # Clustered text per container, that of the containers inside it included.
    weight = np.zeros(len(parser.parents))
    for (text, _, _, c), yes in zip(lines, chosen, strict=True):
        weight[c] += len(text) if yes else 0
    for c in range(len(weight) - 1, 0, -1):
        weight[parser.parents[c]] += weight[c]
    articles = np.where([k in CONTENT for k in parser.kinds], weight, 0)
    if articles.max() > 0:  # the outermost article or main with most clustered text
        best = int(articles.argmax())
        inside = np.zeros(len(parser.parents), bool)
        inside[best] = True
        for c in range(best + 1, len(inside)):  # a container comes after the one it stands in
            inside[c] = inside[parser.parents[c]]
        return " ".join(t for t, _, _, c in lines if t and inside[c])
    # No such container: from the first to the last cluster that has a fair part of the text.
    at = np.flatnonzero(chosen)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    sizes = [sum(len(lines[i][0]) for i in r) for r in runs]
    kept = [r for r, n in zip(runs, sizes, strict=True) if n * 4 >= max(sizes)]
    return " ".join(lines[i][0] for i in range(kept[0][0], kept[-1][-1] + 1) if lines[i][0])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html)."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return only(pages, "page_id", "url", "html").mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
