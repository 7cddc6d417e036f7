"""Listing scans: links of captured pages, as candidates with their position, kept by the shape of the url."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, text, urls

#: Link texts that say nothing about where they lead.
GENERIC = ["aqui", "ver", "ver mais", "download", "descarregar", "abrir", "consultar", "saber mais"]
SPREADSHEET = r"(?i)\.(?:xlsx?|ods)(?:$|[?#])"


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.words: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.end()
            self.href = dict(attrs).get("href")

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.end()

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.words.append(data)

    def end(self) -> None:
        if self.href is not None:
            self.found.append((self.href, " ".join("".join(self.words).split())))
        self.href, self.words = None, []


class _Dated(HTMLParser):
    """Anchors with the date that is first in the text of the element around them, before or after."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, date: re.Pattern) -> None:
        super().__init__(convert_charrefs=True)
        self.date = date
        self.text: list[str] = []
        self.open: list[list] = [["", 0, [], None]]  # tag, place of its text, the anchors right inside, itself if it is one; first the page
        self.anchors: list[list] = []  # href, begin and end of its text, date

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.VOID:
            return
        if tag == "a" and dict(attrs).get("href") is not None:
            self.anchors.append([dict(attrs)["href"], len(self.text), None, None])
            self.open[-1][2].append(self.anchors[-1])
            self.open.append([tag, len(self.text), [], self.anchors[-1]])
        else:
            self.open.append([tag, len(self.text), [], None])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        if any(x[0] == tag for x in self.open):
            while self.shut() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def shut(self) -> str:
        tag, begin, inside, anchor = self.open.pop()
        if anchor:
            anchor[2] = len(self.text)
        if inside:  # the text is searched once for all anchors of an element
            found = self.date.search(" ".join("".join(self.text[begin:]).split()))
            for a in inside:
                a[3] = found and found[0]
        return tag

    def links(self) -> list[tuple[str, str, str | None]]:
        while self.open:
            self.shut()
        return [(href, " ".join("".join(self.text[a:b]).split()), found) for href, a, b, found in self.anchors]


#: A date of digits, or of a day, a month's name and a year.
DATE = re.compile(r"\b\d{1,2}\s*[-./]\s*\d{1,2}\s*[-./]\s*\d{2,4}\b|\b\d{1,2}\s+de\s+[a-zç]+\s+de\s+\d{4}\b", re.I)


def dated_links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """(url, posicao, href, texto, data): ``links`` with the date that stands in the element around each, as text, or null."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = _Dated(DATE)
                p.feed(page or "")
                p.close()
                rows += [(u, i, *x) for i, x in enumerate(p.links())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["url", "posicao", "href", "texto", "data"])

    return pages.select(url, body).mapInArrow(scanned, "url string, posicao int, href string, texto string, data string")


def page_links(page: str | None) -> list[tuple[str, str]]:
    """(href, text) of every anchor of a page, in order."""
    p = _Links()
    p.feed(page or "")
    p.close()
    p.end()
    return p.found


def links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """(url, posicao, href, texto): every anchor of every page in order. Null pages have none."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(u, i, h, t) for i, (h, t) in enumerate(page_links(page))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["url", "posicao", "href", "texto"])

    return pages.select(url, body).mapInArrow(scanned, "url string, posicao int, href string, texto string")


class _Articles(HTMLParser):
    """Of each article with a class: the link of its heading, else its first, and what stands in its element of dates."""

    def __init__(self, container: str, heading: str, dated: str) -> None:
        super().__init__(convert_charrefs=True)
        self.names = container, heading, dated
        self.found: list[tuple[str, str, str]] = []
        self.links: list[list] = []  # href, text, whether it stands in a heading
        self.depth = 0  # of articles inside the container, itself included
        self.open: str | None = None  # tag of the heading
        self.link = False
        self.date: list[str] = []
        self.dating: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = dict(attrs)
        classes = (values.get("class") or "").split()
        container, heading, dated = self.names
        if tag == "article" and (self.depth or container in classes):
            self.depth += 1
        if not self.depth:
            return
        if heading in classes and tag in ("h1", "h2"):
            self.open = tag
        if dated in classes and not self.date:
            self.dating = tag
        if tag == "a" and values.get("href"):
            self.links.append([values["href"], "", self.open is not None])
            self.link = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag == self.open:
            self.open = None
        if tag == self.dating:
            self.dating = None
        if tag == "article" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.end()

    def handle_data(self, data: str) -> None:
        if self.link:
            self.links[-1][1] += data
        if self.dating:
            self.date.append(data)

    def end(self) -> None:
        if self.links:
            href, words, _ = next((x for x in self.links if x[2]), self.links[0])
            self.found.append((href, " ".join(words.split()), " ".join("".join(self.date).split())))
        self.links, self.date, self.open, self.dating, self.link = [], [], None, None, False


def articles(pages: DataFrame, container: str, heading: str, dated: str, url: str = "url", body: str = "html") -> DataFrame:
    """(url, posicao, href, texto, publicado): one link per article of the class ``container``, as ``links`` gives them.

    Links outside such articles are none; the date is text as it stands, empty where there is none.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = _Articles(container, heading, dated)
                p.feed(page or "")
                p.close()
                p.end()
                rows += [(u, i, *x) for i, x in enumerate(p.found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["url", "posicao", "href", "texto", "publicado"])

    return pages.select(url, body).mapInArrow(scanned, "url string, posicao int, href string, texto string, publicado string")


def published(s: Column) -> Column:
    """The day an archive names as "Ago 10, 2026", as text; null where there is none. It tells of the announcement, never of a deadline."""
    short = "|".join(dict.fromkeys(name[:3] for name in dates.MONTHS))
    return F.nullif(F.regexp_extract(s, rf"(?i)\b(?:{short})[a-zç]*[.]? +[0-9]{{1,2}},? +[0-9]{{4}}\b", 0), F.lit(""))


def candidates(found: DataFrame, shape: str, least_title: int = 8, refuse_titles: str | None = None, refuse_names: str | None = None) -> DataFrame:
    """Links whose path has the shape and whose title is long enough, one per canonical url: the first on the page.

    ``refuse_titles`` is held against titles, ``refuse_names`` against the last part of the path without its ending, as
    that of links to further pages.
    """
    target = urls.resolve(F.col("url"), F.col("href"))
    rows = found.withColumn("alvo", target).where(F.col("alvo").isNotNull() & F.regexp_extract("alvo", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1).rlike(shape) & (F.length("texto") >= least_title))
    if refuse_titles:
        rows = rows.where(~text.comparable(F.col("texto")).rlike(refuse_titles))
    if refuse_names:
        rows = rows.where(~F.regexp_replace(F.regexp_extract("alvo", r"([^/?#]*)/?(?:[?#].*)?$", 1), r"\.[^.]*$", "").rlike(refuse_names))
    rows = rows.withColumn("chave", urls.canonical_url(F.col("alvo")))
    first = Window.partitionBy("url", "chave").orderBy("posicao")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("url", "chave", "alvo", F.col("texto").alias("titulo"), text.legal_reference(F.col("texto")).alias("referencia"), "posicao", *[c for c in ("publicado", "data") if c in found.columns])


def spreadsheets(found: DataFrame) -> DataFrame:
    """Links to spreadsheets; a generic link text gives way to the file's name."""
    target = urls.resolve(F.col("url"), F.col("href"))
    name = F.regexp_extract("alvo", r"([^/?#]+)(?:[?#].*)?$", 1)
    plain = text.comparable(F.col("texto"))
    rows = found.withColumn("alvo", target).where(F.col("alvo").rlike(SPREADSHEET))
    return rows.select("url", "alvo", F.when((F.length("texto") < 4) | plain.isin(GENERIC), name).otherwise(F.col("texto")).alias("titulo"), "posicao")
