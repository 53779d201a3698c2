"""Reading articles out of raw pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text is no article text.
SKIPPED = {"script", "style", "nav", "aside", "footer", "header", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.paragraphs, self.here, self.skip, self.inside, self.seen_article = "", [], [], 0, [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "article":
            self.paragraphs, self.seen_article = [], True
        if tag in ("p", "h1", "h2", "h3", "li", "article", "br"):
            self.close_paragraph()
        self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag in ("p", "li", "article"):
            self.close_paragraph()
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if "title" in self.inside:
            self.title += data
        elif not self.skip:
            self.here.append(data)

    def close_paragraph(self) -> None:
        if text := " ".join("".join(self.here).split()):
            self.paragraphs.append(text)
        self.here = []


def read_article(page: str | None) -> tuple[str, list[str]]:
    """Title and paragraphs; those before an article element are dropped once one opens."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.close_paragraph()
    return " ".join(reader.title.split()), reader.paragraphs


def extract(pages: DataFrame, least_words: int = 3) -> DataFrame:
    """(page_id, title, text, n_paragraphs, n_words) of each page; paragraphs under least_words words are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [read_article(x) for x in pdf["html"]]
            kept = [[p for p in ps if len(p.split()) >= least_words] for _, ps in read]
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [t for t, _ in read], "text": ["\n".join(p) for p in kept], "n_paragraphs": [len(p) for p in kept], "n_words": [sum(len(x.split()) for x in p) for p in kept]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string, n_paragraphs long, n_words long")


def repaired(markup: Column) -> Column:
    """Markup for a strict parser: without what stands before its start and without forbidden control characters; bare ampersands are escaped, but not
    in CDATA sections, where they may stand."""
    begun = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?s)^.*?(<\?xml|<!DOCTYPE|<html\b|<rss\b|<feed\b|<rdf:RDF\b)", "$1")
    clean = F.regexp_replace(begun, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    pieces = F.regexp_extract_all(clean, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|.[^<]*"), F.lit(0))
    kept = lambda x: F.regexp_replace(x, r"&([A-Za-z][A-Za-z0-9]{0,31}|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});", "\u0001$1;")
    fixed = lambda x: F.replace(F.replace(kept(x), F.lit("&"), F.lit("&amp;")), F.lit("\u0001"), F.lit("&"))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("<![CDATA["), x).otherwise(fixed(x))), "")
