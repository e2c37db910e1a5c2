"""Markup documents: flattening to text, section trees as flat rows (a tree has no type of its own in Spark)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset({"script", "style", "figure", "table", "nav", "noscript"})
BLOCKS = frozenset({"p", "div", "li", "br", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "title"})
HEADINGS = {f"h{i}": i for i in range(1, 7)}
VOID = frozenset({"br", "hr", "img", "input", "link", "meta", "source", "wbr", "col", "area", "base", "embed", "track"})


class _Flat(HTMLParser):
    """Text without skipped subtrees; citations become [REF]; counts the tags taken off."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip: list[str] = []
        self.tags = 0
        self.sections: list[tuple[int, str, list[str]]] = [(0, "", [])]
        self.heading = ""

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in SKIPPED:
            self.skip.append(tag)
        if self.skip:
            return
        if tag in BLOCKS:
            self._text("\n")
        if tag in HEADINGS:
            self.sections.append((HEADINGS[tag], "", []))
            self.heading = tag
        if tag == "a" and dict(attrs).get("class") == "bibr":
            self._text("[REF]")

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
            return
        if not self.skip and tag in BLOCKS:
            self._text("\n")
        if tag == self.heading:
            self.heading = ""

    def handle_data(self, data):
        if self.skip:
            return
        if self.heading:
            depth, title, body = self.sections[-1]
            self.sections[-1] = (depth, title + data, body)
        self._text(data)

    def _text(self, data: str) -> None:
        self.parts.append(data)
        if not self.heading:
            self.sections[-1][2].append(data)


def _squash(text: str) -> str:
    return " ".join(text.split())


def parse(markup: str | None) -> _Flat:
    flat = _Flat()
    flat.feed(markup or "")
    flat.close()
    return flat


def flatten(pages: DataFrame, *, id_: str = "page_id", markup: str = "html") -> DataFrame:
    """Text, words and tags of each page; null markup is empty, broken markup is read as far as it goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(x) for x in batch["m"]]
            texts = [_squash("".join(f.parts)) for f in found]
            yield pd.DataFrame({"id": batch["id"], "text": texts, "words": [len(t.split()) for t in texts], "tags": [f.tags for f in found]})

    kind = pages.schema[id_].dataType.simpleString()
    return pages.select(F.col(id_).alias("id"), F.col(markup).alias("m")).mapInPandas(run, f"id {kind}, text string, words long, tags long").withColumnRenamed("id", id_)


def sections(pages: DataFrame, *, id_: str = "page_id", markup: str = "html") -> DataFrame:
    """One row per section, depth first, with its path, title trail and text; text before the first heading is a section of its own."""

    def rows(key, flat: _Flat) -> Iterator[tuple]:
        path: list[int] = []
        trail: list[tuple[int, str]] = []
        for n, (depth, title, body) in enumerate(flat.sections):
            text = _squash("".join(body))
            if n == 0 and not text:
                continue
            level = max(1, depth)
            while trail and trail[-1][0] >= level:
                trail.pop()
            path = [*path[: len(trail)], (path[len(trail)] if len(path) > len(trail) else 0) + 1]
            trail.append((level, _squash(title)))
            yield key, f"{key}#s{'.'.join(map(str, path))}", len(trail), trail[-1][1], " > ".join(t for _, t in trail if t), text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [r for key, x in zip(batch["id"], batch["m"], strict=True) for r in rows(key, parse(x))]
            yield pd.DataFrame(out, columns=["id", "section_id", "depth", "title", "title_path", "text"])

    kind = pages.schema[id_].dataType.simpleString()
    return pages.select(F.col(id_).alias("id"), F.col(markup).alias("m")).mapInPandas(run, f"id {kind}, section_id string, depth int, title string, title_path string, text string").withColumnRenamed("id", id_)
