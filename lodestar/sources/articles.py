"""Article and bibliography XML as flat rows, read in Arrow batches; a file that can't be parsed is a row with a status, never an error."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents inside a document: their content is their own.
NESTED = frozenset({"sub-article", "response"})
ARTICLE = "id string, status string, pmid string, doi string, title string, journal string, authors array<string>, affiliations int, abstract string, dates map<string,string>, body_words long, sections int, references int"
CITATION = "id string, status string, title string, abstract string, authors array<string>, journal string, doi string, pmcid string, mesh array<string>, year string, month string, day string, free_date string"


def local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def walk(node: ET.Element) -> Iterator[ET.Element]:
    """A node and all below it, in document order, without documents nested inside."""
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(c for c in reversed(at) if local(c.tag) not in NESTED)


def find(node: ET.Element | None, path: str) -> ET.Element | None:
    """The first element along a path of local names."""
    for name in path.split("/"):
        node = None if node is None else next((c for c in node if local(c.tag) == name), None)
    return node


def children(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [c for c in node if local(c.tag) == name]


def text_of(node: ET.Element | None) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def _date(node: ET.Element) -> str:
    parts = [text_of(find(node, k)) for k in ("year", "month", "day")]
    out = []
    for value, width in zip(parts, (4, 2, 2), strict=True):
        if not value.isdigit():
            break
        out.append(value.zfill(width))
    return "-".join(out)


def _person(contrib: ET.Element) -> str:
    name = find(contrib, "name")
    return " ".join(filter(None, (text_of(find(name, "given-names")), text_of(find(name, "surname"))))) or text_of(find(contrib, "collab"))


def article(markup: str | bytes) -> dict:
    """Front matter, body size and references of one article."""
    try:
        root = ET.fromstring(markup)
    except ET.ParseError:
        return {"status": "parse_error"}
    top = root if local(root.tag) == "article" else next((x for x in walk(root) if local(x.tag) == "article"), root)
    meta, body = find(top, "front/article-meta"), find(top, "body")
    ids = {x.get("pub-id-type", ""): text_of(x) for x in reversed(children(meta, "article-id"))}
    groups = children(meta, "contrib-group")
    people = [p for g in groups for c in children(g, "contrib") if c.get("contrib-type", "author") == "author" and (p := _person(c))]
    places = sum(len(children(x, "aff")) for x in [meta, *groups] if x is not None)
    # a plain abstract before one of a kind of its own (graphical, a teaser)
    abstracts = sorted(children(meta, "abstract"), key=lambda x: x.get("abstract-type") is not None)
    dates = {}
    for d in children(meta, "pub-date"):
        kind = d.get("pub-type") or d.get("date-type") or "pub"
        if value := _date(d):
            dates.setdefault(kind, value)
    inside = list(walk(body)) if body is not None else []
    refs = {r.get("id") or id(r) for lst in walk(top) if local(lst.tag) == "ref-list" for r in walk(lst) if local(r.tag) == "ref"}
    words = len(" ".join("".join(p.itertext()) for p in inside if local(p.tag) == "p").split())
    return {
        "status": "ok" if body is not None else "no_body", "pmid": ids.get("pmid", ""), "doi": ids.get("doi", ""), "title": text_of(find(meta, "title-group/article-title")),
        "journal": text_of(find(top, "front/journal-meta/journal-title-group/journal-title")) or text_of(find(top, "front/journal-meta/journal-title")),
        "authors": people, "affiliations": places, "abstract": text_of(abstracts[0]) if abstracts else "", "dates": dates, "body_words": words, "sections": sum(local(x.tag) == "sec" for x in inside), "references": len(refs),
    }


def _heading(node: ET.Element) -> str:
    major = "*" if node.get("MajorTopicYN") == "Y" else ""
    return text_of(node) + major


def citation(markup: str | bytes) -> dict:
    """One bibliography record, of an article or a book chapter."""
    try:
        root = ET.fromstring(markup)
    except ET.ParseError:
        return {"status": "parse_error"}
    book = find(root, "BookDocument") if local(root.tag) == "PubmedBookArticle" else None
    core = book if book is not None else find(root, "MedlineCitation")
    work = core if book is not None else find(core, "Article")
    parts = []
    for p in children(find(work, "Abstract"), "AbstractText"):
        label, body = (p.get("Label") or "").strip(), text_of(p)
        if body:
            parts.append(f"{label}: {body}" if label else body)
    people = []
    for lst in children(work, "AuthorList"):
        for a in children(lst, "Author"):
            name = " ".join(filter(None, (text_of(find(a, "ForeName")) or text_of(find(a, "Initials")), text_of(find(a, "LastName"))))) or text_of(find(a, "CollectiveName"))
            if name:
                people.append(name)
    history = find(root, "PubmedBookData" if book is not None else "PubmedData")
    ids = {x.get("IdType", ""): text_of(x) for lst in children(history, "ArticleIdList") for x in reversed(children(lst, "ArticleId"))}
    placed = next((text_of(x) for x in children(work, "ELocationID") if x.get("EIdType") == "doi" and text_of(x)), "")
    mesh = []
    for h in children(find(core, "MeshHeadingList"), "MeshHeading"):
        mesh.append("/".join(_heading(x) for x in h if local(x.tag) in ("DescriptorName", "QualifierName")))
    when = [find(work, "Book/PubDate"), find(work, "Book/BeginningDate")] if book is not None else [find(work, "Journal/JournalIssue/PubDate"), find(work, "ArticleDate")]
    when += [d for status in ("pubmed", "entrez", "medline") for d in children(find(history, "History"), "PubMedPubDate") if d.get("PubStatus") == status]
    chosen = next((d for d in when if d is not None and (text_of(find(d, "Year")) or text_of(find(d, "MedlineDate")))), None)
    return {
        "status": "ok", "title": text_of(find(work, "ArticleTitle")), "abstract": "\n".join(parts), "authors": people, "journal": text_of(find(work, "Book/BookTitle" if book is not None else "Journal/Title")),
        "doi": placed or ids.get("doi", ""), "pmcid": ids.get("pmc", ""), "mesh": mesh, "year": text_of(find(chosen, "Year")), "month": text_of(find(chosen, "Month")), "day": text_of(find(chosen, "Day")), "free_date": text_of(find(chosen, "MedlineDate")),
    }


def _parsed(rows: DataFrame, parse, schema: str) -> DataFrame:
    fields = [x.split(" ")[0] for x in re.split(r", (?=\w+ )", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{"id": key, **parse(markup if markup is not None else "")} for key, markup in zip(batch["id"], batch["markup"], strict=True)]
            yield pd.DataFrame([[x.get(f) for f in fields] for x in found], columns=fields)

    return rows.select(F.col("id").cast("string").alias("id"), F.col("markup").alias("markup")).mapInPandas(run, schema)


def articles(rows: DataFrame) -> DataFrame:
    """One row for each (id, markup); null or broken markup has the status parse_error and nulls."""
    return _parsed(rows, article, ARTICLE)


def citations(rows: DataFrame) -> DataFrame:
    """One row for each (id, markup) of a bibliography."""
    return _parsed(rows, citation, CITATION)


def article_files(spark: SparkSession, folder: str, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The articles of a folder of `PMC<number>.xml` files; a subset by id, or the first ones by number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "PMC*.xml").load(folder)
    name = F.regexp_extract("path", r"(PMC\d+)\.xml$", 1)
    rows = files.select(name.alias("id"), F.col("content").alias("markup"))
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids))
    if limit is not None:
        rows = rows.orderBy(F.substring("id", 4, 20).cast("long")).limit(limit)
    return articles(rows)
