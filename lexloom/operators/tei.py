"""Structured text of papers: TEI to Markdown, tables, metadata and references."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.operators.chunking import norm_space

T = "{http://www.tei-c.org/ns/1.0}"
MOST_AUTHORS, MOST_HIGHLIGHTS = 12, 12


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _name(node) -> dict:
    """full, forename, surname; letters that stand apart are put together."""
    join = lambda s: re.sub(r"\s+", "", s) if re.fullmatch(r"(?:\w\s+)+\w", s) else s
    fore = " ".join(filter(None, (join(_text(x)) for x in node.findall(f".//{T}forename"))))
    sur = join(_text(node.find(f".//{T}surname")))
    return {"full": f"{fore} {sur}".strip() or _text(node), "forename": fore, "surname": sur}


def _year(root) -> int | None:
    for d in root.iter(f"{T}date"):
        if m := re.search(r"\b((?:19|20)\d{2})\b", d.get("when") or _text(d)):
            return int(m[1])
    return None


def _body(div, depth: int) -> list[str]:
    out = []
    for node in div:
        tag, text = node.tag.removeprefix(T), _text(node)
        if tag == "head" and text:
            out.append(f"{'#' * min(depth, 6)} {text}")
        elif tag == "div":
            out += _body(node, depth + 1)
        elif tag == "list":
            out.append("\n".join(f"- {_text(i)}" for i in node.findall(f"{T}item") if _text(i)))
        elif tag == "formula" and text:
            out.append(f"$$ {text} $$")
        elif tag == "figure":
            continue
        elif text:
            out.append(text)
    return out


def _unique(items: list[dict]) -> list[dict]:
    return list({x["full"].lower(): x for x in reversed(items) if x["full"]}.values())[::-1]


METADATA = {"title", "doi", "journal", "year", "authors", "abstract"}


def parse_tei(xml: str | None, wanted: set[str] | None = None) -> dict | None:
    """What is read from one document, all or the ``wanted`` fields of it; None where it isn't XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    own = {"highlights": _highlights, "tables": tei_tables, "references": _references}
    out = {k: read(root) for k, read in own.items() if wanted is None or k in wanted}
    if wanted is None or wanted & (METADATA | {"markdown"}):
        made = _metadata(root, wanted is None or "markdown" in wanted)
        out |= {k: v for k, v in made.items() if wanted is None or k in wanted}
    return out


def _metadata(root, markdown: bool) -> dict:
    """Fields of METADATA and, if asked for, the document as Markdown."""
    header, source = root.find(f"{T}teiHeader"), root.find(f".//{T}sourceDesc")
    header = header if header is not None else root
    authors = _unique([_name(p) for p in (source if source is not None else header).findall(f".//{T}author/{T}persName")])
    title = _text(header.find(f".//{T}titleStmt/{T}title"))
    found = next((_text(i) for i in header.iter(f"{T}idno") if (i.get("type") or "").upper() == "DOI"), "")
    journals = [x for x in header.iter(f"{T}title") if x.get("level") == "j"]
    abstract = " ".join(filter(None, (_text(p) for p in header.findall(f".//{T}abstract//{T}p")))) or _text(header.find(f".//{T}abstract"))
    year = _year(header)
    made = {"title": title, "doi": found, "journal": _text(journals[0]) if journals else "", "year": year, "authors": authors, "abstract": abstract}
    if not markdown:
        return made
    body = root.find(f".//{T}body")
    cover = ["**Authors:** " + "; ".join(a["full"] for a in authors[:MOST_AUTHORS])] if authors else []
    cover += [f"**Year:** {year}"] if year else []
    cover += [f"**DOI:** {found}"] if found else []
    parts = [f"# {title}" if title else "", *cover, *(["## Abstract", abstract] if abstract else []), *([x for d in body.findall(f"{T}div") for x in _body(d, 2)] if body is not None else [])]
    return made | {"markdown": norm_space("\n\n".join(filter(None, parts)))}


def _highlights(root) -> list[str]:
    found = list(dict.fromkeys(_text(i) for d in root.iter(f"{T}div") if re.search("highlight", (d.get("type") or "") + _text(d.find(f"{T}head")), re.I) for i in d.iter(f"{T}item") if _text(i)))
    return found[:MOST_HIGHLIGHTS]


def _references(root) -> list[dict]:
    references = []
    for b in root.findall(f".//{T}listBibl/{T}biblStruct"):
        own = next((_text(i) for i in b.iter(f"{T}idno") if (i.get("type") or "").upper() == "DOI"), "")
        heads = {x.get("level"): _text(x) for x in b.iter(f"{T}title")}
        note = b.find(f"{T}note[@type='raw_reference']")
        raw, name = (_text(note) if note is not None else "") or _text(b), heads.get("a") or heads.get("m") or ""
        references.append({"ref_key": hashlib.sha1((own or name or raw).lower().encode()).hexdigest()[:12], "doi": own, "title": name, "container": heads.get("j") or "", "year": _year(b), "authors": list(dict.fromkeys(_name(p)["full"] for p in b.findall(f".//{T}author/{T}persName"))), "raw": raw})
    return references


def tei_tables(root) -> list[dict]:
    """Tables with one row per paragraph; where the first column is headed ``Exp.``, rows of one experiment share a paragraph."""
    out = []
    for n, figure in enumerate((f for f in root.iter(f"{T}figure") if f.get("type") == "table"), 1):
        title, caption = _text(figure.find(f"{T}head")) or f"Table {n}", _text(figure.find(f"{T}figDesc"))
        rows = [[_text(c) for c in r.findall(f"{T}cell")] for r in figure.iter(f"{T}row")]
        rows = [r for r in rows if any(r)]
        line = lambda r: "| " + " | ".join(r) + " |"
        head, groups = (rows[0], []) if rows else ([], [])
        for r in rows[1:]:
            if head and head[0].lower().rstrip(".") == "exp" and groups and not r[0]:
                groups[-1].append(line(r))  # a blank key goes on with the experiment above
            else:
                groups.append([line(r)])
        body = "\n\n".join("\n".join([line(head), *g] if i == 0 else g) for i, g in enumerate(groups)) if groups else (line(head) if head else "")
        out.append({"title": title, "table_id": figure.get("{http://www.w3.org/XML/1998/namespace}id") or "", "header": "\n\n".join(filter(None, (f"## {title}", caption))), "body": body})
    return out


AUTHOR = "struct<full: string, forename: string, surname: string>"
PARSED = f"paper_id string, title string, doi string, journal string, year int, authors array<{AUTHOR}>, abstract string, highlights array<string>, markdown string, tables array<struct<title: string, table_id: string, header: string, body: string>>, references array<struct<ref_key: string, doi: string, title: string, container: string, year: int, authors: array<string>, raw: string>>"


def read_tei(papers: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(paper_id, tei_xml) to metadata, Markdown, tables and references, or ``columns`` of them; documents that aren't XML are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = papers.sparkSession.createDataFrame([], PARSED).schema
    schema = StructType([f for f in schema.fields if columns is None or f.name in ("paper_id", *columns)])
    arrow, wanted = to_arrow_schema(schema), None if columns is None else set(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x | {"paper_id": pid} for pid, xml in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) if (x := parse_tei(xml, wanted)) is not None]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return papers.select("paper_id", "tei_xml").mapInArrow(run, schema)
