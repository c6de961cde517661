"""Chunks of documents: word windows in SQL, and section-aware packing by document in Arrow batches.

Packing carries state from paragraph to paragraph, so each document is one small Python loop;
Spark deals the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import col
from lexloom.functions.text import SECTIONS, trim_space, words
from lexloom.operators.ranking import let

TARGET, OVERLAP, STRETCH = 850, 120, 1.2
MOST_CHARS, LEAST_COVER, LEAST_TABLE = 8000, 200, 200


def word_windows(text, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Chunks of a text without blank lines: itself where it is short enough, else windows of ``target`` words.

    Windows start every ``target`` - ``overlap`` words up to the end, so the last may lie within the
    one before. Empty texts have no chunk.
    """
    text, w = col(text), words(text)

    def of(w: Column) -> Column:
        step = target - overlap
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, target), " "))
        short = F.when(F.size(w) > 0, F.array(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) > target * STRETCH, windows).otherwise(short)

    return F.get(F.transform(F.array(w), of), F.lit(0))


def chunk_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index from 1, n_words, chunk)."""
    out = docs.select(F.col(id_col), F.posexplode(word_windows(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "chunk"))
    return out.select(id_col, (F.col("pos") + 1).alias("chunk_index"), F.size(words("chunk")).alias("n_words"), "chunk")


def pack_words(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed to ``target`` words.

    A chunk that closes hands its last ``overlap`` words to the next one, which takes the paragraph
    that did not fit whatever its size. A paragraph over 1.2 targets closes what is open, and its
    windows stand alone: nothing is handed on from before or after it.
    """
    chunks, held, count = [], [], 0

    def close() -> list[str]:
        body = "\n\n".join(held).strip()
        if body:
            chunks.append(body)
        return body.split()[-overlap:] if overlap else []

    for p in filter(None, map(str.strip, text.split("\n\n"))):
        w = p.split()
        if len(w) > target * STRETCH:
            if held:
                close()
            chunks += [" ".join(w[i : i + target]) for i in range(0, len(w), max(1, target - overlap))]
            held, count = [], 0
            continue
        if held and count + len(w) > target:
            tail = close()
            held, count = ([" ".join(tail)], len(tail)) if overlap else ([], 0)
        held.append(p)
        count += len(w)
    if held:
        close()
    return chunks


def _fill(units: list[tuple[str, str]], most: int, held: str = "") -> tuple[list[str], str]:
    """(full pieces, open piece) of units with their separators, each piece at most ``most`` long."""
    done = []
    for separator, unit in units:
        if held and len(held) + len(separator) + len(unit) > most:
            done.append(held)
            held = unit
        else:
            held = held + separator + unit if held else unit
    return done, held


def split_chars(text: str | None, most: int = MOST_CHARS) -> list[str]:
    """Pieces of at most ``most`` characters, cut between paragraphs, else lines, else words, else anywhere.

    What is left of a cut paragraph stays open for the next one.
    """
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    out, held = [], ""
    for p in filter(None, map(str.strip, text.split("\n\n"))):
        if len(p) <= most:
            done, held = _fill([("\n\n", p)], most, held)
            out += done
            continue
        if held:
            out.append(held)
        held = ""
        for line in p.split("\n"):
            if not line.strip():
                continue
            if len(line) <= most:
                units = [("\n", line)]
            else:
                units = []
                for w in line.split():
                    if len(w) > most:
                        done, held = _fill(units, most, held)
                        out += done + ([held] if held else [])
                        cut = [w[i : i + most] for i in range(0, len(w), most)]
                        out += cut[:-1]
                        units, held = [], cut[-1]
                    else:
                        units.append((" ", w))
            done, held = _fill(units, most, held)
            out += done
    return out + ([held] if held else [])


_AUTHORS, _COVER = re.compile(r"(?im)^[ \t]*\*\*Authors:\*\*.*$"), re.compile(r"(?im)^[ \t]*\*\*(?:Authors:\*\*|Year\b|DOI\b).*$")


def cover_residue(text: str | None) -> int | None:
    """Characters of prose in a cover block beside its author, year and DOI lines; None for other blocks."""
    if not _AUTHORS.search(text or ""):
        return None
    return len(re.sub(r"\n{2,}", "\n\n", _COVER.sub("", text)).strip())


def merge_covers(pieces: list[dict], most: int = MOST_CHARS) -> list[dict]:
    """Covers with little prose join the piece after them and take its section; a joined piece isn't tried again."""
    out, i = [], 0
    while i < len(pieces):
        piece, rest = pieces[i], cover_residue(pieces[i]["text"])
        after = pieces[i + 1] if i + 1 < len(pieces) else None
        if rest is not None and rest < LEAST_COVER and after and len(piece["text"]) + 2 + len(after["text"]) <= most:
            out.append(after | {"text": f"{piece['text']}\n\n{after['text']}"})
            i += 2
        else:
            out.append(piece)
            i += 1
    return out


_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")


def norm_space(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def sections_of(markdown: str) -> list[tuple[str, str, int]]:
    """(title, text, level) of sections with text; what stands before the first heading is level 0."""
    out, title, level, held = [], "Preamble", 0, []
    for line in [*markdown.splitlines(), None]:
        m = _HEADING.match(line) if line is not None else None
        if m or line is None:
            if body := norm_space("\n".join(held)):
                out.append((title, body, level))
            if m:
                title, level, held = m[2].strip(), len(m[1]), []
        else:
            held.append(line)
    return out


def section_label(title: str) -> str:
    t = title.lower()
    return next((name for name, parts in SECTIONS.items() if any(p in t for p in parts)), "other")


def article_pieces(markdown: str, target: int = TARGET, overlap: int = OVERLAP) -> list[dict]:
    """Section, label, part and text of an article's text chunks.

    A title (level 1) or preamble is always ``other``. A section without a label of its own takes
    that of its nearest labelled ancestor below the title. References are left out.
    """
    pieces, path = [], {}
    for title, body, level in sections_of(markdown):
        path = {k: v for k, v in path.items() if k < level} | {level: "other" if level <= 1 else section_label(title)}
        if title.lower().startswith("references"):
            continue
        label = next((path[k] for k in sorted(path, reverse=True) if k >= 1 and path[k] != "other"), "other")
        parts = [p for c in pack_words(body, target, overlap) for p in split_chars(c)]
        pieces += [{"section": title, "section_canonical": label, "section_part": i, "text": p} for i, p in enumerate(parts, 1)]
    return merge_covers(pieces)


def table_pieces(tables: list[dict]) -> list[dict]:
    """Table chunks: each part begins with the table's heading and caption, which its length allows for."""
    out = []
    for n, t in enumerate(tables, 1):
        head = t.get("header") or ""
        room = MOST_CHARS - len(head) - 2 if head else MOST_CHARS
        if room < LEAST_TABLE:
            head, room = "", MOST_CHARS
        for i, part in enumerate(split_chars(t.get("body"), room) or [""], 1):
            out.append({"section": t.get("title") or f"Table {n}", "section_canonical": "table", "section_part": i, "table_id": t.get("table_id") or "", "text": f"{head}\n\n{part}".strip() if head else part})
    return out


CHUNK = "paper_id string, doc_type string, section string, section_canonical string, type string, chunk_index int, section_part int, table_id string, text string"
_FIELDS = ("paper_id", "doc_type", "section", "section_canonical", "type", "chunk_index", "section_part", "table_id", "text")
_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())


def chunk_articles(articles: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of (paper_id, markdown, tables): text first, then tables, numbered through from 1.

    ``tables`` is an array of structs with title, table_id, header and body, or null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pid, markdown, tables in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = [p | {"type": "text", "table_id": None} for p in article_pieces(markdown or "", target, overlap)]
                made = text + [p | {"type": "table"} for p in table_pieces(tables or [])]
                rows += [p | {"paper_id": pid, "doc_type": "article", "chunk_index": i} for i, p in enumerate(made, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(_FIELDS, _TYPES, strict=True)], list(_FIELDS))

    return articles.select("paper_id", "markdown", "tables").mapInArrow(run, CHUNK)


def _exploding(df: DataFrame, id_col: str, text_col: str, name: str, cut) -> DataFrame:
    """(id, index from 1, piece) by a function from text to pieces."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cut(t or "") for t in batch.column(1).to_pylist()]
            at = [i for i, x in enumerate(made) for _ in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([n for x in made for n in range(1, len(x) + 1)], pa.int32()), pa.array([p for x in made for p in x], pa.string())], [id_col, f"{name}_index", name])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {name}_index int, {name} string")


def chunk_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Word chunks of texts with any paragraphs."""
    return _exploding(docs, id_col, text_col, "chunk", lambda t: pack_words(t, target, overlap))


def char_units(text: Column, most: int) -> Column:
    """A text as units in order (what joins it to the one before, its text, whether it begins a piece).

    Units are paragraphs; of a longer one its lines; of a longer line its words; and of a longer
    word its stretches, which stand alone but for the last.
    """

    def unit(sep: str, text: Column, fresh: bool = False) -> Column:
        return F.struct(F.lit(sep).alias("sep"), text.alias("text"), F.lit(fresh).alias("fresh"))

    def of_word(w: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(1), F.length(w), F.lit(most)), lambda i: unit("", F.substr(w, i, F.lit(most)), True))
        return F.when(F.length(w) <= most, F.array(unit(" ", w))).otherwise(stretches)

    def of_line(line: Column) -> Column:
        return F.when(F.length(line) <= most, F.array(unit("\n", line))).otherwise(F.flatten(F.transform(words(line), of_word)))

    def of_paragraph(p: Column) -> Column:
        lines = F.flatten(F.transform(F.filter(F.split(p, "\n"), lambda x: trim_space(x) != ""), of_line))
        first = F.transform(lines, lambda u, i: F.struct(u["sep"].alias("sep"), u["text"].alias("text"), (u["fresh"] | (i == 0)).alias("fresh")))
        return F.when(F.length(p) <= most, F.array(unit("\n\n", p))).otherwise(first)

    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), trim_space), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, of_paragraph))


def char_pieces(text, most: int = MOST_CHARS) -> Column:
    """As ``split_chars``, as a fold over a text's units: the open piece takes a unit or is closed by it."""
    whole = trim_space(F.coalesce(col(text), F.lit("")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(a: Column, u: Column) -> Column:
        close = (a["held"] != "") & (u["fresh"] | (F.length(a["held"]) + F.length(u["sep"]) + F.length(u["text"]) > most))
        return F.when(close, F.struct(F.concat(a["done"], F.array(a["held"])).alias("done"), u["text"].alias("held"))).otherwise(
            F.struct(a["done"].alias("done"), F.when(a["held"] == "", u["text"]).otherwise(F.concat(a["held"], u["sep"], u["text"])).alias("held"))
        )

    def cut(t: Column) -> Column:
        folded = F.aggregate(char_units(t, most), start, step, lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"]))))
        short = F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))
        return F.when(F.length(t) <= most, short).otherwise(folded)

    return let(whole, cut)


def split_long(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """(id, piece_index from 1, piece): pieces of at most ``most`` characters. Null and empty texts have none."""
    pieces = docs.select(F.col(id_col), F.posexplode(char_pieces(text_col, most)).alias("pos", "piece"))
    return pieces.select(id_col, (F.col("pos") + 1).alias("piece_index"), "piece")


def pack_chars(text: str, target: int = 1000, overlap: int = 150, least: int = 30) -> list[str]:
    """Paragraphs of an attachment packed to about ``target`` characters, each chunk beginning with the last ``overlap`` of the one before."""
    chunks, held, size = [], [], 0
    for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if held and size + len(p) + 2 > target:
            body = "\n\n".join(held)
            chunks.append(body)
            held = [body[-overlap:]] if overlap else []
            size = len(held[0]) if held else 0
        held.append(p)
        size += len(p) + 2
    if held:
        chunks.append("\n\n".join(held))
    return [c for c in chunks if len(c) >= least]


def chunk_attachments(files: DataFrame, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """Chunks of attachments, in the shape of corpus chunks."""
    found = _exploding(files, id_col, text_col, "chunk", pack_chars)
    return found.select(id_col, F.lit("__attachment__").alias("paper_id"), F.lit("ADJUNTO").alias("section"), F.lit("attachment").alias("section_canonical"), F.lit("text").alias("type"), F.col("chunk_index"), F.col("chunk").alias("text"))
