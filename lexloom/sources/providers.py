"""What runs outside Spark comes in through these: embedding, generation and lookup of works."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS, LEAST_CHARS, BATCH = 8000, 400, 16


class Embedder(Protocol):
    """Vectors of texts; raises ValueError where one is too long."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class WorkLookup(Protocol):
    """A work's record as JSON, None where it isn't known."""

    def __call__(self, doi: str) -> str | None: ...


def _embed_one(embed: Embedder, text: str) -> tuple[list[float], bool]:
    cut = False
    while True:
        try:
            return embed([text])[0], cut
        except ValueError:
            if len(text) <= LEAST_CHARS:
                raise
            text, cut = text[: max(LEAST_CHARS, len(text) * 2 // 3)], True


def embed(chunks: DataFrame, make: Callable[[], Embedder], text: str = "text") -> DataFrame:
    """``chunks`` with embedding and embed_truncated.

    Texts go in batches of 16, cut to 8000 characters. Where a batch fails, its texts go one by one,
    each shortened by a third until it fits.
    """
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields]
    at = chunks.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            vectors, cut = [], []
            for i in range(0, len(texts), BATCH):
                part = [t[:MOST_CHARS] for t in texts[i : i + BATCH]]
                try:
                    got, short = embedder(part), [False] * len(part)
                except ValueError:
                    both = [_embed_one(embedder, t) for t in part]
                    got, short = [v for v, _ in both], [c for _, c in both]
                vectors += got
                cut += [s or len(t) > MOST_CHARS for s, t in zip(short, texts[i : i + BATCH], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(cut, pa.bool_())], [*batch.schema.names, "embedding", "embed_truncated"])

    return chunks.mapInArrow(run, ", ".join([*kinds, "embedding array<float>", "embed_truncated boolean"]))


def look_up(papers: DataFrame, make: Callable[[], WorkLookup], doi: str = "doi") -> DataFrame:
    """(doi, message) of each different DOI, asked once; misses are null."""
    wanted = papers.select(F.lower(F.trim(doi)).alias("doi")).where("doi != ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ask(d) for d in batch.column(0).to_pylist()], pa.string())], ["doi", "message"])

    return wanted.mapInArrow(run, "doi string, message string")


def answer(prompts: DataFrame, make: Callable[[], Generator], prompt: str = "prompt") -> DataFrame:
    """``prompts`` with answer and error: a question that fails doesn't stop the others."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields]
    at = prompts.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = make()
        for batch in batches:
            said, failed = [], []
            for p in batch.column(at).to_pylist():
                try:
                    said.append(generate(p))
                    failed.append(None)
                except Exception as e:  # any failure of the model belongs to its question
                    said.append(None)
                    failed.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(failed, pa.string())], [*batch.schema.names, "answer", "error"])

    return prompts.mapInArrow(run, ", ".join([*kinds, "answer string", "error string"]))


class Busy(Exception):
    """A service asks to wait; ``seconds`` says how long."""

    def __init__(self, seconds: float = 60) -> None:
        super().__init__(seconds)
        self.seconds = seconds


class PageFetch(Protocol):
    """A page of a literature search, from record ``start`` on, as JSON; raises Busy, or OSError where it can't be had."""

    def __call__(self, query: str, start: int, count: int) -> str: ...


PAGE, TRIES = 25, 3


def _page(fetch: PageFetch, query: str, start: int, pause: float) -> tuple[int, list[dict]]:
    for attempt in range(1, TRIES + 1):
        try:
            found = json.loads(fetch(query, start, PAGE)).get("search-results", {})
            total = str(found.get("opensearch:totalResults", "0"))
            return int(total) if total.isdigit() else 0, found.get("entry", [])
        except Busy as e:
            time.sleep(e.seconds)
        except OSError:
            time.sleep(pause * attempt * 3)
    raise RuntimeError(f"no page from record {start} in {TRIES} tries")


def search_pages(queries: DataFrame, make: Callable[[], PageFetch], most: int = 5000, pause: float = 1.0) -> DataFrame:
    """(category, query, seq from 0, entry as JSON): the first ``most`` records of each query, page by page.

    ``queries`` has category and query. Entries that report an error don't count. Pages end where
    the service has no more, and a page that can't be had in three tries fails the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = make()
        for batch in batches:
            for category, query in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                start, seq, total = 0, 0, None
                while total is None or start < total:
                    if start:
                        time.sleep(pause)
                    size, entries = _page(fetch, query, start, pause)
                    total = min(most, size) if total is None else total
                    good = [json.dumps(e, ensure_ascii=False) for e in entries if "error" not in e][: total - seq]
                    yield pa.RecordBatch.from_arrays([pa.array([category] * len(good), pa.string()), pa.array([query] * len(good), pa.string()), pa.array(range(seq, seq + len(good)), pa.int64()), pa.array(good, pa.string())], ["category", "query", "seq", "entry"])
                    start, seq = start + PAGE, seq + len(good)
                    if not entries:
                        break

    asked = queries.select("category", "query")
    return asked.mapInArrow(run, "category string, query string, seq long, entry string")


class TitleSearch(Protocol):
    """The works, as JSON, that fit a title best, best first."""

    def __call__(self, title: str, n: int) -> list[str]: ...


def suggest(papers: DataFrame, make: Callable[[], TitleSearch], n: int = 3, id_col: str = "paper_id") -> DataFrame:
    """(id, rank from 1, message): up to ``n`` works for each title; blank titles aren't asked for."""
    kind = papers.schema[id_col].dataType.simpleString()
    wanted = papers.where(F.trim("title") != "").select(id_col, "title")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make()
        for batch in batches:
            found = [ask(t, n)[:n] for t in batch.column(1).to_pylist()]
            at = [i for i, x in enumerate(found) for _ in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([r for x in found for r in range(1, len(x) + 1)], pa.int32()), pa.array([m for x in found for m in x], pa.string())], [id_col, "rank", "message"])

    return wanted.mapInArrow(run, f"`{id_col}` {kind}, rank int, message string")
