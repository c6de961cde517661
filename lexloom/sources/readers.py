"""Sources: JSON lines with three ways to take bad ones, sniffed CSV, whole files, configuration."""

from __future__ import annotations

import csv
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.functions import ids
from lexloom.functions.text import fold
from lexloom.sources import lines

# Names under which a table may hold a column, the first that is there wins.
ALIASES = {
    "doi": ["doi"],
    "title": ["title", "titulo", "article title", "document title"],
    "year": ["year", "ano", "publication year"],
    "authors": ["authors", "autores", "author"],
    "journal": ["journal", "revista", "source title", "source"],
}
SEPARATORS = ",;\t|"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, bad: str = "drop") -> DataFrame:
    """Records of JSON lines under ``path``; ``bad`` lines are dropped, kept (in _corrupt_record) or fail."""
    reader = spark.read.option("recursiveFileLookup", "true").option("mode", {"drop": "DROPMALFORMED", "keep": "PERMISSIVE", "fail": "FAILFAST"}[bad])
    if bad == "keep":
        base = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        schema = StructType([*base.fields, *spark.createDataFrame([], "_corrupt_record string").schema.fields])
    return reader.schema(schema).json(path)


def read_chunks(spark: SparkSession, path: str, schema: StructType | str, phase: str = "all") -> DataFrame:
    """Chunks of JSON lines; the phase is the record's, else that of its folder; ``all`` takes every phase."""
    rows = read_jsonl(spark, path, schema).withColumn("_file", F.col("_metadata.file_path"))
    folder = F.nullif(F.regexp_extract("_file", r"([^/]+)/[^/]*$", 1), F.lit(""))
    out = rows.withColumn("phase", F.coalesce(F.nullif(F.trim("phase"), F.lit("")), folder)).drop("_file")
    return out if phase == "all" else out.where(F.col("phase") == phase)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1, line) of text files that are not blank; a large file is many tasks' work."""
    return lines.numbered(spark, path).where(F.trim("line") != "").select("path", "line_no", "line")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with line numbers; what isn't JSON, or has no DOI or stem, is left out."""
    parsed = numbered_lines(spark, path).select("path", "line_no", F.from_json("line", schema).alias("r")).where("r is not null").select("path", "line_no", "r.*")
    stem = ids.infer_stem(parsed.columns)
    return parsed.withColumn("stem", stem).where((F.col("stem") != "") & (ids.doi("doi", "corpus") != ""))


def sniff(header: str) -> str:
    """The separator that the header has most of."""
    return max(SEPARATORS, key=header.count)


def read_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]] | None = None, required: tuple[str, ...] = ("doi", "title")) -> DataFrame:
    """A table as text: separator sniffed, byte order mark off, columns by their aliases, the number of a record's first line as seq.

    Fields may have line ends within quotes, and a quote within quotes is written twice. Every
    file begins with the header. A large file is many tasks' work. Raises where a required column
    is missing. An empty file has no columns and no rows.
    """
    first = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).first()
    header = (first.value if first else "").lstrip("\ufeff").rstrip("\r")
    sep = sniff(header)
    names = [n.strip() for n in next(csv.reader([header], delimiter=sep), [])] if header else []
    found = lines.records(spark, path).where("line_no > 1").withColumn("record", F.regexp_replace("record", "\r$", "")).where("record != ''")
    fields = F.from_csv("record", ", ".join(f"c{i} string" for i in range(max(1, len(names)))), {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    rows = found.select(fields.alias("r"), F.col("line_no").alias("seq")).select(*(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)), "seq")
    return resolve_columns(rows, aliases or ALIASES, required)


def _plain(spark: SparkSession, names: list[str]) -> list[str]:
    """Folded names, by the same function as columns."""
    row = spark.range(1).select(*(fold(F.lit(n.strip())).alias(str(i)) for i, n in enumerate(names))).first()
    return list(row) if names else []


def resolve_columns(rows: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed by the first alias that equals their folded name."""
    folded = dict(zip(_plain(rows.sparkSession, rows.columns), rows.columns, strict=True))
    for name, options in aliases.items():
        found = next((folded[o] for o in options if o in folded), None)
        if found is None and name in required:
            raise ValueError(f"no column for {name}")
        if found is not None and found != name:
            rows = rows.withColumnRenamed(found, name)
    return rows


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The column that is a candidate, else the first that contains one, case aside."""
    low = {c.lower().strip(): c for c in columns}
    exact = next((low[x.lower()] for x in candidates if x.lower() in low), None)
    return exact or next((c for c in columns for x in candidates if x.lower() in c.lower()), None)


def read_texts(spark: SparkSession, path: str, readers: dict[str, Callable[[], Callable[[bytes], str]]] | None = None) -> DataFrame:
    """(file, text) of text and Markdown files, and of those endings that ``readers`` has a reader of; others raise when read.

    A reader is made once a task and takes a file's bytes, as one of PDF would. Bytes that are no
    UTF-8 are replaced.
    """
    made = readers or {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    name = F.regexp_extract("path", r"[^/]*$", 0).alias("file")
    text = F.when(ending.isin("txt", "md"), F.expr("try_to_binary(hex(content), 'hex')").cast("string")).otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path"))))
    plain = files.where(~ending.isin(list(made))).select(name, text.alias("text")) if made else files.select(name, text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Callable[[bytes], str]] = {}
        for batch in batches:
            out = []
            for kind, content in zip(batch.column("ending").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if kind not in known:
                    known[kind] = made[kind]()
                out.append(known[kind](content or b""))
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(out, pa.string())], ["file", "text"])

    if not made:
        return plain
    return plain.unionByName(files.where(ending.isin(list(made))).select(name, ending.alias("ending"), "content").mapInArrow(run, "file string, text string"))


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, name, modified, length) of files under ``path``, each once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.col("modificationTime").alias("modified"), "length").distinct()


def file_marks(spark: SparkSession, path: str) -> str:
    """A hash of names, times and lengths of the files under ``path``, which changes when one of them does; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = found.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("x")).first()
    return f"{row.n}:{row.x}"


def keyword_table(spark: SparkSession, keywords: dict[str, list[str]]) -> DataFrame:
    """Configuration as a table: category, seq, keyword; an order-keeping list without repeats."""
    rows = [(c, i, w) for c, ws in keywords.items() for i, w in enumerate(dict.fromkeys(ws))]
    return spark.createDataFrame(rows, "category string, seq int, keyword string")


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration file: JSON, or YAML where a reader of it is installed. An empty file is an empty dict."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one file of settings
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text or "{}")


def named_queries(config: dict) -> list[tuple[str, str]]:
    """(category, query) of ``queries``: a category has one query or a list of them; blank ones don't count."""
    found = [(c, q) for c, own in (config.get("queries") or {}).items() for q in (own if isinstance(own, list) else [own])]
    return [(c, q.strip()) for c, q in found if q and q.strip()]


def active_categories(config: dict) -> list[str]:
    """Names of ``categories`` in order: a list of names, or settings by name of which ``active: false`` leaves one out."""
    own = config.get("categories") or []
    return [c for c in own if own[c] is None or own[c].get("active", True)] if isinstance(own, dict) else list(own)


def within(base: str, since_year: int | None = None, until_year: int | None = None, doc_type: str | None = None, recent_days: int | None = None) -> str:
    """A query of a literature search service, narrowed to years, a type and the last days."""
    parts = [f"({base})"]
    if since_year:
        parts.append(f"PUBYEAR > {since_year - 1}")
    if until_year:
        parts.append(f"PUBYEAR < {until_year + 1}")
    if doc_type:
        parts.append(f"DOCTYPE({doc_type})")
    if recent_days is not None:
        parts.append(f"RECENT({recent_days})")
    return " AND ".join(parts)


# Where a record of the search service holds each column.
ENTRY = {
    "doi": "prism:doi",
    "title": "dc:title",
    "authors": "dc:creator",
    "year": "prism:coverDate",
    "journal": "prism:publicationName",
    "volume": "prism:volume",
    "issue": "prism:issueIdentifier",
    "pages": "prism:pageRange",
    "cited_by": "citedby-count",
    "doc_type": "subtypeDescription",
    "open_access": "openaccess",
    "url": "prism:url",
    "service_id": "dc:identifier",
}


def parse_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Records of the search service as JSON, as columns of text: what is missing or isn't JSON is empty, a year is that of the cover."""
    text = {name: F.trim(F.coalesce(F.get_json_object(entry, f"$['{path}']"), F.lit(""))) for name, path in ENTRY.items()}
    return entries.withColumns(text | {"year": F.substring(text["year"], 1, 4)}).drop(entry)


def search_query(terms: list[str], since_year: int | None = None, doc_types: tuple[str, ...] = ("ar", "re")) -> str:
    """A query of a literature search service: all terms in title, abstract or keywords, since a year."""
    parts = [f"TITLE-ABS-KEY({t})" for t in terms]
    if since_year:
        parts.append(f"PUBYEAR > {since_year - 1}")
    if doc_types:
        parts.append("(" + " OR ".join(f"DOCTYPE({d})" for d in doc_types) + ")")
    return " AND ".join(parts)
