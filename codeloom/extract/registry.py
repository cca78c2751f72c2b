"""Parser registry and the Spark table functions over files (file_path, content)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.extract import braces, data, python, web
from codeloom.extract.base import Lines, Parsed, Unit
from codeloom.partitions import spread

Parser = Callable[[str, str], Parsed]
PARSERS: dict[str, Parser] = {"python": python.parse, "html": web.parse_html, "css": web.parse_css, "json": data.parse_json, "yaml": data.parse_yaml} | {k: braces.parse(k) for k in braces.LANGUAGES}
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "cpp", ".cpp": "cpp", ".cxx": "cpp",
    ".cc": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".html": "html", ".htm": "html", ".xhtml": "html", ".css": "css", ".scss": "css", ".sass": "css",
    ".less": "css", ".json": "json", ".jsonc": "json", ".json5": "json", ".yaml": "yaml", ".yml": "yaml",
}


def register(language: str, extensions: list[str], parser: Parser) -> None:
    """Adds or replaces a parser; later registrations win an extension."""
    PARSERS[language] = parser
    EXTENSIONS.update(dict.fromkeys(extensions, language))


def unregister(language: str) -> None:
    PARSERS.pop(language, None)
    for e in [e for e, v in EXTENSIONS.items() if v == language]:
        del EXTENSIONS[e]


def language_for(path: str) -> str | None:
    return EXTENSIONS.get("." + path.rpartition(".")[2].lower()) if "." in path else None


def can_parse(path: str) -> bool:
    return language_for(path) in PARSERS


def parse(text: str, path: str, language: str | None = None) -> Parsed:
    """The entities and relations of a file; a parser that fails gives an error, never a failed task."""
    language = language or language_for(path)
    if language not in PARSERS:
        return Parsed([], [], [f"0: no parser for {path}"])
    try:
        return PARSERS[language](text, path)
    except (RecursionError, ValueError, IndexError, KeyError, AttributeError, TypeError) as e:
        return Parsed([], [], [f"0: {type(e).__name__}: {e}"])


def uuid_of(u: Unit, line: int, column: int, digest: str, path: str) -> str:
    qualified = [u.qualified] if u.qualified and u.qualified != u.name else []
    sig = [hashlib.sha256(u.signature.encode()).hexdigest()[:8]] if u.signature else []
    d = hashlib.sha256(":".join([path, u.name, u.kind, str(line), str(column), digest, *qualified, *sig]).encode("utf-8", "surrogatepass")).hexdigest()
    return "-".join((d[:8], d[8:12], d[12:16], d[16:20], d[20:32]))


ENTITY_DDL = (
    "entity_id string, entity_name string, qualified_name string, entity_type string, signature string, docstring string, source_code string, source_hash string, "
    "file_path string, start_line int, end_line int, start_column int, end_column int, start_byte bigint, end_byte bigint, visibility string, is_async boolean, "
    "is_test boolean, is_deprecated boolean, language string, location_id string"
)


#: A batch of results ends with so many rows or characters: a deep page has its text in the code of each element again.
BATCH_ROWS, BATCH_CHARS = 5_000, 4_000_000
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """Path and text of one file after another."""
    for batch in batches:
        for path, text in zip(batch.column(0), batch.column(1)):
            yield path.as_py(), text.as_py() or ""


def batches_of(rows: Iterable[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")))
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(zip(*held), kinds)], names=names)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def over_files(files: DataFrame, ddl: str, rows_of: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """The rows of every file (file_path, content), in batches of bounded size.

    The files are dealt over all cores, as many small ones can lie in one part of one input file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((row for path, text in texts(batches) for row in rows_of(path, text)), ddl)

    return spread(files.select("file_path", F.col("content").cast("string").alias("content")), "file_path", "content").mapInArrow(run, ddl)


def entities(files: DataFrame, language: str | None = None) -> DataFrame:
    """One row per entity of the files (file_path, content)."""

    def rows(path: str, text: str) -> Iterator[tuple]:
        lines, digest = Lines(text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        lang = language or language_for(path) or "unknown"
        for u in parse(text, path, language).units:
            (l0, c0), (l1, c1) = lines.place(u.start), lines.place(max(u.start, u.end))
            code = text[u.start : u.end]
            yield (
                uuid_of(u, l0, c0, digest, path), u.name, u.qualified or u.name, u.kind, u.signature, u.docstring, code, hashlib.sha256(code.encode("utf-8", "surrogatepass")).hexdigest()[:16],
                path, l0, l1, c0, c1, lines.byte(u.start), lines.byte(u.end), u.visibility, u.is_async, u.name.lower().startswith("test") or "/tests/" in path, "deprecated" in u.docstring.lower(), lang, f"{path}:{l0}:{c0}",
            )

    return over_files(files, ENTITY_DDL, rows)


RELATION_DDL = "id string, relation_type string, source string, target string, file_path string, line int, strength double"


def relations(files: DataFrame, language: str | None = None) -> DataFrame:
    return over_files(files, RELATION_DDL, lambda path, text: ((f"{e.kind}::{e.source}::{e.target}", e.kind, e.source, e.target, path, e.line, 1.0) for e in parse(text, path, language).edges))


def errors(files: DataFrame, language: str | None = None) -> DataFrame:
    """file_path, line, message of what did not parse, at most fifty per file."""
    return over_files(files, "file_path string, line int, message string", lambda path, text: ((path, int(e.partition(":")[0] or 0), e.partition(":")[2].strip()) for e in parse(text, path, language).errors[:50]))


def parse_stats(files: DataFrame, language: str | None = None) -> DataFrame:
    """files, parsed, failed, entities, relations, success_rate over all files, summed within tasks first."""

    def sums(path: str, text: str) -> Iterator[tuple]:
        got = parse(text, path, language)
        yield 1, int(bool(got.errors)), len(got.units), len(got.edges)

    rows = over_files(files, "files bigint, failed bigint, entities bigint, relations bigint", sums)
    out = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "failed", "entities", "relations")))
    return out.withColumn("parsed", F.col("files") - F.col("failed")).withColumn("success_rate", F.when(F.col("files") > 0, F.col("parsed") / F.col("files")).otherwise(0.0))


def payload(rows: DataFrame) -> DataFrame:
    """Entities as the 28 stored columns."""
    fill = {"parent_id": F.lit(None).cast("string"), "children_count": F.lit(0), "dependencies_count": F.lit(0), "created_at": F.current_timestamp(), "last_modified": F.current_timestamp(), "indexed_at": F.lit(None).cast("timestamp"), "is_container": F.col("entity_type").isin(*schema.CONTAINER_TYPES)}
    full = rows.withColumns({k: v for k, v in fill.items() if k not in rows.columns})
    return full.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.ENTITY.fields))
