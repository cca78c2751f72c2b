"""File sources: workspace scans, discovery, robust decoding, project context and prompt tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from codeloom.functions.text import basename, extension, matches_any

# Folders that scans skip, extensions and folders of the file monitor, and the encoding ladder.
SKIPPED_FOLDERS = ("node_modules", "__pycache__", "venv", "env", "build", "dist", "target", "coverage", "htmlcov", "vendor", "bin", "obj", "out", "tmp")
MONITORED = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".scala",
    ".html", ".css", ".scss", ".sass", ".vue", ".md", ".json", ".yaml", ".yml", ".toml", ".xml",
)
IGNORED_FOLDERS = (
    "node_modules", ".git", "__pycache__", ".pytest_cache", ".venv", "venv", "build", "dist", ".cache", "target", ".next", ".nuxt", "coverage",
    ".nyc_output", ".svn", ".hg", ".mypy_cache", ".tox", "env", ".env", ".coverage", ".DS_Store", "Thumbs.db",
)
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252", "iso-8859-1")
MAX_BYTES = 10 << 20
LISTED = 10_000
GLOB = r"[\\{}\[\]*?]"
KEY_FILES = ("README.md", "package.json", "pyproject.toml", "setup.py", "Cargo.toml", "go.mod", "pom.xml", "Makefile", "Dockerfile", "requirements.txt")


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, modificationTime, length, content of these files, and of all files below these folders; the content is read only where it is selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(list(paths))


def relative(path: Column, folder: str) -> Column:
    root = folder.rstrip("/")
    return F.regexp_replace(path, r"^.*?\Q" + root + r"/\E", "")


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """file_path, mtime, size of the workspace's files, without hidden and build folders."""
    rows = files(spark, folder).select(relative(F.col("path"), folder).alias("file_path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"))
    return rows.where(is_scanned(F.col("file_path"), extensions))


def is_scanned(path: Column, extensions: tuple[str, ...] | None = None) -> Column:
    parts = F.split(path, "/")
    ok = ~F.exists(parts, lambda p: p.startswith(".")) & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(s) for s in SKIPPED_FOLDERS)))
    return ok & extension(path).isin(*extensions) if extensions else ok


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    return scan(spark, folder).where(extension(F.col("file_path")).isin(*extensions)).orderBy("file_path")


def selected(rows: DataFrame, include: list[str], exclude: list[str], whole: bool = False, path: str = "file_path") -> DataFrame:
    """Rows whose path matches an include pattern and no exclude pattern; whole=False lets a pattern begin at any folder."""
    return rows.where(matches_any(F.col(path), include, whole) & ~matches_any(F.col(path), exclude, whole))


def should_index(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes win; then includes, all if there are none."""
    return ~matches_any(path, exclude) & (matches_any(path, include) if include else F.lit(True))


def is_monitored(path: Column) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = basename(path).startswith(".") & ~extension(path).isin(".py", ".js", ".ts")
    return extension(path).isin(*MONITORED) & ~F.arrays_overlap(folders, F.array(*(F.lit(s) for s in IGNORED_FOLDERS))) & ~hidden


def is_valid(length: Column, limit: int = MAX_BYTES) -> Column:
    return length.isNotNull() & (length <= limit)


def decode_one(raw: bytes | None, limit: int = MAX_BYTES) -> str | None:
    """The text in the first encoding of the ladder that fits; null above the limit or with over a tenth of replacement characters."""
    if raw is None or len(raw) > limit:
        return None
    for name in ENCODINGS:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        text = text.removeprefix("﻿")
        return None if text and text.count("�") > 0.1 * len(text) else text
    return None


def decode(content: Column) -> Column:
    """Text of a binary column by the encoding ladder, in Arrow batches."""

    @pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(decode_one)

    return run(content)


def texts(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None, among: list[str] | None = None) -> DataFrame:
    """file_path, content (text), file_hash, size of readable files; `among` these paths below the folder only, where given."""
    found = files(spark, folder) if among is None else files(spark, *(f"{folder.rstrip('/')}/{re.sub(GLOB, r'\\\g<0>', p)}" for p in among))
    rows = found.select(relative(F.col("path"), folder).alias("file_path"), "content", F.col("length").alias("size")).where(is_scanned(F.col("file_path"), extensions) & is_valid(F.col("size")))
    return rows.select("file_path", decode(F.col("content")).alias("content"), F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"), "size").where("content is not null")


def texts_of(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """texts() of the files named in paths (file_path): up to `LISTED` of them are opened by name, so that the others are not read; more by one pass over the folder."""
    some = [r.file_path for r in paths.select("file_path").limit(LISTED + 1).collect()]
    if not some:
        return texts(spark, folder).limit(0)
    if len(some) <= LISTED:
        try:
            return texts(spark, folder, among=some)
        except AnalysisException:  # one is gone since it was listed
            pass
    return texts(spark, folder).join(paths.select("file_path"), "file_path", "left_semi")


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("\n... [truncated]"))).otherwise(text)


def recovered(text: Column) -> Column:
    """Without NUL characters, replacement characters as question marks, line ends as \\n."""
    return F.regexp_replace(F.translate(F.regexp_replace(text, "\x00", ""), "�", "?"), "\r\n?", "\n")


def project_tree(paths: DataFrame, depth: int = 5, limit: int = 1000) -> DataFrame:
    """line_no, line of an indented tree, folders before files at each level."""
    parts = F.split("file_path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(F.slice(parts, 1, i).alias("p"), (i < F.size(parts)).alias("folder")))
    nodes = paths.select(F.explode(levels).alias("n")).select("n.*").distinct()
    # a folder sorts before a file of the same parent: prefix each step by 0 (folder) or 1 (file)
    n = F.size("p")
    key = F.concat_ws("/", F.transform("p", lambda x, i: F.concat(F.when(F.col("folder") | (i < n - 1), "0").otherwise("1"), x)))
    rows = nodes.select(key.alias("k"), F.concat(F.repeat(F.lit("  "), n - 1), F.element_at("p", -1), F.when(F.col("folder"), "/").otherwise("")).alias("line"))
    top = rows.orderBy("k").limit(limit)
    from pyspark.sql import Window

    return top.withColumn("line_no", F.row_number().over(Window.orderBy("k"))).select("line_no", "line")


def language_histogram(rows: DataFrame) -> DataFrame:
    """language, files, share, dominant (the most frequent, then the first by name)."""
    from pyspark.sql import Window

    w = Window.partitionBy()
    counts = rows.groupBy("language").agg(F.count("*").alias("files"))
    first = F.row_number().over(Window.orderBy(F.desc("files"), "language")) == 1
    return counts.select("language", "files", F.round(F.col("files") / F.sum("files").over(w), 6).alias("share"), first.alias("dominant"))


def key_files(paths: DataFrame) -> DataFrame:
    return paths.where(basename(F.col("file_path")).isin(*KEY_FILES))
