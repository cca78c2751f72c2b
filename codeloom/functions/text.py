"""Text, query-analysis and path expressions over columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark exact, code, file and semantic queries, in the order they are reported.
EXACT_MARKS = ('"', "'", "`", "exact:", "name:", "file:", "id:", "uuid:", "hash:", "path:", "line:", "column:")
CODE_MARKS = (
    "def ", "class ", "function", "method", "import", "variable", "constant", "async ", "await ", "return", "if ", "for ", "while ", "try ",
    "except ", "finally ", "self.", "this.", "__init__", "__main__", "lambda ", "yield ", "with statement", "assert ", "raise ", "pass",
    "break", "continue", "global ", "nonlocal ",
)
FILE_MARKS = ("file:", "path:", ".py", ".js", ".ts", ".go", ".rs", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".scala")
SEMANTIC_MARKS = (
    "how to", "what is", "why does", "when should", "where can", "which way", "explain", "describe", "find code that", "find", "show me",
    "help me", "i need", "looking for", "similar", "related to", "like", "resembles",
)
# The tag of queries within prompts, which also begins tool collection names, and suffixes that stems lose.
TAG = "ccc"
STEM_SUFFIXES = ("tion", "ing", "ed", "er", "ly", "al", "ive", "ate", "ize")


def clean(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"\s+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts), F.lit(False))


def hits(text: Column, parts: tuple[str, ...], kind: str) -> Column:
    """kind:mark for each mark within the text, in the marks' order."""
    return F.array_compact(F.array(*(F.when(text.contains(p), F.lit(f"{kind}:{p if kind in ('exact', 'file', 'semantic') else p.strip()}")) for p in parts)))


def analyse(query: Column) -> Column:
    """struct(cleaned, word_count, has_exact, has_code, patterns, mode, confidence) of a search query."""
    cleaned = clean(F.coalesce(query, F.lit("")))
    low = F.lower(cleaned)
    n = F.size(words(cleaned))
    exact, code, file, semantic = contains_any(query, EXACT_MARKS), contains_any(low, CODE_MARKS), contains_any(low, FILE_MARKS), contains_any(low, SEMANTIC_MARKS)
    pick = lambda mode, confidence: F.struct(F.lit(mode).alias("mode"), F.lit(confidence).alias("confidence"))
    choice = (
        F.when(cleaned == "", pick("hybrid", 0.0))
        .when(exact, pick("payload", 0.9))
        .when(semantic & (n >= 4), pick("semantic", 0.8))
        .when(code & (n <= 2), pick("payload", 0.7))
        .when(code, pick("hybrid", 0.8))
        .when(file, pick("payload", 0.7))
        .when((n <= 2) & ~low.rlike(r"[\p{L}\p{N}\s]"), pick("hybrid", 0.4))
        .when(n <= 2, pick("payload", 0.6))
        .when(n >= 6, pick("semantic", 0.6))
        .otherwise(pick("hybrid", 0.5))
    )
    patterns = F.concat(hits(query, EXACT_MARKS, "exact"), hits(low, CODE_MARKS, "code"), hits(low, FILE_MARKS, "file"), hits(low, SEMANTIC_MARKS, "semantic"))
    blank = cleaned == ""
    return F.struct(
        cleaned.alias("cleaned"), n.alias("word_count"), (exact & ~blank).alias("has_exact"), (code & ~blank).alias("has_code"),
        F.when(blank, F.array().cast("array<string>")).otherwise(patterns).alias("patterns"), choice["mode"].alias("mode"), choice["confidence"].alias("confidence"),
    )


def explain_mode(a: Column) -> Column:
    """One sentence on why `analyse` chose its mode."""
    shown = F.concat(F.lit("["), F.array_join(a["patterns"], ", "), F.lit("]"))
    count = a["word_count"].cast("string")
    return (
        F.when((a["mode"] == "payload") & a["has_exact"], F.concat(F.lit("Exact search: the query has exact-match marks "), shown))
        .when((a["mode"] == "payload") & (a["word_count"] <= 2), F.concat(F.lit("Keyword search: a short query of "), count, F.lit(" words")))
        .when(a["mode"] == "payload", F.concat(F.lit("Keyword search: file or code marks "), shown))
        .when((a["mode"] == "semantic") & F.exists(a["patterns"], lambda p: p.startswith("semantic:")), F.concat(F.lit("Semantic search: natural-language marks "), shown))
        .when(a["mode"] == "semantic", F.concat(F.lit("Semantic search: a long query of "), count, F.lit(" words")))
        .otherwise(F.concat(F.lit("Hybrid search: keyword and vector results for "), count, F.lit(" words")))
    )


def sanitise(text: Column, limit: int) -> Column:
    """Cut to `limit` characters and without control characters but tab, line feed and return."""
    return F.regexp_replace(F.left(text, F.lit(limit)), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def planned_mode(query: Column) -> Column:
    """Search mode that the deterministic planner picks."""
    low, n = F.lower(query), F.size(words(query))
    return F.when((n <= 3) & ~contains_any(low, ("how", "what", "why", "explain")), "payload").when(contains_any(low, ("explain", "how", "pattern", "implement", "example")), "semantic").otherwise("hybrid")


def stem(word: Column) -> Column:
    """The word without the first of nine suffixes that fits and leaves three letters; words of up to four stay."""
    out = word
    for s in reversed(STEM_SUFFIXES):
        out = F.when((F.length(word) > len(s) + 2) & word.endswith(s), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return F.when(F.length(word) <= 4, word).otherwise(out)


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct lower-cased words of two texts; 0 if either has none."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def related(query: Column, recent: Column) -> Column:
    """Whether a recent query bears on the query: substring, shared word, word within word, shared beginning or stem."""
    q, r = F.lower(F.trim(query)), F.lower(F.trim(recent))
    long_words = lambda t: F.filter(words(t), lambda w: F.length(w) >= 3)

    def pair(a: Column, b: Column) -> Column:
        within = (F.length(a) >= 4) & (b.contains(a) | a.contains(b))
        begin = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4))
        stems = (F.length(a) > 3) & (F.length(b) > 3) & (stem(a) == stem(b)) & (F.length(stem(a)) > 2)
        return (a == b) | within | begin | stems

    inside = r.contains(q) | q.contains(r)
    return (q != r) & (inside | F.exists(long_words(q), lambda a: F.exists(long_words(r), lambda b: pair(a, b))))


def parse_time(value: Column) -> Column:
    """Epoch seconds of a number or an ISO-8601 text (with or without Z); null if it is neither."""
    iso = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(value), "Z$", "+00:00"), "T", " "))
    return F.coalesce(value.try_cast("double"), F.unix_micros(iso) / 1e6)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def first_words(text: Column, n: int, mark: str = "...") -> Column:
    """The first n words; with the mark where words were left out."""
    w = words(text)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(mark))).otherwise(text)


def retry_delay(attempt: Column, jitter: Column | float = 0.0) -> Column:
    base = F.least(F.pow(F.lit(2.0), attempt), F.lit(30.0))
    return base * (1 + (F.lit(jitter) if isinstance(jitter, float) else jitter))


def worker_backoff(failures: Column) -> Column:
    return F.when(failures < 3, F.lit(0.0)).otherwise(F.least(F.pow(F.lit(2.0), failures - 3), F.lit(30.0)))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, extension(path)), F.lit("unknown"))


#: Parts of a path that mark a test file, and those that mark anything but main sources.
TEST_MARKS = ("test_", "_test.", "spec.", ".test.", "/tests/", "/test/")
SIDE_MARKS = ("test", "spec", "example", "__pycache__")


def is_test_path(path: Column) -> Column:
    return contains_any(F.lower(path), TEST_MARKS)


def is_main_path(path: Column) -> Column:
    return (F.length(path) > 0) & ~contains_any(F.lower(path), SIDE_MARKS)


def glob_regex(pattern: str, whole: bool = True) -> str:
    """A regular expression for a shell pattern; `whole` anchors both ends, else the pattern may begin at any folder."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", r"\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$" if whole else f"(^|/){out}$"


def matches_any(path: Column, patterns: list[str], whole: bool = True) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(glob_regex(p, whole)) for p in patterns), F.lit(False))


def tagged_queries(prompt: Column) -> Column:
    """array<struct<text, start, end>> of the non-blank tagged parts of a prompt, any letter case."""
    whole = F.regexp_extract_all(prompt, F.lit(rf"(?is)<{TAG}>.*?</{TAG}>"), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def take(acc: Column, tag: Column) -> Column:
        at = F.position(tag, prompt, acc["at"])
        text = F.trim(F.substring(tag, F.lit(6), F.length(tag) - 11))
        row = F.struct(text.alias("text"), (at - 1).alias("start"), (at - 1 + F.length(tag)).alias("end"))
        return F.struct((at + F.length(tag)).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    found = F.aggregate(whole, start, take, lambda acc: acc["out"])
    return F.filter(found, lambda s: s["text"] != "")


def without_tags(prompt: Column) -> Column:
    return F.trim(F.regexp_replace(prompt, rf"(?is)<{TAG}>.*?</{TAG}>", ""))


def collection_name(project: Column, kind: Column) -> Column:
    return F.concat_ws("-", F.regexp_replace(F.lower(project), "[ _]", "-"), kind)


def tool_collection_name(project: Column) -> Column:
    return F.concat(F.lit(f"{TAG}_"), F.regexp_replace(F.lower(project), "[^a-z0-9]", "_"))
