"""Query suggestions as one table of templates over a query's features.

A template is (text, condition, confidence, kind); all are evaluated as columns of
the queries DataFrame, so many queries are completed in one narrow stage, and the
only shuffle is the de-duplication by query.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import TEST_MARKS, contains_any, extension, jaccard, related, words

# Confidence levels, limits, language marks and suggestion templates.
HIGH, MEDIUM_HIGH, MEDIUM, LOW = 0.9, 0.85, 0.75, 0.6
PER_TYPE, SHORT_QUERY, LONG_QUERY = 6, 3, 8
LANGUAGE_MARKS = {
    "python": (".py", "def ", "import ", "from ", "__init__", "self.", "pip", "pytest"),
    "javascript": (".js", ".jsx", "function ", "const ", "let ", "var ", "npm", "jest"),
    "typescript": (".ts", ".tsx", "interface ", "type ", ": string", ": number", "tsc"),
    "go": (".go", "func ", "package ", "import (", "go mod", "go test"),
    "rust": (".rs", "fn ", "impl ", "trait ", "cargo", "#[test]"),
    "java": (".java", "public class", "private ", "extends ", "implements ", "junit"),
}
FUNCTION_TEMPLATES = {
    "generic": ("{query} function", "{query} method", "test {query}", "{query} handler", "{query} validator"),
    "python": ("def {query}", "async def {query}", "def test_{query}", "@property {query}", "{query}(self"),
    "javascript": ("function {query}", "const {query} =", "async {query}", "{query}() {", "test('{query}'"),
    "go": ("func {query}", "func Test{query}", "func (r *) {query}", "{query}() error", "type {query} func"),
}
CLASS_TEMPLATES = {
    "generic": ("{query} class", "{query} model", "{query} service", "{query} controller", "{query} manager"),
    "python": ("class {query}", "class {query}(BaseModel)", "class Test{query}", "@dataclass {query}", "class {query}Exception"),
    "javascript": ("class {query}", "class {query} extends", "interface {query}", "type {query} =", "const {query} = class"),
    "go": ("type {query} struct", "type {query} interface", "type {query}Service", "type {query}Error", "type Mock{query}"),
}
FILE_TEMPLATES = {
    "python": ("{query}.py", "test_{query}.py", "{query}_test.py", "__{query}__.py"),
    "javascript": ("{query}.js", "{query}.test.js", "{query}.spec.js", "{query}.jsx"),
    "typescript": ("{query}.ts", "{query}.test.ts", "{query}.spec.ts", "{query}.tsx"),
    "go": ("{query}.go", "{query}_test.go", "{query}_mock.go"),
    "rust": ("{query}.rs", "test_{query}.rs", "mod_{query}.rs"),
    "java": ("{query}.java", "{query}Test.java", "{query}Spec.java"),
}
LANGUAGE_ADDITIONS = {
    "python": ("decorator", "async", "property"),
    "javascript": ("arrow function", "callback", "promise"),
    "go": ("goroutine", "channel", "interface"),
    "rust": ("trait", "lifetime", "ownership"),
}
LANGUAGE_TERMS = {
    "python": {"function": ("method", "def"), "class": ("type", "dataclass")},
    "javascript": {"function": ("method", "callback"), "class": ("prototype", "constructor")},
    "go": {"function": ("func", "method"), "class": ("struct", "type")},
}
TERMS = {"function": ("method", "procedure"), "class": ("type", "struct"), "method": ("function", "member function"), "interface": ("protocol", "abstract class"), "util": ("helper", "utility"), "test": ("spec", "unittest")}
SEMANTIC_LEADS = ("how to {query}", "find {query}", "show me {query}")
SEMANTIC_TEMPLATES = ("{query} examples", "{query} implementation", "find {query} that handles", "{query} similar to", "{query} in file", "{query} with pattern")
TEST_SEMANTIC = ("test {query} behavior", "{query} test coverage", "mock {query} for testing")
CONTEXT_TEMPLATES = {"test": ("test {query}", "{query} test cases", "{query} unit tests", "{query} mocks", "{query} fixtures"), "general": ("{query} in this file", "{query} similar to", "{query} with examples", "{query} and related", "{query} dependencies")}
REFINING = ("examples", "implementation", "usage", "documentation", "patterns", "best practices")


@dataclass
class Features:
    query: Column
    low: Column
    n: Column
    language: Column
    is_test: Column
    current_file: Column
    recent: Column
    function_count: Column
    class_count: Column
    frequency: Column


def counting(marks: tuple[str, ...]):
    """Adds the number of marks within a text."""
    return lambda acc, r: acc + sum((F.lower(r).contains(m).cast("int") for m in marks), F.lit(0))


def within(template: str):
    return lambda w: F.lit(template).contains(w)


def language_vote(query: Column, current_file: Column, recent: Column) -> Column:
    """Most-voted language or null: marks in the query count 2 each, the file's extension 5, marks in recent queries 1; earlier languages win ties."""
    low, ext = F.lower(query), extension(F.coalesce(current_file, F.lit("")))
    votes = []
    for i, (lang, marks) in enumerate(LANGUAGE_MARKS.items()):
        own = sum((2 * low.contains(m).cast("int") for m in marks), F.lit(0))
        file = F.when(ext.isin(*[m for m in marks if m.startswith(".")]), 5).otherwise(0)
        past = F.aggregate(F.coalesce(recent, F.array().cast("array<string>")), F.lit(0), counting(marks))
        votes.append(F.struct((own + file + past).alias("votes"), F.lit(-i).alias("order"), F.when(own + file + past > 0, F.lit(lang)).alias("lang")))
    return F.array_max(F.array(*votes))["lang"]


def features(query: Column, current_file: Column, recent: Column) -> Features:
    low = F.lower(F.trim(query))
    past = F.coalesce(recent, F.array().cast("array<string>"))
    with_any = lambda parts: F.size(F.filter(past, lambda r: contains_any(F.lower(r), parts)))
    terms = F.flatten(F.transform(past, lambda r: F.filter(words(F.lower(r)), lambda w: F.length(w) >= 3)))
    return Features(query, low, F.size(words(low)), language_vote(query, current_file, recent), contains_any(F.lower(F.coalesce(current_file, F.lit(""))), TEST_MARKS), current_file, past, with_any(("def", "function")), with_any(("class", "type")), terms)


def fill(template: str, query: Column) -> Column:
    before, _, after = template.partition("{query}")
    return F.concat(F.lit(before), query, F.lit(after))


def lasting(count: Column, base: float) -> Column:
    """Confidence that grows with how often a kind was asked for."""
    return F.lit(base) + F.when(count > 3, 0.1).when(count > 1, 0.05).otherwise(0.0)


def candidates(f: Features) -> Column:
    """array<struct<text, kind, confidence, seq>> of all suggestions whose conditions hold."""
    rows: list[Column] = []

    def add(text: Column, kind: str, confidence: Column | float, when: Column) -> None:
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        row = F.struct(text.alias("text"), F.lit(kind).alias("kind"), c.cast("double").alias("confidence"), F.lit(len(rows)).alias("seq"))
        rows.append(F.when(when & (text != f.query), row))

    lang = F.coalesce(f.language, F.lit("generic"))
    of = lambda table, name: ~lang.isin(*[k for k in table if k != "generic"]) if name == "generic" else lang == name
    has = lambda *parts: contains_any(f.low, parts)

    wants = has("def", "function", "func", "method") | (f.n <= F.when(f.function_count > 2, SHORT_QUERY + 1).otherwise(SHORT_QUERY)) | (f.is_test & has("test"))
    base = F.least(lasting(f.function_count, MEDIUM_HIGH) + F.when(f.is_test, 0.05).otherwise(0.0), F.lit(0.95))
    for name, templates in FUNCTION_TEMPLATES.items():
        for t in templates:
            low = t.lower()
            boost = F.when(has("async") & F.lit("async" in low), 0.05).otherwise(0.0) + F.when(has("test") & F.lit("test" in low), 0.05).otherwise(0.0) + F.when(f.is_test & F.lit("test" in low), 0.03).otherwise(0.0) - F.when(has(*low.split()), 0.02).otherwise(0.0)
            add(fill(t, f.query), "completion", F.least(base + boost, F.lit(0.95)), wants & of(FUNCTION_TEMPLATES, name))
    wants = has("class", "interface", "type", "model", "struct") | (f.n <= SHORT_QUERY) | (f.class_count > 1)
    for name, templates in CLASS_TEMPLATES.items():
        for t in templates:
            add(fill(t, f.query), "completion", F.least(lasting(f.class_count, MEDIUM), F.lit(0.95)), wants & of(CLASS_TEMPLATES, name))
    wants = has("file:", "path:", ".") | (has("file") & has(":"))
    stem = F.when(f.query.contains(":"), F.regexp_replace(f.query, "^[^:]*:", "")).otherwise(f.query)
    confidence = F.when(has("file:"), MEDIUM_HIGH).otherwise(LOW) + F.when(f.language.isin(*FILE_TEMPLATES), 0.1).otherwise(0.0)
    shown = 0
    for name, templates in FILE_TEMPLATES.items():
        for i, t in enumerate(templates):
            general = f.language.isNull() & F.lit(i < 2 and shown < 8)
            shown += i < 2
            add(fill(t, stem), "completion", F.least(confidence, F.lit(0.95)), wants & (F.coalesce(f.language == name, F.lit(False)) | general))
    wants = has("how", "what", "find", "show", "explain") | (f.n >= 2)
    led = reduce(lambda a, b: a | b, (f.low.startswith(w) for w in ("how", "what", "find", "show")))
    for i, t in enumerate(SEMANTIC_LEADS + SEMANTIC_TEMPLATES + TEST_SEMANTIC):
        k = i - len(SEMANTIC_LEADS)
        slot = F.when(led, F.lit(k)).otherwise(F.lit(i))
        ok = (slot >= 0) & (slot < PER_TYPE) & (F.lit(k < len(SEMANTIC_TEMPLATES)) | f.is_test)
        liked = F.exists(f.frequency, within(t))
        add(fill(t, f.query), "completion", F.least(F.lit(HIGH) + F.when(liked, 0.05).otherwise(0.0), F.lit(0.95)), wants & ok)

    for name, extra in LANGUAGE_ADDITIONS.items():
        for x in extra:
            add(F.concat(f.query, F.lit(f" {x}")), "refinement", MEDIUM, F.coalesce(f.language == name, F.lit(False)))
    for x in ("unit test", "integration test", "mock"):
        add(F.concat(f.query, F.lit(f" {x}")), "refinement", MEDIUM_HIGH, f.is_test)
    for x in ("def", "class"):
        add(F.concat(F.lit(f"{x} "), f.query), "refinement", LOW, (f.n >= 2) & ~has("async", "def", "class"))
    for x in (".py", ".js", ".ts", ".go"):
        add(F.concat(f.query, F.lit(f" {x}")), "refinement", 0.5, ~has(".py", ".js", ".ts", ".go", ".rs"))
    asking = has("how to", "what is", "find", "show")
    for x in REFINING:
        add(F.concat(f.query, F.lit(f" {x}")), "refinement", F.when(asking, 0.82).otherwise(0.7), (f.n <= 2) | asking)
    for x in ("definition", "implementation", "declaration"):
        add(F.concat(f.query, F.lit(f" {x}")), "refinement", MEDIUM, has("function", "class", "method", "interface", "variable", "util", "test"))

    for name, terms in LANGUAGE_TERMS.items():
        for term, others in terms.items():
            for x in others:
                add(F.replace(f.query, F.lit(term), F.lit(x)), "alternative", MEDIUM_HIGH, F.coalesce(f.language == name, F.lit(False)) & has(term))
    plain = F.regexp_replace(f.query, "[\"']", "")
    plain = F.when(plain.contains(":"), F.regexp_replace(plain, "^[^:]*:", "")).otherwise(plain)
    add(F.concat(F.lit("how to use "), plain), "alternative", MEDIUM_HIGH, contains_any(f.query, ('"', "'", ":")))
    for term, others in TERMS.items():
        for x in others:
            add(F.replace(f.query, F.lit(term), F.lit(x)), "alternative", MEDIUM, has(term))
    key = F.filter(words(f.query), lambda w: (F.length(w) > 3) & ~F.lower(w).isin("with", "that", "this", "have"))
    add(F.concat(F.lit('"'), F.try_element_at(key, F.lit(1)), F.lit('"')), "alternative", MEDIUM, (f.n >= 4) & (F.size(key) > 0))

    for kind, templates in CONTEXT_TEMPLATES.items():
        for i, t in enumerate(templates):
            add(fill(t, f.query), "context", LOW + 0.1, (f.is_test if kind == "test" else ~f.is_test) & (f.language.isNull() | F.lit(i < 3)))
    add(F.concat(f.query, F.lit(" in "), f.language), "context", LOW + 0.1, f.language.isNotNull())
    add(F.concat(f.query, F.lit(" in "), f.current_file), "context", MEDIUM_HIGH, F.length(f.current_file) > 0)
    for i in range(3):
        past = F.try_element_at(f.recent, F.lit(i + 1))
        add(past, "context", F.least(F.lit(0.7) + 0.2 * jaccard(f.query, past), F.lit(0.95)), past.isNotNull() & related(f.query, past))
    return F.array_compact(F.array(*rows))


def suggestions(queries: DataFrame, limit: int = 10) -> DataFrame:
    """query, text, kind, confidence, rank of the best suggestions of each row (query, current_file, recent array<string>)."""
    f = features(F.col("query"), F.col("current_file"), F.col("recent"))
    names = [x for x in f.__dataclass_fields__ if x not in ("query", "current_file", "recent")]
    # the features become columns first: hundreds of templates refer to them
    rows = queries.where(F.length(F.trim("query")) > 0).select("query", "current_file", f.recent.alias("recent"), *(getattr(f, x).alias(x) for x in names))
    f = Features(**{x: F.col(x) for x in f.__dataclass_fields__})
    one = rows.select("query", F.explode(candidates(f)).alias("s"), f.frequency.alias("terms"), f.is_test.alias("is_test")).select("query", "s.*", "terms", "is_test")
    counts = lambda: F.aggregate(F.array_distinct("terms"), F.lit(0.0), lambda acc, w: acc + F.when(F.lower("text").contains(w), F.least(0.02 * F.size(F.filter("terms", lambda x: x == w)), F.lit(0.1))).otherwise(0.0))
    boost = counts() + F.when(F.col("is_test") & F.lower("text").contains("test"), 0.05).otherwise(0.0)
    scored = one.withColumn("confidence", F.round(F.least(F.col("confidence") + boost, F.lit(0.99)), 6))
    # the first of equal texts with the highest confidence, then by confidence
    best = scored.groupBy("query", F.lower(F.trim("text")).alias("key")).agg(F.min_by(F.struct("text", "kind", "confidence", "seq"), F.struct(-F.col("confidence"), F.col("seq"))).alias("s"), F.min("seq").alias("first"))
    w = Window.partitionBy("query").orderBy(F.desc("s.confidence"), "first")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query", "s.text", "s.kind", "s.confidence", "rank")


def hints(query: Column, limit: int = 3) -> Column:
    """array<string>: up to three ways to improve the query."""
    f = features(query, F.lit(None).cast("string"), F.array(query))
    has = lambda *parts: contains_any(f.low, parts)
    lang = F.coalesce(f.language, F.lit(""))
    rows = [
        F.when(f.n == 1, "Try adding more context words for better results").when(f.n > LONG_QUERY, "Consider using shorter, more specific terms"),
        F.when((lang == "python") & ~has("def"), "Use 'def' to search for Python functions")
        .when((lang == "javascript") & ~has("function"), "Use 'function' or 'const' for JavaScript code")
        .when((lang == "") & ~has("def", "class", "function", "method") & (f.n <= SHORT_QUERY), "Add 'def' or 'class' to search for specific code elements"),
        F.when(~contains_any(query, ('"', "'")) & (f.n <= 2), 'Use quotes for exact matches: "ExactFunctionName"'),
        F.when(~has(".py", ".js", ".ts", ".go", ".rs"), "Specify file type to narrow results: query.py"),
        F.when(~has("how", "what", "find", "show", "explain") & (f.n >= 3), "Start with 'how to' or 'find' for explanation-style results"),
    ]
    return F.slice(F.array_compact(F.array(*rows)), 1, limit)


def explain(kind: Column) -> Column:
    return F.when(kind == "completion", "completes the query by a common pattern").when(kind == "refinement", "narrows the query").when(kind == "alternative", "another way to search").otherwise("adds context to the query")
