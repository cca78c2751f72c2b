"""Secret scans: three pattern kinds, and a guess-cost measure of values in a credential context.

The cost of a value is that of its cheapest segmentation into known words (their
rank by counts over the whole corpus, in a table of bounded size), dates, repeats,
keyboard walks, sequences and brute-force spans, found by dynamic programming over
its positions; a segmentation of k parts costs k! times the product of its parts.
A value whose log10 guesses reach `min_guesses_log10` is a secret.

Null and empty texts: no spans.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import LETTERS, chunks, map_texts, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Other ways to introduce a value: more names, a few words or signs between, any printable value.
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer|kennwort|passwort|contraseña|motdepasse)["']?\x20{0,4}(?::=|=>|[:=]|\x20is\x20|\x20)\x20{0,4}(["'`]?)(?=[!-~]{6})""", re.I)
#: The whole value, however long, by the quote it starts with.
VALUE = {"": re.compile(r"[!-~]*"), '"': re.compile(r"[!#-~]*"), "'": re.compile(r"[!-&(-~]*"), "`": re.compile(r"[!-_a-~]*")}
CONTEXT_HINT = re.compile(r"pass|pwd|secret|token|key|credential|bearer|kennwort|contrase", re.I)

#: Keyboard rows, and very common passwords by rank.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn")
COMMON = (
    "password", "qwerty", "dragon", "baseball", "football", "letmein", "monkey", "abc", "mustang", "michael", "shadow", "master",
    "jennifer", "jordan", "superman", "harley", "hunter", "trustno", "ranger", "buster", "thomas", "robert", "soccer", "batman",
    "test", "pass", "killer", "hockey", "george", "charlie", "andrew", "michelle", "love", "sunshine", "jessica", "pepper",
    "daniel", "access", "joshua", "maggie", "starwars", "silver", "william", "dallas", "yankees", "hello", "amanda", "orange",
    "biteme", "freedom", "computer", "sexy", "thunder", "nicole", "ginger", "heather", "hammer", "summer", "corvette", "taylor",
    "admin", "welcome", "login", "princess", "changeme", "secret", "example", "default", "guest", "root", "user", "demo", "none",
    "null", "true", "false", "undefined", "placeholder", "your", "token", "key", "here", "insert", "dummy", "sample", "redacted",
)
LEET = str.maketrans("4@310!|5$7", "aaeioilsst")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d")
BRUTE = math.log10(10)
MAX_WORDS, TALLY = 20_000, 200_000


def walk_pairs() -> set[str]:
    """Pairs of keys beside each other on one row, either way."""
    pairs = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:])}
    return pairs | {p[::-1] for p in pairs}


WALKS = walk_pairs()


def guesses_log10(value: str, ranks: dict[str, float], limit: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of the value takes, or some number from `limit` on if it reaches that.

    Costs only grow along a segmentation, so what has reached the limit is not followed, and the work ends where nothing
    below it is left.  Of a long run (repeats, walks, sequences) only ends near its start or its own end are tried.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    stops: dict[tuple[int, int], tuple[int, int]] = {}  # by kind of run and step: the last run, start and end

    def run_end(kind: int, step: int, i: int, goes_on: Callable[[int], bool]) -> int:
        a, j = stops.get((kind, step), (0, 0))
        if not a <= i < j - 1:
            a, j = i, i + 1
            while j < n and goes_on(j):
                j += 1
            stops[kind, step] = a, j
        return j

    def ends(i: int, j: int) -> list[int]:
        return [*range(i + 3, j + 1)] if j - i <= 256 else [*range(i + 3, i + 128), *range(j - 127, j + 1)]

    def parts_from(i: int) -> list[tuple[int, float]]:
        """(end, log10 guesses) of the parts that start here, save brute force."""
        out: list[tuple[int, float]] = []
        for j in range(i + 3, min(n, i + 24) + 1):  # words
            for s, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
                if (r := ranks.get(s)) is not None:
                    upper = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 1.0
                    out.append((j, r + extra + upper))
                    break
        j = run_end(0, 0, i, lambda j: value[j] == value[j - 1])  # one character again and again
        out += [(k, 1.5 + math.log10(k - i)) for k in ends(i, j)]
        for width in range(2, 9):  # a block again and again
            if BRUTE * width >= limit:
                break
            if j >= i + 2 * width:
                continue  # one character only, cheaper as that
            e = i + width
            while value[e : e + width] == value[i : i + width] and e + width <= n:
                e += width
            if e > i + width:
                out.append((e, BRUTE * width + math.log10((e - i) // width)))
        j = run_end(1, 0, i, lambda j: low[j - 1 : j + 1] in WALKS)
        out += [(k, 2.0 + 0.5 * math.log10(k - i)) for k in ends(i, j)]
        if i + 2 < n and abs(step := ord(value[i + 1]) - ord(value[i])) == 1 and value[i].isalnum():
            j = run_end(2, step, i, lambda j: ord(value[j]) - ord(value[j - 1]) == step)
            out += [(k, 1.5 + math.log10(k - i)) for k in ends(i, j)]
        if (m := DATE.match(value, i)) and m.end() - i >= 4:
            out.append((m.end(), 4.5 if m.end() - i > 4 else 2.1))
        return out

    best: dict[int, dict[int, float]] = {0: {0: 0.0}}  # by end: parts -> log10 guesses, all below the limit
    most = 12
    for i in range(n):
        here = best.pop(i, None)
        if here:
            parts = parts_from(i)
            far = n if i == 0 or n <= 64 else min(n, i + 64)
            if limit < math.inf:
                far = min(far, i + int(limit / BRUTE) + 1)
            parts += [(j, BRUTE * (j - i) + (0.0 if j - i > 1 else 0.1)) for j in range(i + 1, far + 1)]
            for k, cost in here.items():
                if k > most:
                    continue
                order = math.log10(math.factorial(k + 1))
                for j, g in parts:
                    if cost + g + order < limit and cost + g < best.setdefault(j, {}).get(k + 1, 1e9):
                        best[j][k + 1] = cost + g
        if not best:
            return limit
    return min((c + math.log10(math.factorial(k)) for k, c in best.get(n, {}).items()), default=BRUTE * n if limit == math.inf else limit)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order of start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int]], ranks: dict[str, float], min_guesses_log10: float) -> list[tuple[int, int, int]]:
    if not CONTEXT_HINT.search(text):
        return []
    out, ends = [], []
    for a, _, b in base:  # what the base covers, in runs
        if ends and a <= ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], b)
        else:
            ends.append([a, b])
    at = after = 0
    while m := CONTEXT.search(text, after):
        start = m.end()
        value = VALUE[m[1]].match(text, start)[0].rstrip(".,;:!?)]}>\"'`")
        end = after = start + len(value)
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        if len(value) < 6 or at < len(ends) and ends[at][0] <= start and end <= ends[at][1]:
            continue  # all of it is a base span
        if (value.isalpha() and value.islower()) or value[:1].isupper() and value[1:].islower() and value.isalpha():
            continue  # a word of prose
        if guesses_log10(value, ranks, min_guesses_log10) >= min_guesses_log10:
            out.append((start, 3, end))
    return out


def train_ranks(docs: DataFrame, max_words: int = MAX_WORDS) -> dict[str, float]:
    """log10 rank of words by frequency in all documents; common passwords come first.

    At most `max_words`: a histogram of the counts, by 64ths of an octave, tells from which count on there are that
    many, so neither a sort of all words nor a top k of each task comes to the driver.  Words of one level stay together.
    """

    def counted(tally: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": list(tally), "n": list(tally.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for _, texts in chunks(batches):
            for text in texts:
                tally.update(w for w in LETTERS.findall(text.lower()) if 3 <= len(w) <= 24)
                if len(tally) >= TALLY:
                    yield counted(tally)
                    tally = Counter()
        yield counted(tally)

    text = F.col("text").cast("string").alias("text")
    words = written(docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 64)
    least, room = None, max_words
    for at, size in sorted(words.groupBy(level.alias("at")).count().collect(), reverse=True):  # below 4,000 rows at any size
        room -= size
        if room < 0:
            break
        least = at
    top = [] if least is None else words.where(level >= least).collect()
    words = dict.fromkeys([*COMMON, *(r.word for r in sorted(top, key=lambda r: (-r.n, r.word)))])
    return {w: math.log10(i + 2) for i, w in enumerate(words)}


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, ranks: dict[str, float] | None = None, min_guesses_log10: float = 8.0) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans joined, how many the cost measure added, and how many there are."""
    ranks = train_ranks(docs) if ranks is None else ranks

    def fn(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "n_spans")}
        for text in texts:
            base = base_spans(text)
            added = added_spans(text, base, ranks, min_guesses_log10)
            per = Counter(k for _, k, _ in base)
            for i, kind in enumerate(KINDS[:3]):
                out[f"n_{kind}"].append(per[i])
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + added))
            out["n_added"].append(len(added))
            out["n_spans"].append(len(base) + len(added))
        return out

    return map_texts(docs, fn, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint")


def redact(text: str, ranks: dict[str, float], min_guesses_log10: float = 8.0, mark: str = "<secret>") -> str:
    """The text with every span replaced by the mark; overlapping spans become one."""
    base = base_spans(text)
    spans = sorted((a, b) for a, _, b in base + added_spans(text, base, ranks, min_guesses_log10))
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
