"""Benchmark decontamination by pigeonhole edit matching.

Text and test items become word sequences (lower case, letters and digits).  An
item of n words has an error budget of k = floor(max_error_rate * n) word edits.
It is split into k + 1 pieces; where a document holds the item within k edits, at
least one piece stands there unchanged.  One automaton finds all pieces exactly;
each hit opens a window of the item's length and budget around it, in which Myers'
bit-parallel distance verifies the item.  Items shorter than `min_words` match
only documents that consist of them.

Null or empty texts and items match nothing.  The items are sent to the executors
in blocks of at most `block_words` words: a larger benchmark takes more passes
over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.llm.common import chunks

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
MAX_ERROR_RATE, MIN_WORDS, BLOCK_WORDS = 0.2, 8, 2_000_000


def normal_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """budget + 1 runs of words, as even as can be, with their offsets."""
    n, parts = len(words), budget + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern_masks: dict[str, int], m: int, text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the end of the first such stretch."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, best_end = m, 0
    for j, w in enumerate(text):
        eq = pattern_masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # free start: the row above is all zero
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, best_end = score, j + 1
    return best, best_end


def masks(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], max_error_rate: float = MAX_ERROR_RATE, min_words: int = MIN_WORDS):
        import ahocorasick

        self.items = []
        self.whole: dict[str, list[int]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = normal_words(text or "")
            if not words:
                continue
            if len(words) < min_words:
                self.whole.setdefault(" ".join(words), []).append(item_id)
                continue
            budget = int(max_error_rate * len(words))
            for offset, run in pieces(words, budget):
                at.setdefault(f" {' '.join(run)} ", []).append((len(self.items), offset))
            self.items.append((item_id, words, masks(words), budget))
        self.auto = ahocorasick.Automaton() if at else None
        for text, held in at.items():
            self.auto.add_word(text, (len(text), held))
        if self.auto:
            self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, least distance, start word, end word) of each item found within its budget, once per item."""
        words = normal_words(text)
        if not words:
            return []
        joined = f" {' '.join(words)} "
        out = [(i, 0, 0, len(words)) for i in self.whole.get(joined.strip(), ())]
        if not self.auto:
            return out
        windows: dict[int, list[tuple[int, int]]] = {}
        seen, counted = 0, 0  # words before `seen` characters
        for end, (size, held) in self.auto.iter(joined):
            start = end - size + 1
            if start >= seen:
                counted += joined.count(" ", seen, start)
                seen = start
                first = counted
            else:
                first = counted - joined.count(" ", start, seen)
            for which, offset in held:
                _, item, _, budget = self.items[which]
                a = max(0, first - offset - budget)
                windows.setdefault(which, []).append((a, min(len(words), first - offset + len(item) + budget)))
        for which, spans in windows.items():
            item_id, item, pattern, budget = self.items[which]
            best = (budget + 1, 0)
            reach = -1
            for a, b in sorted(set(spans)):
                if b <= reach:
                    continue
                reach = b
                d, e = myers(pattern, len(item), words[a:b])
                if d < best[0]:
                    best = (d, a + e)
                if d == 0:
                    break
            if best[0] <= budget:
                out.append((item_id, best[0], max(0, best[1] - len(item)), best[1]))
        return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one block at a time; each is small enough to broadcast."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    size = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        if rows := sorted({(r.item_id, r.text) for r in part.collect()}):
            yield rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_error_rate: float = MAX_ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word: one row for each document row and item that it holds."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, start_word int, end_word int"
    out, item_arrow = None, to_arrow_type(benchmark.schema["item_id"].dataType)
    for block in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, max_error_rate)
            for cut, texts in chunks(batches):
                rows = [(i, *m) for i, t in enumerate(texts) for m in matcher.matches(t)]
                if rows:
                    at, item, dist, a, b = (list(c) for c in zip(*rows))
                    yield pa.RecordBatch.from_arrays([cut.column("doc_id").take(pa.array(at)), pa.array(item, item_arrow), *(pa.array(c, pa.int32()) for c in (dist, a, b))], names=["doc_id", "item_id", "distance", "start_word", "end_word"])

        found = src.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean_rows(docs: DataFrame, benchmark: DataFrame, max_error_rate: float = MAX_ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no item, with their columns as they were."""
    from codeloom.llm.common import filter_rows

    for block in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)
        docs = filter_rows(docs, lambda texts, m: (not m.matches(t) for t in texts), setup=lambda held=held: Matcher(held.value, max_error_rate))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
