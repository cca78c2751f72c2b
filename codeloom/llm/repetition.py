"""Quality rules on repetition, from a suffix array over the words of each text.

Words of a batch of texts get dense ranks that differ between texts, so one array
serves the batch and no suffix runs into another text.  Prefix doubling sorts it,
going on only with suffixes not yet told apart, and keeps the ranks of each level;
the longest common prefix of neighbours is read off these from the highest level
down.  Every suffix lies in one deepest longest-common-prefix interval, whose
length is the larger of its two neighbours' values: the union of those spans over
all suffixes is the union over all maximal repeats.  For a length of 8 it is
exactly the words in 8-word windows found twice or more.

Null and empty texts have no words and fail the base.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import map_texts, words_of

WINDOW = 8
#: Limits of the method's own verdict: repeats of at least MIN_REPEAT words may cover this share, the longest may have so many words or that share of the text.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST_WORDS, MAX_LONGEST_SHARE = 5, 0.35, 200, 0.35


def dense_ranks(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each word, number of its text), ranks of different texts apart."""
    sizes = np.array([len(d) for d in docs], np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    flat = [w for d in docs for w in d]
    word, known = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
    return doc * max(1, len(known)) + word, doc


def deepest_repeats(rank: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each position the length of the longest stretch from there that its text has elsewhere too, where it is at least `least`; else 0."""
    n = len(rank)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    ends = np.searchsorted(doc, doc, side="right")  # end of each position's text
    order = np.argsort(rank, kind="stable")
    small = np.int32 if n < 1 << 30 else np.int64  # of places in the batch, of which every level keeps as many as there are words
    first = np.empty(n, small)
    sorted_rank = rank[order]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = sorted_rank[1:] != sorted_rank[:-1]
    first[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank: place of the first equal suffix
    levels = [first]
    tied = np.ones(n, bool)
    tied[order] = ~(new & np.append(new[1:], True))
    live = np.flatnonzero(tied).astype(small)
    k = 1
    active = [live]
    while len(live):
        prev = levels[-1]
        after = live + k
        nxt = np.where(after < ends[live], prev[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((nxt, prev[live]))
        p, q, at = prev[live][by], nxt[by], live[by]
        m = len(by)
        start = np.empty(m, bool)
        start[0] = True
        start[1:] = p[1:] != p[:-1]
        new = start.copy()
        new[1:] |= q[1:] != q[:-1]
        place = np.arange(m)
        group = np.maximum.accumulate(np.where(start, place, 0))
        head = np.maximum.accumulate(np.where(new, place, 0))
        cur = prev.copy()
        cur[at] = p + (head - group)
        levels.append(cur)
        alone = new & np.append(new[1:], True)
        short = (q == 0) & ~alone  # equal to the end of the text: cannot tie with others in it
        live = np.sort(at[~alone & ~short])
        active.append(live)
        k *= 2
    # suffixes still tied at level j share 2**j words; only those that tie on `least` words matter
    start_level = int(np.floor(np.log2(max(1, least))))
    pool = active[min(start_level, len(active) - 1)] if start_level < len(active) else np.zeros(0, np.int64)
    if not len(pool):
        return longest
    final = levels[-1]
    pool = pool[np.argsort(final[pool], kind="stable")]
    a, b = pool[:-1], pool[1:]
    same = doc[a] == doc[b]
    a, b = a[same], b[same]
    i, j, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step, r = 1 << level, levels[level]
        ok = (i + step <= ends[a]) & (j + step <= ends[a])
        hit = ok & (r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)])
        i, j, common = i + step * hit, j + step * hit, common + step * hit
    keep = common >= least
    np.maximum.at(longest, a[keep], common[keep])
    np.maximum.at(longest, b[keep], common[keep])
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions in the union of the repeated spans of at least `least` words."""
    n = len(longest)
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + longest[at], -1)
    return np.cumsum(mark[:-1]) > 0


def measure(texts: list[str]) -> dict[str, list]:
    """Per text: words, their characters, words in repeated 8-word windows, words in repeats, longest repeat."""
    docs = [words_of(t) for t in texts]
    rank, doc = dense_ranks(docs)
    longest = deepest_repeats(rank, doc, MIN_REPEAT)
    edges = np.cumsum([0, *(len(d) for d in docs)])
    total = lambda flags: (np.append(0, np.cumsum(flags))[edges[1:]] - np.append(0, np.cumsum(flags))[edges[:-1]]).tolist()
    most = [int(longest[a:b].max()) if b > a else 0 for a, b in zip(edges, edges[1:])]
    spaces = [sum(map(t.count, " \t\n\v\f\r")) for t in texts]
    return {
        "n_words": [len(d) for d in docs],
        "word_chars": [len(t) - s for t, s in zip(texts, spaces)],
        "n_dup_lines": [duplicate_lines(t) for t in texts],
        "n_repeat_words": total(covered(longest, WINDOW)),
        "n_covered": total(covered(longest, MIN_REPEAT)),
        "longest_repeat": most,
    }


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def symbols(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("bigint")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures and verdict, the repetition measures, and `kept`: one row per document."""
    got = map_texts(docs, measure, "n_words bigint, word_chars bigint, n_dup_lines bigint, n_repeat_words bigint, n_covered bigint, longest_repeat bigint", also={"n_symbols": symbols(F.col("text"))})
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    limit = F.greatest(F.lit(MAX_LONGEST_WORDS), F.lit(MAX_LONGEST_SHARE) * F.col("n_words"))
    kept = ~failed & (F.col("n_covered") <= MAX_COVERED * F.col("n_words")) & (F.col("longest_repeat") <= limit)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_covered", "longest_repeat")


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
