"""Language identification by multilingual mixture inference.

A document is a bag of byte trigrams drawn from a mixture of the learned
languages.  Expectation-maximisation estimates its proportions; the set of
languages is the one of highest likelihood less half a log of the trigram count
for each language beyond the first, found by backward elimination.  Where the
gain that any mixture can bring over the best single language (the largest
directional derivative, an upper bound as the likelihood is concave) is below one
penalty, the single language is the answer without iterating.

Trigram counts are learned on a bounded, documented sample of the labelled
documents.  Null text, or text without a letter: `und`, score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import chunks, fold_of, hash_share, map_texts

SLOTS = 1 << 16
SAMPLE_DOCS = 20_000
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Slot of each byte trigram of the lower-cased letters, words apart by one space."""
    raw = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class Mixture:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.05
        self.p = (smooth / smooth.sum(1, keepdims=True)).T.copy()  # slots x languages
        self.log = np.log(self.p)

    def _em(self, p: np.ndarray, n: np.ndarray, use: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
        pi, last = np.full(len(use), 1.0 / len(use)), -np.inf
        q = p[:, use]
        for _ in range(rounds):
            mix = q @ pi
            ll = float(n @ np.log(mix))
            if ll - last < 1e-3:
                break
            last = ll
            pi = pi * (q.T @ (n / mix))
            pi /= pi.sum()
        return pi, float(n @ np.log(q @ pi))

    def predict(self, text: str) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, its proportion, and all selected languages with theirs."""
        if not self.langs or not LETTER.search(text):
            return "und", 0.0, []
        slots, n = np.unique(trigrams(text), return_counts=True)
        p, total = self.p[slots], int(n.sum())
        single = n @ self.log[slots]
        best = int(single.argmax())
        penalty = 0.5 * np.log(max(2, total))
        if len(self.langs) == 1 or float((n @ (p / p[:, [best]])).max()) - total <= penalty:
            return self.langs[best], 1.0, [(self.langs[best], 1.0)]
        use = np.sort(np.argsort(-single, kind="stable")[:8])
        pi, ll = self._em(p, n, use)
        score = ll - penalty * (len(use) - 1)
        while len(use) > 1:
            fewer = np.delete(use, int(pi.argmin()))
            pi2, ll2 = self._em(p, n, fewer)
            if (score2 := ll2 - penalty * (len(fewer) - 1)) < score:
                break
            use, pi, score = fewer, pi2, score2
        top = int(pi.argmax())
        return self.langs[use[top]], float(min(1.0, pi[top])), [(self.langs[u], float(x)) for u, x in zip(use, pi)]


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Mixture:
    """Trigram counts by language over about `sample_docs` rows (text, lang).

    They are picked by a hash of the text and, where there is one, the doc_id, so that a text
    with very many copies is neither wholly in the sample nor wholly out of it.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = sample_docs / max(1, rows.count())
    cut = hash_share(share, *(c for c in ("doc_id", "text") if c in labelled.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, np.ndarray] = {}
        for cut_rows, texts in chunks(batches):
            for lang, text in zip(cut_rows.column("lang").to_pylist(), texts):
                tally.setdefault(lang, np.zeros(SLOTS, np.int64))
                tally[lang] += np.bincount(trigrams(text), minlength=SLOTS)
        for lang, counts in tally.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "slot", "n"])

    got = rows.where(cut).select("lang", "text").mapInArrow(run, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), SLOTS))
    for i, lang in enumerate(langs):
        part = got[got["lang"] == lang]
        counts[i, part["slot"].to_numpy()] = part["n"].to_numpy()
    return Mixture(langs, counts)


def predict_languages(docs: DataFrame, model: Mixture, also: dict | None = None) -> DataFrame:
    """doc_id, lang_pred, score, and the selected languages with their proportions as text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed height for each language

    def fn(texts: list[str]) -> dict[str, list]:
        got = [held.value.predict(t) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "mixture": [",".join(f"{k}:{x:.4f}" for k, x in g[2]) for g in got]}

    return map_texts(docs, fn, "lang_pred string, score double, mixture string", also=also)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = fold_of(F.col("doc_id"), 4)
    model = train(docs.where(fold != 2).select("doc_id", "text", "lang"))
    return predict_languages(docs, model, {"held_out": F.coalesce(fold == 2, F.lit(False))})
