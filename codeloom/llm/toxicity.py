"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the word classes of a clause: insult, threat, target,
negation and reported speech.  Each maps (state, class) to a next state and a
factor; they are composed into one machine whose states are the tuples of theirs
and whose factors are the products.  A clause scores the sum of its insult and
threat weights times those factors, so a word alone counts less than one aimed at
somebody, and denied or reported ones count less still.

Word weights come from the labels: log odds of whole words and of word beginnings
and endings, over a bounded, documented sample of the labelled training rows from
which near copies are removed (else the words of one copied text would look
toxic).  A logistic curve over the document's clause scores gives the result.

Null and empty texts have no clauses and get the score of no evidence.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import LETTERS, chunks, fold_of, hash_share, map_texts, written

# Seed words of the classes, in four languages.
INSULTS = (
    "idiot idiots moron morons imbecile stupid dumb dumbass scum trash loser losers pathetic worthless disgusting clown clowns bastard asshole "
    "bitch cretin vermin filth freak retard jerk pig idiota imbécil estúpido estúpida basura escoria idiote imbécile connard ordure "
    "salaud crétin trottel dummkopf arschloch abschaum vollidiot versager"
).split()
THREATS = "kill murder hurt destroy stab shoot strangle beat burn bomb matar mataré töten umbringen tuer buter frapper golpear".split()
TARGETS = "you your yours youre u ya he she they them his her their those these du dich dir ihr euch tu te toi vous ton usted ustedes ti él ella".split()
NEGATIONS = "not no never isnt arent wasnt dont doesnt didnt cannot cant without kein keine nicht nie pas jamais sans nunca sin ni".split()
REPORTS = "said says say wrote writes called calls claimed claims stated quoted quote reported according sagte schrieb dit écrit dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEED_WEIGHT = 2.0
SAMPLE_ROWS, MAX_PATTERNS = 20_000, 20_000
AFFIX_LENGTHS = (4, 5, 6)
MIN_RATIO = 15.0
CLAUSE_END = re.compile(r"[.!?;:\n]+|, (?:but|and|or|aber|und|mais|et|pero|y)\b")


@dataclass(frozen=True)
class Transducer:
    """arcs: state -> class -> (next state, factor); a class without an arc leads to `rest` of the state at factor 1."""

    arcs: tuple[dict[int, tuple[int, float]], ...]
    rest: tuple[int, ...]

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs[state].get(symbol, (self.rest[state], 1.0))


def insult_machine() -> Transducer:
    """A second insult in a row weighs more."""
    return Transducer(({INSULT: (1, 1.0)}, {INSULT: (1, 1.25)}), (0, 0))


def threat_machine() -> Transducer:
    """A threat counts in full within three words after a target; else a quarter, and the rest at a target within three words after it.

    States: 0; 1 to 3 a target that many words ago at most; 4 to 6 likewise a threat.
    """
    lone, aimed, waiting = ({TARGET: (3, t), THREAT: (q, w)} for t, q, w in ((0.0, 6, 0.25), (0.0, 0, 1.0), (0.75, 6, 0.25)))
    return Transducer((lone, aimed, aimed, aimed, waiting, waiting, waiting), (0, 0, 1, 2, 0, 4, 5))


def target_machine() -> Transducer:
    """After somebody is addressed, insults within five words weigh more."""
    arcs = {TARGET: (5, 1.0), INSULT: (5, 1.5)}
    return Transducer(({TARGET: (5, 1.0)}, arcs, arcs, arcs, arcs, arcs), (0, 0, 1, 2, 3, 4))


def negation_machine() -> Transducer:
    """For three words after a negation, insults and threats weigh little."""
    arcs = {NEGATION: (3, 1.0), INSULT: (0, 0.3), THREAT: (0, 0.3)}
    return Transducer(({NEGATION: (3, 1.0)}, arcs, arcs, arcs), (0, 0, 1, 2))


def report_machine() -> Transducer:
    """After a verb of speaking, to the end of the clause, half."""
    return Transducer(({REPORT: (1, 1.0)}, {INSULT: (1, 0.5), THREAT: (1, 0.5)}), (0, 1))


def compose(*machines: Transducer) -> list[list[tuple[int, float]]]:
    """The product machine: state -> class -> (next state, factor)."""
    states = list(itertools.product(*(range(len(m.rest)) for m in machines)))
    at = {s: i for i, s in enumerate(states)}
    table = []
    for s in states:
        row = []
        for symbol in range(6):
            steps = [m.step(q, symbol) for m, q in zip(machines, s)]
            row.append((at[tuple(q for q, _ in steps)], math.prod(f for _, f in steps)))
        table.append(row)
    return table


GRAMMAR = compose(insult_machine(), threat_machine(), target_machine(), negation_machine(), report_machine())
CLASS_OF = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}


class Scorer:
    """patterns: (" word ", " begin" or "end ") -> weight.  coef: of 1, log(1 + sum of clause scores), the highest clause score and log(1 + clauses that score)."""

    def __init__(self, patterns: dict[str, float], coef: tuple[float, ...]):
        import ahocorasick

        self.coef = coef
        self.weights = {f" {w} ": SEED_WEIGHT for w in INSULTS} | patterns
        self.threats = {f" {w} " for w in THREATS}
        self.auto = ahocorasick.Automaton()
        for p in {*self.weights, *self.threats}:
            core = p.strip(" ")
            held = self.auto.get(core, None) or []
            self.auto.add_word(core, [*held, (p, len(core))])
        self.auto.make_automaton()

    def hits(self, low: str) -> dict[int, tuple[int, float]]:
        """By start of the word: (class, weight) of words that some pattern matches."""
        out: dict[int, tuple[int, float]] = {}
        n = len(low)
        for end, held in self.auto.iter(low):
            for p, size in held:
                a, b = end - size + 1, end + 1
                if p[0] == " " and a > 0 and low[a - 1].isalpha() or p[-1] == " " and b < n and low[b].isalpha():
                    continue
                while a > 0 and low[a - 1].isalpha():
                    a -= 1
                if p in self.weights:
                    w = self.weights[p]
                    if out.get(a, (OTHER, 0.0))[0] != INSULT or out[a][1] < w:
                        out[a] = (INSULT, w)
                elif a not in out:
                    out[a] = (THREAT, SEED_WEIGHT)
        return out

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the clauses with an insult or threat."""
        low = text.lower()
        if len(low) != len(text):  # rare letters that grow in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = self.hits(low)
        out, done = [], -1
        for start in sorted(found):
            if start < done:
                continue
            left = 0
            for m in CLAUSE_END.finditer(low, max(0, start - 400), start):
                left = m.end()
            left = max(left, start - 400)
            m = CLAUSE_END.search(low, start)
            right = m.start() if m else len(low)
            state = score = 0
            for w in LETTERS.finditer(low, left, right):
                kind, weight = found.get(w.start()) or ((k := CLASS_OF.get(w[0], OTHER)), SEED_WEIGHT * (k == TARGET))
                state, factor = GRAMMAR[state][kind]
                score += weight * factor
            out.append((left, right, float(score)))
            done = right
        return out

    def evidence(self, text: str) -> tuple[float, float, float]:
        scores = [s for _, _, s in self.clauses(text)]
        return math.log1p(sum(scores)), max(scores, default=0.0), math.log1p(len(scores))

    def score(self, text: str) -> float:
        z = self.coef[0] + sum(c * x for c, x in zip(self.coef[1:], self.evidence(text)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


#: Used where there are no labels to learn from.
DEFAULT_COEF = (-4.0, 2.0, 0.5, 0.0)


def affixes(word: str) -> list[str]:
    out = [f" {word} "]
    for k in AFFIX_LENGTHS:
        if len(word) >= k:
            out += [f" {word[:k]}", f"{word[-k:]} "]
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def without_near_copies(rows: DataFrame) -> DataFrame:
    """Keeps one row (text, toxic) of those with an equal minimum hash of three-word runs, under three hashes in turn.

    rows: a bounded sample.  It is written once; only its hashes, four numbers a row, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row = TaskContext.get().partitionId() << 32
        for cut, texts in chunks(batches):
            mins = np.zeros((len(texts), 3), np.uint64)
            for i, text in enumerate(texts):
                words = LETTERS.findall(text.lower())
                h = np.fromiter((xxhash.xxh64_intdigest(" ".join(w)) for w in {*zip(words, words[1:], words[2:])} or {tuple(words)}), np.uint64)
                if len(h):
                    mins[i] = [mix64(h ^ np.uint64(salt)).min() for salt in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            yield pa.RecordBatch.from_arrays([cut.column("text"), cut.column("toxic"), pa.array(np.arange(row, row + len(texts))), *(pa.array(mins[:, j].astype(np.int64)) for j in range(3))], names=["text", "toxic", "row", "m0", "m1", "m2"])
            row += len(texts)

    sample = written(rows.mapInArrow(run, "text string, toxic int, row bigint, m0 bigint, m1 bigint, m2 bigint"), "training-sample")
    marks = sample.select("row", "m0", "m1", "m2").toPandas().sort_values(["m0", "m1", "m2", "row"])
    for c in ("m0", "m1", "m2"):
        marks = marks.drop_duplicates(c)
    kept = rows.sparkSession.createDataFrame([(int(r),) for r in marks["row"]], "row bigint")
    return sample.join(F.broadcast(kept), "row", "left_semi").select("text", "toxic")


def learn(labelled: DataFrame, max_patterns: int = MAX_PATTERNS) -> Scorer:
    """Fits word weights and the final curve on the rows (text, toxic) of a bounded sample."""
    rows = labelled.where(F.col("toxic").isin(0, 1) & F.col("text").isNotNull()).select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = without_near_copies(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = (Counter(), Counter())
        for cut, texts in chunks(batches):
            for label, text in zip(cut.column("toxic").to_pylist(), texts):
                words = set(LETTERS.findall(text.lower()))
                tally[label].update({a for w in words for a in affixes(w)})
                tally[label][""] += 1
        for label in (0, 1):
            names = list(tally[label])
            yield pa.RecordBatch.from_pydict({"pattern": names, "toxic": [label] * len(names), "n": [tally[label][a] for a in names]}, pa.schema([("pattern", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    n = {c: F.coalesce(F.sum(F.when(F.col("toxic") == v, F.col("n"))), F.lit(0)) for c, v in (("bad", 1), ("good", 0))}
    counts = sample.mapInArrow(count, "pattern string, toxic int, n bigint").groupBy("pattern").agg(n["bad"].alias("bad"), n["good"].alias("good")).where("bad >= 6 and bad * 4 > good or pattern = ''")
    top = counts.orderBy(F.expr("pattern = ''").desc(), F.expr("bad / (good + 3.0)").desc(), "pattern").limit(max_patterns + 1).collect()
    total = next(((r.bad, r.good) for r in top if r.pattern == ""), (0, 0))
    patterns: dict[str, float] = {}
    if min(total):
        words: dict[str, int] = {}  # for each affix, the documents of its most frequent single word
        for r in top:
            if r.pattern.startswith(" ") and r.pattern.endswith(" "):
                for a in affixes(r.pattern.strip())[1:]:
                    words[a] = max(words.get(a, 0), r.bad)
        for r in top:
            ratio = (r.bad / total[0]) / ((r.good + 3.0) / total[1])
            if r.pattern and ratio >= MIN_RATIO and r.bad >= 1.5 * words.get(r.pattern, 0):  # else the affix of one word only
                patterns[r.pattern] = min(6.0, math.log(ratio))
    draft = Scorer(patterns, DEFAULT_COEF)
    if not min(total):
        return draft

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(patterns, DEFAULT_COEF)
        for cut, texts in chunks(batches):
            got = [scorer.evidence(t) for t in texts]
            yield pa.RecordBatch.from_arrays([cut.column("toxic"), *(pa.array([g[i] for g in got], pa.float64()) for i in range(3))], names=["toxic", "total", "most", "clauses"])

    got = sample.mapInArrow(measure, "toxic int, total double, most double, clauses double").toPandas()  # at most about sample_rows rows
    x = np.column_stack([np.ones(len(got)), got["total"], got["most"], got["clauses"]])
    y = got["toxic"].to_numpy(float)
    w = np.zeros(4)
    ridge = np.diag([1e-3, 0.5, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Scorer(patterns, tuple(float(v) for v in w))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about `sample_rows` labelled documents, picked by a hash of the id, none of the held-out fold.

    The sample is drawn from the labels, so the join moves the texts of the sample only where it is small enough to broadcast its ids.
    """
    known = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), 4) != 2))
    picked = known.where(hash_share(sample_rows / max(1, known.count()), "doc_id")).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    small = F.broadcast(picked.limit(4 * sample_rows))  # at most that many ids and labels
    return docs.select("doc_id", "text").join(small, "doc_id").select("text", "toxic")


def score_documents(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses: one row per document."""
    weights, coef = {p: w for p, w in scorer.weights.items()}, scorer.coef

    def fn(texts: list[str], s: Scorer) -> dict[str, list]:
        scores = [s.score(t) for t in texts]
        return {"score": scores, "predicted": [int(v >= threshold) for v in scores]}

    return map_texts(docs, fn, "score double, predicted int", also={"held_out": F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))}, setup=lambda: Scorer(weights, coef))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = learn(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_documents(docs, scorer)
