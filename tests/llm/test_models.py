"""Toxicity, language model, language identification and rollups."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import langid, language_model, rollup, toxicity

DATA = "/root/testdata/sf0.01"


def test_composed_machine_equals_its_parts():
    machines = [toxicity.insult_machine(), toxicity.threat_machine(), toxicity.target_machine(), toxicity.negation_machine(), toxicity.report_machine()]
    rng = random.Random(2)
    for _ in range(200):
        symbols = [rng.randrange(6) for _ in range(12)]
        states, state = [0] * len(machines), 0
        for s in symbols:
            steps = [m.step(q, s) for m, q in zip(machines, states)]
            states = [q for q, _ in steps]
            state, factor = toxicity.GRAMMAR[state][s]
            assert math.isclose(factor, math.prod(f for _, f in steps))


def test_clauses():
    s = toxicity.Scorer({}, toxicity.DEFAULT_COEF)
    one = lambda t: sum(x for *_, x in s.clauses(t))
    assert one("you are an idiot") > one("an idiot") > one("he said an idiot") > one("not an idiot") > one("nothing here") == 0
    assert one("I will kill you") > one("kill the process")
    assert one("") == 0 and s.score("") < 0.3 < s.score("you idiot, you moron. you are scum")
    assert len(s.clauses("You idiot. Fine words. You moron!")) == 2


def test_toxicity_learns_words(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "sol", "tiv", "wex", "yom")]
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        w = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(30)]
        if bad:
            for _ in range(4):
                w[rng.randrange(30)] = "zorgl" + rng.choice(("ax", "ex", "ix", "ux"))
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    scorer = toxicity.learn(df.where("doc_id % 2 = 0"))
    got = toxicity.score_documents(df.where("doc_id % 2 = 1"), scorer).join(df, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)


def test_toxicity_documents(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id bigint, toxic int")
    scorer = toxicity.learn(toxicity.training_rows(docs, labels))
    out = toxicity.score_documents(docs, scorer)
    assert out.count() == 11 and out.where("score between 0 and 1 and predicted = 0").count() == 11 and toxicity.score_documents(empty, scorer).count() == 0


def brute_force_scores(rows):
    """Counts in dictionaries, the same split and mixture, expectation-maximisation token by token: id -> score, id -> score without the text's own counts, and the probability of any word after a context."""
    lm = language_model
    kind = {r.doc_id: r.kind for r in rows}
    marked = {r.doc_id: [None, None, *lm.tokens_of(r.text)] for r in rows}

    def tables(kinds, some=None):
        out = [Counter(), Counter(), Counter()]
        texts = 0
        for i, t in marked.items() if some is None else [(some, marked[some])]:
            if kind[i] in kinds:
                texts += 1
                for o in range(3):
                    out[o].update(tuple(t[k - o : k + 1]) for k in range(2, len(t)))
        out[0][(None,)] = out[1][(None, None)] = texts
        return out, sum(n for (w,), n in out[0].items() if w is not None)

    def level(c):
        return min(1 + math.ceil(math.log2(c)), lm.LEVELS - 1) if c else 0

    def estimates(made, u, v, w, own=([Counter()] * 3, 0)):
        count = lambda *gram: made[0][len(gram) - 1][gram] - own[0][len(gram) - 1][gram]
        p = [count(u, v, w) / max(1, count(u, v)), count(v, w) / max(1, count(v)), count(w) / (made[1] - own[1]), float(count(w) == 0)]
        return level(count(v)) * lm.LEVELS + level(count(u, v)), p

    part, every = tables({lm.ESTIMATION}), tables({lm.ESTIMATION, lm.HELD})
    events = [estimates(part, *t[k - 2 : k + 1]) for i, t in marked.items() if kind[i] == lm.HELD for k in range(2, len(t))]
    may = lm.allowed()
    weights = may / may.sum(1, keepdims=True)
    for _ in range(lm.EM_ROUNDS):
        uses = np.zeros_like(weights)
        for b, p in events:
            joint = np.array(p) * weights[b]
            uses[b] += joint / joint.sum()
        pooled = (uses.sum(0) + 1e-3) / (uses.sum() + 4e-3)
        uses = (uses + lm.EM_PRIOR * pooled) * may
        now, weights = weights, uses / uses.sum(1, keepdims=True)
        if np.abs(weights - now).max() < lm.EM_CLOSE:
            break

    def chance(u, v, w, own=([Counter()] * 3, 0)):
        b, p = estimates(every, u, v, w, own)
        return float(weights[b] @ p)

    def score(i, t, *own):
        return sum(math.log10(chance(*t[k - 2 : k + 1], *own)) for k in range(2, len(t)))

    scores = {i: score(i, t) for i, t in marked.items()}
    alone = {i: score(i, t, tables({lm.ESTIMATION, lm.HELD}, i)) for i, t in marked.items()}
    return scores, alone, chance, [w for (w,) in every[0][0] if w is not None]


def test_language_model_equals_brute_force(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(10**6 + i, "a b a b\n A B " + "c" * (i % 3)) for i in range(60)], df.schema))
    fold = language_model.fold_of(F.col("doc_id"), 5)
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("em")), F.lit(language_model.HELD_ONE_IN)) == 0
    rows = df.withColumn("kind", F.when(fold == 1, language_model.SCORED).when(held, language_model.HELD).otherwise(language_model.ESTIMATION)).collect()
    assert len({r.kind for r in rows}) == 3
    want, alone, chance, vocabulary = brute_force_scores(rows)
    for context in ((None, None), (None, b"a"), (b"a", b"b"), (b"zz", b"a"), (b"zz", b"zz")):
        assert math.isclose(sum(chance(*context, w) for w in [*vocabulary, b"zz"]), 1, rel_tol=1e-9)  # "zz" stands for all unknown words
    small = {"BLOCK_CHARS": 20_000, "BUCKET_CHARS": 40_000, "LEAST_CHARS": 40_000}
    for limits in ({}, small, small | {"FAN": 1}):  # the last by way of nodes
        for name, value in limits.items():
            monkeypatch.setattr(language_model, name, value)
        got = language_model.score_documents(df).collect()
        assert {r.doc_id for r in got} == set(want) and all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-4) for r in got)
        assert all(math.isclose(r.deleted_score, alone[r.doc_id], rel_tol=1e-4) and math.isclose(r.per_token * r.n_tokens, r.deleted_score) for r in got)


def test_tokenise():
    import pyarrow as pa

    texts = ["One two\n\x0bONE", None, "", "x", " \t", "y\u00a0z \u00c9", "x" * 70_000]
    words, code, per = language_model.tokenise(pa.array(["no", *texts])[1:])
    known = words.to_pylist()
    split = [language_model.tokens_of(t) for t in texts]
    assert [known[i] for i in code] == [w for t in split for w in t] and per.tolist() == [len(t) for t in split] and len(set(known)) == len(known)


def test_packing():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.uint64), np.array([0]), np.array([3, 300, 70_000]), rng.integers(0, 1 << 62, 1000)):
        assert language_model.unpack(language_model.pack(a)).tolist() == a.tolist()
        s = np.sort(a).astype(np.uint64)
        assert language_model.unpack_sorted(language_model.pack_sorted(s)).tolist() == s.tolist()


def test_language_model_base(spark, docs):
    import zlib

    df = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6)
    both = df.select("doc_id", "text").unionByName(extra)
    got = language_model.score_documents(both).collect()
    rows = both.collect()
    split = {r.doc_id: language_model.tokens_of(r.text) for r in rows}
    c = Counter(w for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in language_model.tokens_of(r.text))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    base = score = 0.0
    for r in got:
        if r.doc_id is None:
            continue
        w = split[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > base


def test_language_model_empty(spark, empty):
    assert language_model.score_documents(empty).count() == 0
    alone = language_model.score_documents(spark.createDataFrame([(None, "never trained on"), (None, None)], "doc_id bigint, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in alone) == [(1, 0, 0, 0, 0, False), (4, 0, 0, 0, 0, False)]


def test_language_held_out(spark, docs, empty):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.op10_langid(spark, DATA).join(df.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    model = langid.train(df.select("text", "lang"))
    got = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    assert got[5].lang_pred == got[4].lang_pred == got[8].lang_pred == "und" and got[5].score == 0
    assert langid.predict_languages(empty, model).count() == 0
    none = langid.train(empty.select("text", "lang"))
    assert none.predict("some text")[0] == "und"


def test_mixture():
    counts = np.zeros((2, langid.SLOTS))
    a, b = "the cat sat on the mat with that hat " * 20, "der hund und die katze sind nicht da " * 20
    for i, t in enumerate((a, b)):
        counts[i] = np.bincount(langid.trigrams(t), minlength=langid.SLOTS)
    m = langid.Mixture(["en", "de"], counts)
    assert m.predict(a)[:2] == ("en", 1.0) and m.predict(b)[:2] == ("de", 1.0)
    main, share, all_of = m.predict(a + b + b)
    assert main == "de" and 0.55 < share < 0.8 and len(all_of) == 2
    assert m.predict("123 !!")[0] == "und"


def test_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "t1", 5), ("a", "en", "t1", 7), (None, "de", "t1", None)], "source string, lang string, tokenizer string, n_tokens bigint")
    table = rollup.Rollup(spark, str(tmp_path / "r"))
    assert table.totals().count() == 0
    assert table.commit("one", rollup.signed(rows, 1)) and not table.commit("one", rollup.signed(rows, 1))
    total = lambda: sorted((r.source or "", r.tokenizer, r.n_docs, r.n_tokens) for r in table.totals().collect())
    assert total() == [("", "t1", 1, 0), ("a", "t1", 2, 12)]
    changes = spark.createDataFrame([("revise", "a", "en", "t2", 6, "t1", 5), ("delete", "a", "en", "t1", 7, None, None), ("insert", "b", "en", "t2", 1, None, None)], "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokenizer string, old_n_tokens bigint")
    table.commit("two", rollup.deltas(changes))
    want = [("", "t1", 1, 0), ("a", "t2", 1, 6), ("b", "t2", 1, 1)]
    assert total() == want
    table.compact()
    assert total() == want and table.committed() == ["one", "two"] and not table.commit("two", rollup.signed(rows, 1))
    table.commit("three", rollup.signed(rows, 1))
    table.compact()
    assert sum(x[2] for x in total()) == 6


def test_rollup_query_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = sorted(map(str, c.execute(rollup.ORACLE).fetchall()))
    assert sorted(str(tuple(r)) for r in rollup.op7_rollup(spark, DATA).collect()) == want


def test_word_counts(docs):
    got = {r.doc_id: r.n for r in docs.select("doc_id", rollup.n_words(F.col("text")).alias("n")).collect()}
    assert got[1] == 23 and got[5] == 0 and got[8] == 0 and got[7] == 1


def test_work_can_be_removed(spark, docs):
    import os

    from codeloom.llm import common

    path = common.shared_folder(spark, "x").removeprefix("file:")
    assert common.written(docs.select("doc_id"), "some").count() == 11
    assert os.listdir(os.path.dirname(path))
    common.remove_work(spark)
    assert not os.path.exists(os.path.dirname(path))
