import random

import numpy as np

from codeloom.llm import neardup as N


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    """component by id, by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d, _ in sets}


def corpus(seed, groups=30, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(int(rng.random() * 0.05 * len(w))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()))
            n += 1
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = corpus(1)
    got = {r.doc_id: r for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85).collect()}
    want = plain(rows)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (want[d] == d) and r.n_shingles == len(shingles(dict(rows)[d])) for d, r in got.items())


def test_branching_and_blocks(spark, monkeypatch):
    """With tiny leaves all the deeper branches and the shared leaders are used."""
    monkeypatch.setattr(N.leaves, "__defaults__", (6, 2))
    rows = corpus(2, groups=4, copies=60)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85).collect()}
    want = plain(rows)
    assert sum(got[d] != want[d] for d in want) <= 0.02 * len(want)


def test_linked():
    a = np.arange(100, dtype=np.uint64)
    assert N.linked(a, a[:85], 85) and not N.linked(a, a[:84], 85) and N.linked(a, a[:80], 80) and N.linked(a, a, 100)


def test_components(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(50)] + [(b"z1", b"z2")]
    got = {bytes(r.node): bytes(r.root) for r in N.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert len({got[bytes([i])] for i in range(51)}) == 1 and got[b"z1"] == got[b"z2"] != got[b"\x00"]


def test_documents(docs, empty):
    rows = N.near_duplicates(docs).collect()
    got = {(r.doc_id, r.n_shingles): r for r in rows}
    assert len(rows) == 11
    assert got[2, 19].component_id == 1 and not got[2, 19].kept and got[3, 20].component_id == 1
    assert got[None, 19].component_id is None and got[None, 19].kept
    assert got[4, 0].kept and got[5, 0].component_id == 5 and got[6, 1].kept and got[8, 0].kept
    assert N.near_duplicates(empty).count() == 0
    left = N.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "1", "4", "5", "6", "7", "8", "9", "None"]


def test_pairs_in_a_template_group(spark, monkeypatch):
    """Texts of one template, each linked with one other only: a large node whose pairs are all compared."""
    monkeypatch.setattr(N.leaves, "__defaults__", (64, N.DEPTH))
    rng = random.Random(5)
    template = [f"word{rng.randrange(3000)}" for _ in range(200)]
    rows = []
    for pair in range(600):
        base = list(template)
        for at in (20, 60, 100, 101):
            base[at] = f"only{pair}at{at}"
        twin = list(base)
        for at in (165, 175, 185):
            twin[at] = f"twin{pair}at{at}"
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(twin))]
    a, b, c = (shingles(rows[i][1]) for i in (0, 1, 2))
    assert 100 * len(a & b) >= 85 * len(a | b) and 100 * len(a & c) < 85 * len(a | c)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_trees_reach_the_target():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** (N.WIDTH * N.DEPTH)) ** N.trees_for(percent) <= N.MISS
