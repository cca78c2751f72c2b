import random

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import decontamination as D


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


words = st.lists(st.sampled_from("abcd"), max_size=20)


@settings(max_examples=300, deadline=None)
@given(words.filter(bool), words)
def test_myers(pattern, text):
    assert D.myers(D.masks(pattern), len(pattern), text)[0] == least_distance(pattern, text)


def test_finds_all_within_budget():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40)))) for i in range(30)]
    m = D.Matcher(items)
    for _ in range(120):
        i, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.randint(0, len(w) // 3)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["odd"], [w[k], "odd"]])
            w = w or ["odd"]
        doc = [rng.choice(vocabulary) for _ in range(50)] + w + [rng.choice(vocabulary) for _ in range(50)]
        found = {a: d for a, d, _, _ in m.matches(" ".join(doc))}
        for j, other in items:
            d = least_distance(other.split(), doc)
            if d <= int(0.2 * len(other.split())):
                assert found[j] == d
            else:
                assert j not in found


def test_short_items_and_punctuation():
    m = D.Matcher([(1, "Just three words"), (2, None), (3, "")])
    assert [x[0] for x in m.matches("just, THREE words!")] == [1] and m.matches("just three words more") == [] and m.matches("") == []


def test_documents(spark, docs, empty):
    items = spark.createDataFrame([(1, "the QUICK brown fox, jumps over the lazy dog while seven wizards"), (2, None), (None, "x")], "item_id int, text string")
    assert sorted(r.doc_id or 0 for r in D.find_leaks(docs, items).collect()) == [0, 1, 1, 2, 3]
    assert D.clean_rows(docs, items).count() == 6 and D.clean_rows(docs, items).columns == docs.columns
    assert D.find_leaks(docs, items.where("1 = 0")).count() == 0 and D.find_leaks(empty, items).count() == 0
    assert len(list(D.item_blocks(items, block_words=1))) >= 1
