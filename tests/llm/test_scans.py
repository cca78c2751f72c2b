"""Personal data and secrets against plain forms of their rules."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_pii(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.@.-+ ()0123456789%é\n"), max_size=80))
def test_base_pii(text):
    assert sorted(pii.base_spans(text)[0]) == plain_pii(text)


def test_base_pii_planted():
    rng = random.Random(3)
    for _ in range(200):
        parts = [rng.choice(["a.b@c.de", "1.2.3.4", "300.1.2.3", "4316522678525456", "4316 5226 7852 5456", "+1 (017) 555-7713", "+12", "word", "a@b", "1.2.3.4.5.6.7.8", "a@b.c@d.e"]) for _ in range(6)]
        text = rng.choice([" ", ",", ""]).join(parts)
        assert sorted(pii.base_spans(text)[0]) == plain_pii(text)


def field():
    import numpy as np

    return pii.Field({}, np.array([0.0, 0.0, 0.0, 0.0, 1.0]), np.array([0.0, 6.0, 2.0]))


def test_field_spreads_labels():
    text = "card 4316522678525456 then, much later, " + "word " * 100 + "4316.5226.7852.5456 and 7777.8888.9999.0001"
    base, added = pii.spans_of(text, field())
    assert [k for k, *_ in base] == [2]
    assert [text[a:b] for _, a, b in added] == ["4316.5226.7852.5456"]
    assert pii.spans_of("", field()) == ([], []) and pii.spans_of("no digits here", field()) == ([], [])


def test_marginals_match_enumeration():
    import itertools

    import numpy as np

    f = pii.Field({"u": np.array([1.0, 0.2, 0.0, 0.5, 0.1])}, np.zeros(5), np.array([0.3, 1.5, 0.7]))
    nodes, edges = [("u",), (), ("u",)], [(0, 1, 1), (1, 2, 2)]
    got = f.marginals(nodes, [-1, -1, -1], edges, rounds=200)
    want = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        e = sum(f.weights["u"][y[i]] for i in (0, 2)) + sum(f.agree[t] * (y[i] == y[j]) for i, j, t in edges)
        for i in range(3):
            want[i, y[i]] += np.exp(e)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_pii_documents(docs, empty):
    out = pii.find_pii(docs)
    assert out.count() == 11 and out.where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert pii.find_pii(empty).count() == 0


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Token", "api_key", "PASSWORD", " ", "=", ":", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "xyz-123", "é", "ſecret"]), max_size=14))
def test_base_secrets(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == plain_secrets(text)


def test_guess_cost():
    ranks = {w: 1.0 for w in ("password", "summer", "letter")}
    cost = lambda s: secrets.guesses_log10(s, ranks)
    assert cost("password") < 2 and cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("19991231") < 6 and cost("abcdefgh") < 5
    assert cost("summer1999") < 6 < cost("xK9#mQ2$vL") <= 10.5
    assert cost("P4ssword") < 4
    assert 15 < cost("g7Jw0pZx1Qe9uTb4")
    assert abs(cost("zt") - 2) < 0.5


def test_added_secrets():
    ranks = {"opensesame": 2.0}
    found = lambda t: [t[a:b] for a, _, b in secrets.added_spans(t, secrets.base_spans(t), ranks, 8.0)]
    assert found("the passphrase is 'xK9#mQ2$vLw' for all") == ["xK9#mQ2$vLw"]
    assert found("password: opensesame") == [] and found("the token ring and password rules") == [] and found("") == []
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    assert found(text) == [] and secrets.redact(text, ranks) == '<secret>" end'


def test_secret_documents(docs, empty):
    assert secrets.find_secrets(docs).where("n_assign + n_access + n_hex + n_added > 0").count() == 0
    assert secrets.find_secrets(empty).count() == 0


def test_long_secrets():
    import time

    rng = random.Random(4)
    long = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789$%&") for _ in range(800))
    for text in (f"Bearer {long} end", f"pwd: {long} end", f'pwd: "{long}" end'):
        assert long not in secrets.redact(text, {}) and secrets.redact(text, {}).replace('"', "").split()[1:][-2:] == ["<secret>", "end"]
    text = f'{{"pwd":"short1","x":{long},"pwd":"xK9#mQ2$vLw"}}'
    assert [text[a:b] for a, _, b in secrets.added_spans(text, secrets.base_spans(text), {}, 8.0)] == ["xK9#mQ2$vLw"]
    start = time.monotonic()
    assert secrets.guesses_log10("-" * 100_000, {}, 8.0) < 8 and secrets.guesses_log10("xyz" * 30_000, {}, 8.0) < 8
    assert secrets.redact("pwd: " + long * 300, {}) == "pwd: <secret>"
    assert time.monotonic() - start < 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["pass", "summer", "P4ss", "aaaa", "1234", "qwer", "abcd", "19991231", "xyxy", "K#", "7", "z"]), min_size=1, max_size=8))
def test_guess_limit(parts):
    ranks, value = {"pass": 1.0, "summer": 1.2}, "".join(parts)
    full, limited = secrets.guesses_log10(value, ranks), secrets.guesses_log10(value, ranks, 8.0)
    assert abs(limited - full) < 1e-9 if full < 8 - 1e-9 else limited >= 8 - 1e-9


def test_values_that_a_base_span_covers_in_part():
    for value in ("Abcdef123456!Kq#77$zz", "Xy9!0123456789abcdef#Q7z"):
        for text in (f"password={value} end", f"pwd={value} end"):
            assert secrets.base_spans(text) or "Abcdef" in text
            assert secrets.redact(text, {}).removeprefix("password=").removeprefix("pwd=") == "<secret> end"


def test_ranks_count_every_document(spark):
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(12_000)]
    rows = [(i, w) for i, w in enumerate(words)] + [(len(words), "often often")]
    ranks = secrets.train_ranks(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert set(words) <= set(ranks) and ranks["often"] < min(ranks[w] for w in words if w not in secrets.COMMON)
    few = secrets.train_ranks(spark.createDataFrame([(0, "top top top top mid mid mid low low one two six")], "doc_id bigint, text string"), max_words=4)
    assert sorted(set(few) - set(secrets.COMMON)) == ["low", "mid", "top"] and few["top"] < few["mid"] < few["low"]  # the words that occur once would be too many
    assert set(secrets.train_ranks(spark.createDataFrame([(0, None)], "doc_id bigint, text string"))) == set(secrets.COMMON)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="12", min_size=8, max_size=9), max_size=30))
def test_similar_keys_are_connected(keys):
    """Every two keys that differ in one character are joined by skip edges, however many others are like them."""
    edges = pii.similar_edges(keys)
    alike = lambda x, y: len(x) == len(y) and sum(p != q for p, q in zip(x, y)) <= 1
    tail = lambda x, y: min(len(x), len(y)) >= 8 and (x.endswith(y) or y.endswith(x))
    assert all(alike(keys[i], keys[j]) or tail(keys[i], keys[j]) or len(keys[i]) != len(keys[j]) or keys[i][1:] == keys[j][1:] for i, j, _ in edges)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j, _ in edges:
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i in range(len(keys)) for j in range(i) if alike(keys[i], keys[j]) or tail(keys[i], keys[j]))


def test_similar_key_behind_another():
    assert (0, 2, 2) in pii.similar_edges(["12345678", "12340000", "12345679"])
    assert (0, 1, 2) in pii.similar_edges(["15550177130", "5550177130"])
