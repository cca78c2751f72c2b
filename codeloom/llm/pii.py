"""Personal data: four pattern kinds, and a skip-chain conditional random field over the candidates of a document.

Candidates are the base matches and the same things in looser forms (other
separators, no leading plus, "at" and "dot" spelled out).  Node potentials come
from a softmax regression trained here: base-form candidates of a bounded,
documented sample of documents, labelled by whether the base keeps them.  Chain
edges join neighbouring candidates; skip edges join candidates with the same or a
similar key, however far apart, in chains per key, so their number is linear in
the candidates.  The skip weights are log odds of label agreement, counted on the
same sample.  Loopy sum-product passing gives marginals; a loose candidate gets
the kind whose marginal reaches `min_marginal`.  Base spans always stay.

Null and empty texts: no spans.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import chunks, hash_share, map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "other")
OTHER = len(KINDS)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[({<]\x20?(?:at|AT)\x20?[\])}>]|\x20(?:dot|DOT)\x20")
LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])[(+]?[0-9](?:[ ()./_,:-]{0,2}[0-9]){6,}+")
AT = r"(?:@|\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]+\x20(?:dot|DOT)\x20))"
DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
LOOSE_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}")
LOOSE_HINT = re.compile(r"[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]|\x20(?:dot|DOT)\x20")
#: Words shortly before a candidate that hint at a kind.
HINTS = {
    "email": ("mail", "contact", "e-mail", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "teléfono"),
}
SAMPLE_DOCS = 20_000
PRIME, BASE = (1 << 89) - 1, 0x9E3779B97F4A7C15F39CC060  # of the hashes of keys


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern in linear time: each @ takes the longest run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base spans, and of base-form matches that their check drops."""
    kept, dropped = [(0, a, b) for a, b in emails(text)], []
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            if kind == 1:
                good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
            else:
                n = digits_of(m[0])
                good = (13 <= len(n) <= 19 and luhn(n)) if kind == 2 else 9 <= len(n) <= 15
                if not good and len(n) < 7:
                    continue
            (kept if good else dropped).append((kind, *m.span()))
    return kept, dropped


def key_of(s: str) -> str:
    """What makes two candidates the same thing: digits only, or the plain address."""
    local, found, domain = (re.split(f"({AT})", s, maxsplit=1) + ["", ""])[:3]
    if found:
        return f"{local}@{re.sub(DOT, '.', domain)}".lower()
    return digits_of(s)


def features(text: str, start: int, end: int, key: str) -> tuple[str, ...]:
    """Discrete features that do not depend on which pattern found the candidate."""
    if "@" in key:
        shape = ("address", "dotted" if "." in key.rpartition("@")[2] else "undotted")
    else:
        body = text[start:end]
        parts = re.findall(r"[0-9]+", body)
        n = len(key)
        shape = (
            f"digits:{n if n < 21 else '21+'}", f"luhn:{luhn(key)}",
            f"quad:{len(parts) == 4 and body.count('.') == 3 and all(len(p) < 5 and int(p) < 256 for p in parts)}",
            f"paren:{'(' in body}", f"plus:{body.startswith('+')}", f"parts:{min(len(parts), 5)}",
        )
    before = text[max(0, start - 32) : start].lower()
    return (*shape, *(f"near:{k}" for k, ws in HINTS.items() if any(w in before for w in ws)))


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, label, form): form 0 base, 1 loose (label -1), 2 a base form that its check dropped (label "other", for training)."""
    kept, dropped = base_spans(text)
    out = [(a, b, k, 0) for k, a, b in kept]
    taken = sorted((a, b) for _, a, b in kept)
    starts = [a for a, _ in taken]
    furthest = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b))
        return i == 0 or furthest[i - 1] <= a

    seen = set()
    for k, a, b in dropped:
        if free(a, b) and (a, b) not in seen:
            seen.add((a, b))
            out.append((a, b, OTHER, 2))
    for m in [*LOOSE_NUMBER.finditer(text), *(LOOSE_EMAIL.finditer(text) if LOOSE_HINT.search(text) else ())]:
        if m.span() not in seen and free(*m.span()):
            out.append((*m.span(), -1, 1))
    return sorted(out)


def similar_edges(keys: list[str]) -> list[tuple[int, int, int]]:
    """(i, j, 1 same key / 2 one changed character) / with and without a country code, in chains: keys equal, equal but for one position, or one the other's tail."""
    edges, groups = set(), defaultdict(list)
    for i, k in enumerate(keys):
        groups["=", k].append(i)
    firsts = [g[0] for g in groups.values()]
    for (_, _k), g in groups.items():
        edges.update((a, b, 1) for a, b in zip(g, g[1:]))
    blanked = defaultdict(list)
    for i in firsts:
        k = keys[i]
        if len(k) >= 8:
            for name in one_left_out(k):
                blanked[name].append(i)
    for g in blanked.values():  # all members of a group differ in that one position only
        edges.update((min(a, b), max(a, b), 2) for a, b in zip(g, g[1:]))
    whole = {keys[i]: i for i in firsts}
    tails = defaultdict(list)
    for k, i in whole.items():
        if k.isdigit():
            for cut in range(1, min(3, len(k) - 8) + 1):  # a country code of one to three digits
                tails[k[cut:]].append(i)
    for k, g in tails.items():
        if k in whole:
            chain = sorted({whole[k], *g})
            edges.update((a, b, 2) for a, b in zip(chain, chain[1:]))
    return sorted(edges)


def one_left_out(key: str) -> list[tuple[int, int, int]]:
    """(length, position, hash of the rest) for each position of the key, in time linear in its length."""
    ahead = [0]
    for c in key:
        ahead.append((ahead[-1] * BASE + ord(c) + 1) % PRIME)
    out, behind, power = [], 0, 1
    for i in range(len(key) - 1, -1, -1):
        out.append((len(key), i, (ahead[i] * power * BASE + behind) % PRIME))
        behind = (behind + (ord(key[i]) + 1) * power) % PRIME
        power = power * BASE % PRIME
    return out


class Field:
    """Weights of the field: features x labels, and label agreement for chain (0), same-key (1) and similar-key (2) edges."""

    def __init__(self, weights: dict[str, np.ndarray], bias: np.ndarray, agree: np.ndarray):
        self.weights, self.bias, self.agree = weights, bias, agree

    def marginals(self, nodes: list[tuple[str, ...]], labels: list[int], edges: list[tuple[int, int, int]], rounds: int = 30) -> np.ndarray:
        m, k = len(nodes), len(LABELS)
        unary = np.array([self.bias + sum((self.weights[f] for f in set(fs) if f in self.weights), np.zeros(k)) for fs in nodes])
        for i, y in enumerate(labels):  # the base has decided these
            if y >= 0:
                unary[i] = -30.0
                unary[i, y] = 0.0
        if edges:
            e = np.array(edges)
            src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            gain = np.concatenate([self.agree[e[:, 2]]] * 2)[:, None]
            back = np.concatenate([np.arange(len(e), 2 * len(e)), np.arange(len(e))])
            msg = np.zeros((2 * len(e), k))
            for _ in range(rounds):
                total = unary.copy()
                np.add.at(total, dst, msg)
                cavity = total[src] - msg[back]
                top = cavity.max(1, keepdims=True)
                p = np.exp(cavity - top)
                new = np.log(p.sum(1, keepdims=True) + p * np.expm1(gain))
                new -= new.max(1, keepdims=True)
                done = np.abs(new - msg).max() < 1e-4
                msg = 0.5 * msg + 0.5 * new
                if done:
                    break
            np.add.at(unary, dst, msg)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def graph(text: str, found: list[tuple[int, int, int, int]]) -> tuple[list[tuple[str, ...]], list[tuple[int, int, int]]]:
    keys = [key_of(text[a:b]) for a, b, _, _ in found]
    chain = [(i, i + 1, 0) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] < 80]
    return [features(text, a, b, k) for (a, b, _, _), k in zip(found, keys)], chain + similar_edges(keys)


def spans_of(text: str, field: Field, min_marginal: float = 0.9) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans, (kind, start, end), each sorted."""
    if not ANY.search(text):
        return [], []
    found = candidates(text)
    base = sorted((y, a, b) for a, b, y, form in found if form == 0)
    if not any(form for *_, form in found):
        return base, []
    nodes, edges = graph(text, found)
    p = field.marginals(nodes, [y if form == 0 else -1 for *_, y, form in found], edges)
    added = []
    for (a, b, _, form), q in zip(found, p):
        allowed = q[:1] if "@" in key_of(text[a:b]) else np.append(0.0, q[1:OTHER])  # an address is no number
        best = int(allowed.argmax())
        if form and allowed[best] >= min_marginal:
            added.append((best, a, b))
    return base, sorted(added)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fits the field on about `sample_docs` documents, picked by a hash of id and text; their statistics are counts of discrete features."""
    share = sample_docs / max(1, docs.count())
    cut = hash_share(share, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for _, texts in chunks(batches):
            for text in texts:
                if not ANY.search(text):
                    continue
                found = candidates(text)
                nodes, edges = graph(text, found)
                tally.update(("n", "|".join(fs), y) for fs, (*_, y, form) in zip(nodes, found) if form != 1)
                tally.update(("e", str(t), int(found[i][2] == found[j][2])) for i, j, t in edges if found[i][3] != 1 and found[j][3] != 1)
        yield pa.RecordBatch.from_pydict({"what": [k[0] for k in tally], "features": [k[1] for k in tally], "label": [k[2] for k in tally], "n": list(tally.values())}, pa.schema([("what", pa.string()), ("features", pa.string()), ("label", pa.int32()), ("n", pa.int64())]))

    counted = docs.where(cut).select("text").mapInArrow(run, "what string, features string, label int, n bigint").groupBy("what", "features", "label").agg(F.sum("n").alias("n")).collect()
    rows = sorted((r.features.split("|"), r.label, r.n) for r in counted if r.what == "n")
    agree, total = np.ones(3), np.full(3, 2.0)
    for r in counted:
        if r.what == "e":
            agree[int(r.features)] += r.n * r.label
            total[int(r.features)] += r.n
    odds = np.clip(np.log(agree / np.maximum(total - agree, 1.0)), 0.0, 6.0)
    odds[0] = min(odds[0], 1.0)  # neighbours only lean on each other
    k = len(LABELS)
    names = sorted({f for fs, _, _ in rows for f in fs})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    y = np.zeros((len(rows), k))
    n = np.array([r[2] for r in rows], float)
    for i, (fs, label, _) in enumerate(rows):
        x[i, [at[f] for f in fs]] = 1
        x[i, -1] = 1
        y[i, label] = 1
    w = np.zeros((len(names) + 1, k))
    if len(rows):
        n = n / n.sum()
        for _ in range(400):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w += 4.0 * (x.T @ ((y - p) * n[:, None]) - 1e-3 * w)
    else:
        w[-1, OTHER] = 3.0  # nothing seen: lean to "other"
    return Field({f: w[i] for f, i in at.items()}, w[-1], odds)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, field: Field | None = None, min_marginal: float = 0.9) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans joined, how many the field added, and how many there are."""
    field = field or train(docs)

    def fn(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans")}
        for text in texts:
            base, added = spans_of(text, field, min_marginal)
            per = Counter(k for k, _, _ in base)
            for i, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(per[i])
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + added))
            out["n_added"].append(len(added))
            out["n_spans"].append(len(base) + len(added))
        return out

    return map_texts(docs, fn, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
