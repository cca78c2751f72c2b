"""Language-model scores by deleted interpolation of word trigrams.

P(w | u, v) = a * c(u, v, w) / c(u, v) + b * c(v, w) / c(v) + c * c(w) / N for words of
the vocabulary, and d for all others as one unknown token: the same events as those of
the base score.  Counts are of every n-gram of all training documents.  The weights
depend on the frequency buckets of both contexts, c(u, v) and c(v), and come from
expectation-maximisation on held-out counts: a twentieth of the training documents is
set aside for them, and the estimates they meet are of the others; final counts are of
all training documents.  A text is its words and one end; before it stand two marks.

`score` is the probability under all counts.  `deleted_score` leaves the document's own
counts out, so that training documents are measured like unseen ones, and one that
occurs again elsewhere stands out; for documents that were not learned from, both are equal.

Documents are read into blocks, each of one kind (estimation, held-out, scored only),
and kept as packed word numbers.  A block asks each bucket of hash values once for the
words and n-grams it holds, packed and sorted, and gets packed counts back.  So
the text is read once and never shuffled, a shuffled entry is a distinct n-gram of
a block, and no word or context makes a hot key: n-grams are dealt by their own hash,
not by their context's.  Above `FAN` buckets (about 30 GB of text) the requests go
through nodes, two levels of sqrt(buckets) each, so a row holds about a thousand
entries at 100 TB too.

Words are compared as they are.  N-grams are told apart by hashes with `SPARE_BITS` more
bits than the number of characters has, so an unseen one is taken for another with a
probability of about 4e-6, the same at any size up to 70 TB (62 bits at most).

Null and empty texts consist of the end alone.  Null ids: scored, never trained on.
Rows that repeat an id count each time.  Without training tokens every word is unknown.
A repeated task must see the same rows in the same order, as with tables in files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import cuts, fold_of, mix, written

ORDER = 3
BLOCK_CHARS, BUCKET_CHARS, LEAST_CHARS = 8_000_000, 8_000_000, 1_000_000
SPARE_BITS, SLICE, ROWS, FAN = 16, 1 << 18, 16, 4096
ESTIMATION, HELD, SCORED = 0, 1, 2
HELD_ONE_IN = 20
EM_ROUNDS, EM_CLOSE, EM_PRIOR = 15, 2e-3, 1.0
LEVELS = 12
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
with np.errstate(over="ignore"):
    FACTORS = mix(np.arange(501, 501 + ORDER, dtype=np.uint64)) | np.uint64(1)
BEFORE = mix(np.array([77], np.uint64))[0]


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them, compressed byte plane by byte plane."""
    if not len(numbers):
        return b""
    least = numbers.astype(np.min_scalar_type(int(numbers.max())))
    return bytes([least.itemsize]) + squeeze(least.view(np.uint8).reshape(len(least), -1).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    return np.ascontiguousarray(np.frombuffer(expand(blob[1:]), np.uint8).reshape(width, -1).T).view(f"u{width}").ravel()


def pack_sorted(hashes: np.ndarray) -> bytes:
    return pack(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def strings(lengths: np.ndarray, body: bytes) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def pack_strings(words: pa.Array) -> list[bytes]:
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    return [pack(lengths), squeeze(b"".join(words.to_pylist()))]


def tokenise(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words; the number of each token's word; tokens of each text), the end being the empty word."""
    col = pc.fill_null(texts, "").cast(pa.large_binary())
    edges = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    low = np.frombuffer(data[int(edges[0]) : int(edges[-1])].to_pybytes().lower(), np.uint8) if data else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    inside = ~SPACE[low]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < len(low)]
    start[first] = inside[first]  # a text begins a word, whatever stood before it
    lengths = np.diff(np.append(np.flatnonzero(start[inside]), inside.sum()))
    words = strings(lengths, low[inside].tobytes()).dictionary_encode()
    per = np.diff(np.searchsorted(np.flatnonzero(start), edges)) + 1
    ends = np.cumsum(per) - 1
    code = np.full(len(lengths) + len(per), len(words.dictionary), np.int32)
    word = np.ones(len(code), bool)
    word[ends] = False
    code[word] = words.indices.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([words.dictionary, pa.array([b""], pa.binary())]), code, per


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def word_hashes(words: pa.Array, bits: int) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words)) >> np.uint64(64 - bits)


def shifted(values: np.ndarray, first: np.ndarray, before) -> np.ndarray:
    """The value at the token before each; at the first token of a text, `before`."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = before
    return out


def grams(token_hash: np.ndarray, first: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For orders two and up, the hash of the n-gram that ends at each token."""
    gram = previous = token_hash
    with np.errstate(over="ignore"):
        for o in range(1, ORDER):
            previous = shifted(previous, first, BEFORE)
            gram = mix(previous * FACTORS[o] + gram)
            yield gram >> np.uint64(64 - bits)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, how often each occurs)."""
    values = np.sort(values)
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[at], np.diff(np.append(at, len(values)))


def spread(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each value what was found for it; found: by sorted distinct values."""
    order = np.argsort(values)
    out = np.empty(len(values), found.dtype)
    values = values[order]
    out[order] = found[np.cumsum(np.append(False, values[1:] != values[:-1]))]
    return out


def times(values: np.ndarray) -> np.ndarray:
    """For each value how often it occurs."""
    order = np.argsort(values)
    ordered = values[order]
    group = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    out = np.empty(len(values), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def ddl(id_type: str) -> str:
    """Rows of the exchange: to a bucket or node (key >= 0), or things kept (key < 0), with packed parts; stats as in answer()."""
    return f"key bigint, block bigint, kind int, ids array<{id_type}>, parts array<binary>, stats array<bigint>"


def batch_of(rows: list[tuple], id_type: pa.DataType) -> dict:
    """rows of (key, block, kind, ids, parts[, stats]) as columns."""
    kinds = {"key": pa.int64(), "block": pa.int64(), "kind": pa.int32(), "ids": pa.list_(id_type), "parts": pa.list_(pa.binary()), "stats": pa.list_(pa.int64())}
    full = [(*r, None)[:6] for r in rows]
    return {"arrays": [pa.array(c, t) for c, t in zip(zip(*full) if full else [()] * len(kinds), kinds.values())], "names": list(kinds)}


def edges_of(buckets: int, bits: int) -> list[int]:
    return [((i << bits) + buckets - 1) // buckets for i in range(buckets + 1)]


def request_parts(words: pa.Array, tables: list[tuple], edges: list[int]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the bucket, packed request) of the buckets that have to do with these words and n-grams.

    tables: by order (sorted hashes, counts in the estimation part, in the held-out part), None for counts of zero.
    """
    spans = [np.searchsorted(keys, np.array(edges, np.uint64)) for keys, _, _ in tables]
    for k in range(len(edges) - 1):
        if all(s[k] == s[k + 1] for s in spans):
            continue
        parts = pack_strings(words[spans[0][k] : spans[0][k + 1]])
        for o, ((keys, *counts), s) in enumerate(zip(tables, spans)):
            a, b = s[k : k + 2]
            parts += [pack_sorted(keys[a:b])] if o else []
            parts += [b"" if n is None else pack(n[a:b]) for n in counts]
        yield k, parts


def block_rows(ids: pa.Array, texts: pa.Array, kind: int, block: int, buckets: int, bits: int) -> list[tuple]:
    """The documents of a block as one row, and one request row for each bucket that has to do with it."""
    words, code, per = tokenise(texts)
    hashes, uses = word_hashes(words, bits), np.bincount(code, minlength=len(words))
    common = np.lexsort((hashes, -uses))  # small numbers for common words, and sorted runs of hashes: both pack well
    rank = np.empty(len(common), np.int32)
    rank[common] = np.arange(len(common))
    rows = [(-1 - block, block, kind, ids.to_pylist(), [pack(per), pack(rank[code]), pack_sorted(hashes[common])])]
    order = common[np.argsort(hashes[common], kind="stable")]  # as the block will see them, equal hashes too
    found = [(hashes[order], uses[order]), *map(distinct, grams(hashes[code], np.cumsum(per) - per, bits))]
    tables = [(keys, n if kind == ESTIMATION else None, n if kind == HELD else None) for keys, n in found]
    return rows + [(k, block, kind, None, parts) for k, parts in request_parts(words.take(pa.array(order)), tables, edges_of(buckets, bits))]


def requests(src: DataFrame, buckets: int, bits: int) -> DataFrame:
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = map(((TaskContext.get().partitionId()) << 24).__add__, count())
        waiting: dict[int, list] = {ESTIMATION: [], HELD: [], SCORED: []}
        sizes = dict.fromkeys(waiting, 0)

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            ids, texts = (pa.concat_arrays([b.column(c) for b in waiting[kind]]) for c in ("doc_id", "text"))
            waiting[kind], sizes[kind] = [], 0
            rows = block_rows(ids, texts, kind, next(number), buckets, bits)
            for a in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays(**batch_of(rows[a : a + ROWS], ids.type))

        for cut in cuts(batches):
            for kind in waiting:
                some = cut.filter(pc.equal(cut.column("kind"), kind))
                if some.num_rows:
                    waiting[kind].append(some)
                    sizes[kind] += pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                    if sizes[kind] >= BLOCK_CHARS:
                        yield from flush(kind)
        for kind in waiting:
            if waiting[kind]:
                yield from flush(kind)

    return src.select("doc_id", "text", "kind").mapInArrow(run, ddl(id_type))


class Asked:
    """Requests put together: by order the distinct entries, their counts, and the places of each request's entries among them."""

    def __init__(self, requests: list[list[bytes]]):
        self.known, self.at, self.est, self.held = [], [], [], []
        for o in range(ORDER):
            if o == 0:
                lists = [strings(unpack(p[0]), expand(p[1])) for p in requests]
                coded = pa.concat_arrays(lists).dictionary_encode()
                known, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            else:
                lists = [unpack_sorted(p[1 + 3 * o]) for p in requests]
                known, at = np.unique(np.concatenate(lists), return_inverse=True)
            ends = np.cumsum([0, *map(len, lists)])
            places = [at[a:b] for a, b in zip(ends, ends[1:])]
            counts = np.zeros((2, len(known)), np.int64)
            for place, p in zip(places, requests):
                for total, blob in zip(counts, p[2 + 3 * o : 4 + 3 * o]):
                    if blob:
                        total[place] += unpack(blob).astype(np.int64)  # an entry is there once in a request
            self.known.append(known)
            self.at.append(places)
            self.est.append(counts[0])
            self.held.append(counts[1])


def reply(both: list[np.ndarray], held: list[np.ndarray], places: list[np.ndarray], kind: int) -> list[bytes]:
    """Counts of all training documents at these places; for held-out blocks also those of the held-out part."""
    return [pack(n[at]) for n, at in zip(both, places)] + ([pack(n[at]) for n, at in zip(held, places)] if kind == HELD else [])


def answer(table: pa.Table) -> pa.Table:
    """A reply for each request of a bucket; rows that are kept stay as they are.

    Each bucket adds one row with stats: tokens and ends in the estimation part and in both, and distinct words in both.
    """
    key = table.column("key")[0].as_py()
    if key < 0:
        return table
    blocks, kinds, requests = (table.column(c).to_pylist() for c in ("block", "kind", "parts"))
    asked = Asked(requests)
    both = [e + h for e, h in zip(asked.est, asked.held)]
    rows = [(key, b, kind, None, reply(both, asked.held, [at[i] for at in asked.at], kind)) for i, (b, kind) in enumerate(zip(blocks, kinds))]
    end = pc.index(asked.known[0], pa.scalar(b"", pa.binary())).as_py()
    ends = [int(n[end]) if end >= 0 else 0 for n in (asked.est[0], both[0])]
    rows.append((key, None, None, None, None, [int(asked.est[0].sum()), int(both[0].sum()), *ends, int((both[0] > 0).sum())]))
    return pa.Table.from_arrays(**batch_of(rows, table.schema.field("ids").type.value_type))


def merge(side: int, bits: int):
    """Puts the requests of many blocks to one coarse bucket together into requests to fine ones; keeps what leads back to the blocks."""
    edges = edges_of(side * side, bits)

    def run(table: pa.Table) -> pa.Table:
        node = table.column("key")[0].as_py()
        if node < 0:
            return table
        blocks, kinds, requests = (table.column(c).to_pylist() for c in ("block", "kind", "parts"))
        asked = Asked(requests)
        hashes = word_hashes(asked.known[0], bits)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tables = [(hashes[order], asked.est[0][order], asked.held[0][order]), *zip(asked.known[1:], asked.est[1:], asked.held[1:])]
        first = node // side * side
        rows = [(first + k, node, HELD, None, parts) for k, parts in request_parts(asked.known[0].take(pa.array(order)), tables, edges[first : first + side + 1])]
        for i, (block, kind) in enumerate(zip(blocks, kinds)):
            rows.append((-1 - block, node, kind, None, [pack(rank[asked.at[0][i]]), *(pack(at[i]) for at in asked.at[1:])]))
        return pa.Table.from_arrays(**batch_of(rows, table.schema.field("ids").type.value_type))

    return run


def give_back(table: pa.Table) -> pa.Table:
    """The replies to a node, as replies to its blocks."""
    rows = table.take(pc.sort_indices(table.column("key")))
    keys, kinds, parts = (rows.column(c).to_pylist() for c in ("key", "kind", "parts"))
    kept = sum(k < 0 for k in keys)
    both, held = ([np.concatenate([unpack(p[o + skip]).astype(np.int64) for p in parts[kept:]]) for o in range(ORDER)] for skip in (0, ORDER))
    node = table.column("block")[0].as_py()
    out = [(node, -1 - k, kind, None, reply(both, held, [unpack(x).astype(np.int64) for x in p], kind)) for k, kind, p in zip(keys[:kept], kinds, parts)]
    return pa.Table.from_arrays(**batch_of(out, table.schema.field("ids").type.value_type))


def exchange(src: DataFrame, buckets: int, bits: int) -> tuple[DataFrame, list[int]]:
    """(rows of the blocks: their documents, and the counts of what they hold; sums of the stats).

    With very many buckets a block would send each next to nothing.  Then it asks one of sqrt(buckets)
    coarse ones, where nodes put together what many blocks ask and ask the fine ones.
    """
    tasks = 2 * buckets  # by the size of the input, so that a task holds few buckets or blocks at any size
    if buckets <= FAN:
        sent = requests(src, buckets, bits)
        found = answered = written(sent.repartition(tasks, "key").groupBy("key").applyInArrow(answer, sent.schema), "counts")
    else:
        side = math.isqrt(buckets - 1) + 1
        sent = requests(src, side, bits)
        node = F.when(F.col("key") >= 0, F.col("key") * side + F.pmod(F.xxhash64("block"), F.lit(side))).otherwise(F.col("key"))
        merged = written(sent.withColumn("key", node).repartition(tasks, "key").groupBy("key").applyInArrow(merge(side, bits), sent.schema), "merged")
        fine = merged.where("key >= 0").repartition(tasks, "key").groupBy("key").applyInArrow(answer, sent.schema)
        answered = written(fine, "answers")
        back = answered.where("block is not null").unionByName(merged.where("key < 0 and ids is null"))
        back = back.repartition(tasks, "block").groupBy("block").applyInArrow(give_back, sent.schema)
        found = merged.where("ids is not null").unionByName(written(back, "counts"))
    stats = answered.where("stats is not null").agg(*(F.sum(F.col("stats")[i]) for i in range(5))).first()
    return found.where("block is not null").repartition(tasks, "block"), [x or 0 for x in stats]


class Block:
    """A block's documents with the counts of their tokens and n-grams: ids, tokens of each text, counts by order."""

    def __init__(self, table: pa.Table, bits: int, estimation: bool = False, own: bool = False):
        rows = table.select(["key", "parts"]).take(pc.sort_indices(table.column("key"))).column("parts").to_pylist()
        at = pc.index(pc.less(table.column("key"), 0), True).as_py()
        self.ids, self.kind = table.column("ids").combine_chunks()[at].values, table.column("kind")[at].as_py()
        self.per, code, hashes = unpack(rows[0][0]).astype(np.int64), unpack(rows[0][1]), unpack_sorted(rows[0][2])
        self.first = np.cumsum(self.per) - self.per
        total = lambda part: np.concatenate([unpack(p[part]).astype(np.int64) for p in rows[1:]])
        replies = [total(o) - (total(ORDER + o) if estimation else 0) for o in range(ORDER)]
        of_word = np.empty(len(hashes), np.int64)
        of_word[np.argsort(hashes, kind="stable")] = replies[0]
        self.counts, self.own = [of_word[code]], []
        salt = np.repeat(mix(np.arange(len(self.per), dtype=np.uint64)), self.per)
        with np.errstate(over="ignore"):
            self.own += [times(mix(code + salt))] if own else []
            for gram, reply in zip(grams(hashes[code], self.first, bits), replies[1:]):
                self.counts.append(spread(gram, reply))
                self.own += [times(mix(gram + salt))] if own else []

    def without_own(self) -> None:
        """Takes from the counts what the document itself gave to them."""
        self.counts = [c - o for c, o in zip(self.counts, self.own)]

    def estimates(self, tokens: int | np.ndarray, texts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By slices of tokens (maximum-likelihood estimates, longest first, then 1 for an unknown word; bucket of the contexts)."""
        contexts = [shifted(c, self.first, texts) for c in self.counts[:-1]]
        tokens = np.broadcast_to(tokens, len(self.counts[0]))
        for a in range(0, len(self.counts[0]), SLICE):
            counts, before = [c[a : a + SLICE] for c in self.counts], [c[a : a + SLICE] for c in contexts]
            p = np.empty((len(counts[0]), ORDER + 1))
            for o in range(1, ORDER):
                p[:, ORDER - 1 - o] = counts[o] / np.maximum(before[o - 1], 1)
            p[:, ORDER - 1] = counts[0] / np.maximum(tokens[a : a + SLICE], 1)
            p[:, ORDER] = counts[0] == 0
            bucket = np.zeros(len(p), np.int64)
            for c in before:
                bucket = bucket * LEVELS + level(c)
            yield p, bucket

    def by_text(self, values: np.ndarray) -> pa.Array:
        return pa.array(np.add.reduceat(values, self.first))


def level(counts: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0, 1, 2, 3-4, 5-8, and so on."""
    return np.where(counts > 0, np.minimum(1 + np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), LEVELS - 1), 0)


def allowed() -> np.ndarray:
    """Which estimates each bucket may use: none of a context that was never seen."""
    out = np.ones((LEVELS ** (ORDER - 1), ORDER + 1))
    rest = np.arange(len(out))
    for o in range(ORDER - 1, 0, -1):
        out[rest % LEVELS == 0, ORDER - 1 - o] = 0
        rest = rest // LEVELS
    return out


def maximise(events: DataFrame) -> np.ndarray:
    """Mixture weights by bucket (rows of 1), from expectation-maximisation on rows of packed events; one sum for each weight comes back.

    A bucket with few events leans on the weights of all buckets, by EM_PRIOR events.
    """
    may = allowed()
    weights = may / may.sum(1, keepdims=True)
    for _ in range(EM_ROUNDS):
        now = weights

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            uses = np.zeros_like(now)
            for batch in batches:
                for p, bucket in zip(batch.column("p").to_pylist(), batch.column("bucket").to_pylist()):
                    at = unpack(bucket).astype(np.int64)
                    joint = np.frombuffer(expand(p), np.float32).reshape(-1, ORDER + 1) * now[at]
                    share = joint / np.maximum(joint.sum(1), 1e-300)[:, None]
                    for k in range(ORDER + 1):
                        uses[:, k] += np.bincount(at, share[:, k], len(now))
            cells = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(uses.ravel()[cells])], names=["cell", "uses"])

        uses = np.zeros(now.size)
        for cell, total in events.mapInArrow(step, "cell bigint, uses double").groupBy("cell").agg(F.sum("uses")).collect():
            uses[cell] = total
        uses = uses.reshape(now.shape)
        pooled = (uses.sum(0) + 1e-3) / (uses.sum() + 1e-3 * (ORDER + 1))
        uses = (uses + EM_PRIOR * pooled) * may
        weights = uses / uses.sum(1, keepdims=True)
        if np.abs(weights - now).max() < EM_CLOSE:
            break
    return weights


def score_documents(docs: DataFrame, folds: int = 5, held_out_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, deleted_score, per_token (deleted_score by token): one row per document."""
    fold = fold_of(F.col("doc_id"), folds)
    chars = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, math.ceil(chars / BUCKET_CHARS), min(8 * cores, math.ceil(chars / LEAST_CHARS)))  # small inputs still use all cores
    bits = min(62, max(chars, 1).bit_length() + SPARE_BITS)
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("em")), F.lit(HELD_ONE_IN)) == 0
    kind = F.when(fold.isNull() | (fold == held_out_fold), SCORED).when(held, HELD).otherwise(ESTIMATION)
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), kind.cast("int").alias("kind"))
    blocks, (n_est, n, texts_est, texts, v) = exchange(src, buckets, bits)

    def events(table: pa.Table) -> pa.Table:
        rows = [(squeeze(p.astype(np.float32).tobytes()), pack(bucket)) for p, bucket in Block(table, bits, estimation=True).estimates(n_est, texts_est)]
        return pa.table([pa.array(c, pa.binary()) for c in zip(*rows)], names=["p", "bucket"])

    weights = maximise(written(blocks.where(F.col("kind") == HELD).groupBy("block").applyInArrow(events, "p binary, bucket binary"), "events"))
    if not n:
        weights = np.eye(ORDER + 1)[np.full(len(weights), ORDER)]

    def score(table: pa.Table) -> pa.Table:
        learned = table.column("kind")[0].as_py() != SCORED
        block = Block(table, bits, own=learned)
        base = block.by_text(np.log10((block.counts[0] + 0.5) / (n + 0.5 * (v + 1))))
        chance = lambda tokens, texts: block.by_text(np.concatenate([np.log10((p * weights[bucket]).sum(1)) for p, bucket in block.estimates(tokens, texts)]))
        total = chance(n, texts)
        known = block.by_text((block.counts[0] > 0).astype(np.int64))
        alone = total
        if learned:
            block.without_own()
            alone = chance(n - np.repeat(block.per, block.per), texts - 1)
        held_out = pc.and_(pc.is_valid(block.ids), block.kind == SCORED)
        return pa.table(
            [block.ids, held_out, pa.array(block.per), known, pa.array([n] * len(block.per), pa.int64()), base, total, alone, pc.divide(alone, block.per)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "deleted_score", "per_token"],
        )

    id_type = src.schema["doc_id"].dataType.simpleString()
    return blocks.groupBy("block").applyInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, deleted_score double, per_token double")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
