"""BPE encoding and decoding by tree concatenation.

The split pattern cuts a text into pieces that are encoded on their own; the
tokenizers library encodes those not seen before.  Pieces of more than
`leaf_chars` characters (long unsplit text) are encoded as halves of halves, all
leaves in one batch; going up the tree, a window of tokens around each join is
encoded again and grown until its first and last token are those that the two
sides have there.  Every pair of neighbouring tokens then stands in some true
encoding, which makes the whole sequence the true encoding.

Null and empty text: no tokens, and the empty text back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import map_texts

#: The split pattern of byte-level BPE vocabularies.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LEAF_CHARS = 4096
CACHE_SIZE = 300_000
#: A vocabulary file above this is not broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeEncoder:
    """Encodes by the pieces of the split pattern; a bounded cache keeps the pieces seen, with their ids as text and decoded."""

    def __init__(self, source: str, leaf_chars: int = LEAF_CHARS, cache_size: int = CACHE_SIZE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(source)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = {t["content"]: t["id"] for t in json.loads(source).get("added_tokens", [])}
        letters = byte_alphabet()
        self.bytes_of = [b""] * (max(self.tok.get_vocab().values()) + 1)
        for token, i in self.tok.get_vocab().items():
            self.bytes_of[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added_id = added
        self.leaf_chars, self.cache_size = leaf_chars, cache_size
        self.cache: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        """(ids, ids as text, decoded bytes) of each piece of the text, in order."""
        if self.added and self.added.search(text):
            out, at = [], 0
            for m in self.added.finditer(text):
                i = self.added_id[m[0]]
                out += [*self._split(text[at : m.start()]), ((i,), str(i), self.bytes_of[i])]
                at = m.end()
            return out + self._split(text[at:])
        return self._split(text)

    def _split(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        found = SPLIT.findall(text)
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        cache = self.cache
        if new := [p for p in set(found) if p not in cache]:
            short = [p for p in new if len(p) <= self.leaf_chars]
            for p, ids in [*zip(short, self._batch(short)), *((p, self._tree(p)) for p in new if len(p) > self.leaf_chars)]:
                cache[p] = tuple(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
        return [cache[p] for p in found]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library's own encode() gives them."""
        return [i for ids, _, _ in self.pieces(text) for i in ids]

    def _halves(self, piece: str) -> list[str]:
        if len(piece) <= self.leaf_chars:
            return [piece]
        mid = len(piece) // 2
        return self._halves(piece[:mid]) + self._halves(piece[mid:])

    def _tree(self, piece: str) -> list[int]:
        parts = self._batch(self._halves(piece))
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded stretches put together."""
        if not left or not right:
            return left or right
        a = b = 4
        inside = lambda i: 0x80 <= self.bytes_of[i][0] < 0xC0  # noqa: E731  starts within a character
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            while a < len(left) and inside(left[-a]):
                a += 1
            while b < len(right) and inside(right[b]):
                b += 1
            window = b"".join(self.bytes_of[i] for i in left[-a:] + right[:b]).decode()
            ids = self._batch([window])[0]
            left_agrees = a == len(left) or ids[0] == left[-a]
            right_agrees = b == len(right) or ids[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return left[:-a] + ids + right[b:]
            a, b = a * (1 if left_agrees else 2), b * (1 if right_agrees else 2)

    def decode_bytes(self, raw: bytes) -> bytes:
        """UTF-8 of the text that joined token bytes stand for; bytes that form no character become U+FFFD."""
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(b"".join(map(self.bytes_of.__getitem__, ids))).decode()


_ENCODERS: dict[tuple[int, int], TreeEncoder] = {}


def shared_encoder(source: str, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder for each vocabulary in a process, so that a worker's tasks share its cache of pieces."""
    key = hash(source), leaf_chars
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TreeEncoder(source, leaf_chars)
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, path: str) -> Callable[[], str]:
    """Reads the vocabulary file here and sends it to the executors; its size is checked."""
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    with open(path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    return lambda: held.value


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary_path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids array<int>."""
    source = vocabulary(docs.sparkSession, vocabulary_path or default_vocabulary())
    return map_texts(docs, lambda texts, enc: {"ids": [enc.encode(t) for t in texts]}, "ids array<int>", setup=lambda: shared_encoder(source(), leaf_chars))


def decode_documents(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give ""."""
    import pyarrow as pa

    source = vocabulary(encoded.sparkSession, vocabulary_path or default_vocabulary())

    def run(batches):
        enc = shared_encoder(source())
        for b in batches:
            texts = [enc.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def digest_documents(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every text in one pass."""
    source = vocabulary(docs.sparkSession, vocabulary_path or default_vocabulary())

    def fn(texts: list[str], enc: TreeEncoder) -> dict[str, list]:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in texts:
            found = enc.pieces(text)
            out["n_tokens"].append(sum(len(ids) for ids, _, _ in found))
            out["ids_sha256"].append(hashlib.sha256(",".join([t for _, t, _ in found]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.decode_bytes(b"".join([raw for _, _, raw in found]))).hexdigest())
        return out

    return map_texts(docs, fn, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", setup=lambda: shared_encoder(source()))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
