import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from codeloom.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def encoder():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.TreeEncoder(f.read(), leaf_chars=8)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcthe éñ日😀 \n\t'=-_0123456789<|>"), max_size=200))
def test_equals_library(encoder, text):
    ids = encoder.encode(text)
    assert ids == encoder.tok.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == encoder.tok.decode(ids, skip_special_tokens=False)


def test_long_unsplit_texts(encoder):
    rng = random.Random(1)
    for alphabet in ("ab", "thequickbrownfox", "éñü", "日本", " ", "=-", "0123456789"):
        text = "".join(rng.choice(alphabet) for _ in range(5000)) + "<|endoftext|> tail\n\n x"
        assert encoder.encode(text) == encoder.tok.encode(text, add_special_tokens=False).ids


def test_documents(spark, docs, empty):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.digest_documents(docs).collect()}
    assert len(bpe.digest_documents(docs).collect()) == 11
    none = hashlib.sha256(b"").hexdigest()
    assert got[5, 0].ids_sha256 == got[4, 0].decoded_sha256 == none
    ids = bpe.encode_documents(docs)
    back = {r.doc_id: r.text for r in bpe.decode_documents(ids).collect()}
    assert back[3].endswith(" again") and back[5] == "" and back[7] == "x" * 200_000
    assert bpe.digest_documents(empty).count() == 0
