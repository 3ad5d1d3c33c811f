import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expect(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "aaaaaaa aaaa aa a", "Hello's IT'S 12 Ünï!! <|endoftext|> x<|startoftext|>y <|endoftext", "ΑΣ ΣΑΣ", "İstanbul é́",
    "a\x1cb \x1f\x85c　d", "ab" * 3000, "$" * 500, "½ ² Ⅷ x_y", "can't WON'T'll 'S", "日本語テキスト", "'s's 'Re.'d",
])
def test_like_the_library(library, text):
    model = bpe.load(PATH)
    ids, decoded = expect(library, text)
    assert model.encode([text]) == [ids] and model.decode(ids) == decoded


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcDEFthe'sinéÜß 12.,!$\n\t\x1c<|>_"), max_size=60), max_size=4))
def test_random_texts(texts):
    library, model = Tokenizer.from_file(PATH), bpe.load(PATH)
    assert model.encode(texts) == [expect(library, t)[0] for t in texts]


def test_query_columns(spark, documents, odd_texts, library):
    rows = bpe.digests(documents([*odd_texts, "x " * 100_000]), PATH).orderBy("doc_id").collect()
    for row, text in zip(rows, [*odd_texts, "x " * 100_000], strict=True):
        ids, decoded = expect(library, text)
        assert row.n_tokens == len(ids) // 4 and row.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    both = bpe.encode_decode(documents(odd_texts), PATH).orderBy("doc_id").collect()
    assert [(bytes(r.ids), r.decoded) for r in both] == [expect(library, t) for t in odd_texts]
    assert bpe.digests(documents([]), PATH).count() == 0


def test_long_words():
    """Words of many letters take little time and give the library's ids."""
    import time

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.load(path)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("etaoinshr"), n)) for n in (399, 400, 401, 5000)] + ["ab" * 3000, "a" * 5001, "é" * 700, "x " + "".join(rng.choice(list("etaoin"), 900)) + " y z"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.time()
    own.encode(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 500_000))])
    assert time.time() - began < 30
