import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab'sé 12.,!\n\t\x1c\xa0<|>endoftext"), max_size=80))
def test_ids_like_the_library(text):
    assert packing.load(PATH).encode(text) == np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", ["a  b", "a\n b", "a \nb", " a", "a ", "a\n\n  b c", "x<|endoftext|> y", "a\x1c b", "word.\nNext word"])
def test_white_space(text):
    assert packing.load(PATH).encode(text) == np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def holds(pieces, sizes, limits):
    placed, bins = {}, {}
    for key, start, length, sequence, offset in pieces:
        assert length > 0
        placed.setdefault(key, []).append((start, length))
        bins.setdefault(sequence, []).append((offset, length))
    for key, size in sizes.items():
        at = 0
        for start, length in sorted(placed.get(key, [])):
            assert start == at
            at += length
        assert at == size
    padding = 0
    for parts in bins.values():
        at = 0
        assert len(parts) <= limits[1]
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits[0]
        padding += limits[0] - at if at & (at - 1) else 0
    return padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=120), st.integers(2, 40))
def test_every_token_once(sizes, segments):
    limits = (1024, segments, 1023)
    packer = packing.Packer(limits, window=32)
    pieces = [p for k, n in enumerate(sizes) for p in packer.add(k, n)] + list(packer.finish())
    holds(pieces, dict(enumerate(sizes)), limits)


def test_loss_limit():
    packer = packing.Packer((64, 8, 20), window=16, cuts=False)
    items = [(k, 10 + k % 7, k % 9) for k in range(200)]
    pieces = [p for i in items for p in packer.add(*i)] + list(packer.finish())
    loss = {}
    for key, _, _, sequence, _ in pieces:
        loss[sequence] = loss.get(sequence, 0) + items[key][2]
    assert max(loss.values()) <= 20 and len(pieces) == 200


def test_documents(spark, documents, odd_texts):
    texts = [*odd_texts, "many words here " * 2000, *[f"text number {i} " * (i % 40) for i in range(300)]]
    library = Tokenizer.from_file(PATH)
    rows = packing.pieces_with_checksums(documents(texts).repartition(3), PATH).collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    pieces = [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows]
    padding = holds(pieces, {k: len(x) for k, x in enumerate(ids)}, packing.LIMITS)
    assert padding == 0
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert packing.pieces_with_checksums(documents([]), PATH).count() == 0


def test_long_white_space():
    """Runs that the pattern would backtrack over give the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.load(path)
    for run in (" " * 300_000, "\n" * 300_000, "\t \n" * 2000, " " * 1024, "\u3000" * 1500, "\x1c" * 2000):
        for text in (run, "a" + run, run + "b", "it's" + run + "b c", run + "<|endoftext|>" + run, "x" + run + "\n"):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
