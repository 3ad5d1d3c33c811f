import re
import string

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import near_dup
from tallyspark.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(texts, size):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(i, len(sets[i]), root(i), root(i) == i) for i in range(len(texts))]


def corpus(rng):
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for k in range(30):
        base = list(rng.choice(vocab, rng.integers(30, 120)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 9)):
            base = base.copy() if k % 2 else texts[-1].split()
            for _ in range(rng.integers(0, 4)):
                base[rng.integers(len(base))] = rng.choice(vocab)
            texts.append(" ".join(base))
    # one large group whose members differ in a word or two, and texts that share half of theirs
    base = list(rng.choice(vocab, 100))
    for _ in range(150):
        other = base.copy()
        other[rng.integers(100)] = rng.choice(vocab)
        texts.append(" ".join(other))
    for _ in range(60):
        texts.append(" ".join(base[:70] + list(rng.choice(vocab, 30))))
    return texts


def test_components_match_brute_force(spark, documents, odd_texts):
    texts = odd_texts + corpus(np.random.default_rng(4)) + ["THE The the and of", "the the the and of", "same text"] + ["same text"] * 9
    docs = documents(texts).withColumn("Component_ID", F.lit("clash")).withColumn("signature", F.lit(1)).repartition(3)
    for size in (4, 5):
        got = sorted(map(tuple, near_dup.near_duplicates(docs, size=size).collect()))
        assert got == brute(texts, size)


def test_empty_null_and_repeated_rows(spark, documents):
    assert near_dup.near_duplicates(documents([])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (False, 1, 1, True), (False, 1, 1, True), (False, 2, 2, True), (True, 0, 0, True), (True, 0, 0, True)]


def test_posterior_bounds():
    bounds = near_dup.least_matches(0.8, 1e-6)
    assert bounds[0][0] == near_dup.BATCH and all(0 < m < 0.8 * n for n, m in bounds)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (4000, 320), np.uint8)
    same = rng.random((4000, 320)) < np.repeat([0.8, 0.3], 2000)[:, None]
    b = np.where(same, a, rng.integers(0, 256, (4000, 320), np.uint8))
    left = near_dup.plausible(a, b, 0.8, 1e-6)
    assert (left < 2000).sum() >= 1998 and (left >= 2000).sum() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3)], "a int, b int")
    for local in (200_000, 5):
        assert {(r.id, r.component) for r in components(edges.repartition(6), "a", "b", local_edges=local).collect()} == {(i, 0) for i in range(41)}


def test_bands_are_shared_by_their_keys_only(spark):
    """Signatures are equal in the first band's bytes, its keys aren't: the pair counts in the second band."""
    sig, first = bytes(near_dup.HASHES), [[k] + [7] + [k * 100 + b for b in range(2, near_dup.BANDS)] for k in (1, 2)]
    rows = [(7, 1, 10 + k, 10 + k, 50, sig, bands) for k, bands in enumerate(first)]
    members = spark.createDataFrame(rows, "key long, band int, doc_id long, component long, n_shingles long, signature binary, bands array<long>")
    cells = near_dup._cells(members)
    assert {tuple(r) for r in near_dup._likeliest(cells, 80, 1e-5).collect()} == {(11, 10)}
    assert {r.doc_id for r in near_dup._open_rows(cells, 80, 1e-5).collect()} == {10, 11}


def test_a_block_returns_links_that_join_components_only(spark):
    """Twelve documents, each like the next but unlike the one after it: eleven links of 66 pairs join all."""
    sig = bytes(near_dup.HASHES)
    sets = [[*range(10 * k, 10 * k + 100)] for k in range(12)]
    rows = [(7, 0, k, k, 100, sig, [7] + [k * 100 + b for b in range(1, near_dup.BANDS)], s) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, band int, doc_id long, component long, n_shingles long, signature binary, bands array<long>, shingles array<long>")
    open_rows = near_dup._open_rows(near_dup._cells(members.drop("shingles")), 80, 1e-5)
    links = near_dup._joining_links(open_rows.join(members.select("doc_id", "shingles"), "doc_id").select(*near_dup._CELL, "shingles"), 80, 1e-5).collect()
    assert sorted(map(tuple, links)) == [(k + 1, k) for k in range(11)]
