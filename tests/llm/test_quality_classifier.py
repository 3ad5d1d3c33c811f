import zlib

import numpy as np

from tallyspark.llm import quality_classifier as q


def test_blocked_products_are_exact():
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.3, (2500, 50 + q.FORMS)).astype(np.float32)
    labels = rng.integers(0, 2, 2500)
    model = q.train(counts, labels, np.arange(50, dtype=np.uint64))
    own = model.project(counts[:40])
    cosine = own @ model.vectors.T
    near = np.argsort(-cosine, axis=1)[:, : q.NEIGHBOURS]
    vote = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** 4
    expect = (vote * model.labels[near]).sum(axis=1) / vote.sum(axis=1)
    assert np.allclose(model.score(counts[:40]), expect, atol=1e-5)


def make(rng, n):
    vocab = ["the", "of", "and", "river", "house", "light", "winter", "garden", "stone", "music"]
    good = [" ".join(rng.choice(vocab, 60)).capitalize() + "." for _ in range(n)]
    loud = [" ".join(rng.choice(vocab, 60)).upper().replace(" ", "!! ") for _ in range(n // 6)]
    stuck = [" ".join(w for w in rng.choice(vocab, 8) for _ in range(9)) for _ in range(n // 6)]
    return good, loud + stuck


def test_held_out_accuracy(spark, documents, odd_texts):
    good, bad = make(np.random.default_rng(7), 300)
    docs = documents(good + bad + odd_texts)
    quality = [1] * len(good) + [0] * len(bad)
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(quality)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = q.quality_scores(docs, labels).orderBy("doc_id").collect()
    assert len(rows) == len(good + bad + odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id < len(quality)]
    assert np.mean([r.predicted == quality[r.doc_id] for r in out]) > 0.98
    # held-out labels have no influence
    other = spark.createDataFrame([(i, 1 - v if zlib.crc32(str(i).encode()) % 4 == 2 else v, 0) for i, v in enumerate(quality)], "doc_id long, quality int, toxic int")
    assert [r.score for r in q.quality_scores(docs, other).orderBy("doc_id").collect()] == [r.score for r in rows]


def test_no_labels_and_no_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in q.quality_scores(documents(["a b", None]), labels).collect()] == [0.5, 0.5]
    assert q.quality_scores(documents([]), labels).count() == 0
