import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if count[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_match_brute_force(spark, documents, odd_texts):
    rng = np.random.default_rng(1)
    texts = odd_texts + [" ".join(rng.choice(["a", "bé", "c\n", "$d", "e"], 60)) for _ in range(40)] + ["w " * 400_000 + "end"]
    rows = q.text_statistics(documents(texts).withColumn("N_Words", F.lit("clash"))).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in q.STATISTICS[:5]) for r in rows] == [brute(t) for t in texts]


def test_list_learns_thresholds():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(q.FEATURES)))
    bad = (x[:, 1] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 4] > 0.5))
    rules = q.learn_list(x, bad)
    got = np.any([r.covers(x) for r in rules], axis=0)
    assert rules and np.mean(got == bad) > 0.97
    assert q.learn_list(x[:0], bad[:0]) == [] and q.learn_list(x, np.zeros(3000, bool)) == []


def test_whole_operator(spark, documents, odd_texts):
    good = ["The cat sat on some mat number %d and it was good so we read on there for a while. " % i * 1 + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(120)]
    junk = [" ".join(f"w{i}y{j}$$$" for j in range(70)) for i in range(60)]
    docs = documents(good + junk + odd_texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in q.quality_rules(docs, labels).collect()}
    assert len(rows) == len(good + junk + odd_texts)
    assert all(rows[i].kept for i in range(120)) and not any(rows[i].kept for i in range(120, 180))
    assert all(rows[180 + i].base_failed and not rows[180 + i].kept for i in range(len(odd_texts)))
    empty = q.quality_rules(docs.limit(0), labels.limit(0))
    assert empty.count() == 0


def test_the_list_does_not_depend_on_the_order_of_rows(spark, documents):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "#", "$$", "x1"], rng.integers(20, 200), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1] if i % 2 else [0.4, 0.3, 0.3, 0, 0, 0])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(rng.random() < (0.2 if i % 2 else 0.9)), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = documents(texts)
    assert len({str(q.fit(docs.repartition(n), labels)) for n in (1, 3, 8)}) == 1
