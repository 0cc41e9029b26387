"""MaxScore against scoring every document, on odd rows and with small shards, stretches and blocks."""

import math
import random
import re

import pytest

from freshet.llm import lexical_search as ls

DOC = "doc_id long, text string, rank string"


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, queries, k):
    words = [(d, terms(t)) for d, t in docs]
    some = [(d, w) for d, w in words if w]
    n_docs, n_words = len(some), sum(len(w) for _, w in some)
    out = []
    for item, text in queries:
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in some) + 1))) for t in set(terms(text))}
        scored = []
        for d, w in some:
            m = 100 - 50 + (50 * len(w) * n_docs) // n_words
            s = sum(x * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t, x in weight.items())
            if s > 0:
                scored.append((-s, math.inf if d is None else d))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "x1", "A"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(30)))) for i in range(n)]
    return docs + [(None, "w1 w2"), (None, "w1 w2"), (n, None), (n + 1, ""), (n + 2, "w1 " * 3000), (5, docs[5][1]), (n + 3, "---")], words, rng


@pytest.mark.parametrize(("k", "postings", "stretch", "block"), [(5, 1 << 21, 1024, 4 << 20), (3, 100, 4, 20), (1, 40, 1, 1), (50, 300, 16, 100)])
def test_every_document_scored(spark, monkeypatch, k, postings, stretch, block):
    monkeypatch.setattr(ls, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ls, "STRETCH", stretch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    docs, words, rng = corpus(250)
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(8)] + [(3, "w1 W1 w1"), (None, "été absent"), (11, None), (12, ""), (13, "absent")]
    try:
        got = ls.search(spark.createDataFrame([(*d, "x") for d in docs], DOC).repartition(3), spark.createDataFrame(queries, "item_id long, text string").coalesce(1), k, block_bytes=block)
        assert sorted(map(tuple, got.collect()), key=str) == plain(docs, queries, k)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_ties_go_to_the_smallest_id(spark):
    docs = spark.createDataFrame([(i, "same words here", "") for i in range(40)][::-1] + [(99, "other", "")], DOC).repartition(4)
    got = ls.search(docs, spark.createDataFrame([(1, "words")], "item_id long, text string"), 7).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(i + 1, i) for i in range(7)]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", "")], DOC)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(none, items).collect() == []
    assert ls.search(some, items.where("false")).collect() == []
    assert ls.search(some, items).columns == ls.search(some, items.where("false")).columns


def test_lists_below_the_needed_score_are_only_probed(monkeypatch):
    import numpy as np

    ids = np.arange(1000)
    counts = np.array([2 if i % 10 == 0 else 1 for i in ids])  # term 0 everywhere, term 1 in every tenth
    terms_ = np.array([t for i in ids for t in ((0, 1) if i % 10 == 0 else (0,))])
    shard = ls.Shard(ids, np.full(1000, 100), counts, terms_, np.ones(len(terms_), dtype=np.int64), np.array([1, 100]))
    best = ls.Best(5)
    monkeypatch.setattr(ls, "STRETCH", 100)
    offered = []
    real = best.offer
    best.offer = lambda s, d: (offered.extend(d.tolist()), real(s, d))
    shard.search([0, 1], best)
    assert best.docs.tolist() == [0, 10, 20, 30, 40]
    assert all(d % 10 == 0 for d in offered if d >= 100)
