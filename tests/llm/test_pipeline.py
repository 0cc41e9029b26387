"""Each stage of the pipeline against a plain version, and a whole run on odd rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from freshet.llm import mixing, packing, quality, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good, bad and toxic prose with labels, near copies, repeated ids with other texts, rows without id, source or text."""
    rng = np.random.default_rng(21)
    words = [f"w{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(250)]
    prose = lambda n: list(rng.choice(words, n))
    rows, labels = [], []
    for i in range(360):
        t, kind = prose(70), i % 6
        if kind == 0:
            t = [w + "#%&|"[rng.integers(4)] * 3 for w in t]
        if kind == 1:
            t[10:12], t[30], t[50] = ["you", "zorbly"], "zorbly", "zorbly"
        rows.append((i, " ".join(t), "en", f"s{i % 4}", 0))
        labels.append((i, int(kind != 0), int(kind == 1)))
    base = prose(100)
    for i in range(400, 420):
        t = list(base)
        t[int(rng.integers(100))] = "changed"
        rows.append((i, " ".join(t), "en", "s1", 0))
    rows += [(500, " ".join(prose(80)), "en", "s1", 0), (500, " ".join(prose(80)), "en", "s2", 0), (None, " ".join(base), "en", None, 0), (None, " ".join(prose(80)), None, None, None)]
    rows += [(501, None, "en", "s1", 0), (502, "", "en", "s1", 0), (503, "too few", "en", "s1", 0), (504, " ".join(prose(30_000)), "en", "s3", 0), rows[5], rows[5]]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_plain_versions(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    good = corpus_pipeline.quality_rules(spark, docs, folder)
    assert good.columns == COLUMNS
    model = quality.fit(docs, labels)

    def keeps(t):
        n, *_, again = quality.base_counts(t or "")
        return n >= 50 and 100 * again <= 50 * n and model.probability(np.array([model.margin(*next(quality.hashed(pa.array([t or ""]))))]))[0] >= 0.5

    assert plain(good) == sorted((r for r in rows if keeps(r[1])), key=str)
    good = spark.createDataFrame(good.collect(), docs.schema)

    calm = corpus_pipeline.toxic_documents(spark, good, folder)
    fitted = toxicity.fit(docs, labels)
    scores = {(r.doc_id, r.text): r.score for r in toxicity.score(good, fitted).collect()}
    assert calm.columns == COLUMNS and plain(calm) == sorted((r for r in map(tuple, good.collect()) if scores[r[0], r[1]] < 0.3), key=str)
    kept = {r.doc_id for r in calm.collect()}
    held = [i for i in range(360) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((i in kept) == (i % 6 > 1) for i in held)
    calm = spark.createDataFrame(calm.collect(), docs.schema)

    single = corpus_pipeline.near_duplicates(spark, calm, folder)
    own = [tuple(r) for r in calm.collect()]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (re.findall(r"[^\x20\x09-\x0D]+", r[1].lower()) for r in own)]
    group = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert single.columns == COLUMNS
    got = [tuple(r) for r in single.collect()]
    assert len(got) == len(set(group)) and len({group[own.index(r)] for r in got}) == len(got)
    for r in got:
        ids = [own[i][0] for i in range(len(own)) if group[i] == group[own.index(r)]]
        assert r[0] == min((i for i in ids if i is not None), default=None)
    assert sum(r[0] == 500 for r in got) == 2
    single = spark.createDataFrame(got, docs.schema)

    mixed = corpus_pipeline.mixed_sources(spark, single, folder)
    taken = mixing.mix(mixing.with_size_and_weight(single)).collect()
    assert mixed.columns == COLUMNS and sorted((r.doc_id is None, r.doc_id, r.text) for r in mixed.collect() if r.doc_id is not None) == sorted((False, r.doc_id, r.text) for r in taken if r.doc_id is not None for _ in range(r.epochs))
    mixed = spark.createDataFrame(mixed.collect(), docs.schema)

    pieces = corpus_pipeline.packed_windows(spark, mixed, folder).collect()
    encode = packing.encoder(packing.default_tokenizer())
    assert sum(p.length for p in pieces) == sum(len(encode(r.text or "")) // 4 + 1 for r in mixed.collect())


def test_a_whole_run_and_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    assert {0, 1}.isdisjoint({r.doc_id % 6 for r in out if r.doc_id is not None and r.doc_id < 360 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "mixing", "packing"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
