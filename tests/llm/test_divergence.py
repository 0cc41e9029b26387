"""The source audit against plain arithmetic, radix ranking against sorting."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import divergence as dv

DOC = "doc_id long, text string, lang string, source string, term string"


def plain(docs, min_docs, k):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in docs]
    out = []
    for lang in {x for x, _, _ in words}:
        mine = [(s, w) for x, s, w in words if x == lang]
        kept = sorted(t for t in {t for _, w in mine for t in w} if sum(t in w for _, w in mine) >= min_docs)
        shares = {}
        for s in [None, *sorted({s for s, _ in mine})]:
            n = {t: sum(w.count(t) for x, w in mine if s is None or x == s) for t in kept}
            shares[s] = {t: (1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)), n[t]) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in shares:
            if s is None:
                continue
            pairs = [(-sum(f(shares[s][t][0], shares[o][t][0]) for t in kept), o) for o in shares if o not in (None, s)]
            terms = [(-f(shares[s][t][0], shares[None][t][0]), t) for t in kept if shares[s][t][1] and shares[s][t][0] > shares[None][t][0]]
            utf8 = lambda x: (x[0], x[1].encode())
            for part, ranked in (("pair", sorted(pairs, key=utf8)), ("term", sorted(terms, key=utf8)[:k])):
                out += [(lang, s, part, item, -v, r) for r, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"t{c}" for c in "abcdefghijklmnop"] + ["Été", "日本", "𝔘x", "zz"]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None, "é", "z"])
        out.append((" ".join(rng.choices(words, k=rng.randrange(12))), lang, source))
    return [*out, (None, "en", "only null"), ("", "en", "only null"), ("12 --- 3", "xx", "s1"), ("rare words here", "xx", "s2"), ("alone", "yy", "one")]


@pytest.mark.parametrize(("min_docs", "k", "held", "paired"), [(10, 10, 24 << 20, 100_000), (2, 3, 0, 7), (1, 1, 500, 1)])
def test_audit_against_plain_arithmetic(spark, monkeypatch, min_docs, k, held, paired):
    monkeypatch.setattr(dv, "HELD_BYTES", held)
    monkeypatch.setattr(dv, "PAIRED_ROWS", paired)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    docs = corpus(min_docs, 200)
    docs += docs[:5]  # repeated rows are documents of their own
    try:
        got = dv.audit(spark.createDataFrame([(i, *d, "clash") for i, d in enumerate(docs)], DOC).repartition(3), min_docs, k).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert sorted(map(tuple, got)) == plain(docs, min_docs, k)


def test_empty_table(spark):
    assert dv.audit(spark.createDataFrame([], DOC)).collect() == []


def test_shares_of_large_counts_are_exact(spark):
    cases = [(0, 5), (10**15, 3 * 10**15), (9 * 10**15 - 2, 9 * 10**15), (7, 9), (123456789012, 10**15 + 7)]
    got = spark.createDataFrame(cases, "c long, d long").select("c", "d", dv.share(F.col("c"), F.col("d")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.c + 2) // r.d for r in got]


@pytest.mark.parametrize("seed", range(3))
def test_radix_top_against_sorting(spark, seed):
    rng = random.Random(seed)
    stem = "a" * 9
    rows = []
    for g in ("g1", "g2", "g3", "few"):
        names = {stem + "".join(rng.choices("ab é日𝔘", k=rng.randrange(6))) for _ in range(3 if g == "few" else 300)} | {"", "a", stem}
        most = [3, 2_000, 1 << 35][seed] if g != "g3" else 1
        rows += [(g, i % 2, rng.randrange(most), t) for i, t in enumerate(sorted(names))]
    path = dv.stored(spark.createDataFrame(rows, "g string, h int, value long, item string"))
    for k in (1, 10, 57):
        want = []
        for key in {(g, h) for g, h, _, _ in rows}:
            mine = sorted(((-v, t.encode(), t) for g, h, v, t in rows if (g, h) == key))[:k]
            want += [(*key, -v, t, r) for r, (v, _, t) in enumerate(mine, 1)]
        assert sorted(map(tuple, dv.radix_top(path, ["g", "h"], "value", "item", k).collect())) == sorted(want)


def test_radix_top_with_equal_rows_ends(spark):
    same = dv.stored(spark.createDataFrame([("g", 5, "same")] * 20 + [("g", 5, "sam"), ("g", 5, "samey")], "g string, value long, item string"))
    got = dv.radix_top(same, ["g"], "value", "item", 4).orderBy("rank").collect()
    assert [(r.item, r["rank"]) for r in got] == [("sam", 1), ("same", 2), ("same", 3), ("same", 4)]


def test_terms_of_many_texts_at_once():
    texts = ["", "One two-ONE", "é", "x1y", "end", "start", " a\tb", "", "ÀB z", "--", "q"]
    got, bounds = dv.text_terms(pa.array(texts, pa.large_string()).slice(1))
    own = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts[1:]]
    assert [got.to_pylist()[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == own
    none, bounds = dv.text_terms(pa.array(["", ""], pa.large_string()))
    assert len(none) == 0 and bounds.tolist() == [0, 0, 0]
