"""Joins, components, WARC, urls and mixing: against brute force and on odd rows."""

import hashlib
import io
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import embedding_dedup, mixing, ngram_join, shared, shingles, url_filters, warc


def least_labels(nodes, links):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_nothing(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = least_labels({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if any(n in e for e in links if e[0] != e[1])}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [None, "", "  \n", "one two", "One TWO", "one two three", "a b c d e"]
    base = rng.choices(words, k=150)
    for _ in range(60):  # near copies of one text, some further than the threshold
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [texts[10]] * 12
    texts += [" ".join(rng.choices(words, k=rng.randint(20, 200))) + " " + passage for _ in range(80)]
    texts += [passage] * 3
    return [(i, t, "x") for i, t in enumerate(texts)]


def jaccard_links(rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, links


@pytest.mark.parametrize(("frequent", "run_rows"), [(64, 50_000), (3, 20)])
def test_ngram_join_against_every_pair(spark, monkeypatch, frequent, run_rows):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "RUN_ROWS", run_rows)
    rows = corpus()
    sizes, links = jaccard_links(rows)
    got = {r.doc_id: r for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string, sig string")).collect()}
    want = least_labels(sizes, links)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == want


def test_runs_longer_than_a_batch_meet_every_pair(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        rows = corpus()
        sizes, links = jaccard_links(rows)
        got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string, sig string")).collect()}
        assert got == least_labels(sizes, links)
    finally:
        spark.conf.set(key, before)


def test_batches_are_cut_between_runs():
    rng = random.Random(9)
    for _ in range(200):
        keys = sorted((rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(30)))
        whole = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["a", "b"])
        batches, at = [], 0
        while at < len(keys):
            size = rng.randrange(4)
            batches.append(whole.slice(at, size))
            at += size
        got = [list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for b in ngram_join._whole_runs(iter(batches), (0, 1))]
        assert [k for b in got for k in b] == keys and all(got)
        assert all(x[-1] != y[0] for x, y in zip(got, got[1:], strict=False))


def test_sets_of_repeated_rows_are_fetched_once(spark):
    texts = ["a b c d e f g h", "other words that stand in this text here"]
    d = spark.createDataFrame([(None, t) for t in texts] * 16, "doc_id long, text string").repartition(16).withColumn("key", F.xxhash64("doc_id", "text"))
    wanted = ngram_join.classes(d.withColumn("mark", F.lit(0).cast("long")))[0].groupBy("sig").agg(F.min("key").alias("key"))
    got = ngram_join.token_sets(d, wanted, "text").collect()
    assert sorted(len(r.tokens) // 8 for r in got) == [4, 4] and len({r.sig for r in got}) == 2


def test_ngram_join_of_nothing_and_of_rows_without_id(spark):
    assert ngram_join.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (9, "A b c d e f"), (None, None), (5, "other")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.link(d).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (9, 4), (9, 4), (None, None), (5, 5)], key=str)


def test_sketches_never_refute_a_link():
    rng = np.random.default_rng(5)
    refuted = 0
    for _ in range(300):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        keep = x[rng.random(len(x)) < rng.uniform(0.5, 1)]
        y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        ok = all(ngram_join.may_link(np.frombuffer(ngram_join._sketch(x, k), np.uint16), len(x), np.frombuffer(ngram_join._sketch(y, k), np.uint16), len(y)) for k in (2, 3))
        bits = ngram_join._mask(x) & ngram_join._mask(y)
        ok &= bits & 0xFFFFFFFF != 0 and bits >> 32 != 0
        assert ok or 100 * both < 80 * (len(x) + len(y) - both)
        refuted += not ok
    assert refuted > 50


def test_differences_to_a_third_set_bound_the_overlap():
    rng = np.random.default_rng(6)
    tight = 0
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 200))).astype(np.uint64))
        sets = [np.union1d(base[rng.random(len(base)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 62, int(rng.integers(1, 30))).astype(np.uint64)) for _ in range(2)]
        rows = []
        for s in sets:
            lacked, beyond = np.setdiff1d(base, s), np.setdiff1d(s, base)
            rows.append(np.concatenate([ngram_join._bits(lacked), ngram_join._bits(beyond), np.array([len(lacked), len(beyond)], np.uint64)]))
        bound, both = int(ngram_join.most_common(rows[0], len(sets[0]), rows[1][None, :])[0]), len(np.intersect1d(*sets))
        assert bound >= both
        tight += bound <= both + 8
    assert tight > 150


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=120)
    texts = []
    for _ in range(2000):
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(t))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    made = []
    plain = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: made.append(pairs.count()) or plain(pairs, *rest))
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string, sig string")).collect()}
    names: dict[tuple, int] = {}
    sets = [{names.setdefault(tuple(w[k : k + 5]), len(names)) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    held = np.zeros((2000, len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, list(s)] = 1
    both = held @ held.T
    size = held.sum(axis=1)
    x, y = np.nonzero(100 * both >= 80 * (size[:, None] + size[None, :] - both))
    assert len(x) > 50_000 and got == least_labels(range(2000), zip(x.tolist(), y.tolist(), strict=True))
    assert sum(made) < 60_000


def test_one_of_each_group_stays(spark):
    a, b = "one two three four five six seven", "other words stand in this one here"
    rows = [(5, a, "s"), (3, a, "s"), (3, b, "s"), (3, b, "s"), (None, a, "s"), (None, b.upper(), "t"), (None, "alone " + a, None), (None, "alone " + a, None), (7, None, "s"), (7, None, "s"), (8, " ", "s"), (9, "x", "s"), (9, "y", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = ngram_join.one_of_each(d)
    assert got.columns == d.columns
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == sorted([(3, a, "s"), (3, b, "s"), (None, "alone " + a, None), (7, None, "s"), (7, None, "s"), (8, " ", "s"), (9, "x", "s"), (9, "y", "s")], key=str)
    assert ngram_join.one_of_each(d.limit(0)).count() == 0


def test_embeddings_against_every_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 20))
    rows = [((base[rng.integers(30)] + rng.normal(size=20) * rng.choice([0, 0.1, 0.3, 0.5])) * rng.uniform(0.1, 9)).tolist() for _ in range(300)]
    rows += [rows[0]] * 5 + [None, [0.0] * 20, [float("nan")] + [1.0] * 19, [1.0, 2.0], [2.0, 4.0], [None] + [1.0] * 19, [], [float("inf")] * 20]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.link(df, tile=16, block_bytes=5_000).collect()}
    unit = [np.array(r) / np.linalg.norm(r) if r and None not in r and np.isfinite(r).all() and np.linalg.norm(r) > 0 else None for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    n = dict.fromkeys(range(len(rows)), 0)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    want = least_labels(n, links)
    assert len(links) > 300 and {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (i == want[i]) for i, r in got.items())
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_embeddings_of_any_size_and_under_one_id(spark):
    d = spark.createDataFrame([(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e-200, -0.0]), (4, [0.0, 5e-324]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in embedding_dedup.link(d).where("vec_id is not null").collect()) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
    d = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embedding_dedup.link(d).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def pages():
    big = "<p>" + "é" * 80 + "</p>"
    return [(3, "http://a/1", big), (1, "http://a/%20\r\nx", big), (7, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (8, "u", "x" * 300_000), (1, "again", big)]


def test_archives_hold_what_was_written(spark):
    uri = shared.shared_dir(spark) + "/archives"
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    warc.write(warc.records(df).repartition(2), uri)
    got = warc.read(spark, uri).collect()
    assert len(got) == 9
    want = {p: (h or "").encode() for p, _, h in pages()}
    for r in got:
        assert r.payload_digest == hashlib.sha256(want[r.page_id]).hexdigest() and r.payload_bytes == len(want[r.page_id])
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id in (3, 7) or r.target_uri == pages()[1][1] else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else want[r.page_id])
    assert {(r.page_id, r.target_uri) for r in got} == {(p, u) for p, u, _ in pages()}
    assert warc.read(spark, shared.shared_dir(spark)).count() == 0


def test_one_response_for_each_digest(spark):
    big, other = "x" * 200, "y" * 200
    rows = [(4, "u", big)] * 6 + [(4, None, big), (9, "a", big), (None, "a", big)] + [(None, "n", other)] * 3 + [(2, None, "z" * 200)] * 2
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc.records(d).collect()
    kinds = lambda page: sorted((r.record_type, r.refers_to, r.payload is None) for r in got if r.payload_digest == hashlib.sha256(page.encode()).hexdigest())
    assert kinds(big) == [("response", None, False)] + [("revisit", 4, True)] * 8
    assert kinds(other) == [("response", None, False)] * 3
    assert kinds("z" * 200) == [("response", None, False), ("revisit", 2, True)]
    assert len({r.record_id for r in got}) == len(rows) and [r.page_id for r in got if r.record_type == "response" and r.refers_to is None and r.page_id == 4] == [4]


def test_headers_of_any_length_and_writes_side_by_side(spark, tmp_path):
    uri = shared.shared_dir(spark) + "/archives"
    long = spark.createDataFrame([(1, "http://a/" + "x" * 1_200_000, "short")], "page_id long, url string, html string")
    warc.write(warc.records(long), uri)
    one, two = warc.WarcWriter(f"file://{tmp_path}", 1 << 20), warc.WarcWriter(f"file://{tmp_path}", 1 << 20)
    batch = pa.RecordBatch.from_pylist([row()])
    first, second = one.write(iter([batch])), two.write(iter([batch]))
    lost = one.write(iter([batch]))
    assert lost.files != first.files
    one.commit([first])
    two.commit([second, None])
    assert warc.read(spark, f"file://{tmp_path}").count() == 2 and sorted(x.name for x in tmp_path.iterdir()) == sorted(f.rsplit("/", 1)[1] for m in (first, second) for _, f in m.files)
    (r,) = warc.read(spark, uri).collect()
    assert len(r.target_uri) == 1_200_009 and r.payload == b"short"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(empty).count() == 0


def row(payload=b"data"):
    return {"record_id": "x", "record_type": "response", "target_uri": "u", "page_id": 1, "refers_to": None, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def test_members_are_read_in_chunks_and_damage_is_named():
    data = b"".join(warc.record(row(bytes([i]) * 100_000)) for i in range(5))
    found = list(warc.members(io.BytesIO(data)))
    assert [warc.parse(x)["payload_bytes"] for _, x in found] == [100_000] * 5 and found[0][0] == 0 and found[-1][0] < len(data)
    with pytest.raises(warc.BadRecord, match="cut short"):
        list(warc.members(io.BytesIO(data[:-5])))
    with pytest.raises(warc.BadRecord):
        list(warc.members(io.BytesIO(b"not gzip at all")))
    plain = found[0][1]
    with pytest.raises(warc.BadRecord, match="digest"):
        warc.parse(plain[:-5] + b"!" + plain[-4:])
    with pytest.raises(warc.BadRecord, match="framed"):
        warc.parse(plain[:-9] + b"\r\n\r\n")


URLS = [None, "", "no scheme/org/", "HTTP://Example.ORG/es/1", "https://example.org/en/12?x#y", "https://a.b.example.org/en/2", "http://shop.example.com/fr/1", "ftp://x.com/de/", "http://com", "http://notorg/x", "http://x.org?/es/", "http://free-bets.example.net/en/1", "http://my.cheap-pills.net", "http://betsy.net/a", "x://h#f", "http://ÄB.org/"]


def test_urls_against_the_rules_read_plainly(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filters.url_filter(d, url_filters.BASE_RULES + url_filters.METHOD_RULES).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [n for n in rules if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith("/" + n.split("/", 1)[1])]
        best = max(fit, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best)
        if best:
            assert got[i].verdict == rules[best]
    assert got[11].verdict == "block" and got[12].verdict == "block" and got[13].verdict == "allow"


def test_only_candidates_run_their_patterns(spark):
    d = spark.createDataFrame([(i, f"http://site{i}.example.net/en/{i}") for i in range(50)], "page_id long, url string")
    assert url_filters.url_filter(d, url_filters.BASE_RULES + url_filters.METHOD_RULES).agg(F.sum("n_candidates")).first()[0] < 50 * 3


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), " ".join(["w"] * rng.randint(0, 80))) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(mixing.with_size_and_weight(d)).collect()
    assert len(got) == 1500 and sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    sources = sorted({r.source for r in got if r.source is not None}) + [None]
    for k, s in enumerate(sources):
        own = [r for r in got if r.source == s]
        size, target, taken = own[0].source_size, own[0].target, sum(r.taken for r in own)
        assert size == sum(r.size for r in own) and target <= 2 * size + 1e-6 and abs(taken - target) <= 80
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
        full = int(target // size)
        assert all(r.taken >= full * r.size for r in own)
    again = mixing.mix(mixing.with_size_and_weight(d.repartition(7))).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixed_corpus_repeats_rows_as_often_as_the_mix_takes_them(spark):
    rng = random.Random(3)
    rows = [(i % 50, "a" if i % 3 else None, " ".join(["w"] * (i % 50 + 1)), "clash") for i in range(300)] + [(None, "a", "w w", "x")] * 5 + [(60, "b", None, "y"), (61, "b", "", "y")]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, key string")
    taken = mixing.mix(mixing.with_size_and_weight(d)).collect()
    assert "key" in taken[0].asDict() and len(taken) == len(rows)
    got = mixing.stage(d).collect()
    want: dict = {}
    for r in taken:
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    made: dict = {}
    for r in got:
        made[r.doc_id, r.source] = made.get((r.doc_id, r.source), 0) + len((r.text or "").split())
    assert {k: n for k, n in want.items() if n} == {k: n for k, n in made.items() if n}


def test_mix_against_a_plain_one(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice("aab") if i % 9 else None, rng.randint(0, 40), rng.choice([0.05, 0.3, 1.0])) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long, quality_weight double")
    name = F.xxhash64("doc_id", "source", "size", "quality_weight")
    keyed = d.select("doc_id", ((F.pmod(F.xxhash64(name, F.lit(1).cast("long"), F.lit(17)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()
    u = {r.doc_id: r.u for r in keyed}
    total = 1.5 * sum(r[2] for r in rows)
    weight = {"a": 3.0, "b": 1.0, None: 2.0}
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in weight}
    target, full = {}, set()
    while True:
        rest = total - sum(target[s] for s in full)
        free = sum(weight[s] for s in weight if s not in full)
        target.update({s: rest * weight[s] / free for s in weight if s not in full})
        over = {s for s in weight if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
        target.update({s: 2.0 * size[s] for s in over})
    want = {}
    for s in weight:
        epochs, ahead = int(target[s] / size[s] + 1e-12), 0
        rest = target[s] - epochs * size[s]
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-math.log(u[r[0]]) / r[3], r[0])):
            want[r[0]] = r[2] * min(2, epochs + (rest > 0 and ahead + r[2] / 2 <= rest))
            ahead += r[2]
    for bucket_rows in (400, 3):
        mixing.BUCKET_ROWS, before = bucket_rows, mixing.BUCKET_ROWS
        assert {r.doc_id: r.taken for r in mixing.mix(d).collect()} == want
        mixing.BUCKET_ROWS = before


def test_rows_that_look_alike_spread_and_reruns_agree(spark):
    copies = spark.createDataFrame([(None, "s", 5, 1.0)] * 3000 + [(7, "s", 5, 1.0)] * 3000 + [(i, "t", 5, 1.0) for i in range(3000)], "doc_id long, source string, size long, quality_weight double")
    d = spark.createDataFrame([(7, f"text {i} x", "s" if i % 3 else None) for i in range(40)] + [(None, "same x y", "s")] * 9, "doc_id long, text string, source string")
    runs = [sorted(map(str, mixing.stage(d.repartition(k)).collect())) for k in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) > 49
    got = mixing.mix(copies, weights=(1.0, 3.0)).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    of = {r.doc_id: r for r in got if r.source == "s"}
    assert sum(r.n for r in got) == 9000 and 0.8 < of[None].taken / of[7].taken < 1.25 and of[None].taken + of[7].taken == pytest.approx(9000 * 5 * 1.5 - 2 * 3000 * 5, abs=5)  # t stops at its cap, s gets the rest


def test_weights_tell_prose_from_noise(spark):
    texts = ["a plain line of prose that says a few things\nand another line of it", "### $$$ {{}} ||| <<<>>>", "12345 67890 12 34 5678", "SHOUTED WORDS AND NOTHING ELSE", "x" * 300, "again\n" * 30, "", None]
    got = [r.quality_weight for r in mixing.with_size_and_weight(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")).orderBy("i").collect()]
    assert got[0] == 1.0 and got[6] == got[7] == 1.0 and all(0.05 <= w < 0.75 for w in got[1:6])


def test_better_documents_are_likelier(spark):
    rows = [(i, "s", 10, 1.0 if i % 2 else 0.1) for i in range(2000)] + [(10_000 + i, "t", 10, 1.0) for i in range(20_000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long, quality_weight double")
    got = [r for r in mixing.mix(d, weights=(1.0, 49.0)).collect() if r.source == "s" and r.taken]
    assert sum(r.doc_id % 2 for r in got) > 0.8 * len(got)


def test_mix_of_nothing_and_of_empty_texts(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(mixing.with_size_and_weight(d)).count() == 0
    d = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, None, "")], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.mix(mixing.with_size_and_weight(d)).collect()] == [0, 0, 0]
    assert mixing.stage(d).columns == d.columns


def test_many_texts_are_hashed_at_once(monkeypatch):
    rng = random.Random(11)
    texts = [None, "", "a", "A b", *[" ".join(rng.choices(["a", "B", "cd", "é"], k=rng.randrange(12))) for _ in range(2000)]]
    alone = [next(shingles.shingle_sets(pa.array([t], pa.string()))) for t in texts]
    calls, plain = [], shingles._slice_words
    monkeypatch.setattr(shingles, "_slice_words", lambda *a: calls.append(1) or plain(*a))
    together = list(shingles.shingle_sets(pa.array(texts)))
    assert len(calls) < 5 and all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))


def test_prefixes_put_frequent_tokens_last():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (7, 1, 40, 130)]
    bounds = np.append(0, np.cumsum([len(s) for s in sets]))
    often = rng.random(bounds[-1]) < 0.4
    token, place, of = ngram_join._prefixes(np.concatenate(sets), bounds, often)
    for k, s in enumerate(sets):
        flags = often[bounds[k] : bounds[k + 1]]
        want = [*s[~flags], *s[flags]][: len(s) - -(-80 * len(s) // 100) + 1]
        assert [t for _, t in sorted(zip(place[of == k], token[of == k], strict=True))] == want
