"""Licence scans, quality rules, toxicity, packing, main text: against plain versions and on odd rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import license_scan, main_text, packing, quality, shingles, toxicity

TEXTS = ["", " \n\t ", None, "one", "a b c d", "a b c d e", "The MIT License. cc-by; CC BY\nmit license", "x\x0by\x0cz ²³ ½ 日本語 テスト", "word " * 5000, "same line\nsame line\nsame line \n\n", "été Ünïcode gnu general public license " * 3, "Licensed under the Apache License, Version 2.0."]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_shingle_sets_tell_words_apart():
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    rng = np.random.default_rng(0)
    texts = [*TEXTS, *[" ".join(rng.choice(["ab", "ba", "a", "b", "ä", "A"], 40)) for _ in range(60)]]
    seen = {}
    for t, s in zip(texts, shingles.shingle_sets(pa.array(texts, pa.string())), strict=True):
        w = words(t)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        assert len(s) == len(want)
        for name in set(s.tolist()):
            seen.setdefault(name, set()).add(frozenset(want))
    sets = [frozenset(tuple(x) for x in v) for v in seen.values()]
    assert sets  # equal hashes only ever come from sets that share a shingle
    for v in seen.values():
        assert frozenset.intersection(*v)


def test_word_hashes_do_not_depend_on_the_batch():
    one = [shingles.word_hashes(pa.array([t], pa.string()))[0].tolist() for t in TEXTS]
    h, b = shingles.word_hashes(pa.array(["pad", *TEXTS], pa.string())[1:])
    assert [h[x:y].tolist() for x, y in zip(b[:-1], b[1:], strict=True)] == one
    small = [p for p in shingles.portions(pa.array(TEXTS, pa.string()), 64)]
    assert sum(map(len, small)) == len(TEXTS)


def test_license_phrases_against_a_plain_search(spark):
    got = {r.doc_id: r for r in license_scan.scan(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        hits = [(k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_spans_survive_small_edits(spark):
    body = license_scan.TEMPLATES["mit-grant"].split()
    body[20] = "programs"
    text = "Intro words here. " + " ".join(body) + " Trailing words."
    r = license_scan.scan(docs(spark, [text])).first()
    assert "mit-grant" in r.labels.split(",") and 0.9 < r.score < 1
    span = max(r.spans, key=lambda s: s.n_matched)
    assert (span.template, span.first_word) == ("mit-grant", 3) and span.n_words > span.n_matched


def test_licenses_with_edits_insertions_and_repeats(spark):
    rng = np.random.default_rng(8)
    for name, t in license_scan.TEMPLATES.items():
        words = t.split()
        texts = [t + " " + t, "x " * 30 + " ".join(words[: len(words) // 2]) + " page header that says nothing at all, over more than twelve words in one line " + " ".join(words[len(words) // 2 :])]
        for _ in range(4):
            w = list(words)
            for i in rng.choice(len(w), max(1, len(w) // 20), replace=False):
                w[i] = "changed"
            texts.append("Before. " + " ".join(w) + " After.")
        a = license_scan.LicenseAutomaton(license_scan.TEMPLATES, license_scan.BASE_PHRASES)
        for k, text in enumerate(texts):
            cover = a.covers(a.scan(text)[2]).get(name, 0.0)
            assert cover <= 1 and (cover >= license_scan.MIN_COVER or len(words) < 20), (name, k, cover)


def test_chains_against_every_chain():
    import itertools
    import random

    def best(matches):
        most = 0
        for k in range(1, len(matches) + 1):
            for c in itertools.permutations(matches, k):
                total, ok = c[0][2], True
                for (px, pt, pn), (x, t, n) in itertools.pairwise(c):
                    cut = max(px + pn - x, pt + pn - t, 0)
                    ok &= px < x + cut and pt < t + cut and cut < n and x - px - pn <= 12 and t - pt - pn <= 12 and (px, pt, pn) < (x, t, n) and x + n > px + pn and t + n > pt + pn
                    total += n - cut
                most = max(most, total if ok else 0)
        return most

    rng = random.Random(5)
    for _ in range(150):
        matches = list({(rng.randrange(40), rng.randrange(40), rng.randint(4, 9)) for _ in range(rng.randint(1, 5))})
        found = license_scan.chains(matches)
        assert max(m for _, _, m, _, _ in found) == best(matches)
        for (a, n, *_), (b, m, *_) in itertools.combinations(found, 2):
            assert a + n <= b or b + m <= a


def test_automaton_statistics_against_every_substring():
    import random

    rng = random.Random(1)
    for _ in range(30):
        templates = {f"t{i}": " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for i in range(3)}
        phrases = {" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))): "x" for _ in range(3)}
        a = license_scan.LicenseAutomaton(templates, phrases)
        text = [rng.choice("abcde") for _ in range(60)]
        _, places, spans = a.scan(" ".join(text))
        want = sorted((k, i) for i, p in enumerate(phrases) for k in range(60) if text[k : k + len(p.split())] == p.split())
        assert sorted(places) == want
        for s in spans:
            assert s.n_matched <= s.n_words and s.template_start >= 0


def repeat_words(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})


def test_quality_counts_against_a_plain_version():
    rng = np.random.default_rng(2)
    for t in [*TEXTS, *[" ".join(rng.choice(list("abc"), 30)) for _ in range(50)]]:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), repeat_words(w))
        assert quality.base_counts(t) == want


def labelled_corpus(spark):
    rng = np.random.default_rng(3)
    words = "the quick brown fox jumps over a lazy dog and runs home again while it rains on hills far away from our town".split()
    good = [" ".join(rng.choice(words, 90)) for _ in range(60)]
    bad = [" ".join(w + "#%&|"[rng.integers(4)] * 3 for w in rng.choice(words, 90)) for _ in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(0, 120)], "doc_id long, quality int, toxic int")
    return d, labels


def test_quality_learns_and_keeps(spark):
    d, labels = labelled_corpus(spark)
    model = quality.fit(d, labels)
    got = {r.doc_id: r for r in quality.judge(d.withColumn("kept", F.lit("clash")), model).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 120))
    odd = quality.judge(docs(spark), model).collect()
    assert len(odd) == len(TEXTS) and all(r.base_failed and not r.kept for r in odd if r.n_words < 50)


def test_quality_is_fitted_in_small_blocks(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    d, labels = labelled_corpus(spark)
    fitted = []
    fit = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows: fitted.append(fit(self, rows)) or fitted[-1])
    model = quality.fit(d, labels)
    *blocks, line = fitted
    assert max(m.numFeatures for m in fitted) * 8 < 1 << 19 and sum(m.numFeatures for m in blocks) == 2 << quality.BITS
    want = np.concatenate([m.coefficients.toArray() for m in blocks]) / len(blocks)
    assert np.abs(want).max() > 0 and np.allclose(model.weights, want, atol=1e-6)
    assert np.isclose(model.bias, np.mean([m.intercept for m in blocks])) and model.slope == line.coefficients[0]
    tops = [np.flatnonzero(m.coefficients.toArray()) for m in blocks]
    seen = np.unique(np.concatenate([i for r in d.collect() for i in next(quality.hashed(pa.array([r.text])))]))
    assert set(np.concatenate([t + (k << quality.BLOCK_BITS) for k, t in enumerate(tops)])) <= set(seen)


@pytest.mark.parametrize("keep", [[0], []])
def test_models_without_both_labels(spark, keep):
    d, labels = labelled_corpus(spark)
    some = labels.where(F.col("doc_id").isin(keep)) if keep else labels.limit(0)
    assert quality.judge(d, quality.fit(d, some)).count() == 120
    scores = [r.score for r in toxicity.score(d, toxicity.fit(d, some)).collect()]
    assert len(scores) == 120 and all(0 <= s <= 1 for s in scores)


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(300)]
    rows = []
    for i in range(400):
        t = list(rng.choice(words, 60))
        if i % 4 == 0:
            t[10], t[30] = "you zorbly"[:3], "zorbly"
            t[40] = "grumptious" + "abc"[i % 3] + rng.choice(words)
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.97
    odd = toxicity.score(docs(spark), toxicity.fit(d, labels)).collect()
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in odd)


def test_labels_of_held_out_rows_are_not_read(spark):
    d, labels = labelled_corpus(spark)
    where = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2"
    kept = {r.doc_id for r in quality.labelled(d, labels, "toxic", 1000, where).collect()}
    assert kept == {i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    e = packing.encoder(packing.default_tokenizer())
    texts = [t or "" for t in TEXTS] + ["hello <|endoftext|> world", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", " <|endoftext|> it's IT'S 'll", "  \n\n a  ", "​ zero  y", "tab\tname 12345 --- ..."]
    assert e.fast is not None
    for t, x in zip(texts, Tokenizer.from_file(packing.default_tokenizer()).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e(t), "<u4").tolist() == x.ids


def test_pieces_cover_every_id_once_and_sequences_are_gapless(spark):
    d = docs(spark).unionByName(docs(spark).where("doc_id = 3"))
    rows = packing.pack_documents(d).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    e = packing.encoder(packing.default_tokenizer())
    for i, t in enumerate(TEXTS):
        ids = np.frombuffer(e(t or ""), "<u4").tolist() + [0]
        own = sorted(by_doc[i], key=lambda r: r.start)
        if i != 3:
            assert [r.start for r in own] == list(range(0, len(ids), 1024))
        for r in own:
            assert r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert len(by_doc[3]) == 2
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own][:-1]]).tolist() and sum(r.length for r in own) <= 1024


def test_packing_of_nothing_of_long_texts_and_of_one_id(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = spark.createDataFrame([(None, "some words here") for _ in range(300)] + [(1, "many different words 12 " * 20_000)], "doc_id long, text string")
    rows = packing.pack_documents(d).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sum(r.doc_id is None for r in rows) == 300 and sum(r.length for r in rows if r.doc_id == 1) == next(r.doc_tokens for r in rows if r.doc_id == 1) > 80_000
    assert len(by_seq) <= sum(r.length for r in rows) // 1024 + 2
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own][:-1]]).tolist()


def test_fill_reaches_the_best_sum():
    rng = np.random.default_rng(4)
    for _ in range(40):
        window = 50
        counts = np.zeros(window, dtype=np.int64)
        for n in rng.integers(1, window, 8):
            counts[n] += 1
        plan = packing.fill(counts, window)
        used = np.zeros(window, dtype=np.int64)
        left = counts.copy()
        for chosen, times in plan:
            items = [n for n, c in enumerate(left) for _ in range(c)]
            first = max(items)
            items.remove(first)
            sums = {0}
            for n in items:
                sums |= {s + n for s in sums if s + n <= window - first}
            assert sum(n * k for n, k in chosen.items()) == first + max(sums)
            for n, k in chosen.items():
                used[n] += k * times
                left[n] -= k * times
        assert (used == counts).all()


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><div id=header>Site name and menu</div>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, a lot. Accept?</div><!-- <p>hidden</p> --><article><h1>Head &amp; line</h1><p>First, with <b>bold</b>
 and&nbsp;more.<br>Next line.<p>Short.</p><figure><figcaption>Caption, here.</figcaption></figure><div class="ad">Buy now!</div><form><p>Mail us</p></form></article>
<aside><p>Related: a long text, with marks; and more. It goes on, and on.</p></aside><section class=comments><p>Reader: I liked it, really; a lot!</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text_leaves_furniture_out():
    assert main_text.main_text(PAGE) == "Head & line First, with bold and more. Next line. Short. Caption, here."


def test_layout_names_do_not_hide_the_content():
    body = "<p>One, two; three.</p><p>Four.</p>"
    for names in ('class="content sidebar-right"', 'class="site-main has-sidebar"', 'id=main class="post no-comments"', 'class="entryBody"'):
        assert main_text.main_text(f"<body class='single footer'><div {names}><div class='entry-header'><h1>Head</h1></div>{body}</div><div class='comment-content'><p>Nice, really; yes.</p></div>") == "Head One, two; three. Four."
    for names in ('class="AdSlot"', 'id="googleAd"', 'class="post-comments"', 'class="related posts"', 'role="navigation"'):
        assert main_text.main_text(f"<article>{body}</article><div {names}><p>Gone, all; of it. And this, too.</p></div>") == "One, two; three. Four."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<html>", ""), ("plain words", "plain words"), ("<p>a&lt;b <i>x</i>y<p>Second &eacute;", "a<b xy Second é"), ("<p>cut &am", "cut &am"), ("<p>a < b</p>", "a < b"),
        ("<script>x", ""), ("<!-- open <p>x</p>", ""), ("<p title=\"a>b\">in</p>", "in"), ("</div></p>stray<p>x", "stray x"), ("<nav>only menu</nav>", ""),
    ],
)
def test_odd_pages(page, text):
    assert main_text.main_text(page) == text


def _paragraphs(*names):
    return "".join(f"<p>{n} one, two; three. Four, five: six.</p>" for n in names), [f"{n} one, two; three. Four, five: six." for n in names]


@pytest.mark.parametrize(
    "page",
    [
        "<article><section>{a}</section><section>{b}</section></article>",
        "<main><div><div>{a}</div></div><div>{b}</div></main>",
        "<div class='post-content'><div>{a}</div><div>{b}</div></div>",
        "<div><div><div>{a}</div><div>{b}</div></div></div>",
        "<div><div><div>{a}</div></div><div>{b}</div></div>",
        "<article>{a}</article><article>{b}</article>",
        "<div class='row'><div class='text-justify'>{a}</div><div>{b}</div></div>",
    ],
)
def test_content_in_unequal_parts_stays_whole(page):
    (a, first), (b, second) = _paragraphs("A", "B", "C"), _paragraphs("D")
    page = page.format(a=a, b=b)
    for around in ("<body>{}</body>", "<body><nav><p>Menu, of it all; here.</p></nav><div>Site</div>{}<div class='comments'><p>Nice, really; yes, yes.</p></div></body>"):
        assert main_text.main_text(around.format(page)).removeprefix("Site ") == " ".join(first + second)


def test_heading_and_lead_beside_the_body_stay():
    body, texts = _paragraphs("A", "B", "C", "D")
    for page in ("<article><h1>Head</h1><p>Lead, short.</p><div class=body>{}</div></article>", "<div id=wrap><div><h1>Head</h1><p>Lead, short.</p><div>{}</div></div></div>"):
        assert main_text.main_text(page.format(body)) == " ".join(["Head Lead, short.", *texts])
    assert main_text.main_text(f"<div><div><h1>Head</h1></div><div>{body}</div></div>") == " ".join(["Head", *texts])


def test_other_blocks_beside_a_content_element_go():
    body, texts = _paragraphs("A", "B", "C")
    assert main_text.main_text(f"<div><article>{body}</article><div><p>About this site, at length; and more. And on.</p></div></div>") == " ".join(texts)


@pytest.mark.parametrize("attrs", ["style='overflow-x:hidden'", 'style="color:red; overflow : hidden"', "class='content overflow-hidden'", "class=hidden-print", "aria-hidden='false'", "data-hidden", "data-hidden=1", "title='a hidden place; display:none'", "data-style='display:none'"])
def test_only_hidden_elements_are_hidden(attrs):
    for tag in ("body", "main", "article", "div"):
        assert main_text.main_text(f"<{tag} {attrs}><p>One, two; three.</p><p>Four.</p></{tag}>") == "One, two; three. Four."


@pytest.mark.parametrize("attrs", ["hidden", "class=x hidden", "hidden=''", "hidden=hidden", "HIDDEN", "aria-hidden=true", 'aria-hidden = "true"', "style='display:none'", 'style="color:red; DISPLAY : none !important"', "style='visibility:hidden;'"])
def test_hidden_elements_go(attrs):
    assert main_text.main_text(f"<article><p>One, two; three.</p><div {attrs}><p>Gone, all; of it.</p></div></article>") == "One, two; three."


@pytest.mark.parametrize(
    ("around", "inner"),
    [
        ("<form action=/x>{}</form>", "<article>{}</article>"), ("<form>{}</form>", "{}"), ("<form><div class=wrap>{}</div></form>", "<div>{}</div>"), ("{}", "<div class='social-science'>{}</div>"),
        ("{}", "<section class=legal>{}</section>"), ("<div class='search-results'>{}</div>", "<main>{}</main>"), ("<form>{}</form>", "<div class=legal>{}</div>"), ("<fieldset class=popup>{}</fieldset>", "<div>{}</div>"),
    ],
)
def test_furniture_around_the_whole_article_is_none(around, inner):
    body, texts = _paragraphs("A", "B", "C")
    page = f"<html><body><nav><a href=/>Home</a></nav>{around.format(inner.format('<h1>Head</h1>' + body))}<div class=comments><p>Reader, liked; it.</p></div><footer>Me.</footer></body></html>"
    assert main_text.main_text(page) == " ".join(["Head", *texts])


def test_doubtful_elements_beside_the_article_go():
    body, texts = _paragraphs("A", "B", "C")
    for beside in ("<form><p>Mail us, now; please. Do.</p><p>Or call, at once. Do.</p></form>", "<div class=legal><p>Rights, all; ours. Yes.</p></div>", "<div class=notice>{}</div>".format("<p>Long, long; notice. Read it.</p>" * 30)):
        assert main_text.main_text(f"<article>{body}</article>{beside}") == " ".join(texts)
        assert main_text.main_text(f"<article>{body}{beside}</article>") == " ".join(texts)
    assert main_text.main_text("<form><label>Name</label><input><p>Fill it in.</p></form>") == ""
    assert main_text.main_text("<div class=notice><p>We moved.</p></div>") == ""


def test_parts_of_an_article_stay():
    one, two = "<p>One, two; three. Four.</p>", "<p>Five, six; seven. Eight.</p>"
    says = "One, two; three. Four. {} Five, six; seven. Eight."
    links = "<ul><li><a href=a>Alpha</a></li><li><a href=b>Beta</a></li></ul>"
    assert main_text.main_text(f"<article><h1 class='page-header'>Head</h1>{one}{two}</article>") == "Head " + says.format("").replace("  ", " ")
    assert main_text.main_text(f"<article>{one}{links}{two}</article>") == says.format("Alpha Beta")
    assert main_text.main_text(f"<article>{one}{two}<p>See:</p>{links}</article>") == says.format("").replace("  ", " ") + " See: Alpha Beta"
    assert main_text.main_text(f"<article><h1>Head</h1>{links}{one}{two}{links}</article>") == "Head " + says.format("").replace("  ", " ")
    assert main_text.main_text(f"<article>{one}<figure class='media social-image'><figcaption>A view.</figcaption></figure>{two}</article>") == says.format("A view.")
    assert main_text.main_text(f"<article>{one}<p>Of <label>inline</label> text.</p>{two}</article>") == says.format("Of inline text.")
    for gone in ("<h3 class='related-title'>More</h3>", "<figure class=ad><figcaption>Buy.</figcaption></figure>", "<form><p>Your <label>name</label></p></form>"):
        assert main_text.main_text(f"<article>{one}{gone}{two}</article>") == says.format("").replace("  ", " ")


def test_path_weights_against_a_plain_version():
    rng = np.random.default_rng(11)
    for _ in range(60):
        page = "<body>" + "".join("<%s>" % rng.choice(["div", "div class=x", "p", "section", "/div", "/section", "li", "ul"]) + " ".join(rng.choice(["word", "a,", "b.", "<a href=x>link text</a>"], rng.integers(0, 6))) for _ in range(25))
        tree = main_text.parse(page)

        def path(e, tree=tree):
            p, out = tree.elements[e].path if e >= 0 else -1, []
            while p >= 0:
                out.append(tree.paths[p][1])
                p = tree.paths[p][0]
            return tuple(reversed(out))

        if not tree.blocks:
            continue
        keys = [path(b.element) for b in tree.blocks]
        ratio = lambda own: (sum(len(b.text) - b.link_chars for b in own) / len(own), sum(len(re.findall("[.,;:!?]", b.text)) for b in own) / len(own))
        fused, plain = {}, {}
        for k in set(keys):
            own = [b for b, x in zip(tree.blocks, keys, strict=True) if x == k]
            around = [b for b, x in zip(tree.blocks, keys, strict=True) if x[: len(k) - 1] == k[:-1] and len(x) >= len(k) - 1] if len(k) > 1 else own
            (t, m), (ut, um) = ratio(own), ratio(around)
            fused[k] = (t + ut) / 2 * (1 + (m + um) / 2) * sum(len(b.text) - b.link_chars for b in own) / sum(len(b.text) for b in own)
            plain[k] = t * (1 + m)
        w = [fused[k] for k in keys]
        least = min(0.5 * np.std(w), max(w))
        got = main_text.path_weights(tree, tree.blocks)
        assert got[0] == pytest.approx([x if x >= least * (1 - 1e-12) else 0.0 for x in w]) and got[1] == pytest.approx([plain[k] for k in keys])


def test_long_and_deep_pages():
    deep = "<div>" * 30_000 + "<p>One, two; three.</p>" * 3_000
    assert main_text.main_text(deep) == " ".join(["One, two; three."] * 3_000)
    long = "<article>" + "<p>" + "word, " * 200_000 + "</p><nav>menu</nav></article>"
    assert main_text.main_text(long) == ("word, " * 200_000).strip()


def test_extract_keeps_every_row(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in main_text.extract(d).orderBy("page_id").collect()]
    assert len(got) == 3 and got[1][1:] == ("", 0) and got[0][2] == len(got[0][1])
    assert main_text.extract(d.limit(0)).count() == 0


def test_labelled_rows_are_bounded_where_ids_repeat(spark):
    rows = [(i % 20, f"text {i % 3}" if i % 7 else None) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, "doc_id long, toxic int")
    got = quality.labelled(d, labels, "toxic", 5).collect()
    assert len(got) == 5 and len({r.doc_id for r in got}) == 5
    again = quality.labelled(d.repartition(3), labels, "toxic", 5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
