"""Byte-level BPE by pair occurrences: against the tokenizers library and a plain merge loop."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from freshet.llm import bpe

ODD = ["", None, " ", "\n", "a", "aaaaaaa" * 300, " \n\t  x  \x0b y\x1c\x1dz", "it's we'll I've they're 'd 'S", "été Ünïcode ½ ²³ ª º 日本語 テスト 🙂👩‍👩‍👧 ​﻿", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", " x \x85y\xa0z", "١٢٣ Ⅷ ꙮ 𝔘𝔫𝔦 \U000e0041", "x" * 5000 + "1" * 3000 + "!" * 2000 + " " * 2500, "\x00\x01\x7f\x80\x9f", "the the the"]


def random_texts(n):
    rng = random.Random(13)
    sets = ["abc ", "etaoin shrdlu", "aé ñß'.,!", " \n\t\r", "aA1_-#$ ", "".join(map(chr, range(0x20, 0x250))), "日本語 абв ١٢ ̀‍🙂½\x1c\x85"]
    return ["".join(rng.choices(rng.choice(sets), k=rng.randrange(80))) for _ in range(n)]


def test_ids_and_texts_as_the_library_gives_them(spark):
    library = Tokenizer.from_file(bpe.default_tokenizer())
    texts = [*ODD, *random_texts(2500)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, IDS string").repartition(5)
    got = bpe.decode(bpe.encode(df))
    assert got.columns == ["doc_id", "ids", "text"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.text == library.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")


def test_index_against_a_plain_merge_loop():
    index = bpe.pieces_of(bpe.default_tokenizer()).index
    rng = random.Random(3)
    pieces = [bytes(rng.choices(rng.choice([b"ab", b"the in", b"aaab", bytes(range(256))]), k=rng.randrange(1, 40))) for _ in range(400)]
    flat, lengths = index.encode(pieces)
    for piece, end, n in zip(pieces, lengths.cumsum(), lengths, strict=True):
        ids = [int(index.of_byte[b]) for b in piece]
        while True:
            ranked = [(index.rank[key], i) for i in range(len(ids) - 1) if (key := ids[i] << 20 | ids[i + 1]) in index.rank]
            if not ranked:
                break
            r, i = min(ranked)
            ids[i : i + 2] = [index.merges[r][2]]
        assert flat[end - n : end].tolist() == ids


def test_ids_that_are_not_utf8_or_not_in_the_file():
    index, library = bpe.pieces_of(bpe.default_tokenizer()).index, Tokenizer.from_file(bpe.default_tokenizer())
    rng = random.Random(5)
    for _ in range(300):
        ids = rng.choices(range(300), k=12)
        assert index.decode(np.array(ids), np.array([0, 5, 12])) == [library.decode(x, skip_special_tokens=False) for x in (ids[:5], ids[5:])]
    assert index.decode(np.array([10**6, -1, *library.encode("ab").ids]), np.array([0, 0, 3])) == ["", "ab"]


def test_forgetting_pieces_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(200))], "doc_id long, text string")
    want = sorted(map(tuple, bpe.encode(df).collect()))
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, bpe.encode(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_empty_table_repeated_rows_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty)).collect() == []
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in bpe.decode(bpe.encode(same)).orderBy("doc_id").collect()] == [(None, "a b"), (None, "a b"), (1, "")]
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def test_other_files_are_refused(tmp_path):
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        file = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"model": file["model"] | {"merges": file["model"]["merges"][::-1]}}):
        (tmp_path / "x.json").write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            bpe.PairIndex(str(tmp_path / "x.json"))


def test_query_digests(spark):
    from pyspark.sql import functions as F

    library = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        assert tuple(got[d.doc_id]) == (d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
