"""Packing documents into token windows by minimum bin slack."""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import small_batches, stored, table

WINDOW = 1024
#: Pieces that one shard packs on average: enough lengths to fill windows exactly, few enough for any task.
SHARD_DOCS = 3_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Set in the ids of sequences that are one whole piece; the others begin with their shard.
WHOLE = 1 << 62
_ID = np.dtype("<u4")
# Texts of these characters are cut alike by the two libraries' patterns; others go to the tokenizer itself.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
_CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by a byte-level BPE file of the tokenizers library.

    If the file's merges stand in the order of their ids, the same merges run in
    tiktoken, which gives the same ids three times as fast; the tests hold them
    against each other.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        # texts that hold the string of an added token: the tokenizer gives it the token's id
        self.added = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        if all(model["vocab"][p] == 256 + i for i, p in enumerate(pairs)):
            import tiktoken

            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
            ranks = {bytes(sign[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("file", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or _OTHER.search(text) or self.added.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype=_ID).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises every text, adds ``end_id`` and cuts the ids into whole windows and a rest: one row per piece, with its place (``mark``) among all.

    A null or empty text is the end id alone.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype=_ID).tobytes()
    step = window * _ID.itemsize
    names = [c.split()[0] for c in (PIECES + ", mark long").split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        mark = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                n = len(ids) // _ID.itemsize
                for s in range(0, len(ids), step):
                    c = ids[s : s + step]
                    rows.append((doc, s // _ID.itemsize, len(c) // _ID.itemsize, zlib.crc32(c), n, mark))
                    mark += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(encode, PIECES + ", mark long")


def fill(counts: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a multiset of lengths: (lengths of one window with their counts, how many such windows), until none is left.

    The largest length left opens a window.  A bitset holds the sums that the
    other lengths can reach, one shift-or for each power-of-two part of a
    length's count; the reached sum closest to the room is walked back through
    the bitsets to the counts it takes.  A window's filling is repeated as long
    as its lengths last, so the work is bounded by the number of lengths.
    """
    left = counts.copy()
    full = (1 << (window + 1)) - 1
    out: list[tuple[dict[int, int], int]] = []
    while (lengths := np.flatnonzero(left)).size:
        first = int(lengths[-1])
        left[first] -= 1
        room = window - first
        reach, steps = 1, []
        mask = full >> first
        goal = 1 << room
        for n in lengths[::-1]:  # long ones first: short ones stay for what is hard to fill
            n, c = int(n), min(int(left[n]), room // int(n))
            part = 1
            while c > 0 and not reach & goal:
                take = min(part, c)
                steps.append((n, take, reach))
                reach |= (reach << (n * take)) & mask
                c -= take
                part *= 2
            if reach & goal:
                break
        at = reach.bit_length() - 1
        chosen: dict[int, int] = {}
        for n, take, before in reversed(steps):
            if not before >> at & 1:
                chosen[n] = chosen.get(n, 0) + take
                at -= n * take
        chosen[first] = chosen.get(first, 0) + 1
        left[first] += 1
        times = min(int(left[n]) // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= k * times
        out.append((chosen, times))
    return out


def pack(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_DOCS) -> DataFrame:
    """Gives every piece a sequence and an offset in it; no sequence holds more than ``window`` ids.

    Pieces as long as the window are sequences of their own and go nowhere.  The
    rests are dealt to shards by their marks, whatever document they come from,
    and a shard is filled into windows by ``fill``.  The last, poorly filled
    windows of a shard are at most a few: a shard has thousands of pieces.
    ``cut`` is read twice, so it has to be a stored table.
    """

    def assign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mark", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        by_length = np.argsort(lengths, kind="stable")
        counts = np.bincount(lengths, minlength=window)
        taken = np.concatenate([[0], np.cumsum(counts)])[:-1]
        n = 0
        for chosen, times in fill(counts, window):
            at = 0
            for length, k in chosen.items():
                rows = by_length[taken[length] : taken[length] + k * times].reshape(times, k)
                taken[length] += k * times
                sequence[rows] = n + np.arange(times)[:, None]
                offset[rows] = at + length * np.arange(k)[None, :]
                at += k * length
            n += times
        pdf["sequence_id"], pdf["offset"] = (int(key[0]) << 40) + sequence, offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    columns = [c.split()[0] for c in PIECES.split(", ")]
    whole = cut.where(F.col("length") >= window).select(*columns, (F.col("mark") + F.lit(WHOLE)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < window)
    shards = max(1, math.ceil(rest.count() / shard_pieces))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)))
    return whole.unionByName(dealt.groupBy("shard").applyInPandas(assign, PACKED))


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all ``docs(doc_id, text)`` with sequence and offset; repeated rows and rows without id are documents like any other."""
    return pack(stored(pieces(docs, tokenizer or default_tokenizer())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
