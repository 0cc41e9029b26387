"""Byte-level BPE by an index of pair occurrences, and its decoding."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.shared import small_batches, table

#: Distinct pieces that a Python worker remembers; beyond that it starts anew.
REMEMBERED = 600_000
#: Characters of texts that are indexed together.
TOGETHER = 16 << 20
_SHIFT = 20
_EDGE, _GONE = -1, -2
# For texts of these characters Python's classes and the tokenizer's are the same; the tokenizer itself cuts the others.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_PIECE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PairIndex:
    """The merges of a byte-level BPE file, applied to many pieces of text at once.

    Every pair of neighbouring symbols that some merge joins is kept with all its
    places.  The ranks that have places are taken in ascending order; a merge
    joins all its places from left to right and enters the pairs that arise on
    both sides into the lists of their own ranks.  Places that a merge has
    changed stay in their old lists and are passed over when those come up.  A
    piece of n bytes costs n log n, however long.

    A file whose merges use a symbol before the merge that makes it, or whose
    parts go beyond plain byte-level BPE, is refused with a ValueError.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before, added = file["model"], file["pre_tokenizer"], file["added_tokens"]
        plain = file["normalizer"] is None and file["post_processor"] is None and before["type"] == file["decoder"]["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        odd_model = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or odd_model or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        self.cut = Tokenizer.from_file(path).pre_tokenizer
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.sign = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab: dict[str, int] = model["vocab"]
        self.of_byte = np.zeros(256, dtype=np.int32)
        for c, b in self.sign.items():
            self.of_byte[b] = vocab[c]
        self.rank: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {vocab[left + right]: r for r, (left, right) in enumerate(parts)}
        for r, (left, right) in enumerate(parts):
            a, b, new = vocab[left], vocab[right], vocab[left + right]
            if max(made.get(a, -1), made.get(b, -1)) >= r or made[new] != r:
                raise ValueError(f"{path}: merge {r} doesn't stand behind those it needs")
            self.rank[a << _SHIFT | b] = r
            self.merges.append((a, b, new))
        self.keys = np.array([*sorted(self.rank), -1])
        self.key_ranks = np.array([self.rank[k] for k in self.keys.tolist()[:-1]], dtype=np.int32)
        self.added = {t["content"]: t["id"] for t in added}
        self.find_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        texts = {i: bytes(self.sign[c] for c in token) if all(c in self.sign for c in token) else token.encode() for token, i in [*vocab.items(), *self.added.items()]}
        of_id = [*[texts.get(i, b"") for i in range(max(texts) + 1)], b""]  # the last stands for ids that there are none of
        self.token_bytes = np.frombuffer(b"".join(of_id), dtype=np.uint8)
        self.byte_starts = np.append(0, np.cumsum([len(x) for x in of_id]))

    def pieces(self, text: str) -> list[str | bytes | int]:
        """The parts of a text that merges never cross, as text or UTF-8, and added tokens as their ids."""
        if self.find_added is not None and self.find_added.search(text):
            parts = self.find_added.split(text)
            return [x for i, part in enumerate(parts) for x in ([self.added[part]] if i % 2 else self.pieces(part))]
        if _ODD.search(text):
            there = self.sign
            return [bytes(there[c] for c in piece) for piece, _ in self.cut.pre_tokenize_str(text)]
        return _PIECE.findall(text)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one behind the other, and how many each has."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        edges = np.cumsum(np.append(0, lengths + 1))
        sym = np.full(len(data) + len(pieces) + 1, _EDGE, dtype=np.int32)
        inside = np.ones(len(sym), dtype=bool)
        inside[edges] = False
        sym[inside] = self.of_byte[data]
        after, before = np.arange(1, len(sym) + 1, dtype=np.int32), np.arange(-1, len(sym) - 1, dtype=np.int32)
        two = np.flatnonzero(inside[:-1] & inside[1:]).astype(np.int32)
        places = self._ranked(sym[two], sym[two + 1], two)
        waiting = list(places)
        heapq.heapify(waiting)
        while waiting:
            r = heapq.heappop(waiting)
            a, b, new = self.merges[r]
            i = np.sort(np.concatenate(places.pop(r)))
            i = i[(sym[i] == a) & (sym[after[i]] == b) & np.append(i[1:] != i[:-1], True)]
            if a == b and len(i) > 1:  # in a run of equal symbols every other place, from its left end
                at = np.arange(len(i))
                i = i[(at - np.maximum.accumulate(np.where(np.append(True, after[i[:-1]] != i[1:]), at, 0))) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            sym[i], sym[j], after[i], before[k] = new, _GONE, k, i
            p = before[i]
            made = np.full(len(i), new, dtype=np.int32)
            for s, more in self._ranked(np.concatenate([sym[p], made]), np.concatenate([made, sym[k]]), np.concatenate([p, i])).items():
                if s in places:
                    places[s] += more
                else:
                    places[s] = more
                    heapq.heappush(waiting, s)
        kept = np.flatnonzero(sym != _GONE)
        ids = sym[kept]
        return ids[ids != _EDGE], np.diff(np.flatnonzero(ids == _EDGE)) - 1

    def _ranked(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> dict[int, list[np.ndarray]]:
        """The places of the pairs that some merge joins, by its rank."""
        pairs = left.astype(np.int64) << _SHIFT | right
        found = np.searchsorted(self.keys[:-1], pairs)
        there = self.keys[found] == pairs
        if not there.any():
            return {}
        ranks, at = self.key_ranks[found[there]], at[there]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        first = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
        bounds = [*first.tolist(), len(at)]
        return {r: [at[a:b]] for r, a, b in zip(ranks[first].tolist(), bounds[:-1], bounds[1:], strict=True)}

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of the ids between each two bounds: their bytes as UTF-8, what isn't UTF-8 as replacement characters; ids that the file lacks are passed over."""
        ids = np.where((ids >= 0) & (ids < len(self.byte_starts) - 1), ids, len(self.byte_starts) - 2)
        data, ends = gathered(self.token_bytes, self.byte_starts, ids)
        ends, data = ends[bounds].tolist(), data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def gathered(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[i]:starts[i + 1]]`` of all i in ``which`` one behind the other, and where each begins and the last ends."""
    lengths = starts[which + 1] - starts[which]
    ends = np.append(0, np.cumsum(lengths))
    return flat[np.repeat(starts[which] - ends[:-1], lengths) + np.arange(ends[-1])], ends


class Pieces(dict):
    """Numbers of the distinct pieces met so far, and their ids one behind the other."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.index = PairIndex(path)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str | bytes | int] = []
        self.ids, self.starts = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def __missing__(self, piece: str | bytes | int) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        pieces = self.index.pieces(text) if text else []
        return np.fromiter(map(self.__getitem__, pieces), np.int32, len(pieces))

    def learn(self) -> None:
        """Encodes the pieces that came since the last time, in one index."""
        ids, lengths = self.index.encode([p.encode() if isinstance(p, str) else p if isinstance(p, bytes) else b"" for p in self.new])
        if added := [i for i, p in enumerate(self.new) if isinstance(p, int)]:
            ids = np.insert(ids, (np.cumsum(lengths) - lengths)[added], [self.new[i] for i in added])
            lengths[added] = 1
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.new = []

    def of(self, numbers: list[np.ndarray]) -> pa.ListArray:
        """The ids of each text, given as the numbers of its pieces."""
        every = np.concatenate([np.zeros(0, dtype=np.int32), *numbers])
        ids, ends = gathered(self.ids, self.starts, every)
        bounds = ends[np.append(0, np.cumsum([len(x) for x in numbers], dtype=np.int64))]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One for each file and Python worker."""
    return _PIECES.get(path) or _PIECES.setdefault(path, Pieces(path))


def _other(df: DataFrame, *names: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in names}]


def encode(df: DataFrame, tokenizer: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Puts ``ids array<int>`` of the whole text in the place of column ``text``.

    The ids are those of the tokenizers library without special tokens added and
    without truncation; the string of an added token has that token's id.  A null
    or empty text has no ids.  Other columns stay, one named like ``ids`` goes.
    ``tokenizer``: a file that every executor has at that path.

    A task indexes the pieces of about 16 MB of texts at a time, but those that
    its worker still remembers from before.
    """
    small_batches(df.sparkSession)
    path, rest = tokenizer or default_tokenizer(), _other(df, text, ids)
    names = [*[f.name for f in rest], ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pieces_of(path)
        held: list[tuple[list[pa.Array], list[np.ndarray]]] = []
        size = 0
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            held.append((batch.columns[: len(rest)], [seen.numbers(t) for t in texts]))
            size += sum(len(t) for t in texts if t)
            if size > TOGETHER:
                yield from emit(seen, held)
                held, size = [], 0
        yield from emit(seen, held)

    def emit(seen: Pieces, held: list) -> Iterator[pa.RecordBatch]:
        seen.learn()
        for columns, numbers in held:
            yield pa.RecordBatch.from_arrays([*columns, seen.of(numbers)], names=names)
        if len(seen) > REMEMBERED:
            seen.forget()

    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(*[F.col(f.name) for f in rest], text).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of column ``ids``; null or no ids give an empty text, other columns stay, one named like ``text`` is replaced."""
    path, rest = tokenizer or default_tokenizer(), _other(df, text)
    at = [f.name for f in rest].index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pieces_of(path).index
        for batch in batches:
            lists = batch.column(at)
            bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
            texts = index.decode(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return df.select(*[F.col(f.name) for f in rest]).mapInArrow(run, T.StructType([*rest, T.StructField(text, T.StringType())]))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    known = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), "ids")
    return decode(known).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
