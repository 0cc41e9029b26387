"""Quality rules: counting rules and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.shared import small_batches, stored, table, unused
from freshet.llm.shingles import mix, portions, word_hashes

#: Labelled documents that the regression learns from at most, those with the smallest hash of doc_id; a quarter of them calibrates.
TRAIN_DOCS = 6_000
BITS = 16
#: The regression is fitted in blocks of so many hashed features. Arrays of numbers stay below half a megabyte, so that
#: the driver's collector frees them with its young objects; larger ones take whole regions, which pile up from pass to pass.
BLOCK_BITS = 15
GRAMS = (3, 5)
#: A document whose calibrated probability of being good is below this goes.
KEEP_FROM = 0.5
_SCALE = 40.0
_SPACE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    k = len(ids)
    pairs = a[:-1] * k + a[1:]
    if k >= 1 << 20:  # else three ids fit one integer
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * k + a[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows) + 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    chars = len(text) - sum(map(text.count, _SPACE))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's feature indices: of its character n-grams (over UTF-8 bytes), and of its words and word pairs."""
    for part in portions(texts):
        yield from _hashed(part)


def _hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words, bounds = word_hashes(texts)
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        single = words >> shift
        double = mix(words[:-1] * np.uint64(3) + words[1:], 8) >> shift
    for i, text in enumerate(texts):
        b = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8).astype(np.uint64)
        grams = []
        for n in GRAMS:
            if len(b) >= n:
                g = np.zeros(len(b) - n + 1, dtype=np.uint64)
                for k in range(n):
                    g |= b[k : k + len(g)] << np.uint64(8 * k)
                with np.errstate(over="ignore"):
                    g *= np.uint64(0x9E3779B97F4A7C15)
                grams.append((g >> shift).astype(np.int32))
        a, z = bounds[i], bounds[i + 1]
        tokens = np.concatenate([single[a:z], double[a : max(a, z - 1)]]).astype(np.int32) if z > a else np.zeros(0, np.int32)
        yield (np.concatenate(grams) if grams else np.zeros(0, np.int32)), tokens + (1 << BITS)


@dataclass(frozen=True)
class Model:
    """Weights of both halves of the hashed features, and the line that turns a margin into a calibrated one."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, grams: np.ndarray, tokens: np.ndarray) -> float:
        return self.bias + _SCALE * sum(float(self.weights[x].mean()) for x in (grams, tokens) if len(x))

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where: str = "true", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``most`` labelled documents (doc_id, text, label, pick): those whose doc_id hashes smallest.

    One label for each doc_id: the largest, where a doc_id is labelled twice; and
    one row: that whose text hashes smallest, where a doc_id stands more than once.
    Only the chosen ids are joined to the texts, and their number is bounded.
    """
    one = labels.where(f"{label} is not null and doc_id is not null and ({where})").groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    picked = one.withColumn("pick", F.xxhash64("doc_id", F.lit(3))).orderBy("pick", "doc_id").limit(most)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
    met = texts.join(F.broadcast(picked), F.col("_id") == F.col("doc_id"))
    return met.groupBy("doc_id", "label", "pick").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label", "pick")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", where: str = "true") -> Model:
    """Learns from at most TRAIN_DOCS labelled rows; three quarters give the weights, the rest the calibration.

    Each block of 2^BLOCK_BITS hashed features has a regression of its own, and
    the margin is the mean of theirs: as linear in all features as one fit.
    With labels of one class only, or none, every document gets the share of
    good labels (1 without any) as its probability.
    """

    blocks = [f"block{k}" for k in range((2 << BITS) >> BLOCK_BITS)]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (grams, tokens) in enumerate(hashed(b.column(0))):  # a row at a time: vectors of long texts are large
                both = [np.unique(x, return_counts=True) for x in (grams, tokens)]
                index = np.concatenate([i for i, _ in both])
                value = np.concatenate([_SCALE * c / max(1, c.sum()) for _, c in both])
                cuts = np.searchsorted(index, np.arange(1, len(blocks)) << BLOCK_BITS)
                parts = zip(np.split(index & ((1 << BLOCK_BITS) - 1), cuts), np.split(value, cuts), strict=True)
                sparse = [
                    pa.StructArray.from_arrays(
                        [pa.array([0], pa.int8()), pa.array([1 << BLOCK_BITS], pa.int32()), pa.array([i], pa.list_(pa.int32())), pa.array([v], pa.list_(pa.float64()))],
                        names=["type", "size", "indices", "values"],
                    )
                    for i, v in parts
                ]
                yield pa.RecordBatch.from_arrays([*sparse, b.column(1).slice(k, 1), b.column(2).slice(k, 1)], names=[*blocks, "label", "fold"])

    from pyspark.ml.classification import LogisticRegression  # here, so that Python workers don't load it
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.linalg import VectorUDT

    small_batches(docs.sparkSession)
    chosen = labelled(docs, labels, label, TRAIN_DOCS, where).select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)).alias("fold"))
    kinds = "".join(f"{c} struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, " for c in blocks)
    made = chosen.repartition(12).mapInArrow(vectors, kinds + "label double, fold long")
    rows = stored(made, as_schema=T.StructType([*(T.StructField(c, VectorUDT()) for c in blocks), *made.schema.fields[len(blocks) :]]))  # training passes run no Python
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    seen = {r.fold: (r.lo, r.hi) for r in rows.groupBy((F.col("fold") == 3).alias("fold")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).collect()}
    if not n or any(seen.get(f, (0, 0))[0] == seen.get(f, (0, 0))[1] for f in (False, True)):
        share = (good / n) if n else 1.0
        return Model(np.zeros(2 << BITS, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    fitted = [LogisticRegression(maxIter=40, regParam=2e-4, standardization=False, tol=1e-5, featuresCol=c).fit(rows.where("fold < 3")) for c in blocks]
    raw = Model(np.concatenate([m.coefficients.toArray() / len(blocks) for m in fitted]).astype(np.float32), sum(m.intercept for m in fitted) / len(blocks), 1.0, 0.0)
    margins = rows.where("fold = 3").withColumn("margin", F.lit(0.0))
    for m in fitted:
        out = m.setProbabilityCol("").setPredictionCol("").setRawPredictionCol("raw").transform(margins)
        margins = out.withColumn("margin", F.col("margin") + F.element_at(vector_to_array("raw"), 2) / len(blocks)).drop("raw")
    margins = stored(margins.select("margin", "label"))  # else each pass of the calibration sends the blocks' models along
    line = LogisticRegression(maxIter=50, standardization=False).fit(margins.select(array_to_vector(F.array("margin")).alias("features"), "label"))
    return Model(raw.weights, raw.bias, float(line.coefficients[0]), float(line.intercept))


def judge(docs: DataFrame, model: Model, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Adds the base counts, base_failed, quality (calibrated probability of being good) and kept to every row.

    A null text counts as empty and fails the base rules for want of words.
    Repeated rows stay; input columns named like an added one are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(BASE + ", quality double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        counts = list(zip(*(base_counts(t.as_py() or "") for t in texts), strict=True)) or [()] * 5
        quality = m.probability(np.array([m.margin(g, t) for g, t in hashed(texts)], dtype=np.float64))
        columns = [pa.array(c, pa.int64()) for c in counts]
        return pa.StructArray.from_arrays([*columns, pa.array(quality)], names=[*[c.split()[0] for c in BASE.split(", ")], "quality"])

    added = [c.split()[0] for c in BASE.split(", ")]
    (found,) = unused(docs, "found")
    out = docs.withColumn(found, score(F.col(text))).withColumns({c: F.col(found)[c] for c in [*added, "quality"]}).drop(found)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= keep_from))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
