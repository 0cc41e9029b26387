"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.quality import labelled
from freshet.llm.shared import small_batches, stored, table, unused

if TYPE_CHECKING:  # Python workers don't load it
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import IsotonicRegressionModel

#: Labelled documents that the lexicon and the trees learn from at most; a third of them calibrates.
TRAIN_DOCS = 12_000
#: Entries of the learned lexicon at most, for whole words and for beginnings of longer words each.
LEXICON = 400
#: Words whose weights a task remembers; beyond it begins anew.
KNOWN = 50_000
_NOTHING = (0.0, 0.0)
#: What a term's log-likelihood ratio has to reach.
EVIDENCE = 22.0
PREFIXES = range(3, 9)
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][@$!*#0-9]+[^\W\d_]")
_SPACED = re.compile(r"(?:\b[^\W\d_][ .\-_*]){3,}")
_DOUBLED = re.compile(r"([!?])\1+")
# Second-person words of the corpus's languages, and insults known beforehand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner euch euer usted ustedes ti tus vosotros".split())
INSULTS = frozenset("idiot moron stupid dumb loser trash garbage scum pathetic worthless disgusting clown fool".split())
FEATURES = (
    "log_words", "known_density", "word_density", "word_hits", "word_weight", "start_density", "start_hits", "start_weight", "best_weight",
    "near_second_person", "second_person_density", "gap_to_second_person", "capital_rate", "shouted_words", "exclamations", "questions",
    "doubled_marks", "punctuation", "symbols", "masked_rate", "spaced_rate", "word_length",
)


def _terms(words: list[str]) -> set[str]:
    """A text's words, and with a trailing ``+`` the beginnings of longer words."""
    distinct = set(words)
    return distinct | {w[:k] + "+" for w in distinct for k in PREFIXES if len(w) > k}


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms that tell toxic texts by smoothed log odds of their document counts.

    Each task counts its own texts, Spark adds the counts up, and only the
    LEXICON strongest terms of each kind come to the driver.  Strength is the
    log-likelihood ratio of a term's counts against the share of toxic texts;
    it has to reach EVIDENCE, so that of a million terms none gets in by chance.
    """
    total = {int(r.label > 0): r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if label > 0 else clean).update(_terms(_WORD.findall((text or "").lower())))
            terms = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    counts = rows.select("text", "label").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (total[1] + 1)) - F.log((F.col("clean") + 0.5) / (total[0] + 1))
    rate = total[1] / (total[0] + total[1])
    both = F.col("toxic") + F.col("clean")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * share))).otherwise(0.0)
    strong = counts.where("toxic >= 3").withColumn("weight", weight).withColumn("strength", 2 * (part("toxic", rate) + part("clean", 1 - rate)))
    strong = strong.where(f"weight > 1.0 and strength >= {EVIDENCE}")
    best = [strong.where(F.col("term").endswith("+") == start).orderBy(F.desc("strength"), "term").limit(LEXICON).collect() for start in (False, True)]
    return {r.term: float(r.weight) for part in best for r in part}


class Featurizer:
    """Dense features of a whole text, in the order of FEATURES."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.words = {t: w for t, w in lexicon.items() if not t.endswith("+")}
        self.starts = {t[:-1]: w for t, w in lexicon.items() if t.endswith("+")}
        self.sizes = sorted({len(t) for t in self.starts})
        self.known: dict[str, tuple[float, float]] = {}

    def weights(self, word: str) -> tuple[float, float]:
        """Weight of a word, and the largest of its beginnings; remembered for up to KNOWN words."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            start = max((self.starts.get(word[:k], 0.0) for k in self.sizes if len(word) > k), default=0.0)
            got = (self.words.get(word, 0.0), start)
            got = self.known[word] = got if got != _NOTHING else _NOTHING
        return got

    def __call__(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        n = max(1, len(words))
        chars = max(1, len(text))
        table = Counter(words)
        weighed = {w: x for w in table if (x := self.weights(w)) is not _NOTHING or w in INSULTS}
        by_word = [(table[w], a) for w, (a, _) in weighed.items() if a]
        by_start = [(table[w], b) for w, (_, b) in weighed.items() if b]
        hits = sum(k for k, _ in by_word), sum(k for k, _ in by_start)
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON] if not SECOND_PERSON.isdisjoint(table) else []
        near, gap = 0, 50
        if persons and weighed:
            for i, w in enumerate(words):
                if w in weighed:
                    j = bisect_right(persons, i)
                    d = min(abs(i - persons[k]) for k in (j - 1, j) if 0 <= k < len(persons))
                    near += d <= 5
                    gap = min(gap, d)
        raw = text.split()
        shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
        marks = text.count("!"), text.count("?")
        symbols = sum(map(text.count, "#*$%&@"))
        return [
            float(np.log1p(len(words))),
            sum(table[w] for w in weighed if w in INSULTS) / n, hits[0] / n, float(np.log1p(hits[0])), sum(k * a for k, a in by_word) / n,
            hits[1] / n, float(np.log1p(hits[1])), sum(k * b for k, b in by_start) / n, max((max(x) for x in weighed.values()), default=0.0),
            near / n, len(persons) / n, float(gap), sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / chars, shouted / max(1, len(raw)), marks[0] / chars, marks[1] / chars,
            len(_DOUBLED.findall(text)) / n if sum(marks) else 0.0, sum(map(text.count, ".,;:")) / chars, symbols / chars,
            len(_MASKED.findall(text)) / n, len(_SPACED.findall(text)) / n, sum(map(len, words)) / n,
        ]


@dataclass(frozen=True)
class Model:
    """The learned lexicon, the trees and their calibration; without both labels only the share of label 1."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    share: float


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str = "text", out: str = "features") -> DataFrame:
    """Adds the dense features of every text as a vector."""
    from pyspark.ml.functions import array_to_vector

    @F.pandas_udf("array<double>")
    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Featurizer(lexicon)
        for texts in batches:
            yield pd.Series([f(t or "") for t in texts])

    return docs.withColumn(out, array_to_vector(dense(F.col(text))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: str = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2") -> Model:
    """Learns the lexicon and trees from two thirds of the labelled rows that ``where`` lets in, calibrates on the rest.

    At most TRAIN_DOCS rows, those whose doc_id hashes smallest; only their
    texts and labels are read.  With labels of one class only, or none, every
    document scores the share of label 1.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import IsotonicRegression

    small_batches(docs.sparkSession)
    rows = stored(labelled(docs, labels, label, TRAIN_DOCS, where).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3))).repartition(12))
    learn = rows.where("fold < 2")
    lexicon = learn_lexicon(learn)
    share = rows.agg(F.avg("label")).first()[0]
    if learn.select("label").distinct().count() < 2:
        return Model({}, None, None, float(share or 0.0))
    dense = stored(with_features(rows, lexicon).select("label", "fold", "features"))
    trees = GBTClassifier(maxIter=24, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=11, maxBins=48).fit(stored(dense.where("fold < 2").repartition(4)))
    scored = stored(raw_score(dense.where("fold = 2"), trees, "features", "raw").select("label", "raw"))
    return Model(lexicon, trees, IsotonicRegression(labelCol="label", featuresCol="raw").fit(scored), float(share))


def raw_score(docs: DataFrame, trees: GBTClassificationModel, features: str, out: str) -> DataFrame:
    """Adds the trees' own probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    prediction, margin, probability = unused(docs, "prediction", "margin", "probability")
    made = trees.setFeaturesCol(features).setPredictionCol(prediction).setRawPredictionCol(margin).setProbabilityCol(probability).transform(docs)
    return made.withColumn(out, F.element_at(vector_to_array(probability), 2)).drop(prediction, margin, probability)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (calibrated, 0 to 1; ties of the calibration are kept in the trees' order) and predicted to every row.

    A null text scores as an empty one.  Repeated rows stay; input columns named
    like an added one are replaced.  Only the features run in Python; trees and
    calibration are the fitted models' own expressions.
    """
    small_batches(docs.sparkSession)
    if model.trees is None:
        return docs.withColumn("score", F.lit(model.share)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    features, raw, step = unused(docs, "features", "raw", "step")
    out = raw_score(with_features(docs, model.lexicon, text, features), model.trees, features, raw)
    out = model.steps.setFeaturesCol(raw).setPredictionCol(step).transform(out)
    # no step of a few rows says 0 or 1, and a thousandth of the raw score orders the rows of one step
    one = F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), F.col(step)))
    out = out.withColumn("score", F.least(F.lit(1.0), 0.999 * one + 0.001 * F.col(raw)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(features, raw, step)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
