"""Ranked lexical search: MaxScore over shards of postings."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.shared import small_batches, stored, table

#: Bytes of query texts that are searched in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Postings of one shard; a document is never split.
SHARD_POSTINGS = 1 << 21
#: Documents of a shard's first stretch; each further one is four times as long.
STRETCH = 1_024
SCALE = 1_000_000_000
_TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FORWARD = "n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased, as UTF-8."""
    return _TERM.findall((text or "").encode().translate(_LOWER))


def blocks(queries: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The query rows in blocks of about ``block_bytes`` of text (a longer one alone), read one partition at a time."""
    block, size = [], 0
    for row in queries.select(item, text).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def forward(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's number of terms, and its terms of the vocabulary by number with their occurrences: (doc_id, n, terms, tfs)."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            n, terms, tfs, bounds = [], [], [], [0]
            for t in batch.column(1):
                words = terms_of(t.as_py())
                found = Counter(map(number, words))
                found.pop(None, None)
                n.append(len(words))
                terms += found.keys()
                tfs += found.values()
                bounds.append(len(terms))
            at = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(_FORWARD).fields]))


class Best:
    """The highest-scoring documents of one query so far: at most ``k``, by score and then by id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.docs = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def needed(self) -> int:
        """The least score that can still enter; a tie may, by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        if len(scores) > 4 * self.k:
            at = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, docs = scores[at], docs[at]
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]


class Shard:
    """Postings of some documents: each term's documents in ascending order with what the term adds to their scores, and the most it adds."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray) -> None:
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(terms, kind="stable")
        terms, self.doc, tfs = terms[order], doc[order], tfs[order].astype(np.int64)
        self.adds = weights[terms] * (SCALE * tfs // (1000 * tfs + 20 * m[self.doc]))
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, dtype=np.int64)
        most = np.maximum.reduceat(self.adds, first).tolist() if len(first) else []
        #: By term: the most it adds, and where its postings stand.
        self.lists = dict(zip(terms[first].tolist(), zip(most, first.tolist(), [*first[1:].tolist(), len(terms)], strict=True), strict=True))

    def search(self, query: list[int], best: Best) -> None:
        """Offers ``best`` every document of the shard that can enter it.

        The query's lists stand by ascending upper bounds; those whose bounds
        together stay below the needed score are not essential: a document of
        them alone can't enter.  Stretch by stretch the essential lists are added
        up, and the others are probed from the greatest bound down, for
        documents that can still reach the needed score.
        """
        lists = sorted(x for t in query if (x := self.lists.get(t)) and x[0] > 0)
        if not lists:
            return
        reach = np.cumsum([x[0] for x in lists]).tolist()
        a, size = 0, STRETCH
        while a < len(self.ids):
            b = min(len(self.ids), a + size)
            needed = best.needed
            essential = next((i for i, r in enumerate(reach) if r >= needed), len(lists))
            if essential == len(lists):
                return
            total = np.zeros(b - a, dtype=np.int64)
            for _, i, j in lists[essential:]:
                i, j = i + np.searchsorted(self.doc[i:j], (a, b))
                total[self.doc[i:j] - a] += self.adds[i:j]
            found = np.flatnonzero(total)
            scores = total[found]
            found += a
            for k in range(essential - 1, -1, -1):
                able = scores + reach[k] >= needed
                found, scores = found[able], scores[able]
                if not len(found):
                    break
                _, i, j = lists[k]
                at = np.searchsorted(self.doc[i:j], found)
                hit = np.flatnonzero((at < j - i) & (self.doc[i + np.minimum(at, j - i - 1)] == found))
                scores[hit] += self.adds[i + at[hit]]
            able = scores >= needed
            if able.any():
                best.offer(scores[able], self.ids[found[able]])
            a, size = b, 4 * size


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of each query row: (item, rank, doc, score), score above 0, ties by ascending id.

    N counts the documents with a term, L their terms, n one document's; a term's
    weight is floor(1000 * ln((2N + 2) / (2df + 1))), and it adds
    weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N) div L.

    Queries come in blocks of bounded bytes, whatever their number; a block's
    distinct terms and their df are all that is broadcast.  One pass over the
    texts keeps each document's counts of a block's terms; tasks invert them shard
    by shard, carry each query's best from shard to shard, and give at most k rows
    for each query, of which a window takes the first.

    Every row is a document, repeated ones too; ids are integers, rows without one
    come behind all others of their score.  Null or empty texts have no terms; a
    query row without terms gets no rows.  Query rows of one item are queries of
    their own.  Other columns are not read.
    """
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType, queries.schema[item].dataType]
    out = T.StructType([T.StructField(item, kinds[1]), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kinds[0]), T.StructField("score", T.LongType())])
    found: DataFrame | None = None
    for block in blocks(queries, item, text, block_bytes):
        asked = [sorted(set(terms_of(t))) for _, t in block]
        vocabulary = sorted({t for q in asked for t in q})
        number = {t: i for i, t in enumerate(vocabulary)}
        part = _search_block(stored(forward(docs, vocabulary, id_col, text)), [[number[t] for t in q] for q in asked], len(vocabulary), k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField(item, kinds[1])]))
        part = part.join(F.broadcast(names), "query").select(item, "rank", F.col("doc_id").cast(kinds[0]).alias(id_col), "score")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], out) if found is None else found


def _search_block(index: DataFrame, asked: list[list[int]], n_terms: int, k: int) -> DataFrame:
    sc = index.sparkSession.sparkContext
    n_docs, n_words = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(n_terms, dtype=np.int64)
    for t, c in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[t] = c
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in df.tolist()], dtype=np.int64)
    sent = sc.broadcast((asked, weights))
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = sent.value
        best = [Best(k) for _ in asked]
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= SHARD_POSTINGS:
                visit(held, asked, weights, best)
                held, size = [], 0
        visit(held, asked, weights, best)
        for a in range(0, len(best), 500):
            some = best[a : a + 500]
            query = np.repeat(np.arange(a, a + len(some)), [len(b.scores) for b in some])
            docs, scores = (np.concatenate([getattr(b, c) for b in some]) for c in ("docs", "scores"))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(docs, mask=docs == none), pa.array(scores)], names=["query", "doc_id", "score"])

    def visit(held: list[pa.RecordBatch], asked: list[list[int]], weights: np.ndarray, best: list[Best]) -> None:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        if not rows:
            return
        ids, n, terms, tfs = rows[0].columns
        ids, n = ids.fill_null(none).to_numpy(), n.to_numpy()
        counts = np.diff(terms.offsets.to_numpy())
        m = 50 + 50 * n * n_docs // n_words
        shard = Shard(ids, m, counts, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), weights)
        for query, b in zip(asked, best, strict=True):
            shard.search(query, b)

    rows = index.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tfs").where(F.size("terms") > 0)
    hits = rows.mapInArrow(run, "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS words FROM documents),
size AS (SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM size),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_WORDS.format(_LOWERED.format("coalesce(text, '')"))}) AS words FROM benchmark),
asked AS (SELECT i, item_id, unnest(words) AS term FROM q),
vocabulary AS (SELECT DISTINCT term FROM asked),
occurrence AS (SELECT r, unnest(words) AS term FROM d),
posting AS (SELECT r, term, count(*) AS tf FROM occurrence SEMI JOIN vocabulary USING (term) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, whole GROUP BY term, n_docs),
added AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_words)))) AS add FROM posting JOIN weight USING (term) JOIN size USING (r), whole),
scored AS (SELECT i, item_id, r, sum(add)::BIGINT AS score FROM asked JOIN added USING (term) GROUP BY i, item_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored JOIN size USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
