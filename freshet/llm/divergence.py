"""Audit of what tells the sources of a language apart: smoothed term shares, radix-select ranking, sparse pairs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.shared import small_batches, stored, table
from freshet.llm.shingles import portions

#: Parts that a share is counted in.
UNITS = 1_000_000_000
#: Bytes of sums that a task keeps when it adds them up; of more it hands them on.
HELD_BYTES = 24 << 20
#: Rows of neighbouring terms that are paired at a time.
PAIRED_ROWS = 100_000
#: Bits and bytes of one radix round.
BITS, BYTES = 10, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts (large strings without nulls) in order, and each text's bounds in them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    a, z = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[a:z] if z > a else np.zeros(0, dtype=np.uint8)
    inside = _IN_TERM[data]
    edges = offsets[:-1] - a
    edges = edges[edges < len(data)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges] = inside[edges]  # a term doesn't go on in the next text
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]]))
    return terms, np.searchsorted(starts, offsets - a)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the documents that hold it; nulls count as ''.

    Terms are maximal runs of ASCII letters and characters beyond ASCII, only A-Z
    lower-cased.  A task adds up its documents before anything is shuffled.
    """
    small_batches(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            group, at = np.array([names.setdefault(g, len(names)) for g in groups], dtype=np.int64), 0
            for part in portions(batch.column(2)):
                held.append(counted(part, group[at : at + len(part)]))
                at += len(part)
                size += held[-1].nbytes
                if size > 2 * HELD_BYTES:
                    held = [summed(held)]
                    size = held[0].nbytes
                    if size > HELD_BYTES:
                        yield from out(held.pop(), list(names))
                        size = 0
        if held:
            yield from out(summed(held), list(names))

    def counted(texts: pa.Array, group: np.ndarray) -> pa.Table:
        """(group, term, n, docs) of some texts."""
        terms, bounds = text_terms(texts)
        coded = terms.dictionary_encode()
        k = max(1, len(coded.dictionary))
        in_text, n = np.unique(np.repeat(np.arange(len(texts)), np.diff(bounds)) * k + coded.indices.to_numpy(), return_counts=True)
        both, at = np.unique(group[in_text // k] * k + in_text % k, return_inverse=True)
        total = np.zeros(len(both), dtype=np.int64)
        np.add.at(total, at, n)
        return pa.table({"group": both // k, "term": coded.dictionary.take(pa.array(both % k)), "n": total, "docs": np.bincount(at, minlength=len(both))})

    def summed(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])

    def out(sums: pa.Table, names: list[tuple]) -> Iterator[pa.RecordBatch]:
        lang, source = (pa.array(c, pa.string()) for c in zip(*names, strict=True))
        for b in sums.to_batches(max_chunksize=20_000):
            group = b.column("group")
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), b.column("term").cast(pa.string()), b.column("n"), b.column("docs")], names=["lang", "source", "term", "n", "docs"])

    return named.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / whole) for count + 2 <= whole, exactly: a long division by thousands, so that nothing exceeds 64 bits."""
    rest, out = count + F.lit(2).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * 1000
        digit = _div(scaled, whole)
        out, rest = out * 1000 + digit, scaled - digit * whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def radix_top(df: DataFrame, keys: Sequence[str], value: str, item: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the largest values, ties by the bytes of ``item``: adds rank.

    ``df`` is read in every round, so it has to be a stored table; values are
    integers from 0, keys not null.  A round counts each group's rows by the next
    BITS of their values, from the top, and keeps the digit in which the kth row
    lies; after the last the kth value of each group is known.  Where more rows
    have it than are needed, rounds over BYTES of their items cut them in the same
    way.  A group's histogram has at most 2^BITS or 256^BYTES rows; no group is
    ever sorted but for what is left.  Rows that are equal in value and item are
    told apart by nothing: which of them stay is open.
    """
    most = df.agg(F.max(value)).first()[0]
    if most is None:
        return df.withColumn("rank", F.lit(1))
    keys = list(keys)
    top = Window.partitionBy(*keys)

    def cut(hist: DataFrame, order: Column) -> DataFrame:
        """Of each group's histogram the row that the kth row lies in, with how many of its rows are needed."""
        upto = F.sum("count").over(top.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = hist.withColumn("_upto", upto).withColumn("_need", F.least("_need", F.sum("count").over(top)))
        found = placed.where((F.col("_upto") - F.col("count") < F.col("_need")) & (F.col("_need") <= F.col("_upto")))
        return found.withColumn("_need", F.col("_need") - F.col("_upto") + F.col("count"))

    rounds = max(1, -(-int(most).bit_length() // BITS))
    state: DataFrame | None = None
    for shift in range(BITS * (rounds - 1), -1, -BITS):
        digit = F.shiftright(value, shift)
        if state is None:
            rows = df.select(*keys, digit.alias("_digit"), F.lit(k).cast("long").alias("_need"))
        else:
            rows = df.select(*keys, digit.alias("_digit"), F.shiftright(value, shift + BITS).alias("_above")).join(state.withColumnRenamed("_digit", "_above"), [*keys, "_above"])
        hist = rows.groupBy(*keys, "_digit").agg(F.count("*").alias("count"), F.first("_need").alias("_need"))
        state = stored(cut(hist, F.desc("_digit")).select(*keys, "_digit", "_need", "count"))
    last = state.select(*keys, F.col("_digit").alias("_least"), (F.col("count") > F.col("_need")).alias("_open"), "_need")
    data = F.encode(item, "utf-8")
    ties = df.join(last.where("_open"), keys).where(F.col(value) == F.col("_least"))
    ties = stored(ties.select(*keys, data.alias("_data")))
    state, settled, at = last.where("_open").select(*keys, F.lit(b"").alias("_cut"), "_need"), None, 0
    while True:
        rows = ties.withColumn("_cut", F.substring("_data", 1, at)).join(state, [*keys, "_cut"])
        hist = rows.groupBy(*keys, F.substring("_data", 1, at + BYTES).alias("_next")).agg(F.count("*").alias("count"), F.first("_need").alias("_need"))
        at += BYTES
        now = stored(cut(hist, F.asc("_next")).select(*keys, F.col("_next").alias("_cut"), "_need", "count"))
        done = (F.col("count") == F.col("_need")) | (F.octet_length("_cut") < at)
        ended = now.where(done).select(*keys, "_cut", F.lit(at).alias("_at"))
        settled = ended if settled is None else settled.unionByName(ended)
        state = now.where(~done).select(*keys, "_cut", "_need")
        if state.isEmpty():
            break
    bounds = last.select(*keys, "_least").join(settled, keys, "left")
    near = df.join(bounds, keys).where((F.col(value) > F.col("_least")) | (F.col(value) == F.col("_least")) & (F.col("_at").isNull() | (F.substring(data, F.lit(1), F.col("_at")) <= F.col("_cut"))))
    rank = F.row_number().over(top.orderBy(F.desc(value), item))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(*df.columns, "rank")


def shared_terms(counted: DataFrame) -> DataFrame:
    """(a, b, value): what terms that both of two groups hold add to their distance beyond what each adds against the other's baseline.

    ``counted(lang, term, gid, p, p0)``: the share of each term that a group holds,
    and the share of one that it doesn't.  Neighbouring rows of one term are
    paired in the task and added up by pair before they leave it, so a task gives
    a row for each pair of groups, not for each term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = defaultdict(int)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= PAIRED_ROWS:
                held = paired(held, sums, False)
                if len(sums) > PAIRED_ROWS:
                    yield out(sums)
                    sums.clear()
        paired(held, sums, True)
        yield out(sums)

    def out(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([a for a, _ in sums], [b for _, b in sums], list(sums.values()))], names=["a", "b", "value"])

    def paired(held: list[pa.RecordBatch], sums: dict, last: bool) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        if rows is None or not len(rows):
            return []
        lang, term = (rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("lang", "term"))
        run = np.append(0, np.cumsum((lang[1:] != lang[:-1]) | (term[1:] != term[:-1])))
        n = len(run) if last else int(np.searchsorted(run, run[-1]))  # the last term may go on in the next batch
        names, gid = np.unique(rows.column("gid").to_numpy()[:n], return_inverse=True)
        p, p0 = (rows.column(c).to_numpy()[:n] for c in ("p", "p0"))
        f = lambda x, y: (x - y) * (x - y) // (x + y)
        for d in range(1, n):
            i = np.flatnonzero(run[: n - d] == run[d:n])
            if not len(i):
                break
            j = i + d
            value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            pair, at = np.unique(gid[i] * len(names) + gid[j], return_inverse=True)
            total = np.zeros(len(pair), dtype=np.int64)
            np.add.at(total, at, value)
            for a, b, v in zip(names[pair // len(names)].tolist(), names[pair % len(names)].tolist(), total.tolist(), strict=True):
                sums[a, b] += v
        return rows.slice(n).to_batches()

    ordered = counted.select("lang", "term", "gid", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "gid")
    return ordered.mapInArrow(run, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 10, k: int = 10) -> DataFrame:
    """How far the sources of each language stand apart, and by which terms: (lang, source, part, item, value, rank).

    A language keeps the V terms that ``min_docs`` of its documents hold.  A kept
    term that occurs ``c`` times in a group has the share
    p = 1 + floor(10^9 (c + 2) / (N + 2V)), N the group's occurrences of kept
    terms; two shares are (p - q)^2 div (p + q) apart.  Part ``pair``: for each
    group (lang, source) every other source of the language, by the sum over all
    kept terms; part ``term``: the first ``k`` terms that a group has a larger
    share of than its language.  Values descend, ties by the item's UTF-8 bytes.

    Pairs are sparse: V times the distance of the baselines (shares of terms that
    neither holds), a correction for each count that one side has against the
    other's baseline, weighed by how many terms have that count, and one for each
    term that both hold.

    Nulls in text, lang and source are ''.  Repeated rows are documents of their
    own, other columns aren't read.  A language without kept terms has pairs of
    value 0 and no terms; a language of one source has no pairs; an empty table
    has no rows.
    """
    counts = stored(term_counts(docs))
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"))
    inside = stored(counts.drop("docs").join(kept, ["lang", "term"]))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_n"))
    of_group = inside.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    whole = lambda n: F.coalesce(F.col(n), F.lit(0)) + 2 * F.col("v")
    groups = named.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    groups = groups.select("lang", "source", "v", whole("n").alias("whole"), whole("lang_n").alias("lang_whole"))
    zero = F.lit(0).cast("long")
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("whole"))).otherwise(1)).withColumn("gid", F.monotonically_increasing_id()))
    counted = inside.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("whole")))
    counted = stored(counted.select("lang", "source", "term", "n", "gid", "p", "p0", share(F.col("lang_n"), F.col("lang_whole")).alias("q")))

    above = stored(counted.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")))
    terms = radix_top(above, ["lang", "source"], "value", "item", k).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    side = lambda s: groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "v", "whole", "p0", "gid")])
    pairs = side("a").join(side("b"), "lang").where("gid_a <> gid_b")
    base = pairs.select(F.col("gid_a").alias("a"), F.col("gid_b").alias("b"), (F.col("v_a") * distance(F.col("p0_a"), F.col("p0_b"))).alias("value"))
    # terms of one count in a group have one share: as many rows as a group has distinct counts
    by_count = counted.groupBy("lang", F.col("gid").alias("gid_a"), F.col("p").alias("p_a"), F.col("p0").alias("p0_a")).agg(F.count("*").alias("h"))
    alone = by_count.join(side("b"), "lang").where("gid_a <> gid_b")
    alone = alone.groupBy(F.col("gid_a").alias("a"), F.col("gid_b").alias("b")).agg(F.sum(F.col("h") * (distance(F.col("p_a"), F.col("p0_b")) - distance(F.col("p0_a"), F.col("p0_b")))).alias("value"))
    one_way = alone.unionByName(shared_terms(counted))
    other_way = one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")
    sums = base.unionByName(one_way).unionByName(other_way).groupBy("a", "b").agg(F.sum("value").alias("value"))
    name = lambda s: groups.select(F.col("gid").alias(s), F.col("lang").alias(f"lang_{s}"), F.col("source").alias(f"source_{s}"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    far = sums.join(name("a"), "a").join(name("b"), "b").select(F.col("lang_a").alias("lang"), F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value").withColumn("rank", rank)
    return far.unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
occurrence AS (SELECT r, lang, source, unnest(words) AS term FROM d),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM occurrence GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM counted GROUP BY lang, term HAVING sum(docs) >= 10),
of_lang AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, o.v, o.total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS whole
    FROM groups g JOIN kept k USING (lang) JOIN of_lang o USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (whole + 2 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 2)) // (total + 2 * v) AS q FROM cell),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
