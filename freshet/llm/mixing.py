"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.shared import picked, row_mark, stored, table, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one bucket of a source holds on average at most; a bucket is the unit that one task sorts.
BUCKET_ROWS = 400
#: Buckets that are added up at a time before their sums are.
WIDE = 4_096


def with_size_and_weight(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size (words of the text, null: 0), quality_weight (0.05 to 1) and row_hash (of all the row's columns but maps).

    The weight is a product of five signals, each 1 for plain prose: few symbols,
    few digits, few capitals, words of 2.5 to 12 characters on average, and lines
    that aren't repeated.  Empty texts weigh 1; their size is 0.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    chars = F.greatest(F.length(clean), F.lit(1))
    share = lambda found: (F.length(clean) - F.length(F.translate(clean, found, ""))) / chars
    within = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    n_words = F.greatest(F.regexp_count(clean, F.lit(WORD)), F.lit(1))
    per_word = F.length(F.translate(clean, " \t\n\x0b\x0c\r", "")) / n_words
    lines = F.split(clean, "\n")
    signals = [
        within(1 - 4 * share("#*$%&|<>{}[]=^~_\\")),
        within(1.2 - 2 * share("0123456789")),
        within(1.3 - 2 * share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        F.when(clean == "", 1.0).otherwise(within(F.least(per_word / 2.5, 12 / F.greatest(per_word, F.lit(1.0))))),
        within(0.2 + F.size(F.array_distinct(lines)) / F.size(lines)),
    ]
    weight = signals[0]
    for x in signals[1:]:
        weight = weight * x
    return docs.withColumns({"size": F.regexp_count(clean, F.lit(WORD)).cast("long"), "quality_weight": F.greatest(F.lit(0.05), weight), "row_hash": row_mark(docs)})


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_factor: float, cap: float) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources stand in order of their code points, null last, and take the weights
    in turn, repeating.  They share ``total_factor`` times all sizes by weight;
    no target exceeds ``cap`` times its source's size, the excess goes to the
    others by weight until none is above.  Each round is one aggregate over the
    sources, of which only three numbers come to the driver.
    """
    spark = sizes.sparkSession
    by_source = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    schema = T.StructType([by_source.schema["source"], by_source.schema["source_size"], T.StructField("place", T.LongType())])
    ordered = by_source.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = stored(spark.createDataFrame(ordered, schema).withColumn("weight", w).withColumn("most", cap * F.col("source_size")))
    budget = total_factor * (placed.agg(F.sum("source_size")).first()[0] or 0)
    rate, full = 0.0, -1
    while True:  # a source is full if its share at this rate is above its cap; rates only rise, so it stays full
        capped = F.lit(rate) * F.col("weight") > F.col("most")
        held, free, n = placed.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)), F.sum(capped.cast("long"))).first()
        if not free or n == full:
            break
        rate, full = (budget - held) / free, n
    return placed.select("source", "source_size", F.least(F.lit(rate) * F.col("weight"), F.col("most")).alias("target") if free else F.col("most").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total_factor: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, source, size, quality_weight)``: adds source_size, target, epochs and taken.

    A source's target is taken as complete epochs first; the rest goes to the
    documents with the smallest keys -ln(u) / quality_weight, until their sizes
    reach it (a document that crosses the budget is taken if at least half of it
    lies inside).  u is a hash of row_hash (where the rows have none, the hash of
    all columns but maps) and of the number of a copy: equal rows are grouped
    before anything is shuffled, and come back numbered, so copies have keys of
    their own and no order of rows or partitions has a say.

    Keys are cut into buckets of equal ratio: whatever the weights, no more than
    width / e of a source's keys have logarithms within one width, so a bucket
    holds BUCKET_ROWS rows on average at most, and a source with a third of all
    rows is sorted by many tasks.  Sums of the buckets, added up in two levels,
    say in which one a source's budget ends.

    Empty documents have size 0 and take 0.  Repeated rows count as often as
    they stand.  Equal keys are ordered by hash, copy, doc_id and size.  Null
    sources are a source of their own; a null doc_id hashes like any value.
    Other columns stay; those named like an added one are replaced.
    """
    added = ["source_size", "target", "epochs", "taken"]
    own = docs.select(*[c for c in docs.columns if c not in added])
    many, copy = unused(own, "copies", "copy")
    name = F.col("row_hash") if "row_hash" in own.columns else row_mark(own)
    once = own.groupBy(*own.columns).agg(F.count("*").alias(many)).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(many))))
    once = once.select(F.struct(*own.columns).alias("row"), "doc_id", "source", "size", "quality_weight", name.alias("name"), F.col(copy).alias("copy"))
    u = (F.pmod(F.xxhash64("name", "copy", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = once.withColumn("key", -F.log(u) / F.greatest("quality_weight", F.lit(1e-6))).drop("quality_weight")
    width = min(1.0, math.e * BUCKET_ROWS / max(1, docs.count()))
    rows = rows.withColumn("bucket", F.floor(F.log("key") / width))
    targets = source_targets(docs, weights, total_factor, cap)
    plan = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))))
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("wide", F.floor(F.col("bucket") / WIDE)))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    wide = sums.groupBy("source", "wide").agg(F.sum("in_bucket").alias("in_wide"))
    wide = wide.select(F.col("source").alias("_source"), F.col("wide").alias("_wide"), F.coalesce(F.sum("in_wide").over(before("source").orderBy("wide")), F.lit(0)).alias("ahead_wide"))
    known = plan.withColumnRenamed("source", "_plan_source")
    ahead = stored(
        sums.withColumn("within", F.coalesce(F.sum("in_bucket").over(before("source", "wide").orderBy("bucket")), F.lit(0)))
        .join(wide, F.col("source").eqNullSafe(F.col("_source")) & (F.col("wide") == F.col("_wide")))
        .join(known, F.col("source").eqNullSafe(F.col("_plan_source")))
        .select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), (F.col("ahead_wide") + F.col("within")).alias("ahead"), "source_size", "target", "full", "rest")
    )
    met = rows.join(ahead, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    upto = F.col("ahead") + F.coalesce(F.sum("size").over(before("source", "bucket").orderBy("key", "name", "copy", "doc_id", "size")), F.lit(0))
    chosen = (upto + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    epochs = F.least(F.col("full") + chosen.cast("long"), F.lit(math.ceil(cap))).cast("long")
    return met.withColumn("epochs", epochs).select("row.*", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_size_and_weight(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    slim = stored(docs.select("doc_id", "source", "size", "quality_weight", "row_hash"))
    return mix(slim).select("doc_id", "size", "source_size", "target", "taken")


def stage(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns it came with.

    Rows that are equal in every column (but maps) are told apart by nothing, so
    they are taken together, as often as the mix takes all of them.
    """
    (times,) = unused(docs, "times")
    taken = mix(stored(with_size_and_weight(docs).select("doc_id", "source", "size", "quality_weight", "row_hash")))
    taken = taken.groupBy(F.col("doc_id").alias("id"), F.col("row_hash").alias("mark")).agg(F.count("*").alias("rows"), F.sum("epochs").alias(times)).where(F.col(times) > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))
    return picked(docs, stored(taken), "doc_id", times).withColumn(times, copies).select(*docs.columns)
