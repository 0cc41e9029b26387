"""The live loop: a product for each cycle, made from what has come, through failures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.sources.runs import RunExistsError, pruned, publish


def with_notes(product: DataFrame, member: str, expected: Sequence[str]) -> DataFrame:
    """The product with a row for every expected member: one that brought nothing has nulls and a note, so that the answer is smaller, not absent."""
    spark = product.sparkSession
    every = spark.createDataFrame([(m,) for m in expected], f"{member} string")
    note = F.when(F.col("_came").isNull(), F.concat(F.lit("no "), F.col(member), F.lit(" in this cycle")))
    return every.join(product.withColumn("_came", F.lit(True)), member, "left").withColumn("note", note).drop("_came")


def cycle(make: Callable[[DataFrame], DataFrame], folder: str, keep: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that publishes ``make(batch)`` as a run named by the batch and deletes the oldest beyond ``keep``.

    A batch that is run again after its product was published changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        try:
            publish(make(batch), folder, number)
        except RunExistsError:
            pass
        pruned(batch.sparkSession, folder, keep)

    return step


def live(stream: DataFrame, step: Callable[[DataFrame, int], None], log: str, every: str | None = None, restarts: int = 3) -> list[str]:
    """Runs the loop and gives what made it start again.

    ``every``: the interval of the processing-time trigger; None takes all that is
    there and ends.  A batch that fails ends the stream; it is started again from
    its log, so that the same batch is the next.  A batch that fails ``restarts``
    times more in a row raises its error.
    """
    failures: list[str] = []
    last, tries = None, 0
    while True:
        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", log)
        query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        try:
            query.awaitTermination()
            return failures
        except StreamingQueryException as e:
            done = query.lastProgress["batchId"] if query.lastProgress else None
            tries = tries + 1 if done == last else 1
            last = done
            if tries > restarts:
                raise
            failures.append(str(e).splitlines()[0])
