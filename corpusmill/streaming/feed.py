"""A change feed that keeps arriving: files of events are picked up once each, and the state is kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusmill.operators.changes import apply_changes, read_changes


def follow(spark: SparkSession, folder: str, schema: StructType, log: str, checkpoint: str) -> StreamingQuery:
    """Append the event files of ``folder`` to the table at ``log``, each file once, and stop when none is left.

    The log holds every change as it arrived, so that late and repeated changes need no special case: the
    state is what apply_changes makes of the log. A batch that is repeated after a failure adds repeats,
    which change nothing.
    """
    events = spark.readStream.schema(schema).parquet(folder)
    return events.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, log: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The state of the table after all changes in the log: key, content, at, row."""
    return apply_changes(None, read_changes(spark.read.parquet(log), extra))
