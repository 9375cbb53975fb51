"""Change streams into a bucketed table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import supported
from ..operators.changefeed import BucketedTable
from ..sources.fs import SharedFiles


def file_events(events: DataFrame) -> DataFrame:
    """File events ``(seq, op, path, text)`` as changes: create and write put, remove and rename delete; other files are ignored."""
    op = F.lower("op")
    kind = F.when(op.isin("create", "write"), "put").when(op.isin("remove", "rename"), "delete")
    return events.where(supported("path") & kind.isNotNull()).select("seq", kind.alias("op"), F.col("path").alias("key"), F.when(kind == "put", F.col("text")).alias("value"))


def apply_stream(changes: DataFrame, into: BucketedTable, checkpoint: str, every: str | None = None):
    """Start a query that applies a stream of changes.

    A micro-batch is named by the stream, which is told apart by a mark in its checkpoint folder, and by
    its number, so one that is replayed after a failure is skipped by the table, and streams
    into one table do not clash; late and repeated records are settled by ``seq``. ``every`` is the time
    between batches; without it the query ends when all there is is taken.
    """
    marks = SharedFiles(changes.sparkSession, checkpoint)
    marks.create_json("stream.json", {"stream": uuid.uuid4().hex})
    stream = marks.read_json("stream.json")["stream"]

    def batch(df: DataFrame, number: int) -> None:
        into.apply(df, f"{stream}-{number}")

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def replayed(spark: SparkSession, source: str, schema: str, make, root: str, files_a_batch: int = 4) -> DataFrame:
    """Run a folder of Parquet files through ``apply_stream`` to its end and return the live rows."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.parquet").parquet(source)
    into = BucketedTable(spark, f"{root}/table", 8)
    apply_stream(make(stream), into, f"{root}/checkpoint").awaitTermination()
    return into.live()
