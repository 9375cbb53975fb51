"""Folders of files into a search index: hash gate, readers by extension, hooks, live watch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import extension, extracted, supported
from ..operators.changefeed import BucketedTable
from ..session import written
from ..sources import files
from .search import SearchIndex


class FileIndexer:
    """Brings an index up to date with files.

    The hashes of what was indexed are kept in a table beside the index; a file is passed on only if
    its content is not what is recorded. Hashes are recorded after the documents are committed, so a run
    that failed is simply run again: indexing a file twice gives the same document.

    ``handlers`` give, by extension, a function of ``(path, content)`` rows to documents ``(id, text)`` or
    to pages ``(document_id, page, text)``; other files go through the text readers. A handler that
    fails leaves its files unrecorded and is named in the result; the rest goes on. ``skip`` is a
    condition on ``path`` that leaves files out. ``after`` is called with the result of every run.
    """

    def __init__(self, index: SearchIndex, handlers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, skip: Callable | None = None, after: Callable[[dict], None] | None = None):
        self.index, self.handlers, self.skip, self.after = index, {}, skip, after
        self.hashes = BucketedTable(index.spark, f"{index.root}/hashes")
        for ext, f in (handlers or {}).items():
            self.register(ext, f)

    def register(self, ext: str, handler: Callable[[DataFrame], DataFrame]) -> None:
        self.handlers[ext.lower()] = handler

    def changed(self, found: DataFrame) -> DataFrame:
        """Those of ``(path, content, sha256)`` whose content is not what is recorded."""
        if self.skip is not None:
            found = found.where(~self.skip(F.col("path")))
        known = self.hashes.live().select(F.col("key").alias("path"), F.col("value").alias("sha256"))
        return found.join(known, ["path", "sha256"], "left_anti")

    def run(self, folder: str, removals: bool = True) -> dict:
        """Index a folder; with ``removals`` documents of files that are gone from it are deleted. Returns counts by outcome."""
        spark = self.index.spark
        out = self.take(files.directory(spark, folder))
        if removals:
            there = files.paths(spark, folder)
            below = self.hashes.live().select(F.col("key").alias("path")).where(F.col("path").startswith(files.qualified(spark, folder) + "/"))
            out["removed"] = self.forget(below.join(there, "path", "left_anti"))
        if self.after is not None:
            self.after(out)
        return out

    def take(self, found: DataFrame) -> dict:
        """Index ``(path, content, sha256)`` as far as it is new; what is new is written once, so all steps see the same."""
        new = written(self.changed(found).withColumn("ext", extension("path")), "changed-files")
        out = {"indexed": 0, "failed": 0, "handlers_failed": []}
        if new.isEmpty():
            return out
        plain = written(extracted(new.where(~F.col("ext").isin(list(self.handlers)))), "extracted")
        self.index.add_batch(plain.where(F.col("error").isNull() & F.col("text").rlike(r"\S")).select(F.col("path").alias("id"), "text"))
        done = plain.where(F.col("error").isNull()).select("path")
        for ext, handler in self.handlers.items():
            rows = new.where(F.col("ext") == ext)
            if rows.isEmpty():
                continue
            try:
                made = handler(rows.select("path", "content"))
                (self.index.add_pages if "page" in made.columns else self.index.add_batch)(made)
                done = done.unionByName(rows.select("path"))
            except Exception as e:  # whatever a caller's handler raises
                out["handlers_failed"].append(f"{ext}: {type(e).__name__}")
        marks = written(new.join(done, "path", "left_semi").select(F.lit("put").alias("op"), F.col("path").alias("key"), F.col("sha256").alias("value")), "marks")
        self.hashes.apply(marks, stamped=True)
        out["indexed"] = marks.count()
        out["failed"] = new.count() - out["indexed"]
        return out

    def forget(self, gone: DataFrame) -> int:
        """Delete the documents and hashes of ``(path)``."""
        gone = written(gone.select("path").distinct(), "gone")
        n = gone.count()
        if n:
            self.index.delete(gone.select(F.col("path").alias("id")))
            self.hashes.apply(gone.select(F.lit("delete").alias("op"), F.col("path").alias("key"), F.lit(None).cast("string").alias("value")), stamped=True)
        return n

    def watch(self, events: DataFrame, checkpoint: str, every: str | None = None):
        """Start a query that follows a stream of file events ``(seq, op, path)``.

        Of a path the last event of a micro-batch counts. Created and written files are read and pass
        the hash gate; removed and renamed ones, and those that are no longer there, are forgotten.
        ``every`` is the time between batches; without it the query ends when all events are taken.
        A batch that is repeated after a failure changes nothing.
        """

        def batch(df: DataFrame, number: int) -> None:
            op = F.lower("op")
            kind = F.when(op.isin("create", "write"), "put").when(op.isin("remove", "rename"), "delete")
            last = df.where(supported("path") & kind.isNotNull()).groupBy("path").agg(F.max(F.struct("seq", kind.alias("kind"))).alias("b")).select("path", "b.kind")
            last = written(last, "events")
            found = written(files.contents(last.where("kind = 'put'").select("path")), "contents")
            out = self.take(found.where("content is not null"))
            out["removed"] = self.forget(last.where("kind = 'delete'").select("path").unionByName(found.where("content is null").select("path")))
            if self.after is not None:
                self.after(out)

        writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
