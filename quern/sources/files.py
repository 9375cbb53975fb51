"""Directory, TSV, log and watch-list readers and writers."""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import supported


def directory(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, sha256)`` of the supported files below a folder; unreadable ones are skipped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
    return rows.where(supported("path")).select("path", "content", F.sha2("content", 256).alias("sha256"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark names it, with its scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def paths(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of the supported files below a folder; their content is not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return rows.where(supported("path"))


def contents(rows: DataFrame) -> DataFrame:
    """``(path, content, sha256)`` of the files named by ``path``, read where the row is; both are null where there is none."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(path: str) -> bytes | None:
            uri = path if "://" in path or not path.startswith("file:") else "file://" + path[5:]
            fs, at = FileSystem.from_uri(uri)
            try:
                with fs.open_input_stream(at) as f:
                    return f.read()
            except OSError:
                return None

        for frame in frames:
            for a in range(0, len(frame), 64):  # few contents are held at a time
                part = frame.iloc[a : a + 64]
                data = part["path"].map(one)
                yield pd.DataFrame({"path": part["path"], "content": data})

    found = rows.select("path").mapInPandas(read, "path string, content binary")
    return found.withColumn("sha256", F.sha2("content", 256))


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(bytes, human)``."""
    n = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return n.select("bytes", human_bytes("bytes").alias("human"))


def human_bytes(column: str):
    b = F.col(column)
    unit = lambda size, name: F.concat(F.format_number(b / size, 1), F.lit(name))
    return F.when(b >= 1 << 30, unit(1 << 30, " GB")).when(b >= 1 << 20, unit(1 << 20, " MB")).when(b >= 1 << 10, unit(1 << 10, " KB")).otherwise(F.concat(b.cast("string"), F.lit(" B")))


def tsv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(id, text)`` of lines with a tab; others are skipped. ``limit`` takes the first lines that are left, in file order."""
    lines = spark.read.text(path).select(F.split("value", "\t", 2).alias("p"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"))
    rows = lines.where(F.size("p") == 2).select(F.col("p")[0].alias("id"), F.col("p")[1].alias("text"), "f", "s", "n")
    if limit is not None:  # within a split lines are numbered in order; each task keeps no more than the limit
        rows = rows.orderBy("f", "s", "n").limit(limit)
    return rows.select("id", "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, doc_id)``: of lines with four columns and a positive last one, a query's last line counts."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p"), F.monotonically_increasing_id().alias("line")).where((F.size("p") >= 4) & (F.col("p")[3].try_cast("int") > 0))
    return rows.groupBy(F.col("p")[0].alias("query_id")).agg(F.max_by(F.col("p")[2], "line").alias("doc_id"))


def with_ground_truth(passages: DataFrame, every: DataFrame, relevant: DataFrame) -> DataFrame:
    """A corpus and the relevant documents it lacks."""
    return passages.unionByName(every.join(relevant.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")).dropDuplicates(["id"])


def log_line(ts, event, detail):
    """An activity line: time, event padded to 10 characters, detail."""
    name = F.when(F.length(event) < 10, F.rpad(event, 10, " ")).otherwise(event)
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("  "), name, F.lit(" "), detail)


def log_lines(rows: DataFrame) -> DataFrame:
    """Activity lines of ``(ts, event, detail)``."""
    return rows.select("ts", log_line(F.col("ts"), F.col("event"), F.col("detail")).alias("line"))


def log_tail(lines: DataFrame, contains: str, n: int, *order: str) -> DataFrame:
    """The last ``n`` lines that contain a text in any letter case."""
    return lines.where(F.upper("line").contains(contains.upper())).orderBy(*[F.col(c).desc() for c in order]).limit(n)


class ActivityLog:
    """A log of activity in one local file of the driver; at ``most`` bytes it becomes ``.1`` and a new one begins."""

    def __init__(self, path: str, most: int = 10 << 20):
        self.path, self.most = path, most

    def append(self, event: str, detail: str, at: dt.datetime | None = None) -> None:
        if os.path.exists(self.path) and os.path.getsize(self.path) >= self.most:
            os.replace(self.path, self.path + ".1")
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(f"{at or dt.datetime.now():%Y-%m-%d %H:%M:%S}  {event:<10} {detail}\n")

    def tail(self, n: int = 0, contains: str = "") -> list[str]:
        """The last ``n`` lines (all if 0) that contain a text in any letter case."""
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            lines = [x for x in f.read().splitlines() if contains.upper() in x.upper()]
        return lines[-n:] if n > 0 else lines

    def follow(self, contains: str = "", pause: float = 0.2, stop: Callable[[], bool] = lambda: False) -> Iterator[str]:
        """Lines as they are added, until ``stop``; a log that was rotated is followed from its start."""
        at = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        rest = b""
        while True:
            ended = stop()
            size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
            if size < at:
                at, rest = 0, b""
            if size > at:
                with open(self.path, "rb") as f:
                    f.seek(at)
                    rest += f.read(size - at)
                at = size
                *whole, rest = rest.split(b"\n")
                for line in whole:
                    text = line.decode(errors="replace")
                    if contains.upper() in text.upper():
                        yield text
            if ended:
                return
            time.sleep(pause)


def duration(seconds: float) -> str:
    """A duration as people read it."""
    for least, factor, digits, unit in ((1, 1, 1, "s"), (1e-3, 1e3, 1, "ms"), (1e-6, 1e6, 1, "µs")):
        if seconds >= least:
            return f"{seconds * factor:.{digits}f}{unit}"
    return f"{seconds * 1e9:.0f}ns"


def report(results: list[dict], path: str, title: str = "Benchmark") -> str:
    """Write engines' results as a Markdown table, one column an engine, and return it.

    A result has ``name`` and ``recall``, ``p50``, ``p95``, ``p99``, ``index`` (seconds) and ``heap_mb``, or ``skipped`` with the reason.
    """
    ran = [r for r in results if not r.get("skipped")]
    figures = {"Recall@10": lambda r: f"{r['recall']:.3f}"} | {f"Query {p}": (lambda r, p=p: duration(r[p])) for p in ("p50", "p95", "p99")}
    figures |= {"Index all docs": lambda r: duration(r["index"]), "Memory (heap)": lambda r: f"{r['heap_mb']:.0f} MB"}
    lines = [f"# {title}", "", "| | " + " | ".join(r["name"] for r in ran) + " |", "|---" * (len(ran) + 1) + "|"]
    lines += [f"| {label} | " + " | ".join(of(r) for r in ran) + " |" for label, of in figures.items()]
    lines += [""] + [f"- {r['name']} skipped: {r['skipped']}" for r in results if r.get("skipped")]
    text = "\n".join(lines).rstrip() + "\n"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


class WatchList:
    """Watched folders in a JSON file."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> list[str]:
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return json.load(f)["dirs"]

    def _save(self, dirs: list[str]) -> None:
        part = self.path + ".part"
        with open(part, "w") as f:
            json.dump({"version": 1, "dirs": dirs}, f)
        os.replace(part, self.path)

    def add(self, folder: str) -> bool:
        folder = os.path.abspath(folder)
        if not os.path.isdir(folder):
            raise NotADirectoryError(folder)
        dirs = self.load()
        if folder in dirs:
            return False
        self._save([*dirs, folder])
        return True

    def remove(self, folder: str) -> bool:
        dirs = self.load()
        kept = [d for d in dirs if d != os.path.abspath(folder)]
        self._save(kept)
        return len(kept) < len(dirs)
