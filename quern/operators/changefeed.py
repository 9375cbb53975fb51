"""Applying a change feed of puts and deletes to a bucketed copy-on-write table.

The table is a folder of Parquet files, one for each bucket of keys and sorted by key, and a series
of manifests that name them. A bucket is a prefix of the key's hash, read from its low end; a bucket
that outgrows ``bucket_bytes`` is written as several with longer prefixes, so buckets keep their
size as the table grows. A batch is combined where it is read and shuffled once, by bucket. The task
of a touched bucket reads the bucket's file as stored, merges the sorted changes into it and writes
a replacement; other buckets are not read. Then the next manifest number is claimed by an exclusive
create; readers see the old manifest or the new one, never a mixture.

Rows keep their ``seq`` and tombstones are kept as rows, so that a change that arrives late is
weighed against what the table already has: the largest ``seq`` of a key wins, whatever the order
and number of deliveries. Applying a batch again changes nothing. ``compact`` drops tombstones up to
a ``seq`` of which the caller knows that everything has arrived.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.fs import SharedFiles

STATE = "key string, seq long, deleted boolean, value string"
ROUTED = pa.schema([("bucket", pa.int32()), ("key", pa.string()), ("seq", pa.int64()), ("deleted", pa.bool_()), ("value", pa.string()), ("h", pa.int64())])
STORED = pa.schema([ROUTED.field(c) for c in ("key", "seq", "deleted", "value", "h")])
MADE = pa.schema([("was", pa.string()), ("now", pa.string()), ("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())])
#: Names of past batches that a manifest remembers, most bits of a bucket's prefix, and rows that are combined at a time before the shuffle.
REMEMBERED, MOST_BITS, COMBINED = 1000, 20, 100_000


def applicable(changes: DataFrame) -> DataFrame:
    """The records of a feed ``(seq, op, key, value)`` that apply, as ``STATE`` rows.

    ``op`` is put or delete in any letter case with blanks around it, or the codes 1 and 2. Left
    out are other ops, null or empty keys, deletes with a non-empty value and records without a
    ``seq``, which have no place in the order. A put may have a null or empty value. Further
    columns are ignored.
    """
    op = F.lower(F.regexp_replace(F.col("op"), r"^\s+|\s+$", ""))
    deleted = F.when(op.isin("put", "1"), F.lit(False)).when(op.isin("delete", "2"), F.lit(True))
    rows = changes.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), deleted.alias("deleted"), F.col("value").cast("string").alias("value"))
    return rows.where(F.col("deleted").isNotNull() & F.col("seq").isNotNull() & (F.length("key") > 0) & ~(F.col("deleted") & (F.length(F.coalesce("value", F.lit(""))) > 0)))


def newest(rows: DataFrame, *by: str) -> DataFrame:
    """One row per key: the one with the largest ``seq``.

    Two different records under one ``seq`` are settled by (deleted, value), so the result is always
    the same. The aggregation combines before the shuffle: a hot key leaves each map task as one row.
    """
    best = F.max(F.struct("seq", "deleted", "value")).alias("b")
    return rows.groupBy(*by, "key").agg(best).select(*by, "key", "b.seq", "b.deleted", "b.value")


def _newest(t: pa.Table) -> pa.Table:
    """``newest`` of an Arrow table, sorted by key."""
    order = pc.sort_indices(t, [("key", "ascending"), ("seq", "descending"), ("deleted", "descending"), ("value", "descending")])
    t = t.take(order)
    if t.num_rows > 1:
        key = t.column("key").combine_chunks()
        key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
        first = np.ones(t.num_rows, dtype=bool)
        first[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        t = t.filter(pa.array(first))
    return t


def _label(bits: int, value: int) -> str:
    return f"{bits}-{value}"


def _directory(labels: list[str]) -> np.ndarray:
    """Place, in ``labels``, of the bucket of each value of the hash's low bits."""
    parts = [tuple(map(int, l.split("-"))) for l in labels]
    most = max(bits for bits, _ in parts)
    out = np.full(1 << most, -1, dtype=np.int32)
    for place, (bits, value) in enumerate(parts):
        out[value :: 1 << bits] = place
    return out


def _store(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root if "://" in root or not root.startswith("file:") else "file://" + root[5:])


def _combiner(labels: list[str]):
    """Per run of rows, one row per key with its bucket: what the shuffle has to carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, held, size = _directory(labels), [], 0

        def combined() -> Iterator[pa.RecordBatch]:
            t = _newest(pa.Table.from_batches(held))
            at = buckets[t.column("h").to_numpy() & (len(buckets) - 1)]
            yield from t.add_column(0, ROUTED.field("bucket"), pa.array(at)).cast(ROUTED).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= COMBINED:
                yield from combined()
                held, size = [], 0
        if held:
            yield from combined()

    return run


def bloom_places(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The ``k`` places of each 64-bit hash in a filter, by double hashing."""
    a, b = h.view(np.uint64) & np.uint64(0xFFFFFFFF), h.view(np.uint64) >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def bloom_filter(h: np.ndarray, miss: float = 0.01) -> bytes:
    """A Bloom filter of 64-bit hashes as packed bits; at most a share of ``miss`` of other hashes seems to be in it."""
    bits = max(64, math.ceil(-len(h) * math.log(miss) / math.log(2) ** 2))
    marks = np.zeros(bits, dtype=bool)
    marks[bloom_places(h, bits, _functions(bits, len(h))).ravel()] = True
    return len(h).to_bytes(8, "little") + bits.to_bytes(8, "little") + np.packbits(marks).tobytes()


def _functions(bits: int, n: int) -> int:
    return max(1, round(bits / max(1, n) * math.log(2))) if n else 1


def might_hold(bloom: bytes, h: int) -> bool:
    n, bits = int.from_bytes(bloom[:8], "little"), int.from_bytes(bloom[8:16], "little")
    marks = np.frombuffer(bloom, dtype=np.uint8, offset=16)
    at = bloom_places(np.array([h], dtype=np.int64), bits, _functions(bits, n))[0].astype(np.int64)
    return bool((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all())


def _written(fs, base: str, was: str, t: pa.Table, limit: int, mark: str) -> Iterator[dict]:
    """Write a bucket's rows, sorted by key, as one file, or as several buckets where they are too large."""
    bits, value = map(int, was.split("-"))
    more = 0
    while t.nbytes > limit << more and bits + more < MOST_BITS:
        more += 1
    h = t.column("h").to_numpy()
    fs.create_dir(f"{base}/data", recursive=True)
    for low in range(1 << more):
        part = t if not more else t.filter(pa.array((h >> bits) & ((1 << more) - 1) == low))
        path = f"data/{mark}-{uuid.uuid4().hex}.parquet"
        with fs.open_output_stream(f"{base}/{path}") as out:
            pq.write_table(part, out, compression="zstd", row_group_size=64_000, write_page_index=True)
        with fs.open_output_stream(f"{base}/{path}.bloom") as out:
            out.write(bloom_filter(part.column("h").to_numpy()))
        yield {"was": was, "now": _label(bits + more, value | low << bits), "path": path, "rows": part.num_rows, "bytes": part.nbytes}


def _merger(root: str, labels: list[str], paths: dict[str, str], limit: int, mark: str, stamp: int | None):
    """Merge the changes of each touched bucket with its stored file and write its replacement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        fs, base = _store(root)
        changes = pa.Table.from_batches(held)
        at = changes.column("bucket").to_numpy()
        for place in np.unique(at):
            was = labels[place]
            rows = changes.filter(pa.array(at == place)).drop_columns("bucket")
            if stamp is not None:
                rows = rows.set_column(rows.column_names.index("seq"), STORED.field("seq"), pa.array(np.full(rows.num_rows, stamp)))
            rows = rows.select(STORED.names).cast(STORED)
            if was in paths:
                rows = pa.concat_tables([pq.read_table(f"{base}/{paths[was]}", filesystem=fs, partitioning=None).cast(STORED), rows])
            yield pa.RecordBatch.from_pylist(list(_written(fs, base, was, _newest(rows), limit, mark)), schema=MADE)

    return run


def _compactor(root: str, labels: list[str], paths: dict[str, str], limit: int, mark: str, upto: int):
    """Rewrite buckets that have tombstones with a seq of at most ``upto`` without these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        for batch in batches:
            for place in batch.column("id").to_pylist():
                was = labels[place]
                if was not in paths:
                    continue
                rows = pq.read_table(f"{base}/{paths[was]}", filesystem=fs, partitioning=None).cast(STORED)
                gone = pc.and_(rows.column("deleted"), pc.less_equal(rows.column("seq"), upto))
                if pc.any(gone).as_py():
                    yield pa.RecordBatch.from_pylist(list(_written(fs, base, was, rows.filter(pc.invert(gone)), limit, mark)), schema=MADE)

    return run


_MADE = "was string, now string, path string, rows long, bytes long"


class BucketedTable:
    """A copy-on-write table below ``root``.

    ``buckets`` is the least number of buckets that a new table starts with (rounded up to a power
    of two); it starts with more where its first batch is larger than that many ``bucket_bytes``.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8, bucket_bytes: int = 64 << 20):
        self.spark, self.root, self.least, self.limit = spark, root.rstrip("/"), buckets, bucket_bytes
        self.files = SharedFiles(spark, self.root)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """``at`` has, by bucket, the path, rows and bytes of its file, or null for one without rows yet."""
        have = self.versions()
        if not have:
            return None
        return self.files.read_json(f"manifests/{version or max(have):010d}.json")

    def _read(self, entries: list[dict | None]) -> DataFrame:
        paths = sorted(e["path"] for e in entries if e)
        if not paths:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*[f"{self.root}/{p}" for p in paths])

    def state(self, version: int | None = None) -> DataFrame:
        """All rows, with the tombstones that are still kept."""
        return self._read(list((self.manifest(version) or {"at": {}})["at"].values()))

    def live(self, version: int | None = None) -> DataFrame:
        """The current rows ``(key, seq, value)``."""
        return self.state(version).where(~F.col("deleted")).select("key", "seq", "value")

    def get(self, key: str, version: int | None = None) -> DataFrame:
        """The live row of one key, if any: the file that can have it is opened, and the row groups that can; no file if its Bloom filter rules the key out."""
        at = (self.manifest(version) or {"at": {}})["at"]
        if not at:
            return self.live(version)
        h = self.spark.range(1).select(F.xxhash64(F.lit(key)).alias("h")).first().h
        labels = list(at)
        where = _directory(labels)
        entry = at[labels[where[h & (len(where) - 1)]]]
        if entry:
            fs, base = _store(self.root)
            with fs.open_input_stream(f"{base}/{entry['path']}.bloom") as f:
                entry = entry if might_hold(f.read(), h) else None
        rows = self._read([entry])
        return rows.where((F.col("key") == key) & ~F.col("deleted")).select("key", "seq", "value")

    def _first_buckets(self, changes: DataFrame) -> dict[str, None]:
        """Empty buckets for a new table, by the optimizer's estimate of the first batch's size."""
        size = int(str(changes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        wanted = max(self.least, min(-(-size // self.limit), 1 << 14) if size < 1 << 60 else 0)
        bits = max(0, (wanted - 1).bit_length())
        return {_label(bits, v): None for v in range(1 << bits)}

    def apply(self, changes: DataFrame, batch: str | None = None, stamped: bool = False) -> int:
        """Apply one batch of changes and commit; returns the version that has it.

        ``batch`` names the batch: a name that a manifest remembers is skipped (it remembers the last
        ``REMEMBERED``; an older one is applied again, which changes nothing). If another writer commits
        first, the merge is done again on its version. With ``stamped`` the version takes the place
        of ``seq``, so that batches count in the order of their commits, whoever makes them.
        Records at or below the ``seq`` up to which the table is compacted have been seen and are left out.
        """
        name = batch or uuid.uuid4().hex
        ship(self.spark)
        rows = applicable(changes.withColumn("seq", F.lit(0)) if stamped else changes).withColumn("h", F.xxhash64("key"))
        while True:
            now = self.manifest() or {"version": 0, "at": self._first_buckets(changes), "batches": [], "horizon": None}
            if name in now["batches"]:
                return now["version"]
            version, labels = now["version"] + 1, list(now["at"])
            fresh = rows if now["horizon"] is None or stamped else rows.where(F.col("seq") > now["horizon"])
            routed = fresh.select("key", "seq", "deleted", "value", "h").mapInArrow(_combiner(labels), "bucket int, key string, seq long, deleted boolean, value string, h long")
            paths = {b: e["path"] for b, e in now["at"].items() if e}
            merged = routed.repartitionById(len(labels), "bucket").mapInArrow(_merger(self.root, labels, paths, self.limit, f"{version:010d}", version if stamped else None), _MADE)
            if self._commit(now, merged.collect(), [*now["batches"], name][-REMEMBERED:], now["horizon"]):
                return version

    def compact(self, upto: int | None = None) -> int:
        """Drop tombstones with a ``seq`` of at most ``upto`` (all by default) and return the version.

        The caller vouches that every record up to there has arrived: later ones are left out.
        Buckets without such tombstones keep their files.
        """
        ship(self.spark)
        while True:
            now = self.manifest()
            if now is None:
                return 0
            horizon = upto if upto is not None else self.state().agg(F.max("seq")).first()[0]
            if horizon is None:
                return now["version"]
            labels = list(now["at"])
            paths = {b: e["path"] for b, e in now["at"].items() if e}
            tasks = self.spark.range(0, len(labels), 1, len(labels))
            made = tasks.mapInArrow(_compactor(self.root, labels, paths, self.limit, f"{now['version'] + 1:010d}", horizon), _MADE).collect()
            if self._commit(now, made, now["batches"], max(horizon, now["horizon"] if now["horizon"] is not None else horizon)):
                return now["version"] + 1

    def _commit(self, now: dict, made: list, batches: list[str], horizon: int | None) -> bool:
        """Claim the next version for the files made; they go if another writer was first."""
        at = {b: e for b, e in now["at"].items() if b not in {m.was for m in made}}
        at |= {m.now: {"path": m.path, "rows": m.rows, "bytes": m.bytes} for m in made}
        version = now["version"] + 1
        if self.files.create_json(f"manifests/{version:010d}.json", {"version": version, "at": at, "batches": batches, "horizon": horizon}):
            return True
        for m in made:
            self.files.delete(m.path)
            self.files.delete(f"{m.path}.bloom")
        return False

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files that none of the last ``keep`` versions uses, and older manifests; returns how many data files went.

        Not to be run while another writer is at work, whose files no manifest names yet.
        """
        versions = self.versions()
        used = {e["path"].split("/")[1] for v in versions[-keep:] for e in self.manifest(v)["at"].values() if e}
        gone = [n for n in self.files.names("data") if n.removesuffix(".bloom") not in used]
        for n in gone:
            self.files.delete(f"data/{n}")
        for v in versions[:-keep]:
            self.files.delete(f"manifests/{v:010d}.json")
        return sum(not n.endswith(".bloom") for n in gone)
