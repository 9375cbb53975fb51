"""Scanning a vector table with a set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as pds
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Vectors that a task holds while it goes through the queries.
RUN = 20_000


def scan_top(queries: DataFrame, vectors: DataFrame, k: int | None = 10, metric: str = "dot", least: float | None = None, block: int = 1024) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the best ``k`` rows of ``vectors`` for each of ``queries``, all compared; without ``k`` all rows.

    Inputs are ``(query_id, vector)`` and ``(vec_id, vector)`` of one length; null and other lengths do
    not match anything. ``vec_id`` may be a number or a string. The queries are written to the shared
    folder; each task reads them once, in blocks of which it holds one, so that their number may grow,
    and hands on only its best ``k`` per query and run of ``RUN`` vectors. For ``l2`` the score is the
    distance, smallest first; otherwise the largest first, only those above ``least``.
    Scores are rounded to 6 digits before ranking, equal ones go by id.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "queries")
    block = block if k is not None else min(block, 128)  # a batch hands on all it finds
    queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).write.parquet(path)
    uri = path if "://" in path or not path.startswith("file:") else "file://" + path[5:]

    def compared(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        s = q @ x.T
        if metric == "cosine":
            norm = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
            s = np.where(norm > 0, s / np.where(norm > 0, norm, 1), 0.0)
        elif metric == "l2":
            # the expanded square is exact enough far away, near pairs are taken again from the differences
            square = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :]
            far = np.maximum(square - 2 * s, 0.0)
            r, c = np.nonzero(far <= 1e-6 * square)
            far[r, c] = ((q[r] - x[c]) ** 2).sum(axis=1)
            s = -np.sqrt(far)
        s = np.round(s, 6)
        keep = s > least if least is not None else np.ones(s.shape, dtype=bool)
        if k is not None and k < s.shape[1]:
            keep &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        r, c = np.nonzero(keep)
        if k is not None:
            order = np.lexsort((ids[c], -s[r, c], r))  # only what may be among the best is sorted
            r, c = r[order], c[order]
            fits = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c = r[fits], c[fits]
        return pd.DataFrame({"query_id": qid[r], "vec_id": c, "score": s[r, c] * (-1.0 if metric == "l2" else 1.0)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        held: dict[int, list] = {}
        size = 0

        def answered() -> Iterator[pd.DataFrame]:
            stacked = {dim: (np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])) for dim, parts in held.items() if dim}
            places = {dim: np.unique(ids, return_inverse=True)[1] for dim, (ids, _) in stacked.items()}
            for batch in pds.dataset(root, filesystem=fs).to_batches(batch_size=block):
                column, qid = batch.column("vector"), batch.column("query_id").to_numpy()
                sizes = np.diff(column.offsets.to_numpy())
                flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
                for dim in np.intersect1d(sizes, list(stacked)).tolist():
                    which = np.flatnonzero(sizes == dim)
                    q = flat[starts[which][:, None] + np.arange(dim)]
                    ids, x = stacked[dim]
                    out = compared(places[dim], x, qid[which], q)
                    out["vec_id"] = ids[out["vec_id"].to_numpy()]
                    yield out

        for frame in frames:
            for dim, part in frame.groupby(frame["vector"].map(len)):
                held.setdefault(int(dim), []).append((part["vec_id"].to_numpy(), np.stack(part["vector"].to_numpy())))
            size += len(frame)
            if size >= RUN:
                yield from answered()
                held.clear()
                size = 0
        if size:
            yield from answered()

    kind = "string" if dict(vectors.dtypes)["vec_id"] == "string" else "long"
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("vec_id").cast(kind), F.col("vector").cast("array<double>"))
    found = rows.mapInPandas(run, f"query_id long, vec_id {kind}, score double")
    score = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
