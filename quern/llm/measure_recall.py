"""Recall of ``nearest`` against brute force: python -m quern.llm.measure_recall TABLE [SAMPLED].

Prints one JSON line: vectors, seconds, the share of the true ten nearest that were found for
SAMPLED vectors (default 2000, chosen by hash; all vectors are searched, the sample is compared),
and the share of the true pairs with a cosine of 0.9 or more.
"""

from __future__ import annotations

import json
import sys
import time

import numpy as np

from ..session import local_session
from .neighbours import nearest, usable_vectors


def main(path: str, sampled: int = 2000, cpus: int = 8) -> None:
    spark = local_session(cpus, "12g", "recall")
    vectors = spark.read.parquet(path)
    began = time.time()
    got = nearest(vectors).toPandas()
    took = time.time() - began
    rows = usable_vectors(vectors, 64).select("vec_id", "elements").dropDuplicates(["vec_id"]).toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.elements.to_numpy()).astype(np.float64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    chosen = np.random.default_rng(5).choice(len(ids), min(sampled, len(ids)), replace=False)
    found = got[got.vec_id.isin(ids[chosen])].groupby("vec_id").near_id.agg(set).to_dict()
    hits = total = close = close_hits = 0
    for a in range(0, len(chosen), 250):
        part = chosen[a : a + 250]
        s = x[part] @ x.T
        s[np.arange(len(part)), part] = -2
        top = np.argpartition(-s, 10, axis=1)[:, :10]
        for line, i in enumerate(part):
            have = found.get(ids[i], set())
            worst = s[line, top[line]].min()
            # of equally similar vectors any will do
            hits += sum(n in have for n in ids[top[line]]) if worst < 0.99999 else min(10, len(have))
            total += 10
            near = top[line][s[line, top[line]] >= 0.9]
            close, close_hits = close + len(near), close_hits + sum(n in have for n in ids[near])
    print(json.dumps({"vectors": len(ids), "seconds": round(took, 1), "sampled": len(chosen), "recall_of_ten": round(hits / max(1, total), 4), "pairs_of_0.9": int(close), "found_of_them": round(close_hits / max(1, close), 4)}))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
