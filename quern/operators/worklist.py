"""Incremental processing with a ledger of work items.

A work item is an id together with the SHA-256 of its content. It is ``pending`` until a worker
leases it, ``leased`` until it is done or the lease runs out, and ``done`` when its result is
committed. The ledger is a folder of append-only Parquet batches; the state of an item is
folded from them, so nothing is updated in place and a lost executor or driver leaves a readable
ledger. Items are leased by shard (a hash of the id), which keeps a lease one small file however
many items it covers.

Fencing: each lease takes the next token by an exclusive create. A commit is accepted only under
the newest token of its shard; a worker that was slow and lost its lease is rejected, and what it
wrote lies in a folder that nothing refers to. Results go to a path made of shard and token, so a
retry of the same lease overwrites its own output and repeats nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fs import SharedFiles

DONE = "id string, sha256 string, order_at timestamp, order_n long"
ITEMS = "id string, request_id long, sha256 string"


def current_requests(requests: DataFrame) -> DataFrame:
    """``(id, request_id, sha256)`` of the newest readable request of each id.

    Newest is the latest ``received_at``, then the largest ``request_id``, among requests with
    non-null data; a null ``received_at`` is older than any. Ids that are null or blank are left out.
    Content is hashed first, so that only 64 characters a row are shuffled, and the aggregation
    combines before the shuffle, so a hot id costs one row per map task.
    """
    rows = requests.where(F.col("data").isNotNull() & F.col("id").rlike(r"\S")).select("id", "request_id", "received_at", F.sha2(F.col("data").cast("binary"), 256).alias("sha256"))
    best = F.max(F.struct("received_at", "request_id", "sha256")).alias("b")
    return rows.groupBy("id").agg(best).select("id", "b.request_id", "b.sha256")


def committed_marks(marks: DataFrame, runs: DataFrame) -> DataFrame:
    """Marks of successful runs as done records; a null hash withdraws what was recorded before.

    The runs table has one row per run and may be of any size: the join is left to the optimizer.
    Rows with a null path or run are left out.
    """
    good = runs.where(F.lower("status") == "committed").select("run_id").distinct()
    return marks.where(F.col("path").isNotNull()).join(good, "run_id", "left_semi").select(F.col("path").alias("id"), F.lower("sha256").alias("sha256"), F.col("marked_at").alias("order_at"), F.col("run_id").alias("order_n"))


def latest_done(done: DataFrame) -> DataFrame:
    """The recorded hash per id: the record with the latest ``(order_at, order_n)``, null where withdrawn.

    Should two records share both, the larger hash counts.
    """
    best = F.max(F.struct("order_at", "order_n", "sha256")).alias("b")
    return done.groupBy("id").agg(best).select("id", F.col("b.sha256").alias("recorded"))


class WorkLedger:
    """Ledger below ``root``. ``shards`` is fixed when it is made."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 16, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.files = SharedFiles(spark, self.root)
        self.files.create_json("meta.json", {"shards": shards})
        self.shards = self.files.read_json("meta.json")["shards"]
        self._known: dict[str, dict] = {}  # lease records never change

    # --- reading -------------------------------------------------------------------------------

    def _leases(self) -> dict[int, dict]:
        """The newest lease record of each shard, from one listing. A closed one whose batch was not logged yet, as its driver died, is logged."""
        newest = {}
        for name in self.files.names("leases"):
            if name.endswith(".json"):
                newest[int(name.split("-")[0])] = name  # names ascend by shard and token
        out = {}
        for shard, name in newest.items():
            if name not in self._known:
                self._known[name] = self.files.read_json(f"leases/{name}")
            last = self._known[name]
            if last["closed"] and not last.get("logged"):
                self._log_done(last["batch"])
                last["logged"] = True
            out[shard] = last | {"state": "closed" if last["closed"] else "leased" if last["until"] > self.clock() else "expired"}
        return out

    def lease_of(self, shard: int) -> dict | None:
        """The newest record of a shard, if any; state is leased, expired or closed."""
        return self._leases().get(shard)

    def _fold(self) -> dict:
        names = [n for n in self.files.names("folds") if n.endswith(".json")]
        return self.files.read_json(f"folds/{names[-1]}") if names else {"number": 0, "done": [], "items": []}

    def _batches(self, kind: str, fold: dict) -> list[str]:
        """Committed batches of one kind that are not folded. A batch counts once its marker exists; half-written ones do not."""
        if kind == "done":
            self._leases()
        folded = set(fold[kind])
        return [n[:-5] for n in self.files.names(f"{kind}-log") if n.endswith(".json") and n[:-5] not in folded]

    def _read(self, kind: str, schema: str) -> DataFrame:
        fold = self._fold()
        paths = [f"{kind}/{n}" for n in self._batches(kind, fold)] + ([f"folded/{fold['name']}/{kind}"] if fold["number"] else [])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _append(self, kind: str, batch: str, df: DataFrame) -> bool:
        """Write a batch to the path its name gives, then its marker. A batch that is there is left alone."""
        if self.files.exists(f"{kind}-log/{batch}.json") or batch in self._fold()[kind]:
            return False
        df.write.mode("overwrite").parquet(f"{self.root}/{kind}/{batch}")
        return self.files.create_json(f"{kind}-log/{batch}.json", {})

    def done(self) -> DataFrame:
        return self._read("done", DONE)

    def items(self) -> DataFrame:
        """Of an id that was listed repeatedly the largest request_id counts."""
        rows = self._read("items", ITEMS)
        return rows.groupBy("id").agg(F.max(F.struct("request_id", "sha256")).alias("b")).select("id", "b.request_id", "b.sha256")

    def pending(self) -> DataFrame:
        """Items ``(id, request_id, sha256)`` whose content is not what is recorded as done.

        Leased items are included: a lease holds back other workers, it does not make an item done.
        """
        return self.items().join(latest_done(self.done()), "id", "left").where(~F.col("recorded").eqNullSafe(F.col("sha256"))).select("id", "request_id", "sha256")

    def shard_of(self, column: str = "id"):
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.shards)).cast("int")

    def _log_done(self, batch: str) -> None:
        if batch not in self._fold()["done"]:
            self.files.create_json(f"done-log/{batch}.json", {})

    # --- writing -------------------------------------------------------------------------------

    def record_done(self, marks: DataFrame, batch: str) -> bool:
        """Take over what earlier runs recorded (``DONE`` columns)."""
        return self._append("done", batch, marks.select("id", "sha256", "order_at", "order_n"))

    def enqueue(self, items: DataFrame, batch: str) -> bool:
        """List items as pending; a batch name that was used is ignored, so a retry adds nothing."""
        return self._append("items", batch, items.select("id", "request_id", "sha256"))

    def lease(self, worker: str, seconds: float, most: int = 1) -> list[dict]:
        """Lease up to ``most`` free shards. An expired lease counts as free; of two workers one gets a shard."""
        now, out = self._leases(), []
        for shard in range(self.shards):
            last = now.get(shard)
            if len(out) == most or last and last["state"] == "leased":
                continue
            token = (last["token"] if last else 0) + 1
            lease = {"shard": shard, "token": token, "worker": worker, "until": self.clock() + seconds, "batch": f"s{shard:05d}-t{token:010d}", "closed": False}
            if self.files.create_json(f"leases/{shard:05d}-{token:010d}.json", lease):
                out.append(lease)
        return out

    def leased_items(self, leases: dict | list[dict]) -> DataFrame:
        """Pending items of the leased shards."""
        shards = [x["shard"] for x in ([leases] if isinstance(leases, dict) else leases)]
        return self.pending().where(self.shard_of().isin(shards) if shards else F.lit(False))

    def complete(self, lease: dict, results: DataFrame, processed: DataFrame, at) -> bool:
        """Commit a lease's results and mark its items done; False if a newer lease fenced it off.

        The commit takes the shard's next token, which a new lease would take too: only one of the
        two can have it. Should the driver die right after, the next look at the leases logs the batch.
        """
        shard, token, batch = lease["shard"], lease["token"], lease["batch"]
        last = self.lease_of(shard)
        if last["token"] != token:
            return last["closed"] and last["batch"] == batch
        results.write.mode("overwrite").parquet(f"{self.root}/results/{batch}")
        done = processed.select("id", "sha256", F.lit(at).cast("timestamp").alias("order_at"), F.lit(token).cast("long").alias("order_n"))
        done.write.mode("overwrite").parquet(f"{self.root}/done/{batch}")
        if not self.files.create_json(f"leases/{shard:05d}-{token + 1:010d}.json", lease | {"token": token + 1, "closed": True}):
            return False
        self._log_done(batch)
        return True

    def fold(self) -> int:
        """Replace all batches by their outcome, so that a look at the ledger costs the same after any number of runs; returns how many went."""
        old = self._fold()
        taken = {kind: self._batches(kind, old) for kind in ("done", "items")}
        if not any(taken.values()):
            return 0
        name = f"{old['number'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        best = F.max(F.struct("order_at", "order_n", "sha256")).alias("b")
        self.done().groupBy("id").agg(best).select("id", "b.sha256", "b.order_at", "b.order_n").write.parquet(f"{self.root}/folded/{name}/done")
        self.items().write.parquet(f"{self.root}/folded/{name}/items")
        # names that are folded stay known, so that a late retry adds nothing
        known = {kind: sorted({*old[kind], *taken[kind]}) for kind in taken}
        if not self.files.create_json(f"folds/{old['number'] + 1:010d}.json", {"number": old["number"] + 1, "name": name} | known):
            return 0
        for kind, names in taken.items():
            for n in names:
                self.files.delete(f"{kind}/{n}")
        return sum(map(len, taken.values()))

    def results(self) -> DataFrame | None:
        """All committed results; those of fenced-off workers are not among them."""
        fold = self._fold()
        committed = {*self._batches("done", fold), *fold["done"]}
        names = [n for n in self.files.names("results") if n in committed]
        return self.spark.read.parquet(*[f"{self.root}/results/{n}" for n in names]) if names else None


def listed(spark: SparkSession, root: str, requests: DataFrame, marks: DataFrame, runs: DataFrame, **how) -> WorkLedger:
    """A ledger below ``root`` that knows what committed runs marked, with the current requests listed.

    Runs that failed, were aborted or never finished leave no done records, so their items are pending again.
    """
    ledger = WorkLedger(spark, root, **how)
    ledger.record_done(committed_marks(marks, runs), "earlier-runs")
    ledger.enqueue(current_requests(requests), "current-requests")
    return ledger


def work_for_next_run(spark: SparkSession, root: str, requests: DataFrame, marks: DataFrame, runs: DataFrame, worker: str = "next-run", seconds: float = 3600.0) -> DataFrame:
    """``(id, request_id, sha256)`` that the next run must process: the items of the shards that it leases from a ledger below ``root``."""
    ledger = listed(spark, root, requests, marks, runs)
    return ledger.leased_items(ledger.lease(worker, seconds, ledger.shards))
