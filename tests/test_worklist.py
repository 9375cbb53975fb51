import datetime as dt
import hashlib

from quern.operators.worklist import DONE, ITEMS, WorkLedger, committed_marks, current_requests, work_for_next_run

T = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_next_run(spark, root):
    req = spark.createDataFrame(
        [(1, "a", "x", T(1)), (2, "a", "y", T(0)), (3, "b", "same", T(1)), (3, "b", "same", T(1)), (4, "c", None, T(1)), (5, " \t", "q", T(1)), (6, None, "q", T(1)), (7, "d", "", T(1)), (8, "e", "é", None), (9, "f", "t", T(2)), (10, "f", "u", T(2))],
        "request_id long, id string, data string, received_at timestamp",
    )
    marks = spark.createDataFrame(
        [(1, "a", SHA("old"), T(0)), (2, "a", SHA("x"), T(1)), (1, "b", SHA("same").upper(), T(0)), (1, "d", SHA(""), T(0)), (3, "d", None, T(1)), (1, None, "z", T(0)), (1, "e", None, T(0))],
        "run_id long, path string, sha256 string, marked_at timestamp",
    )
    runs = spark.createDataFrame([(1, "committed"), (2, "failed"), (3, "committed")], "run_id long, status string")
    got = {(r.id, r.request_id) for r in work_for_next_run(spark, root, req, marks, runs).collect()}
    assert got == {("a", 1), ("d", 7), ("e", 8), ("f", 10)}
    empty = work_for_next_run(spark, root + "/e", req.limit(0), marks.limit(0), runs.limit(0))
    assert empty.count() == 0 and empty.columns == ["id", "request_id", "sha256"]


def test_lease_expiry_fencing_and_retry(spark, root):
    now = [0.0]
    led = WorkLedger(spark, root, 2, lambda: now[0])
    items = spark.createDataFrame([(f"i{k}", k, SHA(str(k))) for k in range(20)], ITEMS)
    assert led.enqueue(items, "one") and not led.enqueue(items, "one")
    first, second = led.lease("w1", 10)[0], led.lease("w2", 10)[0]
    assert {first["shard"], second["shard"]} == {0, 1} and led.lease("w3", 10) == []
    now[0] = 11
    third = led.lease("w3", 10)[0]  # w1's lease ran out
    assert third["shard"] == first["shard"] and third["token"] > first["token"]
    mine = led.leased_items(first)
    assert not led.complete(first, mine, mine, T(5))  # fenced off
    assert led.results() is None and led.pending().count() == 20
    assert led.complete(third, mine, mine, T(5)) and led.complete(third, mine, mine, T(5))
    assert led.results().count() == 20 - led.pending().count()
    led.files.delete(f"done-log/{third['batch']}.json")  # died between the two steps
    assert WorkLedger(spark, root, 2, lambda: now[0]).pending().count() == led.leased_items(second).count()
    assert led.complete(second, led.leased_items(second), led.leased_items(second), T(6))
    assert led.pending().count() == 0 and led.results().count() == 20
    led.enqueue(spark.createDataFrame([("i3", 99, SHA("new"))], ITEMS), "two")
    assert [(r.id, r.request_id) for r in led.pending().collect()] == [("i3", 99)]
    assert led.fold() == 4 and led.fold() == 0 and led.files.names("done") == []
    assert [(r.id, r.request_id) for r in led.pending().collect()] == [("i3", 99)] and led.results().count() == 20
    assert not led.enqueue(items, "one") and led.complete(third, mine, mine, T(5))  # late retries add nothing
    assert WorkLedger(spark, root, 2, lambda: now[0]).pending().count() == 1


def test_extra_columns_and_empty(spark, root):
    req = spark.createDataFrame([(1, "a", "x", T(1), "s", "b")], "request_id long, id string, data string, received_at timestamp, sha256 string, recorded string")
    assert current_requests(req).columns == ["id", "request_id", "sha256"]
    marks = spark.createDataFrame([], "run_id long, path string, sha256 string, marked_at timestamp, status string")
    runs = spark.createDataFrame([], "run_id long, status string, path string")
    assert committed_marks(marks, runs).count() == 0
    assert WorkLedger(spark, root).pending().count() == 0 and DONE
