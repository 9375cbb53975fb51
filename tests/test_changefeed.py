import os
import random

import numpy as np

from quern.operators import changefeed
from quern.operators.changefeed import BucketedTable, applicable

SCHEMA = "seq long, op string, key string, value string"


def fold(records):
    best = {}
    for seq, op, key, value in records:
        o = (op or "").strip().lower()
        o = {"1": "put", "2": "delete"}.get(o, o)
        if o not in ("put", "delete") or not key or seq is None or (o == "delete" and value):
            continue
        if key not in best or best[key][0] < seq:
            best[key] = (seq, o, value)
    return {(k, s, v) for k, (s, o, v) in best.items() if o == "put"}


def random_feed(n, seed):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        op = r.choice(["put", "PUT ", "1", "delete", " Delete", "2", "noop", None, ""])
        key = r.choice([None, "", "hot", "hot", f"k{r.randrange(30)}", "K1"])
        value = r.choice([None, "", f"v{seq}"]) if "el" not in (op or "") and op != "2" else r.choice([None, "", "bad"])
        out.append((seq, op, key, value))
    out += r.choices(out, k=n // 3)
    r.shuffle(out)
    return out


def test_batches_in_any_order_and_again(spark, root):
    feed = random_feed(400, 1)
    t = BucketedTable(spark, root, 4)
    for i in range(0, len(feed), 200):
        t.apply(spark.createDataFrame(feed[i : i + 200], SCHEMA), f"b{i}")
    want = fold(feed)
    assert {tuple(x) for x in t.live().collect()} == want
    version = t.manifest()["version"]
    assert t.apply(spark.createDataFrame(feed[:200], SCHEMA), "b0") == version
    t.apply(spark.createDataFrame(feed[:100], SCHEMA))  # the same records under a new name
    assert {tuple(x) for x in t.live().collect()} == want


def test_only_touched_buckets_are_read_and_replaced(spark, root):
    t = BucketedTable(spark, root, 8)
    t.apply(spark.createDataFrame([(i, "put", f"k{i}", "v") for i in range(64)], SCHEMA))
    before = t.manifest()["at"]
    mine = t.get("k3")
    assert len(mine.inputFiles()) == 1 and [tuple(x) for x in mine.collect()] == [("k3", 3, "v")]
    file = mine.inputFiles()[0].rsplit("/", 1)[1]
    for e in before.values():  # other buckets' files can't even be opened
        if not e["path"].endswith(file):
            os.chmod(f"{root[7:]}/{e['path']}", 0)
            os.rename(f"{root[7:]}/{e['path']}", f"{root[7:]}/{e['path']}.away")
    t.apply(spark.createDataFrame([(100, "put", "k3", "w")], SCHEMA))
    for e in before.values():
        if not e["path"].endswith(file):
            os.rename(f"{root[7:]}/{e['path']}.away", f"{root[7:]}/{e['path']}")
            os.chmod(f"{root[7:]}/{e['path']}", 0o644)
    after = t.manifest()["at"]
    assert sum(before[b] != after[b] for b in after) == 1
    assert t.live(version=1).count() == 64 and t.get("k3").first().value == "w" and t.get("none").count() == 0 and t.get("none").inputFiles() == []
    assert t.vacuum() == 1 and t.live().count() == 64 and t.versions() == [2]


def test_bloom_filter():
    r = np.random.default_rng(0)
    h = r.integers(-(2**63), 2**63, 3000)
    bloom = changefeed.bloom_filter(h)
    assert all(changefeed.might_hold(bloom, int(x)) for x in h[:500])
    assert sum(changefeed.might_hold(bloom, int(x)) for x in r.integers(-(2**63), 2**63, 3000)) < 90
    assert not changefeed.might_hold(changefeed.bloom_filter(h[:0]), 5)


def test_buckets_split_as_they_grow(spark, root):
    t = BucketedTable(spark, root, 1, bucket_bytes=20_000)
    want = {}
    for n in range(3):
        rows = [(n * 1000 + i, "put", f"key {(i * 7 + n) % 1500}", "v" * 40) for i in range(1000)]
        want |= {k: s for s, _, k, _ in rows}
        t.apply(spark.createDataFrame(rows, SCHEMA))
    at = t.manifest()["at"]
    assert len(at) > 4 and max(e["bytes"] for e in at.values() if e) <= 20_000
    assert {x.key: x.seq for x in t.live().collect()} == want
    assert t.get("key 8").first().seq == want["key 8"]


def test_compaction_drops_tombstones(spark, root):
    t = BucketedTable(spark, root, 2)
    t.apply(spark.createDataFrame([(1, "put", "a", "x"), (2, "put", "b", "y"), (3, "delete", "a", None), (9, "delete", "c", None)], SCHEMA))
    assert t.state().count() == 3
    t.compact(5)
    assert sorted((x.key, x.deleted) for x in t.state().collect()) == [("b", False), ("c", True)]
    t.apply(spark.createDataFrame([(1, "put", "a", "x"), (6, "put", "d", "z"), (8, "put", "c", "late")], SCHEMA))  # the first was seen before
    assert sorted(x.key for x in t.live().collect()) == ["b", "d"]
    t.compact()
    assert t.state().where("deleted").count() == 0 and t.live().count() == 2


def test_a_batch_counts_in_the_order_of_its_commit(spark, root):
    a, b = BucketedTable(spark, root, 2), BucketedTable(spark, root, 2)
    for t, value in ((a, "one"), (b, "two"), (a, "three")):
        t.apply(spark.createDataFrame([(None, "put", "k", value)], SCHEMA), stamped=True)
    assert tuple(a.get("k").first()) == ("k", 3, "three")


def test_late_put_does_not_undo_a_delete(spark, root):
    t = BucketedTable(spark, root, 2)
    t.apply(spark.createDataFrame([(5, "delete", "a", None)], SCHEMA))
    t.apply(spark.createDataFrame([(4, "put", "a", "x")], SCHEMA))
    assert t.live().count() == 0


def test_empty_feed_clashing_columns_and_long_values(spark, root):
    t = BucketedTable(spark, root, 2)
    t.apply(spark.createDataFrame([], SCHEMA))
    assert t.live().count() == 0
    wide = spark.createDataFrame([(1, "put", "a", "x" * 300_000, 7, True, "b")], SCHEMA + ", bucket int, deleted boolean, b string")
    assert applicable(wide).columns == ["key", "seq", "deleted", "value"]
    t.apply(wide)
    assert t.live().collect()[0].value == "x" * 300_000


def test_second_writer_rebases(spark, root):
    a, b = BucketedTable(spark, root, 2), BucketedTable(spark, root, 2)
    a.apply(spark.createDataFrame([(1, "put", "a", "x")], SCHEMA))
    b.apply(spark.createDataFrame([(2, "put", "b", "y")], SCHEMA))
    assert a.manifest()["version"] == 2 and a.live().count() == 2
    assert not a.files.create_json("manifests/0000000002.json", {})
