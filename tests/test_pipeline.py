import datetime as dt
import http.server
import json
import os
import random
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.functions import embedders as E
from quern.operators import evaluate, index
from quern.plans.pipeline import FileIndexer
from quern.plans.search import SearchIndex
from quern.sources import files


def ids(ix):
    return sorted(r.key.rsplit("/", 1)[1] for r in ix.docs.live().select("key").collect())


def test_folder_with_hash_gate_handlers_and_removal(spark, tmp_path, root):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in {"a.txt": "alpha words", "sub/b.html": "<p>beta</p>", "c.bin": "no", "d.pdf": "gamma|delta", "e.md": "skipped", "f.md": " "}.items():
        (tmp_path / "in" / name).write_text(text)
    seen = []

    def pages(rows):
        return rows.select(F.col("path").alias("document_id"), F.posexplode(F.split(F.decode("content", "UTF-8"), "[|]")).alias("page", "text"))

    def broken(rows):
        raise RuntimeError("no reader")

    ix = SearchIndex(spark, root + "/ix", lexical_only=True)
    fi = FileIndexer(ix, {".pdf": pages}, skip=lambda p: p.endswith("e.md"), after=seen.append)
    folder = str(tmp_path / "in")
    assert fi.run(folder) == {"indexed": 4, "failed": 0, "handlers_failed": [], "removed": 0}
    assert [n.split("||")[0] for n in ids(ix)] == ["a.txt", "b.html", "d.pdf", "d.pdf"]
    assert fi.run(folder)["indexed"] == 0  # the gate
    (tmp_path / "in" / "a.txt").write_text("omega")
    (tmp_path / "in" / "d.pdf").unlink()
    (tmp_path / "in" / "g.png").write_text("x")
    fi.register(".PNG", broken)
    again = fi.run(folder)
    assert (again["indexed"], again["failed"], again["removed"], again["handlers_failed"]) == (1, 1, 1, [".png: RuntimeError"]) and len(seen) == 3
    assert ids(ix) == ["a.txt", "b.html"] and ix.search("omega").count() == 1 and ix.search("gamma").count() == 0
    # the files change, and a stream of events tells so
    (tmp_path / "in" / "a.txt").write_text("newest")
    uri = files.qualified(spark, folder)
    events = [(1, "create", f"{uri}/a.txt"), (2, "write", f"{uri}/a.txt"), (3, "remove", f"{uri}/sub/b.html"), (4, "create", f"{uri}/gone.txt"), (5, "write", f"{uri}/c.bin")]
    spark.createDataFrame(events, "seq long, op string, path string").coalesce(1).write.parquet(str(tmp_path / "events"))
    fi.handlers.clear()
    fi.watch(spark.readStream.schema("seq long, op string, path string").parquet(str(tmp_path / "events")), root + "/ck").awaitTermination()
    assert seen[-1]["indexed"] == 1 and ids(ix) == ["a.txt"] and ix.search("newest").count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("kubernetes cluster")
    root, log = f"file://{tmp_path}/ix", str(tmp_path / "log")
    for args in (["index", root, str(tmp_path / "in")], ["search", root, "kubernetes"], ["status", root], ["log", root, "indexed"]):
        main([*args, "--lexical", "--log", log])
    out = capsys.readouterr().out
    assert "'indexed': 1" in out and "1.0000" in out and "1 documents, 2 terms" in out and "INDEXED    1 files" in out
    main(["delete", root, files.qualified(spark, str(tmp_path / "in")) + "/a.txt", "--lexical", "--log", log])
    main(["status", root, "--lexical"])
    assert capsys.readouterr().out.startswith("0 documents")


def test_activity_log_and_report(tmp_path):
    log = files.ActivityLog(str(tmp_path / "x.log"), most=100)
    at = dt.datetime(2025, 1, 2, 3, 4, 5)
    assert log.tail() == []
    for i in range(5):
        log.append("SEARCH", f"query {i}", at)
    assert log.tail()[-1] == "2025-01-02 03:04:05  SEARCH     query 4" and log.tail(1, "Query 3")[0].endswith("query 3")
    assert os.path.exists(log.path + ".1") and len(log.tail()) == 2
    stops = iter([False, False, True])

    def stop():
        end = next(stops)
        if not end:
            log.append("X", "followed" if log.tail()[-1].endswith("4") else "other", at)
        return end

    assert [x[-8:] for x in log.follow("FOLLOW", 0.01, stop)] == ["followed"]
    text = files.report([{"name": "a", "recall": 0.5, "p50": 0.0012, "p95": 2, "p99": 3e-6, "index": 1.25, "heap_mb": 7}, {"name": "b", "skipped": "not there"}], str(tmp_path / "r" / "t.md"))
    assert "| Recall@10 | 0.500 |" in text and "1.2ms" in text and "3.0µs" in text and "b skipped: not there" in text and files.duration(5e-9) == "5ns"


def test_first_lines_of_a_tsv(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("".join(f"{i}\ttext {i}\n" if i % 3 else "bad\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert [r.id for r in files.tsv(spark, str(tmp_path / "t.tsv"), 4).collect()] == ["1", "2", "4", "5"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lexer_stems_and_keeps_order(spark):
    df = spark.createDataFrame([(1, "Running faster, 123 numbers x 7 !"), (2, None), (None, "x")], "doc_id long, text string")
    assert {r.doc_id: r.toks for r in index.lexed(df).collect()} == {1: ["run", "faster", "123", "number", "x"], 2: []}
    assert [r.toks for r in index.lexed(df.where("doc_id = 1"), words_only=False).collect()] == [["run", "faster", ",", "123", "number", "x", "7", "!"]]


def test_figures_of_lists_and_categories(spark):
    s = "query_id long, doc_id string, rank int"
    lex, vec = spark.createDataFrame([(1, "a", 1), (2, "b", 30)], s), spark.createDataFrame([(1, "a", 9), (2, "b", 60), (3, "c", 2)], s)
    rel = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "out")], "query_id long, doc_id string")
    docs = spark.createDataFrame([(x,) for x in "abcd"], "doc_id string")
    r = evaluate.list_figures({"lex": lex, "vec": vec}, rel, docs).first()
    assert (r.queries, r.lex_10, r.lex_50, r.vec_10, r.vec_100, r.union_10, r.both_10, r.neither_50) == (4, 0.25, 0.5, 0.5, 0.75, 0.5, 0.25, 0.25)
    assert evaluate.list_figures({"lex": lex, "vec": vec}, rel.limit(0), docs).first().union_10 == 0
    kinds = rel.withColumn("category", F.when(F.col("query_id") < 3, "x").otherwise("y"))
    v = evaluate.verdicts(lex, kinds, spark.createDataFrame([(4,)], "query_id long"))
    assert {tuple(x) for x in evaluate.by_category(v).collect()} == {("x", 1, 1, 0, 0), ("y", 0, 0, 2, 1)}


def test_padded_lengths(spark):
    r = random.Random(1)
    n = [r.choice([8, 16, 24, 80, 256]) for _ in range(333)]
    got = evaluate.padded_lengths(spark.createDataFrame(list(enumerate(n)), "id long, n long").repartition(5), 64).first()
    cost = lambda v: sum(max(v[i : i + 64]) * len(v[i : i + 64]) for i in range(0, len(v), 64)) / len(v)
    o = sorted(n)
    assert (got.texts, got.p50, got.p95, got.p99, got.longest) == (333, o[166], o[315], o[328], max(n))
    assert got.mean == pytest.approx(sum(n) / 333) and got.padded_by_id == pytest.approx(cost(n)) and got.padded_by_length == pytest.approx(cost(o))


def test_http_embedder(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(500 if asked["prompt"] == "bad" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"embedding": [float(len(asked["prompt"])), 1.0]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    embed = E.http_embedder(f"http://127.0.0.1:{server.server_port}")
    got = spark.createDataFrame([("abc",), ("bad",), (None,)], "t string").select("t", embed("t").alias("v")).collect()
    server.shutdown()
    assert {r.t: r.v for r in got} == {"abc": [3.0, 1.0], "bad": None, None: [0.0, 1.0]} and E.dimensions("all-minilm") == 384


def field(number, value):
    """A protocol buffer field: bytes and strings with their length, integers as they are."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_onnx_embedder(spark, tmp_path):
    table = np.random.default_rng(0).normal(size=(6, 3)).astype(np.float32)
    shape = lambda *dims: b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
    value = lambda name, kind, *dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, shape(*dims))))
    weights = field(1, 6) + field(1, 3) + field(2, 1) + field(8, "table") + field(9, struct.pack("18f", *table.ravel()))
    node = field(1, "table") + field(1, "input_ids") + field(2, "hidden") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, weights) + field(11, value("input_ids", 7, "b", "s")) + field(12, value("hidden", 1, "b", "s", 3))
    (tmp_path / "m.onnx").write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13)))
    vocab = {t: i for i, t in enumerate(["[CLS]", "[SEP]", "[UNK]", "a", "##b", "c"])}
    got = spark.createDataFrame([("ab c",), ("a a a a a a a a",), (None,)], "t string").coalesce(1).select("t", E.onnx_embedder(str(tmp_path / "m.onnx"), vocab)("t").alias("v")).collect()
    for r in got:
        mean = table[E.WordPiece(vocab).ids(r.t)].mean(axis=0)
        assert np.allclose(r.v, mean / np.linalg.norm(mean), atol=1e-6)
