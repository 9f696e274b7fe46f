import gzip
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import annotate as A
from corpusmill.sources import readers as R
from corpusmill.sources import writers as W
from corpusmill.streaming import budget as B


def test_jsonl_round_trip(spark, tmp_path):
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write(json.dumps({"id": "a", "text": "t", "metadata": {"url": "u"}}) + "\n{broken\n" + json.dumps({"dolma_id": "b", "text": None, "url": "v"}) + "\n")
    df = R.read_jsonl(spark, str(tmp_path / "x.json.gz"))
    rows = {r[0]: r for r in df.select(R.document_id().alias("k"), "text", "metadata", "url").collect()}
    assert set(rows) == {"a", "b"} and json.loads(rows["a"]["metadata"]) == {"url": "u"} and rows["b"]["url"] == "v"
    W.write_jsonl(df, str(tmp_path / "out"))
    assert R.read_jsonl(spark, str(tmp_path / "out")).count() == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "m.txt").write_text("http://h/wiki/1.gz\n\nhttp://h/news/2.gz\nhttp://h/wikix/3.gz\n")
    m = R.read_manifest(spark, str(tmp_path / "m.txt"), ["wiki", "reddit"])
    assert [tuple(r) for r in m.collect()] == [("http://h/wiki/1.gz", "wiki")]
    assert R.shuffled_files(m).count() == 1


def test_csv_with_line_feeds(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,t,x\n1,"two\nlines, ""quoted""",0.5\n2,,\n')
    rows = R.read_csv(spark, str(tmp_path / "x.csv"), "k int, t string, x double").collect()
    assert rows[0]["t"] == 'two\nlines, "quoted"' and rows[1]["x"] is None
    W.write_csv(spark.createDataFrame(rows[:1]), str(tmp_path / "out"))
    assert R.read_csv(spark, str(tmp_path / "out"), "k int, t string, x double").first()["t"] == rows[0]["t"]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dir/one.txt", "é".encode())
        z.writestr("two.txt", "é".encode("latin-1"))
        z.writestr("skip.csv", "x")
    files = R.read_zip_texts(spark, str(tmp_path / "a.zip"))
    assert {tuple(r) for r in files.collect()} == {("one.txt", "é"), ("two.txt", "é")}
    index = spark.createDataFrame([("one.txt", 1), ("none.txt", 2)], "Text string, k int")
    have, missing = R.join_index(index, files, "Text")
    assert have.first()["text"] == "é" and [r["k"] for r in missing.collect()] == [2]


def test_npy_reports_and_pending(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [(r["row_id"], r["vec"]) for r in R.read_npy(spark, str(tmp_path / "v.npy")).orderBy("row_id").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    report = spark.createDataFrame([("a", 1)], "name string, n int")
    W.write_report(report, str(tmp_path / "r"))
    W.write_report(report, str(tmp_path / "r"), "append")
    assert R.read_report(spark, str(tmp_path / "r")).count() == 2
    assert [r["k"] for r in R.pending(spark.range(3).toDF("k"), spark.range(2).toDF("k"), "k").collect()] == [2]


def test_parquet_and_buckets(spark, tmp_path):
    df = spark.range(10).toDF("doc_id")
    W.write_parquet(df, str(tmp_path / "p"), rows_per_file=3)
    assert R.read_parquet(spark, str(tmp_path / "p")).count() == 10
    W.write_by_bucket(df, df.select("doc_id", F.floor(F.col("doc_id") / 4).alias("file")), "doc_id", str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["file=0", "file=1", "file=2"]


def test_conllu(spark, tmp_path):
    t = A.annotate(spark.createDataFrame([(1, "Big dogs ran. Ok")], "doc_id long, text string"))
    W.write_conllu(t, str(tmp_path / "c"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines.count("") == 2 and lines[0].startswith("1\tBig\tbig\t") and [x.split("\t")[0] for x in lines if x] == ["1", "2", "3", "1"]


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s" if i < 6 else "other", "a b c") for i in range(8)], "doc_id long, source string, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = B.documents(spark, str(tmp_path / "in"), "doc_id long, source string, text string")
    q = B.running_budget(stream, {"s": 10}, 1.0).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("kept").collect())) == [("s", i, 3, 3 * i) for i in range(4)]
    q = B.running_ngrams(stream, 2).writeStream.format("memory").queryName("grams").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("grams").collect()} == {("#", "a", 8), ("a", "b", 8), ("b", "c", 8)}


def test_urls_are_fetched_again_after_a_failure(spark, tmp_path):
    import http.server
    import threading

    body = gzip.compress(b'{"id": "a", "text": "t", "metadata": {"k": 1}}\n[1]\n{broken\n{"dolma_id": "b", "text": "u"}')
    seen: list[str] = []

    class Serve(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen.append(self.path)
            if self.path == "/gone" or (self.path == "/shaky" and seen.count("/shaky") < 2):
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body[:20] if self.path == "/short" else body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Serve)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{at}/{x}",) for x in ("ok", "shaky", "gone", "short")], "url string")
    got = R.read_urls(urls, retries=2, wait=0.01).collect()
    server.shutdown()
    by = {}
    for r in got:
        by.setdefault(r["url"].rsplit("/", 1)[1], []).append(r)
    assert [(r["id"] or r["dolma_id"], r["text"]) for r in by["ok"]] == [("a", "t"), ("b", "u")] and by["ok"][0]["metadata"] == '{"k": 1}'
    assert len(by["shaky"]) == 2 and len(by["gone"]) == len(by["short"]) == 1 and "503" in by["gone"][0]["error"] and by["short"][0]["error"]


def test_logs_and_restarts(spark, tmp_path):
    log = str(tmp_path / "log.json")
    W.append_log(spark, log, {"a": 1})
    W.append_log(spark, log, {"b": "é"})
    assert json.loads((tmp_path / "log.json").read_text()) == [{"a": 1}, {"b": "é"}]
    out = str(tmp_path / "done")
    df = spark.range(10).withColumnRenamed("id", "k")
    assert W.write_pending(df.filter("k < 4"), out, "k").count() == 4
    assert sorted(r["k"] for r in W.write_pending(df, out, "k").collect()) == list(range(4, 10))
    assert W.write_pending(df, out, "k").count() == 0 and spark.read.parquet(out).count() == 10
    assert R.in_file_order(spark.read.parquet(out)).select("file").distinct().count() >= 2


def test_npy_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([(2, [3.0, 4.0]), (1, [1.0, 2.0]), (3, None), (4, [1.0])], "k long, v array<double>")
    assert W.write_npy(df, str(tmp_path / "x.npy"), "k", "v", 2) == 2
    assert np.load(tmp_path / "x.npy").tolist() == [[1.0, 2.0], [3.0, 4.0]]
    W.write_vectors(df, str(tmp_path / "v"), "k", "v")
    assert spark.read.parquet(str(tmp_path / "v")).columns == ["row_id", "vec"]


def test_command_line(spark, data, tmp_path):
    from corpusmill import cli

    root = ["--root", str(tmp_path), "--corpus", "a"]
    spec = ["--spec", f"{data}/source_spec.parquet"]
    cli.main([*root, "sample", "--documents", f"{data}/documents.parquet", *spec], spark)
    n = spark.read.parquet(f"{tmp_path}/a/sampled").count()
    assert n > 0
    cli.main([*root, "sample", "--documents", f"{data}/documents.parquet", *spec, "--resume"], spark)
    assert spark.read.parquet(f"{tmp_path}/a/sampled").count() == n
    for command in (["preprocess", "--min-tokens", "20"], ["verify", *spec], ["parse", "--tokens-per-file", "5000"], ["collate", "--n", "2", "--keep-partials"], ["features"]):
        cli.main([*root, *command], spark)
    assert spark.read.parquet(f"{tmp_path}/a/2grams").filter("count < 2").count() == 0 < spark.read.parquet(f"{tmp_path}/a/depgrams").count()
    log = json.loads((tmp_path / "a" / "log.json").read_text())
    assert [x["command"] for x in log] == ["sample", "sample", "preprocess", "verify", "parse", "collate", "features"] and all(x["elapsed"] > 0 for x in log)


def test_stream_of_counts(spark, tmp_path):
    for i, t in enumerate(("a b a", "a b", "c")):
        spark.createDataFrame([(t,)], "text string").coalesce(1).write.parquet(str(tmp_path / "docs" / str(i)))
    docs = B.documents(spark, str(tmp_path / "docs" / "*"), "text string", files_per_trigger=1)
    assert {tuple(r) for r in B.collect_ngrams(docs, 1, str(tmp_path / "home")).collect()} == {("a", 3), ("b", 2), ("c", 1)}
