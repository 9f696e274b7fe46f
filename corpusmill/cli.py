"""Command line: python -m corpusmill.cli COMMAND --root FOLDER --corpus NAME [...]; each command reads what the one before it wrote."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.config import Paths, stamped
from corpusmill.functions.text import clean_text
from corpusmill.operators import annotate, collate, features, sampling, vectorops, verify
from corpusmill.session import make_session, ship
from corpusmill.shared import ws_count
from corpusmill.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the project's tables")
    p.add_argument("--corpus", default="a")
    p.add_argument("--master", default=None)
    p.add_argument("--checkpoint-dir", default=None, help="folder that all executors share")
    p.add_argument("--seed", type=int, default=42)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sample", help="documents of the configured sources up to their token targets")
    s.add_argument("--documents", required=True)
    s.add_argument("--spec", required=True)
    s.add_argument("--source", default=None)
    s.add_argument("--resume", action="store_true", help="keep what is there and add what is missing")
    s = sub.add_parser("preprocess", help="clean texts, drop short ones")
    s.add_argument("--min-tokens", type=int, default=50)
    s = sub.add_parser("verify", help="report on the clean corpus")
    s.add_argument("--spec", required=True)
    s.add_argument("--min-tokens", type=int, default=100)
    s = sub.add_parser("parse", help="token table")
    s.add_argument("--tokens-per-file", type=int, default=10_000_000)
    s.add_argument("--force", action="store_true")
    s = sub.add_parser("collate", help="n-gram and dependency counts")
    s.add_argument("--n", type=int, default=3)
    s.add_argument("--min-count", type=int, default=2)
    s.add_argument("--keep-partials", action="store_true", help="also write the counts without a floor")
    s.add_argument("--force", action="store_true")
    sub.add_parser("features", help="the features that need one document")
    s = sub.add_parser("show", help="lines of one cluster of a table with labels and vectors")
    s.add_argument("--rows", required=True)
    s.add_argument("--cluster", type=int, required=True)
    s.add_argument("--n", type=int, default=50)
    s.add_argument("--sort", choices=["centroid", "surprisal", "random"], default="centroid")
    s.add_argument("--dim", type=int, default=768)
    for f in ("pos", "dep", "prof"):
        s.add_argument(f"--filter-{f}", action="append", default=[])
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    paths = Paths(a.root)
    if spark is None:
        spark = make_session(a.master or "local[*]", checkpoint_dir=a.checkpoint_dir)
    ship(spark)
    with stamped({"command": a.command, "corpus": a.corpus}) as record:
        record.update(COMMANDS[a.command](spark, paths, a) or {})
    writers.append_log(spark, paths.report(a.corpus, "log"), record)


def _sample(spark, paths, a):
    spec = sampling.select_specs(spark.read.parquet(a.spec), corpus=a.corpus, source=a.source)
    docs = sampling.with_spec(spark.read.parquet(a.documents), spec)
    fit = docs.filter(sampling.long_enough() & sampling.in_domains() & sampling.little_code())
    kept = sampling.token_budget(fit, seed=a.seed).join(docs.select("doc_id", "text", "source"), "doc_id")
    if a.resume:
        return {"documents": writers.write_pending(kept, paths.sampled(a.corpus), "doc_id").count()}
    writers.write_parquet(kept, paths.sampled(a.corpus))
    return {"documents": spark.read.parquet(paths.sampled(a.corpus)).count()}


def _preprocess(spark, paths, a):
    docs = spark.read.parquet(paths.sampled(a.corpus)).withColumn("text", clean_text(F.col("text")))
    docs = docs.withColumn("token_count", ws_count(F.col("text")))
    writers.write_report(verify.preprocess_summary(docs, a.min_tokens), paths.report(a.corpus, "preprocess"))
    writers.write_parquet(docs.filter(F.col("token_count") >= a.min_tokens), paths.clean(a.corpus))


def _verify(spark, paths, a):
    docs = spark.read.parquet(paths.clean(a.corpus))
    writers.write_report(verify.source_stats(docs, spark.read.parquet(a.spec), a.min_tokens), paths.report(a.corpus, "sources"))
    writers.write_report(verify.flags(docs, "doc_id"), paths.report(a.corpus, "flags"))


def _parse(spark, paths, a):
    docs = spark.read.parquet(paths.clean(a.corpus))
    out = paths.tokens(a.corpus)
    if a.force or not _there(spark, out):
        buckets = collate.file_buckets(docs, a.tokens_per_file)
        writers.write_by_bucket(annotate.annotate(docs), buckets, "doc_id", out)
        writers.write_report(annotate.rejects(docs), paths.report(a.corpus, "rejects"))


def _collate(spark, paths, a):
    docs, tokens = spark.read.parquet(paths.clean(a.corpus)), spark.read.parquet(paths.tokens(a.corpus))
    grams = collate.ngram_counts(docs, a.n)
    deps = collate.count_by(collate.depgrams(tokens), collate.DEPGRAM)
    for kind, counts in ((f"{a.n}grams", grams), ("depgrams", deps)):
        out = paths.counts(a.corpus, kind)
        if not a.force and _there(spark, out):
            continue
        if a.keep_partials:
            writers.write_parquet(counts, f"{out}-partial")
            counts = spark.read.parquet(f"{out}-partial")
        writers.write_parquet(counts.filter(F.col("count") >= a.min_count), out)


def _features(spark, paths, a):
    writers.write_parquet(features.document_features(spark.read.parquet(paths.clean(a.corpus))), paths.counts(a.corpus, "features"))


def _show(spark, paths, a):
    rows = readers.read_parquet(spark, a.rows)
    show = vectorops.cluster_show(rows, a.cluster, a.sort, a.n, dim=a.dim, seed=a.seed, pos=a.filter_pos, dep=a.filter_dep, prof=a.filter_prof)
    for r in show.orderBy("number").drop("vec").toLocalIterator():
        print(r.asDict())


def _there(spark: SparkSession, path: str) -> bool:
    fs = spark._jvm.org.apache.hadoop.fs
    return fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(path, "_SUCCESS"))


COMMANDS = {"sample": _sample, "preprocess": _preprocess, "verify": _verify, "parse": _parse, "collate": _collate, "features": _features, "show": _show}

if __name__ == "__main__":
    main()
