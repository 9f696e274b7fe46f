"""Sinks: documents, frequency tables, scores, reports; all through Spark's commit protocol."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.shared import cut
from corpusmill.sources.readers import pending


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None, rows_per_file: int = 0) -> None:
    w = df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of a few rows as one JSON file; mode append keeps a log."""
    df.coalesce(1).write.mode(mode).json(path)


def append_log(spark: SparkSession, path: str, record: dict) -> None:
    """Append one record to a log that is one JSON list; the new list replaces the old one under its name when it is complete."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    disk = at.getFileSystem(spark._jsc.hadoopConfiguration())
    past = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) if disk.exists(at) else []
    draft = fs.Path(f"{path}.draft")
    out = disk.create(draft, True)
    out.write(bytearray(json.dumps([*past, record], ensure_ascii=False, indent=2).encode()))
    out.close()
    disk.delete(at, False)
    disk.rename(draft, at)


def write_pending(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write the rows whose key is not in the table at ``path`` yet, so that a job can be started again: what was written now is returned."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df = pending(df, spark.read.parquet(path), key)
    new = cut(df, "pending")
    new.write.mode("append").option("compression", "zstd").parquet(path)
    return new


def write_npy(df: DataFrame, path: str, key: str, vec: str, dim: int) -> int:
    """One local two-dimensional .npy file of the vectors in key order (for exchange); rows stream one by one, none but the current batch is held.

    Large collections stay in parquet, as (key, ARRAY<FLOAT>): :func:`write_vectors`.  Returns the number of rows.
    """
    rows = df.filter(F.size(vec) == dim)
    n = rows.count()
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (n, dim)})
        for r in rows.orderBy(key).select(vec).toLocalIterator():
            f.write(np.asarray(r[0], "<f4").tobytes())
    return n


def write_vectors(df: DataFrame, path: str, key: str, vec: str, mode: str = "overwrite") -> None:
    """A vectors table: row_id, vec ARRAY<FLOAT>, in key order inside each file."""
    v = df.select(F.col(key).cast("long").alias("row_id"), F.col(vec).cast("array<float>").alias("vec"))
    v.sortWithinPartitions("row_id").write.mode(mode).option("compression", "zstd").parquet(path)


def write_by_bucket(df: DataFrame, buckets: DataFrame, key: str, path: str) -> None:
    """One folder per output file number, see collate.file_buckets."""
    df.join(buckets, key).repartition("file").write.mode("overwrite").partitionBy("file").option("compression", "zstd").parquet(path)


def write_conllu(tokens: DataFrame, path: str) -> None:
    """CoNLL-U lines of a token table, sentences separated by a blank line, one group of documents per file."""
    n = F.col("i") - F.min("i").over(_sentence()) + 1
    head = F.when(F.col("dep") == "ROOT", 0).otherwise(F.col("head_i") - F.min("i").over(_sentence()) + 1)
    row = F.concat_ws("\t", n.cast("string"), "text", "lemma", "pos", "tag", F.lit("_"), head.cast("string"), "dep", F.lit("_"), F.lit("_"))
    sents = tokens.select("doc_id", "sent_i", "i", row.alias("r")).groupBy("doc_id", "sent_i").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("s"))
    text = F.concat(F.array_join(F.transform("s", lambda x: x["r"]), "\n"), F.lit("\n"))
    sents.select("doc_id", "sent_i", text.alias("value")).repartition("doc_id").sortWithinPartitions("doc_id", "sent_i").select("value").write.mode("overwrite").text(path)


def _sentence():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "sent_i")
