"""Building blocks shared by the operators: lineage cuts, distributed ranks, text normalisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import unicodedata
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Tables written by :func:`cut` inside are deleted at the end; what reads them must be done by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str = "cut", keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: survives lost executors, shortens lineage.

    ``keep`` leaves the table to the session beyond the end of a :func:`scope`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most so many rows per Arrow batch for what is computed inside: long vectors would make the default's batches large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.split(":")[-1].lstrip("/").startswith(root.split(":")[-1].lstrip("/")):
            _delete(spark, path)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank", weight: str | None = None) -> DataFrame:
    """Rank (from 0) of each row in its group, or the sum of ``weight`` over the rows before it, without gathering a group in one task.

    Rows are range-partitioned on ``group + order`` and numbered inside their partition by a running window; what earlier
    partitions hold of the same group (one row per partition and group, a distributed table) is joined and added.  A group of any
    size is spread over as many partitions as it fills; ``order`` must be unique inside a group for a fixed result.  NULL weights
    count as 0; NULLs in ``group`` are one group.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    placed = df.withColumn("_w", w).repartitionByRange(partitions_of(spark), *keys)
    placed = cut(placed.withColumn("_pid", F.spark_partition_id()), "ranked")
    held = placed.groupBy("_pid", *group).agg(F.sum("_w").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_before", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    same = F.col("_pid") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return numbered.join(held, same).select(*df.columns, (F.col("_start") + F.col("_before")).alias(out))


def with_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate, as one scalar subquery."""
    s = df.withColumn("_one", one_row.select(F.struct(*one_row.columns).alias("_one")).scalar())
    return s.withColumns({c: F.col(f"_one.{c}") for c in one_row.columns}).drop("_one")


def seeded(seed: int | str, *cols: str) -> Column:
    """A reproducible pseudo-random long for the given columns."""
    return F.xxhash64(F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; NULL stays NULL."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


def strip_ws(c: Column) -> Column:
    """Strip Unicode white space (tabs, no-break spaces and control separators too) on both sides."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def ws_count(c: Column) -> Column:
    """Number of tokens separated by Unicode white space; 0 for NULL."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")), F.lit(0)).cast("long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), component being the smallest node joined, of long edges (src, dst).

    Alternating large-star and small-star steps: the number of edges never grows, a hub's neighbours are
    rewired to its smallest one, and the number of rounds is logarithmic in practice; if they don't suffice it is an error, never an
    unfinished result.  NULL ends are dropped; an isolated node appears if it has an edge to itself.
    """
    e = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).dropna()
    loops = e.filter("u = v").select(F.col("u").alias("node")).distinct()
    e = cut(e.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u")
        small = rest.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = cut(small.filter("u != v").distinct(), "edges")
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(e)
        e = new
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = roots.unionByName(loops).distinct().join(out.select("node"), "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))


def chase(up: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Roots of a forest of pointers by doubling: (u, p) in, u's ancestor without a pointer of its own out, as (u, root).

    Rounds are logarithmic in the longest path; a path that is longer than they reach (a cycle) is an error.
    """
    up = cut(up.select("u", "p"), "up")
    for _ in range(most_rounds):
        far = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        new = cut(up.join(far, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "up")
        discard(up)
        up = new.select("u", "p")
        if new.filter("moved").isEmpty():
            return up.withColumnRenamed("p", "root")
    raise RuntimeError(f"pointers did not end in {most_rounds} rounds")
