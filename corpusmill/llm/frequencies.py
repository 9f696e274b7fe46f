"""Term frequencies kept up to date by signed deltas."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.shared import cut, nfc, strip_ws


def latest_rows(df: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """Of rows equal in ``keys`` (NULLs are equal), the one with the latest ``at`` (NULL is earliest); of ties the largest value, NULL last.

    The rows are placed by key once; both aggregates then run in place on plain numbers, so both are hash aggregates.
    """
    when = F.coalesce(F.col(at), F.timestamp_micros(F.lit(-62_135_596_800_000_000)))
    placed = df.select(*keys, when.alias(at), value).repartition(*keys)
    each = placed.groupBy(*keys, at).agg(F.max(value).alias(value))
    return each.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def term_deltas(rows: DataFrame, fields: Mapping[str, str], count: str, sign: str | None = None) -> DataFrame:
    """Signed change that ``rows`` make: field, term, d_count, d_rows, for every term of every field.

    ``fields`` maps a field name to its column.  ``sign`` is a column with +1 for an added and -1 for a deleted row (a
    changed row is given as both); without it all rows are added.  Rows whose count is NULL or below 1 and terms that
    are NULL or blank are dropped.  A term is its value after NFC, lower-casing and stripping.  Counts are first summed by the
    value as stored (map-side), so a hot term is one row per task, and only distinct values are normalised.
    """
    s = F.col(sign).cast("long") if sign else F.lit(1).cast("long")
    live = rows.filter(F.col(count) >= 1)
    pairs = live.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("raw")) for f, c in fields.items()])).alias("_f"),
        (F.col(count).cast("long") * s).alias("_c"), s.alias("_s"),
    )
    by_value = (
        pairs.select("_f.field", "_f.raw", "_c", "_s")
        .filter(F.col("raw").isNotNull())
        .groupBy("field", "raw")
        .agg(F.sum("_c").alias("d_count"), F.sum("_s").alias("d_rows"))
    )
    # a table of distinct values: without it the branches below would each repeat the aggregate, with their filters on every row
    by_value = cut(by_value, "values")
    plain = ~F.col("raw").rlike(r"[^\x00-\x7f]")
    # only values with non-ASCII characters visit Python
    terms = by_value.filter(plain).withColumn("term", F.col("raw")).unionByName(by_value.filter(~plain).withColumn("term", nfc("raw")))
    return (
        terms.withColumn("term", strip_ws(F.lower("term")))
        .filter(F.col("term") != "")
        .groupBy("field", "term")
        .agg(F.sum("d_count").alias("d_count"), F.sum("d_rows").alias("d_rows"))
    )


class Kept:
    """A table in ``buckets`` hash partitions under ``path``; a new version rewrites only the partitions that it changes.

    Every version is a folder of its own with a manifest that names the version of each partition, so readers of an older version and a job
    that is repeated after a failure are not disturbed; a version counts once its manifest is written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        fs, disk = self._disk(f"{path}/manifest")
        home = fs.Path(f"{path}/manifest")
        done = [x.getPath().getName() for x in disk.listStatus(home)] if disk.exists(home) else []
        self.version = max((int(x[:-5]) for x in done if x.endswith(".json")), default=0)
        rows = spark.read.schema("bucket int, version int").json(f"{path}/manifest/{self.version}.json").collect() if self.version else []
        self.at: dict[int, int] = {r["bucket"]: r["version"] for r in rows}  # at most ``buckets`` entries

    def _disk(self, path: str):
        fs = self.spark._jvm.org.apache.hadoop.fs
        return fs, fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The rows, or those of some partitions, with their ``bucket``."""
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in self.at.items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        whole = self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.path)
        parts = [whole.option("basePath", f"{self.path}/data/{v}").parquet(*[p for p in paths if p.startswith(f"{self.path}/data/{v}/")]) for v in sorted({self.at[b] for b in self.at if only is None or b in only})]
        return reduce(DataFrame.unionByName, parts)

    def replace(self, rows: DataFrame, touched: Sequence[int]) -> None:
        """Write ``rows`` (with their bucket) as the new content of the touched partitions."""
        v = self.version + 1
        out = f"{self.path}/data/{v}"
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(out)
        fs, disk = self._disk(out)
        written = {int(x.getPath().getName()[7:]) for x in disk.listStatus(fs.Path(out)) if x.getPath().getName().startswith("bucket=")}
        at = {**{b: n for b, n in self.at.items() if b not in set(touched)}, **dict.fromkeys(written, v)}
        draft = fs.Path(f"{self.path}/manifest/{v}.draft")
        file = disk.create(draft, True)
        file.write(bytearray("\n".join(json.dumps({"bucket": b, "version": n}) for b, n in sorted(at.items())) or "\n", "ascii"))
        file.close()
        disk.rename(draft, fs.Path(f"{self.path}/manifest/{v}.json"))
        self.version, self.at = v, at


def _touched(df: DataFrame, kept: Kept) -> list[int]:
    """Partitions that rows fall into; on an empty table there is nothing to spare."""
    return [] if not kept.at else [r["bucket"] for r in df.select("bucket").distinct().collect()]


def kept_counts(spark: SparkSession, path: str, buckets: int = 16) -> Kept:
    """Counts (field, term, total, n_rows) in partitions by hash of the term."""
    return Kept(spark, path, "field string, term string, total long, n_rows long", buckets)


def kept_rows(spark: SparkSession, path: str, columns: Sequence[str], buckets: int = 16) -> Kept:
    """Current rows in partitions by hash of their key: the key as 128 bits of hash, the columns counted, count and time, and the count before.

    ``had`` and ``before`` say what the row's last delivery replaced; ``gone`` marks a deleted row, which a later delivery can bring back.
    """
    return Kept(spark, path, "k1 long, k2 long, " + "".join(f"f{i} string, " for i in range(len(columns))) + "count long, at timestamp, gone boolean, had boolean, before long", buckets)


def _hashed(keys: Sequence[str]) -> list[Column]:
    """128 bits of hash of a key; NULLs, which the hash function passes over, count by their places."""
    nulls = sum((F.col(k).isNull().cast("long") * (1 << i) for i, k in enumerate(keys)), F.lit(0).cast("long"))
    return [F.xxhash64(F.lit(seed), nulls, *keys).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]


def apply_delivery(
    rows: Kept, counts: Kept, delivery: DataFrame, keys: Sequence[str], fields: Mapping[str, str], count: str = "count", at: str = "loaded_at", deleted: str | None = None
) -> None:
    """One increment (the first load is one on empty tables): brings the kept rows and the kept counts up to the delivery.

    A delivered row replaces the one of its key if it is later (NULL is earliest; of ties the larger count, NULL last); where ``deleted`` is true
    it removes it (and wins ties).  The delivery and the rows kept in the partitions it touches meet in one shuffle by key; only rows
    that were added, changed or deleted become signed deltas, and only the partitions of their terms are read and written again.
    """
    columns = list(fields.values())
    when = F.coalesce(F.col(at), F.timestamp_micros(F.lit(-62_135_596_800_000_000)))
    gone = F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)) if deleted else F.lit(False)
    new = delivery.select(*_hashed(keys), *[F.col(c).alias(f"f{i}") for i, c in enumerate(columns)], F.col(count).cast("long").alias("count"), when.alias("at"), gone.alias("gone"))
    new = new.withColumn("bucket", F.pmod("k1", F.lit(rows.buckets)).cast("int"))
    first, touched = not rows.at, _touched(new, rows)
    names = ["bucket", "k1", "k2", *[f"f{i}" for i in range(len(columns))]]
    both = new.withColumn("old", F.lit(False)).unionByName(rows.read(touched).select(*new.columns, (~F.col("gone")).alias("old")))
    # equal keys have equal counted columns, as these are part of the key
    kept = F.col("old")
    each = both.repartition("bucket", "k1").groupBy(*names, "at").agg(F.max("count").alias("count"), F.max(F.when(kept, F.col("count"))).alias("before"), F.max(kept.cast("int")).alias("had"), F.max(F.col("gone").cast("int")).alias("gone"))
    now = each.groupBy(*names).agg(F.max_by("count", "at").alias("count"), F.max_by("gone", "at").cast("boolean").alias("gone"), F.max("at").alias("at"), F.max("before").alias("before"), F.max("had").cast("boolean").alias("had"))
    rows.replace(now, touched)
    now = rows.read(None if first else touched)
    change = F.array_compact(F.array(F.when(F.col("had"), F.struct(F.lit(-1).alias("_sign"), F.col("before").alias("_n"))), F.when(~F.col("gone"), F.struct(F.lit(1).alias("_sign"), F.col("count").alias("_n")))))
    moved = now.filter(~(F.col("had") & ~F.col("gone") & F.col("count").eqNullSafe(F.col("before"))))
    signed = moved.select(*[f"f{i}" for i in range(len(columns))], F.inline(change))
    merge_into(counts, term_deltas(signed, {f: f"f{i}" for i, f in enumerate(fields)}, "_n", "_sign"))


def merge_into(counts: Kept, deltas: DataFrame) -> None:
    """Apply deltas to kept counts; terms that no row holds any more vanish."""
    d = deltas.select("field", "term", F.col("d_count").alias("total"), F.col("d_rows").alias("n_rows"), F.pmod(F.xxhash64("term"), F.lit(counts.buckets)).cast("int").alias("bucket"))
    d = cut(d.filter("total != 0 or n_rows != 0"), "deltas")
    touched = _touched(d, counts)
    both = d.unionByName(counts.read(touched).select(*d.columns))
    summed = both.repartition("bucket").groupBy("bucket", "field", "term").agg(F.sum("total").alias("total"), F.sum("n_rows").alias("n_rows"))
    counts.replace(summed.filter(F.col("n_rows") > 0), touched)


def mark_terms(counts: DataFrame, rare_at_most: int = 3, common_share: float = 0.01) -> DataFrame:
    """Marks terms: ``rare`` by summed count, ``common`` by share of the field's rows; a term may get both, as two rows.

    Returns field, term, total, n_rows, mark (NULL for useful terms).  An empty table gives an empty result.
    """
    all_rows = counts.groupBy("field").agg(F.sum("n_rows").alias("_field_rows"))  # one row per field
    m = counts.join(F.broadcast(all_rows), "field").withColumn(
        "_m",
        F.array_compact(
            F.array(
                F.when(F.col("total") <= rare_at_most, F.lit("rare")),
                F.when(F.col("n_rows") >= common_share * F.col("_field_rows"), F.lit("common")),
            )
        ),
    )
    return m.select("field", "term", "total", "n_rows", F.explode_outer("_m").alias("mark"))


def count_terms(tables: Sequence[tuple[DataFrame, Sequence[str], Mapping[str, str]]], count: str = "count", at: str = "loaded_at") -> DataFrame:
    """A recount from scratch over several tables of (rows, key columns, fields); what the increments must equal."""
    out = None
    for df, keys, fields in tables:
        d = term_deltas(latest_rows(df, keys, count, at), fields, count)
        out = d if out is None else out.unionByName(d)
    return out.groupBy("field", "term").agg(F.sum("d_count").alias("total"), F.sum("d_rows").alias("n_rows")).filter(F.col("n_rows") > 0)
