"""Association measures of word pairs, and register comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import with_one


def with_marginals(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with f (joint), f1, f2 and n; marginals are aggregates joined back by word."""
    f = pairs.groupBy(left, right).agg(F.sum("count").alias("f"))
    f1, f2 = f.groupBy(left).agg(F.sum("f").alias("f1")), f.groupBy(right).agg(F.sum("f").alias("f2"))
    return with_one(f.join(f1, left).join(f2, right), f.agg(F.sum("f").alias("n")))


def pmi(k: int = 1) -> Column:
    """log2(f^k n / (f1 f2)); k = 2 and 3 favour frequent pairs."""
    f = F.col("f").cast("double")
    return F.log2(F.pow(f, F.lit(k)) * F.col("n") / (F.col("f1").cast("double") * F.col("f2")))


def log_dice() -> Column:
    return 14 + F.log2(2 * F.col("f") / (F.col("f1") + F.col("f2")))


def delta_p() -> Column:
    """P(right | left) - P(right | not left)."""
    return F.col("f") / F.col("f1") - F.coalesce(F.try_divide(F.col("f2") - F.col("f"), F.col("n") - F.col("f1")), F.lit(0.0))


def register_contrast(a: DataFrame, b: DataFrame, keys: Sequence[str], k: int = 100) -> DataFrame:
    """The k most frequent pairs of two tables with both relative frequencies and their log ratio (0.5 added)."""
    na, nb = a.agg(F.sum("count").alias("_na")), b.agg(F.sum("count").alias("_nb"))
    both = a.withColumnRenamed("count", "count_a").join(b.withColumnRenamed("count", "count_b"), list(keys), "full").fillna(0, ["count_a", "count_b"])
    both = with_one(with_one(both, na), nb)
    ratio = F.log2(((F.col("count_a") + 0.5) / (F.col("_na") + 1)) / ((F.col("count_b") + 0.5) / (F.col("_nb") + 1)))
    return both.withColumn("log_ratio", ratio).orderBy(F.desc(F.col("count_a") + F.col("count_b")), *keys).limit(k).drop("_na", "_nb")
