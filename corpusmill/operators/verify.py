"""Reports on a sampled and cleaned corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preprocess_summary(docs: DataFrame, min_tokens: int) -> DataFrame:
    """Documents, tokens and drops per source and in total (source NULL), in one aggregate."""
    keep = F.col("token_count") >= min_tokens
    return docs.rollup("name").agg(
        F.count_if(keep).alias("docs"), F.coalesce(F.sum(F.when(keep, F.col("token_count"))), F.lit(0)).alias("tokens"), F.count_if(~keep).alias("dropped"), F.grouping("name").cast("int").alias("is_total")
    )


def source_stats(docs: DataFrame, spec: DataFrame, min_tokens: int) -> DataFrame:
    """Per source: documents, tokens against target, mean, median, 5th and 95th percentile by index int(n * p).

    Percentiles come from the histogram of lengths, whose size is the number of distinct lengths, not of documents.
    """
    hist = docs.groupBy("name", "token_count").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("name").orderBy("token_count").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy("name")))

    def at(index):
        return F.min(F.when(F.col("_upto") > index, F.col("token_count")))

    size = F.col("_all")
    per = hist.groupBy("name").agg(
        F.first("_all").alias("docs"), F.sum(F.col("n") * F.col("token_count")).alias("tokens"),
        at(F.least(F.floor(size * 0.05), size - 1)).alias("p5"), at(F.least(F.floor(size * 0.95), size - 1)).alias("p95"),
        ((at(F.floor((size - 1) / 2)) + at(F.floor(size / 2))) / 2).alias("median"),
        F.sum(F.when(F.col("token_count") < min_tokens, F.col("n")).otherwise(0)).alias("below_min"),
    )
    share = 100 * F.col("tokens") / F.col("target_tokens")
    return per.join(F.broadcast(spec.select("name", "target_tokens")), "name").select(
        "name", "docs", "tokens", F.round(share, 2).alias("pct_of_target"), F.round(share - 100, 2).alias("deviation_pct"),
        (F.abs(share - 100) <= 5).alias("within_5pct"), F.round(F.col("tokens") / F.col("docs"), 1).alias("mean_tokens"), "median", "p5", "p95", "below_min",
    )


def flags(docs: DataFrame, key: str = "dolma_id") -> DataFrame:
    """Placeholders left, empty texts, repeated ids (NULL counts as ''), the list of issues and whether there is none."""
    per = docs.agg(
        F.count_if(F.contains("text", F.lit("|||"))).alias("pii_remaining"),
        F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty_docs"),
        (F.count(F.lit(1)) - F.count_distinct(F.coalesce(key, F.lit("")))).alias("duplicate_ids"),
    )
    issues = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.format_string(f"{c}: %d", c)) for c in ("pii_remaining", "empty_docs", "duplicate_ids")]))
    return per.withColumn("issues", F.array_join(issues, "; ")).withColumn("passed", F.size(issues) == 0)


def preview(docs: DataFrame, n: int = 10, width: int = 200, seed: int = 42) -> DataFrame:
    """n documents per source by hash order, with the start of the text on one line."""
    order = Window.partitionBy("name").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(str(seed)))), "doc_id")
    return docs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).select("name", "doc_id", F.translate(F.substring("text", 1, width), "\n", " ").alias("preview"))
