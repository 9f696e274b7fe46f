"""Filters and samples over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import code_fraction, jsonl_value, md5_mod
from corpusmill.shared import ranked, strip_ws, with_one, ws_count


def source_name(c: Column) -> Column:
    return strip_ws(F.lower(c))


def with_spec(docs: DataFrame, spec: DataFrame) -> DataFrame:
    """Documents of the configured sources with their limits; the specification is a handful of rows."""
    return docs.withColumn("name", source_name(F.col("source"))).join(F.broadcast(spec), "name").withColumn("token_count", ws_count(F.col("text")))


def long_enough() -> Column:
    return F.col("token_count") >= F.col("min_doc_tokens")


def in_domains() -> Column:
    """No list, or one of its entries stands in the metadata's domain or the URL (metadata's, else the record's)."""
    domain = F.coalesce(jsonl_value(F.col("metadata"), "$.source_domain"), F.lit(""))
    url = F.coalesce(jsonl_value(F.col("metadata"), "$.url"), F.col("url"), F.lit(""))
    hit = F.exists("domain_filter", lambda d: F.contains(domain, d) | F.contains(url, d))
    return (F.size("domain_filter") == 0) | F.coalesce(hit, F.lit(False))


def little_code() -> Column:
    """No limit, or at most that share of code; a text without characters fails a limit."""
    return F.col("max_code_fraction").isNull() | F.coalesce(code_fraction(F.col("text")) <= F.col("max_code_fraction"), F.lit(False))


def accept_by_hash(key: Column, threshold: int, seed: int = 42) -> Column:
    return md5_mod(F.concat(key.cast("string"), F.lit(str(seed)))) < threshold


def token_budget(docs: DataFrame, overshoot: float = 1.05, seed: int = 42) -> DataFrame:
    """Documents of each source in seeded order until their tokens reach int(target * overshoot), the last one included.

    ``docs``: name, doc_id, token_count, target_tokens.  The running sum is distributed, so a source may hold any share of the rows.
    """
    order = docs.select("name", "doc_id", "token_count", "target_tokens", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(str(seed)))).alias("_h"))
    summed = ranked(order, ["name"], ["_h", "doc_id"], "tokens_before", "token_count")
    return summed.filter(F.col("tokens_before") < F.floor(F.col("target_tokens") * overshoot)).drop("_h", "target_tokens")


def strides(docs: DataFrame, key: str, workers: int) -> DataFrame:
    """Worker of each row: its position in key order, modulo the workers."""
    return ranked(docs.select(key), [], [key], "position").withColumn("worker", F.col("position") % workers)


def tertile(value: Column, edges: Column) -> Column:
    """low / mid / high by two right-closed edges; ties share a bin."""
    return F.when(value.isNull(), None).when(value <= edges[0], "low").when(value <= edges[1], "mid").otherwise("high")


def with_tertiles(df: DataFrame, value: str, out: str = "tertile") -> DataFrame:
    edges = df.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_edges"))  # one row
    return with_one(df, edges).withColumn(out, tertile(F.col(value), F.col("_edges"))).drop("_edges")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of each stratum that come first by md5; Spark limits each partition before the shuffle."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def select_specs(spec: DataFrame, corpus: str | None = None, source: str | None = None) -> DataFrame:
    """Rows of a source specification by corpus or source name; an unknown name is an error."""
    out = spec
    if corpus is not None:
        out = out.filter(F.col("corpus") == corpus)
    if source is not None:
        out = out.filter(F.col("name") == source)
    if out.isEmpty():
        raise ValueError(f"no source matches corpus={corpus!r}, source={source!r}")
    return out


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order: a reservoir that doesn't depend on partitioning, a bounded heap per task."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def text_pairs(df: DataFrame, text: str, meta: list[str]) -> DataFrame:
    """text and a struct of the other columns, names in lower case; rows without text are dropped."""
    return df.filter(F.trim(text) != "").select(F.col(text).alias("text"), F.struct(*[F.col(c).alias(c.lower()) for c in meta]).alias("meta"))
