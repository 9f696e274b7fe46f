"""Frequency tables: n-grams, dependency bigrams, their merge, marginals and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import token_array

PAD = "#"
DEPGRAM = ("head_lemma", "head_tag", "relation", "dependent_lemma", "dependent_tag")


def ngrams(docs: DataFrame, n: int, tokens: Column | None = None) -> DataFrame:
    """Every n-gram of every document, padded before its start with n - 1 marks; as many as tokens.  No shuffle."""
    t = tokens if tokens is not None else token_array(F.col("text"))
    padded = docs.select(F.concat(F.array_repeat(F.lit(PAD), n - 1), t).alias("_t")).filter(F.size("_t") >= n)
    at = padded.select("_t", F.explode(F.sequence(F.lit(0), F.size("_t") - n)).alias("_i"))
    return at.select(*[F.get("_t", F.col("_i") + k).alias(f"token_{k}") for k in range(n)])


def ngram_counts(docs: DataFrame, n: int, min_count: int = 1) -> DataFrame:
    """Frequencies; the floor applies to the whole collection's sums, never to partial ones."""
    keys = [f"token_{k}" for k in range(n)]
    return ngrams(docs, n).groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count)


def depgrams(tokens: DataFrame) -> DataFrame:
    """(head, relation, dependent) of every token but roots and punctuation; the head is in the token's row."""
    dep = tokens.filter(~F.col("dep").isin("ROOT", "punct"))
    return dep.select("doc_id", "head_lemma", "head_tag", F.col("dep").alias("relation"), F.col("lemma").alias("dependent_lemma"), F.col("tag").alias("dependent_tag"))


def approximate_top(grams: DataFrame, keys: Sequence[str], k: int = 20, kept: int = 1000) -> DataFrame:
    """The k most frequent by a sketch of ``kept`` counters a task instead of exact counts: item, count.

    Counts are never above the true ones by more than rows / kept; memory doesn't grow with the number of distinct grams.
    """
    item = F.array_join(F.array(*keys), "\t")
    return grams.agg(F.call_function("approx_top_k", item, F.lit(k), F.lit(kept)).alias("t")).select(F.inline("t"))


def count_by(df: DataFrame, keys: Sequence[str], min_count: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count)


def merge_partials(parts: DataFrame, keys: Sequence[str], min_count: int = 1) -> DataFrame:
    """Partial counts summed over shards, then held to the floor."""
    return parts.groupBy(*keys).agg(F.sum("count").alias("count")).filter(F.col("count") >= min_count)


def marginal(grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grams.groupBy(*keys).agg(F.sum("count").alias("count"))


def top(grams: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """The k most frequent, ties by key: a bounded heap per task, no full sort."""
    return grams.orderBy(F.desc("count"), *keys).limit(k)


def table_report(grams: DataFrame) -> DataFrame:
    return grams.agg(F.count(F.lit(1)).alias("n_types"), F.sum("count").alias("n_tokens"), F.max("count").alias("most"))


def file_buckets(docs: DataFrame, tokens_per_file: int) -> DataFrame:
    """Output file of each document: tokens before it, in key order, divided by the file's size."""
    from corpusmill.shared import ranked

    return ranked(docs.select("doc_id", "token_count"), [], ["doc_id"], "before", "token_count").select("doc_id", F.floor(F.col("before") / tokens_per_file).alias("file"))
