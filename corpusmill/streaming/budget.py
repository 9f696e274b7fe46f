"""Structured Streaming forms: n-gram counts and the token budget per source.

Batch runs don't need them; they serve collections that keep arriving.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.collate import ngrams
from corpusmill.shared import ws_count


def documents(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Files that appear in a folder; the query's checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def running_ngrams(docs: DataFrame, n: int) -> DataFrame:
    """Counts so far (complete or update mode): the partial counts of each trigger merge into the state."""
    return ngrams(docs, n).groupBy(*[f"token_{k}" for k in range(n)]).agg(F.count(F.lit(1)).alias("count"))


def collect_ngrams(docs: DataFrame, n: int, home: str) -> DataFrame:
    """Counts of all documents of a stream that has an end for now: (token_0, ..., count).

    Each trigger writes the counts of its documents under its own number, so a trigger that is repeated replaces its own counts, and no state is
    kept in memory; the counts so far are the sum over the triggers.
    """
    keys = [f"token_{k}" for k in range(n)]

    def keep(df: DataFrame, batch: int) -> None:
        ngrams(df, n).groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{home}/counts/batch={batch}")

    docs.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return docs.sparkSession.read.parquet(f"{home}/counts").groupBy(*keys).agg(F.sum("count").alias("count"))


def running_budget(docs: DataFrame, targets: dict[str, int], overshoot: float = 1.05) -> DataFrame:
    """Documents in order of arrival until a source's target is reached: source, doc_id, token_count, tokens_before.

    The state of a source is its tokens so far and whether it is finished.  Sources without a target are left out.
    """

    def accept(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, limit = (state.get[0] if state.exists else 0), int(targets[key[0]] * overshoot)
        for pdf in pdfs:
            if total >= limit:
                continue
            pdf = pdf.sort_values("doc_id", ignore_index=True)
            before = total + pdf["token_count"].cumsum() - pdf["token_count"]
            keep = before < limit
            out = pdf[keep].assign(tokens_before=before[keep])
            total += int(out["token_count"].sum())
            yield out[["source", "doc_id", "token_count", "tokens_before"]]
        state.update((total,))

    d = docs.filter(F.col("source").isin(*targets)).select("source", "doc_id", ws_count(F.col("text")).alias("token_count"))
    return d.groupBy("source").applyInPandasWithState(accept, "source string, doc_id long, token_count long, tokens_before long", "total long", "append", "NoTimeout")
