"""Mixing sources to target weights: budget fitting on exact token lengths."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import cut, ranked, seeded, strip_ws

#: widest budget, in tokens, that the dynamic programme fits exactly; what is above goes by proportion first
DP_TOKENS = 1 << 16


def bpe_sizes(texts: Column, ranks_file: str, pattern: str) -> Column:
    """Token counts by a byte-level BPE given as a rank file (base64 token, rank); 0 for NULL."""

    @F.pandas_udf("long")
    def size(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in it:
            yield s.map(lambda t: 0 if t is None else len(enc.encode_ordinary(t))).astype("int64")

    return size(texts)


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers"), name)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to ``budget`` as possible from below.

    Takes the same share of every length first; what remains is filled by single documents, longest first, down to
    ``DP_TOKENS``, and the rest is a bounded knapsack solved exactly over reachable sums (bit sets, counts split into powers of two).
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    take = (counts.astype(object) * budget // total).astype(np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= DP_TOKENS:
            break
        if lengths[i]:
            k = min(int(counts[i] - take[i]), (left - DP_TOKENS + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
            take[i] += k
            left -= k * int(lengths[i])
    if left > DP_TOKENS:
        return take
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in range(len(lengths)):
        n, size, k = int(counts[i] - take[i]), int(lengths[i]), 1
        n = min(n, left // size) if size else 0
        while n > 0 and not reach >> left & 1:
            k = min(k, n)
            steps.append((i, k, reach))
            reach |= reach << (k * size) & mask
            n -= k
            k *= 2
    best = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> best & 1:
            take[i] += k
            best -= k * int(lengths[i])
    return take


_PLAN = "mix_id string, source string, length long, repeats long, extra long, target double, size long, capacity double"


def plan_mix(histogram: DataFrame, mix: DataFrame) -> DataFrame:
    """For every mix, source and length: all documents ``repeats`` times and ``extra`` of them once more.

    ``histogram``: source, length, n_docs.  ``mix``: mix_id, source, target_share, max_repeats, total_factor.  The target is
    target_share * total_factor * (summed size of all sources of the mix).  A source whose capacity (size * max_repeats) is
    below its target gives its whole capacity.  A source without documents gives one row of length NULL and size 0.
    One group holds the distinct lengths of one source, never its documents.
    """
    sizes = histogram.groupBy("source").agg(F.sum(F.col("length") * F.col("n_docs")).alias("size"))
    m = (
        mix.select("mix_id", strip_ws(F.lower("source")).alias("source"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("target_share", "max_repeats", "total_factor")])
        .join(sizes, "source", "left")
        .withColumn("size", F.coalesce("size", F.lit(0)))
    )
    whole = m.groupBy("mix_id").agg(F.sum("size").alias("mix_size"))
    m = m.join(whole, "mix_id").withColumn("target", F.col("target_share") * F.col("total_factor") * F.col("mix_size"))
    full = m.join(histogram, "source", "left").select("mix_id", "source", "length", "n_docs", "target", "size", "max_repeats")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        target, size, most = float(pdf["target"].iloc[0]), int(pdf["size"].iloc[0]), int(pdf["max_repeats"].iloc[0])
        pdf = pdf.sort_values("length")
        n = pdf["n_docs"].fillna(0).to_numpy(np.int64)
        lengths = pdf["length"].fillna(0).to_numpy(np.int64)
        times = most if size * most <= target else min(most, int(target // size)) if size else 0
        extra = np.zeros(len(n), np.int64)
        if times < most:
            extra = fit_budget(lengths, n, int(target) - times * size)
        return pd.DataFrame({"mix_id": pdf["mix_id"], "source": pdf["source"], "length": pdf["length"].astype("Int64"), "repeats": times, "extra": extra, "target": target, "size": size, "capacity": float(size * most)})

    return full.groupBy("mix_id", "source").applyInPandas(solve, _PLAN)


def mix_report(histogram: DataFrame, mix: DataFrame) -> DataFrame:
    """Target, capacity, planned tokens, actual share and unmet, by mix and source.

    ``unmet``: the plan uses every document as often as it may (its tokens reach the capacity) and still stays below the target.
    """
    plan = plan_mix(histogram, mix)
    got = F.coalesce(F.col("length") * (F.col("repeats") * F.col("n_docs") + F.col("extra")), F.lit(0))
    per = (
        plan.join(histogram, ["source", "length"], "left")
        .groupBy("mix_id", "source")
        .agg(F.first("target").alias("target"), F.first("size").alias("size"), F.first("capacity").alias("capacity"), F.sum(got).alias("tokens"))
    )
    all_tokens = per.groupBy("mix_id").agg(F.sum("tokens").alias("_all"))
    return per.join(all_tokens, "mix_id").select(
        "mix_id", "source", "target", "size", "capacity", "tokens",
        F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).alias("actual_share"),
        ((F.col("tokens") >= F.col("capacity")) & (F.col("tokens") < F.col("target"))).alias("unmet"),
    )


def sized(docs: DataFrame, size: Callable[[Column], Column] | Column, source: str = "source", key: str = "doc_id") -> DataFrame:
    """key, source (stripped, lower-cased; rows without one are left out) and length of every document."""
    c = size(F.col("text")) if callable(size) else size
    return docs.select(F.col(key).alias("key"), strip_ws(F.lower(F.col(source))).alias("source"), c.alias("length")).filter(F.col("source") != "")


def length_histogram(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n_docs"))


def mix_sources(docs: DataFrame, mix: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Select documents for every mix; returns (selection, report).

    ``docs``: key, source, length (see :func:`sized`); keys are unique.  selection: mix_id, source, key, times.  Documents of
    one length are taken in a seeded random order, the same for every mix; the order is a distributed rank, so one source or length may hold any
    share of the rows.  Empty texts have length 0 and add nothing; they are taken like others but change no sum.
    """
    docs = cut(docs, "sized")
    hist = cut(length_histogram(docs), "lengths")
    plan = cut(plan_mix(hist, mix).filter(F.col("length").isNotNull()), "mixplan")
    order = ranked(docs.withColumn("_r", seeded(seed, "key")), ["source", "length"], ["_r", "key"])
    times = F.col("repeats") + (F.col("rank") < F.col("extra")).cast("long")
    sel = order.join(plan, ["source", "length"]).select("mix_id", "source", "key", times.alias("times")).filter("times > 0")
    return sel, mix_report(hist, mix)
