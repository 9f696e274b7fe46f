"""Predictability of words: a language model behind an interface, windows, alignment, and per-document measures.

The built-in model is an interpolated trigram model over the collection's own counts, a stand-in for a neural one.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import token_array
from corpusmill.operators.collate import PAD
from corpusmill.shared import cut, with_one


class LanguageModel(Protocol):
    def score(self, tokens: DataFrame) -> DataFrame:
        """doc_id, i, token, loss (natural log) for every token."""


def sequences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, i, token and the two tokens before it, without a shuffle."""
    t = docs.select(F.col(key).alias("doc_id"), token_array(F.col("text")).alias("_t"))
    at = t.select("doc_id", "_t", F.posexplode("_t").alias("i", "token"))
    before = lambda k: F.coalesce(F.get("_t", F.col("i") - k), F.lit(PAD))
    return at.select("doc_id", "i", "token", before(1).alias("prev"), before(2).alias("prev2"))


class NgramModel:
    """p(w | a, b) = l3 * c(a b w) / c(a b) + l2 * c(b w) / c(b) + l1 * (c(w) + 1) / (N + V + 1)."""

    def __init__(self, docs: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)):
        self.weights = weights
        # written once: all marginals are sums over it
        self.grams = cut(sequences(docs).groupBy("prev2", "prev", "token").agg(F.count(F.lit(1)).alias("c3")), "grams")

    def score(self, tokens: DataFrame) -> DataFrame:
        """doc_id, i, token, loss of every token after its two predecessors (scoring from both sides: operators.scoring).

        The tokens are joined as a document's distinct trigrams, so each join is as large as the vocabulary in use and a frequent trigram is one row a document.
        """
        l3, l2, l1 = self.weights
        g = self.grams
        two = g.groupBy("prev2", "prev").agg(F.sum("c3").alias("c12"))
        bi = g.groupBy("prev", "token").agg(F.sum("c3").alias("c2"))
        ctx = g.groupBy("prev").agg(F.sum("c3").alias("c1"))
        uni = g.groupBy("token").agg(F.sum("c3").alias("c0"))
        size = uni.agg(F.sum("c0").alias("n"), F.count(F.lit(1)).alias("v"))  # one row
        need = tokens.select("prev2", "prev", "token").distinct()
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        counted = (
            need.join(g, ["prev2", "prev", "token"], "left").join(two, ["prev2", "prev"], "left")
            .join(bi, ["prev", "token"], "left").join(ctx, ["prev"], "left").join(uni, ["token"], "left")
        )
        p = with_one(counted, size).withColumn("p", l3 * F.coalesce(F.col("c3") / F.col("c12"), F.lit(0.0)) + l2 * F.coalesce(F.col("c2") / F.col("c1"), F.lit(0.0)) + l1 * (zero("c0") + 1) / (F.col("n") + F.col("v") + 1))
        places = tokens.groupBy("doc_id", "prev2", "prev", "token").agg(F.collect_list("i").alias("_at"))
        lost = places.join(p.select("prev2", "prev", "token", (-F.log("p")).alias("loss")), ["prev2", "prev", "token"])
        return lost.select("doc_id", F.explode("_at").alias("i"), "token", "loss")

    def entropy(self) -> DataFrame:
        """Entropy of the next token after each single context: prev, entropy (natural log)."""
        bi = self.grams.groupBy("prev", "token").agg(F.sum("c3").alias("c"))
        # H = log C - sum(c log c) / C, one aggregate
        return bi.groupBy("prev").agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("entropy"))


def subword_summary(df: DataFrame, losses: str) -> DataFrame:
    """Per token: probabilities exp(-loss), mean loss and probability, number of parts; no parts: infinite loss, 0 probability."""
    n = F.size(losses)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / n
    return df.withColumn("num_subwords", n).withColumn("mean_loss", F.when(n > 0, mean(F.col(losses))).otherwise(F.lit(float("inf")))).withColumn("mean_prob", F.when(n > 0, mean(F.transform(losses, lambda x: F.exp(-x)))).otherwise(0.0))


def doc_predictability(scores: DataFrame, docs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Means of loss, probability and entropy over tokens with finite loss, and the sample variance of the loss (0 below two tokens).

    With ``docs`` every one of them has a row: without tokens the mean loss is infinite and the rest 0.  Scores without a probability or an entropy
    column get exp(-loss) and NULL.
    """
    fine = scores.filter(F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") < float("inf")))
    prob = F.col("prob") if "prob" in scores.columns else F.exp(-F.col("loss"))
    entropy = F.col("entropy") if "entropy" in scores.columns else F.lit(None).cast("double")
    per = fine.groupBy("doc_id").agg(
        F.avg("loss").alias("mean_loss"), F.avg(prob).alias("mean_prob"), F.avg(entropy).alias("mean_entropy"), F.coalesce(F.var_samp("loss"), F.lit(0.0)).alias("var_loss"), F.count(F.lit(1)).alias("n_tokens")
    )
    if docs is None:
        return per
    out = docs.select(F.col(key).alias("doc_id")).distinct().join(per, "doc_id", "left")
    return out.fillna({"mean_loss": float("inf"), "mean_prob": 0.0, "mean_entropy": 0.0, "var_loss": 0.0, "n_tokens": 0})


def token_at(scores: DataFrame, doc_id: int, i: int) -> DataFrame:
    """The scores of one token; no row if there is none."""
    return scores.filter((F.col("doc_id") == doc_id) & (F.col("i") == i))


def centred_window(n: Column, centre: Column, size: int) -> tuple[Column, Column]:
    """[start, end) of size // 2 on both sides of a position and at least the position, shifted inwards at the ends of a sequence of n.

    An odd size gives size - 1 positions inside a sequence and size at its ends; a size below 1 counts as 1.
    """
    size = max(1, size)
    start, end = centre - size // 2, F.greatest(centre + size // 2, centre - size // 2 + 1)
    left, right = start < 0, end > n
    return F.when(left, 0).when(right, F.greatest(n - size, F.lit(0))).otherwise(start), F.when(left, F.least(F.lit(size), n)).when(right, n).otherwise(end)


def align(words: DataFrame, parts: DataFrame) -> DataFrame:
    """Subword span of every word whose start a subword shares: doc_id, i, first, end.

    ``words``: doc_id, i, char_start; ``parts``: doc_id, sub_i, char_start.  Of parts with one start the first counts; a span ends at the
    next aligned start, the last one after one subword.
    """
    first = parts.groupBy("doc_id", "char_start").agg(F.min("sub_i").alias("first"))
    hit = words.join(first, ["doc_id", "char_start"])
    w = Window.partitionBy("doc_id").orderBy("first")
    return hit.select("doc_id", "i", "first", F.coalesce(F.lead("first").over(w), F.col("first") + 1).alias("end"))


def causal_context(tokens: Column, i: Column, window: int) -> Column:
    """At most ``window`` tokens before position i."""
    start = F.greatest(i - window, F.lit(0))
    return F.slice(tokens, start + 1, i - start)
