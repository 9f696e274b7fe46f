"""Scoring of tokens by a language model that gives logits: windows, batches, masks, losses and entropies.

The model is a plug-in with one method; the built-in one is made of the collection's bigram counts over a bounded vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import token_array

UNKNOWN, FIRST, LAST, MASK, PADDING = range(5)
SPECIAL = ("<unk>", "<s>", "</s>", "<mask>", "<pad>")
SCORES = "doc_id long, i int, token string, loss double, prob double, entropy double, num_subwords int"


class LogitModel(Protocol):
    words: Sequence[str]  # SPECIAL, then the vocabulary

    def logits(self, ids: np.ndarray, attention: np.ndarray, at: np.ndarray, masked: bool) -> np.ndarray:
        """Logits over the words (rows x words) of a batch of padded sequences, each at one position.

        Masked: of the word at the position itself; causal: of the word after it.
        """


@dataclass
class CountModel:
    """P(w | v) = share * c(v w) / c(v) + (1 - share) * (c(w) + 1) / (N + V); masked: the product of both neighbours' chances."""

    words: list[str]
    follow: np.ndarray  # log P(column after row)
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {w: i for i, w in enumerate(self.words)}

    def logits(self, ids, attention, at, masked):
        rows = np.arange(len(ids))
        if not masked:
            return self.follow[ids[rows, at]]
        after = np.minimum(at + 1, ids.shape[1] - 1)
        right = np.where((at + 1 < ids.shape[1]) & (attention[rows, after] > 0), ids[rows, after], LAST)
        out = self.follow[ids[rows, at - 1]]
        return out + np.where(np.isin(right, (LAST, MASK))[:, None], 0.0, self.follow[:, right].T)


def count_model(docs: DataFrame, size: int = 500, share: float = 0.7, text: str = "text") -> CountModel:
    """Counts of neighbouring tokens over the ``size`` most frequent ones (ties by token); others are unknown.

    The vocabulary bounds what reaches the driver: at most (size + 2)^2 counts.
    """
    tokens = docs.select(token_array(F.col(text)).alias("_t")).filter(F.size("_t") > 0)
    count = tokens.select(F.explode("_t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    best = [r["token"] for r in count.orderBy(F.desc("n"), "token").limit(size).collect()]
    words = [*SPECIAL, *best]
    number = docs.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words) if i >= len(SPECIAL)], "_w string, _i int")
    table = F.broadcast(number.agg(F.map_from_entries(F.collect_list(F.struct("_w", "_i"))).alias("_m")))
    known = tokens.crossJoin(table)  # one row
    coded = known.select(F.concat(F.array(F.lit(FIRST)), F.transform("_t", lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(UNKNOWN)))).alias("_c"))
    pairs = coded.select(F.explode(F.arrays_zip(F.slice("_c", F.lit(1), F.size("_c") - 1).alias("a"), F.slice("_c", F.lit(2), F.size("_c") - 1).alias("b"))).alias("p"))
    got = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    c = np.zeros((len(words), len(words)))
    c[got.column("a").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    return CountModel(words, follow_table(c, share))


def follow_table(c: np.ndarray, share: float) -> np.ndarray:
    """log P(column after row) of pair counts; marks of start, end, mask and padding follow nothing."""
    real = np.r_[UNKNOWN, np.arange(len(SPECIAL), len(c))]
    uni = np.zeros(len(c))
    uni[real] = (c[:, real].sum(0) + 1) / (c.sum() + len(real))
    row = c.sum(1, keepdims=True)
    p = np.where(row > 0, share * c / np.maximum(row, 1) + (1 - share) * uni, uni)
    out = np.full(c.shape, -np.inf)
    out[:, real] = np.log(p[:, real])
    return out


def centred(n: int, centre: int, size: int) -> tuple[int, int]:
    """:func:`predict.centred_window` of whole numbers."""
    size = max(1, size)
    start, end = centre - size // 2, max(centre + size // 2, centre - size // 2 + 1)
    return (0, min(size, n)) if start < 0 else (max(0, n - size), n) if end > n else (start, end)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(p + 1e-10)).sum(axis=1)


@dataclass
class Request:
    """One prediction: sequence with its marks, position, word asked for and where the result goes."""

    ids: list[int]
    at: int
    target: int
    word: int


def requests(ids: list[int], spans: list[tuple[int, int]], window: int | None, masked: bool, first_window_only: bool = False) -> Iterator[Request]:
    """Predictions of the words ``spans`` (first, end of their parts) of one document, in order.

    Masked: the word's window with all its parts masked.  Causal: the words that begin in the first window see all before them; later ones
    the window - 1 parts before theirs, or are left out with first_window_only; only a word's first part is predicted.
    """
    n = len(ids)
    size = n if window is None or window >= n else window
    for word, (a, b) in enumerate(spans):
        if masked:
            lo, hi = centred(n, a, size)
            inside = list(range(max(a, lo), min(b, hi)))
            seq = [FIRST, *[MASK if a <= i < b else ids[i] for i in range(lo, hi)], LAST]
            for i in inside:
                yield Request(seq, i - lo + 1, ids[i], word)
        elif a < size or not first_window_only:
            lo = 0 if a < size else max(0, a - size + 1)
            yield Request([FIRST, *ids[lo:a]], a - lo, ids[a], word)
        else:
            break


def batches_of(todo: Iterator[Request], batch: int) -> Iterator[tuple[list[Request], np.ndarray, np.ndarray]]:
    """Requests in batches, their sequences padded to one length, and which places are no padding."""
    rest: list[Request] = []

    def pad(part):
        width = max(len(r.ids) for r in part)
        ids = np.full((len(part), width), PADDING, np.int64)
        for k, r in enumerate(part):
            ids[k, : len(r.ids)] = r.ids
        return part, ids, (ids != PADDING).astype(np.int8)

    for r in todo:
        rest.append(r)
        if len(rest) == batch:
            yield pad(rest)
            rest = []
    if rest:
        yield pad(rest)


def predictions(model: LogitModel, ids: list[int], spans: list[tuple[int, int]], window: int | None, masked: bool, batch: int, first_window_only: bool = False):
    """(requests, probabilities over the words) batch by batch."""
    for part, padded, attention in batches_of(requests(ids, spans, window, masked, first_window_only), batch):
        yield part, softmax(model.logits(padded, attention, np.array([r.at for r in part]), masked))


def score(
    docs: DataFrame, model: LogitModel, mode: str = "masked", window: int | None = 64, batch: int = 32, key: str = "doc_id", text: str = "text", first_window_only: bool = False
) -> DataFrame:
    """doc_id, i, token, loss, prob, entropy, num_subwords of every token by a model that travels to the executors once.

    Losses are in nats; a word's measures are means over its parts (the built-in tokens have one part each).  NULL and blank texts give no
    rows; words without a finite loss are left out.  A document is one pass; its windows go to the model in padded batches.
    """
    if mode not in ("masked", "causal"):
        raise ValueError("mode is masked or causal")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 3, pa.int32()]
    names = [x.split()[0] for x in SCORES.split(", ")]

    def run(it):
        m = shared.value
        known = {w: i for i, w in enumerate(m.words)}
        for b in it:
            rows: list[tuple] = []
            for doc, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not tokens:
                    continue
                ids = [known.get(t, UNKNOWN) for t in tokens]
                got: dict[int, list] = {}
                for part, p in predictions(m, ids, [(i, i + 1) for i in range(len(ids))], window, mode == "masked", batch, first_window_only):
                    loss = -np.log(p[np.arange(len(part)), [r.target for r in part]])
                    for r, x, h in zip(part, loss.tolist(), entropy(p).tolist()):
                        if np.isfinite(x):
                            got.setdefault(r.word, []).append((x, h))
                for w, v in got.items():
                    x = np.array(v)
                    rows.append((doc, w, tokens[w], float(x[:, 0].mean()), float(np.exp(-x[:, 0]).mean()), float(x[:, 1].mean()), len(v)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), token_array(F.col(text)).alias("tokens")).mapInArrow(run, SCORES)


DELTAS = "doc_id long, i int, token string, loss double, delta array<double>, left_context string, right_context string, top_predicted array<string>, top_probs array<double>"


def transformation_vectors(
    docs: DataFrame, model: LogitModel, embedding: np.ndarray, threshold: float, window: int = 64, top: int = 50, shown: int = 3, context: int = 10, batch: int = 32, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Expected minus observed embedding of every token whose masked loss is at least ``threshold``, with its contexts and best predictions.

    ``embedding``: one row per word of the model, bounded like its vocabulary.  The ``top`` most probable words (ties by number, probabilities
    equal to 12 places) are renormalised.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, embedding))
    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64())]
    names = [x.split()[0] for x in DELTAS.split(", ")]

    def run(it):
        m, e = shared.value
        known = {w: i for i, w in enumerate(m.words)}
        for b in it:
            rows: list[tuple] = []
            for doc, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not tokens:
                    continue
                ids = [known.get(t, UNKNOWN) for t in tokens]
                for part, p in predictions(m, ids, [(i, i + 1) for i in range(len(ids))], window, True, batch):
                    for r, q in zip(part, p):
                        loss = -np.log(q[r.target])
                        if not loss >= threshold:
                            continue
                        best = np.argsort(-np.round(q, 12), kind="stable")[:top]
                        w = r.word
                        delta = (q[best] / q[best].sum()) @ e[best] - e[r.target]
                        rows.append((doc, w, tokens[w], float(loss), delta.tolist(), " ".join(tokens[max(0, w - context) : w]), " ".join(tokens[w + 1 : w + 1 + context]), [m.words[k] for k in best[:shown]], q[best[:shown]].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), token_array(F.col(text)).alias("tokens")).mapInArrow(run, DELTAS)
