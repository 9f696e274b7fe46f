"""Near-duplicate texts: BagMinHash signatures of weighted shingles, banding, exact multiset verification."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import components, cut

_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def shingle(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each shingle, its 64-bit hash, number of words of each text); NULL has no words."""
    import xxhash

    lists = [_WORD.findall((t if t.isascii() else unicodedata.normalize("NFC", t)).lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = [w for x in lists for w in x]
    if len(flat) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), n
    code, vocab = pd.factorize(np.array(flat, dtype=object))
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab))[code]
    row = np.repeat(np.arange(len(lists)), n)
    k = len(flat) - size + 1
    g = np.zeros(k, np.uint64)
    for j in range(size):
        g = mix64(g + _G) ^ h[j : j + k]
    inside = row[:k] == row[size - 1 :]
    return row[:k][inside], mix64(g)[inside], n


def bag_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Signatures (rows x m, 64-bit) whose components agree with the probability of the weighted Jaccard similarity.

    Weights are discretised at the levels 0, 1, 2, 4, 8, ...: each level of an element is a Poisson process over the m
    components whose rate is the level's width, so the points below the element's weight are a Poisson process of that
    rate, shared by all bags that hold the element.  The points of a process come in increasing order, all processes at
    once; a process ends at the first point that no component of its bag can still take (all have smaller ones).  In an
    element's last level a point counts if its position lies below the weight (thinning).  Rows without elements keep
    the largest value everywhere.
    """
    reg = np.full((rows, m), np.inf)
    sig = np.full((rows, m), np.iinfo(np.uint64).max, np.uint64)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    rep = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(rep)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix64(element[rep] + mix64(level.astype(np.uint64) + np.uint64(1)))
    r, full = row[rep], weight[rep]
    at = np.zeros(len(rep))
    flat, fsig = reg.ravel(), sig.ravel()
    step = 0
    while len(r):
        step += 1
        x = mix64(seed + np.uint64(step * int(_G) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(_unit(x)) / width
        y = mix64(x ^ _M2)
        slot = (y % np.uint64(m)).astype(np.int64)
        keep = low + _unit(mix64(y)) * width < full
        i = (r * m + slot)[keep]
        a, s = at[keep], x[keep]
        better = a < flat[i]
        i, a, s = i[better], a[better], s[better]
        order = np.argsort(-a, kind="stable")  # of several points for a component the smallest is written last
        flat[i[order]] = a[order]
        fsig[i[order]] = s[order]
        # while most rows are open their maxima are taken at once, later only those of open ones
        live = at < (reg.max(axis=1)[r] if 4 * len(r) > rows else reg[r].max(axis=1))
        r, seed, at, low, width, full = r[live], seed[live], at[live], low[live], width[live], full[live]
    return sig


def _bags(row: np.ndarray, h: np.ndarray, multiset: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted, with their weights: 1, or the number of occurrences."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    count = np.diff(np.r_[at, len(row)])
    return row[at], h[at], count.astype(np.float64) if multiset else np.ones(len(at))


#: rows of one bucket that a task pairs with as many others
BLOCK = 4096


def block_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """All pairs x < y of the values of each group: group, x, y.

    A group of more than BLOCK rows is split by hash and its blocks are paired in tasks of their own, so no task holds more than two blocks.
    """
    n = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    placed = df.select(group, value).join(n, group).withColumn("_b", F.pmod(F.xxhash64(value), F.col("_k")).cast("int"))
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    x = placed.select(group, F.col("_b").alias("_i"), F.col("_o").alias("_j"), F.col(value).alias("x"))
    y = placed.select(group, F.col("_o").alias("_i"), F.col("_b").alias("_j"), F.col(value).alias("y"))
    return x.join(y, [group, "_i", "_j"]).filter("x < y").select(group, "x", "y")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, min_words: int = 1, bands: int = 26, band_rows: int = 5,
    multiset: bool = True, key: str = "doc_id", text: str = "text", chunk: int = 1024,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between different texts, the classes of equal texts, and balls of texts that are all linked: (links, copies, balls).

    links: key_a, key_b (smaller first), similarity: representatives of two different texts, not of one ball, whose multisets (or sets) of
    ``size``-word runs have a weighted Jaccard similarity of at least ``threshold``, verified exactly on the whole texts.
    copies: rep, key, for every document of at least ``min_words`` words, shorter than ``size`` or not, rep being the smallest key
    with that text.
    balls: ball, key: texts (by their representatives) whose similarity to the text ``ball``, verified exactly, is at least
    (1 + threshold) / 2; the ball's own text is in it unless it belongs to another.  One minus the similarity is a metric, so any two texts of one ball
    have at least ``threshold``: their links hold without a list of all pairs.  A text is in one ball at most.

    Words are maximal runs of letters or digits after NFC and lower-casing.  Texts that are NULL, empty, or shorter than
    min_words or ``size`` words are in no link; documents with equal texts are compared once.  The texts of a bucket (one band value) are first
    compared with its smallest one, which is linear; only buckets of several balls give further pairs, by blocks of bounded size, and nothing is
    capped.  A pair at similarity s is found
    with probability 1 - (1 - s^band_rows)^bands, by default 0.99997 at the threshold.  Candidates whose signatures (four bits a component) put the estimated similarity four
    standard deviations below the threshold or lower are not read in full.  Repeated rows of one key count once.
    """
    m = bands * band_rows
    every = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)

    def sign(batches):
        for b in batches:
            for lo in range(0, b.num_rows, chunk):
                part = b.slice(lo, chunk)
                texts = part.column(1).to_pylist()
                row, h, n = shingle(texts, size)
                r, e, w = _bags(row, h, multiset)
                keep = np.flatnonzero(n >= min_words)
                runs = n[keep] >= size  # shorter texts can only have copies: no bands, no sketch
                sig = bag_minhash(r, e, w, len(texts), m)[keep[runs]]
                value = np.zeros((len(sig), bands), np.uint64)
                for j in range(band_rows):
                    value = mix64(value + _G) ^ sig[:, j::band_rows]
                value = mix64(value + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)
                low = (sig & np.uint64(15)).astype(np.uint8)
                sketch = np.full(len(keep), None, object)
                sketch[runs] = [x.tobytes() for x in low[:, 0::2] | low[:, 1::2] << 4]
                ids = [int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep)),
                        pa.array(ids, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(runs * bands)], pa.int32()), pa.array(value.ravel())),
                        pa.array(sketch, pa.binary()),
                    ],
                    names=["key", "text_id", "bands", "sketch"],
                )

    signed = cut(every.mapInArrow(sign, "key long, text_id long, bands array<long>, sketch binary"), "bands")
    rep = signed.groupBy("text_id").agg(F.min("key").alias("rep"))
    copies = signed.select("key", "text_id").join(rep, "text_id").select("rep", "key").distinct()
    # one row per band and distinct text
    firsts = signed.join(rep.select(F.col("rep").alias("key")), "key", "left_semi")
    buckets = firsts.select("key", F.explode("bands").alias("band"))
    n = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lead")).filter("n > 1")
    shared = cut(buckets.join(n.select("band", "lead"), "band"), "shared")
    sketch = cut(firsts.join(shared.select("key").distinct(), "key", "left_semi").select("key", "sketch").dropDuplicates(["key"]), "sketches")
    agree = threshold + (1 - threshold) / 16  # of the four-bit components, at the threshold
    enough = m * (agree - 4 * np.sqrt(agree * (1 - agree) / m))

    def likely(batches):
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in ("x", "y"))
                d = x ^ y
                ok = pa.array(((d & 15) == 0).sum(1) + ((d >> 4) == 0).sum(1) >= enough)
                yield pa.RecordBatch.from_arrays([t.column("key_a").filter(ok), t.column("key_b").filter(ok)], names=["key_a", "key_b"])

    def likely_of(pairs: DataFrame) -> DataFrame:
        drawn = (
            pairs.join(sketch.select(F.col("key").alias("key_a"), F.col("sketch").alias("x")), "key_a")
            .join(sketch.select(F.col("key").alias("key_b"), F.col("sketch").alias("y")), "key_b")
        )
        return cut(drawn.mapInArrow(likely, "key_a long, key_b long"), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("key_a").alias("key")).union(pairs.select("key_b")).distinct()
        texts = cut(every.join(ends, "key", "left_semi").dropDuplicates(["key"]), "texts")
        two = (
            pairs.join(texts.select(F.col("key").alias("key_a"), F.col("text").alias("x")), "key_a")
            .join(texts.select(F.col("key").alias("key_b"), F.col("text").alias("y")), "key_b")
        )
        return cut(two.mapInArrow(verify, "key_a long, key_b long, similarity double"), "links")

    def verify(batches):
        for t in batches:
            for lo in range(0, t.num_rows, chunk):
                p = t.slice(lo, chunk)
                row, h, _ = shingle(p.column("x").to_pylist() + p.column("y").to_pylist(), size)
                s = pair_similarity(*_bags(row, h, multiset), p.num_rows)
                ok = pa.array(s >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([p.column("key_a").filter(ok), p.column("key_b").filter(ok), pa.array(s).filter(ok)], names=["key_a", "key_b", "similarity"])

    tried = likely_of(shared.filter("key != lead").select(F.col("lead").alias("key_a"), F.col("key").alias("key_b")).distinct())
    star = verified(tried)
    held = star.filter(F.col("similarity") >= (1 + threshold) / 2).groupBy(F.col("key_b").alias("key")).agg(F.min("key_a").alias("ball"))
    held = cut(held, "held")
    ball = lambda c, name: held.select(F.col("key").alias(c), F.col("ball").alias(name))
    labelled = shared.filter("key != lead").join(ball("key", "ball"), "key", "left").withColumn("ball", F.coalesce("ball", "key"))
    mixed = labelled.groupBy("band").agg(F.min("ball").alias("_x"), F.max("ball").alias("_y")).filter("_x != _y").select("band")
    open_ = cut(labelled.join(mixed, "band").select("band", "key"), "mixed")
    more = block_pairs(open_, "band", "key").select(F.col("x").alias("key_a"), F.col("y").alias("key_b")).distinct().join(tried, ["key_a", "key_b"], "left_anti")
    apart = lambda df: (
        df.join(ball("key_a", "_p"), "key_a", "left").join(ball("key_b", "_q"), "key_b", "left")
        .filter(F.coalesce("_p", "key_a") != F.coalesce("_q", "key_b")).select(*df.columns)
    )
    links = apart(star).unionByName(verified(likely_of(apart(more))))
    centres = held.select("ball").distinct().join(held.select(F.col("key").alias("ball")), "ball", "left_anti").select("ball", F.col("ball").alias("key"))
    return links, copies, held.select("ball", "key").unionByName(centres)


def pair_similarity(row: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Exact weighted Jaccard similarity of bag i and bag n + i, for i < n."""
    pair = row % n
    order = np.lexsort((row, h, pair))
    p, e, v = pair[order], h[order], w[order]
    same = np.flatnonzero((p[1:] == p[:-1]) & (e[1:] == e[:-1]))
    both = np.bincount(p[same], np.minimum(v[same], v[same + 1]), n)
    whole = np.bincount(p, v, n)
    return np.where(whole > 0, both / np.maximum(whole - both, 1e-9), 0.0)


def expand(links: DataFrame, copies: DataFrame, balls: DataFrame) -> DataFrame:
    """Document pairs (doc_id_a < doc_id_b, similarity) of links between texts, of the texts of one ball and of equal texts.

    The similarity of two texts of one ball is not computed where neither is its centre: NULL.  This writes every pair; :func:`duplicate_classes` doesn't.
    """
    inside = block_pairs(balls, "ball", "key").select(F.col("x").alias("key_a"), F.col("y").alias("key_b"), F.lit(None).cast("double").alias("similarity"))
    texts = links.unionByName(inside)
    c = copies.select(F.col("rep").alias("key_a"), F.col("key").alias("x"))
    d = copies.select(F.col("rep").alias("key_b"), F.col("key").alias("y"))
    across = texts.join(c, "key_a").join(d, "key_b").select("x", "y", "similarity")
    same = block_pairs(copies, "rep", "key").select("x", "y", F.lit(1.0).alias("similarity"))
    return across.unionByName(same).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "similarity")


def duplicate_classes(links: DataFrame, copies: DataFrame, balls: DataFrame, docs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, class_id (smallest document joined by links), n_links of its text, n_copies.

    The links of a text are those listed and one to every other text of its ball.  Those of ``docs`` that are in no copies (NULL, empty, blank or below
    min_words) are a class of their own.
    """
    ends = links.select(F.col("key_a").alias("rep")).unionByName(links.select(F.col("key_b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    size = balls.groupBy("ball").agg((F.count(F.lit(1)) - 1).alias("n"))
    n_links = ends.unionByName(balls.join(size, "ball").select(F.col("key").alias("rep"), "n")).groupBy("rep").agg(F.sum("n").alias("n_links"))
    edges = links.select(F.col("key_a").alias("src"), F.col("key_b").alias("dst")).unionByName(balls.select(F.col("ball").alias("src"), F.col("key").alias("dst")))
    labels = components(edges)
    size = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies"))
    classes = (
        copies.join(size, "rep")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .join(n_links, "rep", "left")
        .select(F.col("key").alias("doc_id"), F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    )
    if docs is None:
        return classes
    alone = docs.select(F.col(key).cast("long").alias("key")).dropna().distinct().join(copies, "key", "left_anti")
    return classes.unionByName(alone.select(F.col("key").alias("doc_id"), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
