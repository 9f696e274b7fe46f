"""Vector operators: sign split, factorisation, neighbour graph, layout, centroids, cluster and component tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.graph import condensed_clusters, spanning_forest
from corpusmill.operators.stats import modes, spearman_by, top_shares
from corpusmill.shared import cut


def posneg(v: Column) -> Column:
    """Positive parts, then magnitudes of negative parts: twice the length, nothing negative."""
    zero = F.lit(0).cast("float")
    return F.concat(F.transform(v, lambda x: F.greatest(x, zero)), F.transform(v, lambda x: F.greatest(-x, zero)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, group: Sequence[str], vec: str, dim: int) -> DataFrame:
    """Mean vector of each group: one partial aggregate per dimension, so no row travels."""
    return df.groupBy(*group).agg(F.array(*[F.avg(F.get(vec, F.lit(k)).cast("double")) for k in range(dim)]).alias("centroid"))


def centroid_distance(df: DataFrame, group: str, vec: str, dim: int) -> DataFrame:
    """Rows with the cosine distance to their group's centroid."""
    c = centroids(df, [group], vec, dim)
    few = (8 << 20) // (8 * dim)  # centroids of at most 8 MB are sent to all tasks
    return df.join(F.broadcast(c) if c.limit(few + 1).count() <= few else c, group).withColumn("distance", 1 - cosine(F.col(vec), F.col("centroid"))).drop("centroid")


# --- non-negative matrix factorisation ------------------------------------------------------------------------------


#: groups of tasks whose sums reach the driver
SUMS = 16


def _batches(t: pa.RecordBatch, key: str, vec: str):
    x = np.array(t.column(vec).to_pylist(), np.float64)
    return t.column(key).to_numpy(zero_copy_only=False), x


def _weights(x: np.ndarray, h: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Non-negative least squares of every row on the components, by coordinate sweeps over components."""
    g, c = h @ h.T, x @ h.T
    w = np.maximum(c / np.maximum(np.diag(g), 1e-12), 0)
    for _ in range(sweeps):
        for j in range(len(h)):
            if g[j, j] > 1e-12:
                w[:, j] = np.maximum(w[:, j] + (c[:, j] - w @ g[:, j]) / g[j, j], 0)
            else:
                w[:, j] = 0
    return w


def nmf(df: DataFrame, key: str, vec: str, dim: int, k: int = 50, rounds: int = 100, tol: float = 1e-4) -> tuple[DataFrame, np.ndarray, float]:
    """(W: key, loadings; H: k x 2 dim; relative error) of the sign-split vectors, Frobenius loss.

    Rows are independent given H, so each round is one pass that returns only W'W and W'X, k x (k + 2 dim) numbers a task; H
    is updated by hierarchical coordinate steps.  Starts from the leading directions of X'X, found by a randomised range finder, with their signs
    split and zeros filled by the mean.  NULL vectors take no part.
    """
    spark = df.sparkSession
    data = cut(df.filter(F.col(vec).isNotNull()).select(key, posneg(F.col(vec)).alias(vec)), "split")
    d2 = 2 * dim

    def reduce(fn, shape: tuple[int, ...]) -> np.ndarray:
        """Sum of fn over all batches: one array a task, added up by groups of tasks, at most SUMS arrays at the driver."""

        def run(batches):
            total, some = np.zeros(shape), False
            for b in batches:
                if b.num_rows:
                    total += fn(_batches(b, key, vec)[1])
                    some = True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

        def add(t: pa.Table) -> pa.Table:
            total = np.zeros(shape)
            for v in t.column("v").to_pylist():
                total += np.frombuffer(v).reshape(shape)
            return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

        parts = data.mapInArrow(run, "v binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(SUMS)))
        out = np.zeros(shape)
        for r in parts.groupBy("g").applyInArrow(add, "v binary").toLocalIterator():
            out += np.frombuffer(r["v"]).reshape(shape)
        return out

    n, whole, mean = (lambda x: (x[0], x[1], x[2:]))(reduce(lambda x: np.r_[len(x), (x * x).sum(), x.sum(0)], (d2 + 2,)))
    if not n:
        return spark.createDataFrame([], f"{key} long, loadings array<double>"), np.zeros((k, d2)), 0.0
    k = min(k, d2)
    # leading directions of X'X: its product with a few random directions spans them, and a small matrix separates them
    omega = np.random.default_rng(0).standard_normal((d2, min(d2, k + 10)))
    q, _ = np.linalg.qr(reduce(lambda x: x.T @ (x @ omega), omega.shape))
    q, _ = np.linalg.qr(reduce(lambda x: x.T @ (x @ q), q.shape))
    value, small = np.linalg.eigh(reduce(lambda x: (lambda y: y.T @ y)(x @ q), (q.shape[1],) * 2))
    vector = q @ small
    h = []
    for v, s in zip(vector[:, ::-1].T, np.sqrt(np.maximum(value[::-1], 0))):
        for part in (np.maximum(v, 0), np.maximum(-v, 0)):
            if len(h) < k and part.any():
                h.append(part * s)
    h = np.array(h)
    k = len(h)
    h = np.where(h > 0, h, mean.mean() / n / 10 + 1e-9)
    last, error, still = np.inf, 1.0, 0
    for _ in range(rounds):
        s = reduce(lambda x, h=h: (lambda w: np.hstack([w.T @ w, w.T @ x]))(_weights(x, h)), (k, k + d2))
        a, b = s[:, :k], s[:, k:]
        error = np.sqrt(max(whole - 2 * (b * h).sum() + (a * (h @ h.T)).sum(), 0) / whole)
        still = still + 1 if last - error < tol * error else 0
        if still > 2:
            break
        last = error
        for _ in range(4):
            for j in range(k):
                if a[j, j] > 1e-12:
                    h[j] = np.maximum(h[j] + (b[j] - a[j] @ h) / a[j, j], 0)

    def load(batches):
        for t in batches:
            if t.num_rows:
                ids, x = _batches(t, key, vec)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(_weights(x, h)), pa.list_(pa.float64()))], names=[key, "loadings"])

    return data.mapInArrow(load, f"{key} long, loadings array<double>"), h, float(error)


def loadings_long(w: DataFrame, key: str) -> DataFrame:
    return w.select(key, F.posexplode("loadings").alias("component", "loading"))


def top_per_component(long: DataFrame, key: str, n: int) -> DataFrame:
    order = Window.partitionBy("component").orderBy(F.desc("loading"), key)
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def component_summary(long: DataFrame, meta: DataFrame, key: str, n: int = 50) -> DataFrame:
    """Per component, over its top n rows: mean loading and surprisal, proficiency shares, three top tags and the top word; over all rows:
    sparsity and the rank correlation of loading and proficiency (low 1, mid 2, high 3)."""
    t = top_per_component(long, key, n).join(meta, key, "left")
    per = t.groupBy("component").agg(
        F.avg("loading").alias("top_load"), F.avg("surprisal").alias("surprisal"), *[F.try_divide(F.count_if(F.col("prof") == p), F.count("prof")).alias(f"{p}_share") for p in ("low", "mid", "high")]
    )
    tag = top_shares(t, ["component"], "pos_tag").withColumnRenamed("pos_tag", "top_pos")
    word = modes(t, ["component"], "token_text").select("component", F.col("token_text").alias("top_token"))
    sparse = long.groupBy("component").agg(F.avg((F.col("loading") < 1e-6).cast("int")).alias("sparsity"))
    level = F.when(F.col("prof") == "low", 1).when(F.col("prof") == "mid", 2).when(F.col("prof") == "high", 3)
    rho = spearman_by(long.join(meta.select(key, level.alias("level")), key), "component", "loading", "level").select("component", "rho")
    return per.join(tag, "component", "left").join(word, "component", "left").join(sparse, "component").join(rho, "component", "left")


def filtered(rows: DataFrame, pos: Sequence[str] = (), dep: Sequence[str] = (), prof: Sequence[str] = ()) -> DataFrame:
    """Rows that have one of the values of every filter given."""
    for column, values in (("pos_tag", pos), ("dep_rel", dep), ("prof", prof)):
        if values:
            rows = rows.filter(F.col(column).isin(*values))
    return rows


def component_show(long: DataFrame, meta: DataFrame, key: str, component: int, n: int = 50, **filters: Sequence[str]) -> DataFrame:
    """The n rows that load most on one component, then the filters (so fewer may come out): number, key, loading and the rows' columns."""
    t = top_per_component(long.filter(F.col("component") == component), key, n).select(key, "loading")
    order = Window.orderBy(F.desc("loading"), key)  # at most n rows
    return filtered(t.join(meta, key), **filters).withColumn("number", F.row_number().over(order))


def valid_labels(labels: DataFrame, label: str = "label", shown: int = 20) -> DataFrame:
    """n_clusters and the first ids of the clusters, in order; noise (-1) is none."""
    ids = labels.filter(F.col(label) >= 0).select(label).distinct()
    return ids.agg(F.count(F.lit(1)).alias("n_clusters")).withColumn("first_ids", ids.orderBy(label).limit(shown).agg(F.sort_array(F.collect_list(label)).alias("_l")).scalar())


def cluster_show(rows: DataFrame, cluster: int, sort: str = "centroid", n: int = 50, key: str = "row_id", label: str = "label", vec: str = "vec", dim: int = 768, seed: int = 42, **filters: Sequence[str]) -> DataFrame:
    """The first n rows of a cluster that pass the filters: number, key and the rows' columns, by distance to the whole cluster's centroid, by surprisal or at random.

    An id that is no cluster's is an error that names the first valid ones.
    """
    mine = rows.filter(F.col(label) == cluster)
    if cluster < 0 or mine.isEmpty():
        valid = valid_labels(rows, label).first()
        raise ValueError(f"no cluster {cluster}; valid: {valid['first_ids']}{'...' if valid['n_clusters'] > 20 else ''} ({valid['n_clusters']} in all)")
    if sort == "centroid":
        mine = centroid_distance(mine, label, vec, dim)
        order = [F.round("distance", 9), key]
    elif sort == "surprisal":
        order = [F.desc_nulls_last("surprisal"), key]
    elif sort == "random":
        order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key]
    else:
        raise ValueError("sort is centroid, surprisal or random")
    best = filtered(mine, **filters).orderBy(*order).limit(n)
    return best.withColumn("number", F.row_number().over(Window.orderBy(*order)))  # at most n rows


# --- neighbour graph, layout, clusters ------------------------------------------------------------------------------


def knn_graph(df: DataFrame, key: str, vec: str, dim: int, k: int = 15, block: int = 2048) -> DataFrame:
    """Exact k nearest by cosine: src, dst, similarity.  Blocks of rows are compared with blocks, each pair of blocks in one task.

    The number of blocks follows the rows; a task keeps k per row, so what is merged is k per row and block.
    """
    rows = cut(df.filter(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<float>").alias("v")), "rows")
    n = max(1, -(-rows.count() // block))
    r = rows.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tasks = r.select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "key", "v")

    def near(t: pa.Table) -> pa.Table:
        ids, b = t.column("key").to_numpy(), t.column("b").to_numpy()
        x = np.array(t.column("v").to_pylist(), np.float32).reshape(len(ids), dim)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        out = []
        for p, q in ((one, two), (two, one)) if lo < hi else ((one, one),):
            if not len(p) or not len(q):
                continue
            s = x[p] @ x[q].T
            s[ids[p][:, None] == ids[q][None, :]] = -2
            m = min(k, len(q))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            out.append((np.repeat(ids[p], m), ids[q][top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        if not out:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        a, c, s = (np.concatenate(z) for z in zip(*out))
        keep = s > -1.5
        return pa.table({"src": a[keep], "dst": c[keep], "similarity": s[keep].astype(np.float64)})

    found = tasks.groupBy("lo", "hi").applyInArrow(near, "src long, dst long, similarity double")
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuzzy_graph(knn: DataFrame, k: int = 15) -> DataFrame:
    """Symmetric fuzzy weights of a neighbour graph: src < dst, weight.

    Per row the distance to the nearest is subtracted and the scale found by bisection so that the weights sum to log2(k);
    both directions join as a + b - a b.
    """
    lists = knn.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "similarity"))).alias("_l"))

    def weigh(pdfs):
        for pdf in pdfs:
            src, dst, w = [], [], []
            for s, l in zip(pdf["src"], pdf["_l"]):
                d = np.array([1 - x["similarity"] for x in l])
                d = np.maximum(d - d.min(), 0)
                lo, hi = 1e-6, 1e3
                for _ in range(50):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if np.exp(-d / mid).sum() < np.log2(max(k, 2)) else (lo, mid)
                src += [s] * len(l)
                dst += [x["dst"] for x in l]
                w += list(np.exp(-d / hi))
            yield pd.DataFrame({"src": src, "dst": dst, "w": w})

    one = lists.mapInPandas(weigh, "src long, dst long, w double")
    pair = one.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n"))
    return pair.select("src", "dst", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("weight"))


def layout(graph: DataFrame, dim: int = 2, rounds: int = 10, seed: int = 42, a: float = 1.577, b: float = 0.895, rate: float = 1.0) -> DataFrame:
    """Coordinates of the graph's nodes by attraction along edges and repulsion from hashed samples: node, y.

    Each round is two joins of the edges with the coordinates and one sum per node, of any size; as a gradient method with few
    rounds it gives a coarse map.  Starts from seeded random positions.
    """
    edges = cut(graph.select("src", "dst", "weight").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "edges")
    nodes = edges.select(F.col("src").alias("node")).distinct()
    n = max(nodes.count(), 1)
    at = lambda d, i: F.pmod(F.xxhash64(F.lit(seed + 31 * d), i), F.lit(1 << 20)) / F.lit(float(1 << 20)) * 20 - 10
    pos = cut(nodes.select("node", *[at(d, F.col("node")).alias(f"y{d}") for d in range(dim)]), "pos")
    slots = pos.select(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(n)).alias("slot"), F.col("node"))
    slots = cut(slots.groupBy("slot").agg(F.min("node").alias("dst")), "slots")
    for step in range(rounds):
        alpha = rate * (1 - step / rounds)
        other = edges.select("src", F.pmod(F.xxhash64("src", "dst", F.lit(step)), F.lit(n)).alias("slot")).join(slots, "slot").select("src", "dst", F.lit(0.0).alias("weight"), F.lit(True).alias("far"))
        both = edges.withColumn("far", F.lit(False)).unionByName(other).filter("src != dst")
        p, q = (pos.select(F.col("node").alias(s), *[F.col(f"y{d}").alias(f"{s}{d}") for d in range(dim)]) for s in ("src", "dst"))
        j = both.join(p, "src").join(q, "dst")
        diff = [F.col(f"src{d}") - F.col(f"dst{d}") for d in range(dim)]
        d2 = sum((x * x for x in diff[1:]), diff[0] * diff[0]) + 1e-4
        pull = -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b))) * F.col("weight")
        push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))
        force = F.when(F.col("far"), push).otherwise(pull)
        move = j.groupBy(F.col("src").alias("node")).agg(*[F.sum(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), force * x))).alias(f"g{d}") for d, x in enumerate(diff)], F.count(F.lit(1)).alias("m"))
        new = pos.join(move, "node", "left")
        pos = cut(new.select("node", *[(F.col(f"y{d}") + alpha * F.coalesce(F.col(f"g{d}") / F.sqrt("m"), F.lit(0.0))).alias(f"y{d}") for d in range(dim)]), "pos")
    return pos.select("node", F.array(*[F.col(f"y{d}") for d in range(dim)]).alias("y"))


def density_labels(knn: DataFrame, min_rows: int = 10, min_samples: int = 5, method: str = "eom") -> DataFrame:
    """Labels of a density clustering of the neighbour graph: key, label (-1: noise), by excess of mass (``eom``) or of the leaves (``leaf``).

    Core similarity is that of the min_samples-th neighbour; links carry the least of their similarity and both core
    similarities; the maximum spanning forest is condensed (see graph.condensed_clusters).
    """
    core = knn.filter(F.col("rank") == min_samples).select("src", F.col("similarity").alias("core"))
    w = F.least("similarity", "core", "_core")
    links = knn.join(core, "src").join(core.select(F.col("src").alias("dst"), F.col("core").alias("_core")), "dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w"))
    forest, labels = spanning_forest(links)
    members, clusters = condensed_clusters(forest, min_rows, method)
    names = clusters.select("cluster_id", "n_rows")
    ranked_names = names.withColumn("label", F.row_number().over(Window.orderBy(F.desc("n_rows"), "cluster_id")) - 1)  # one row per cluster
    named = members.join(ranked_names.select("cluster_id", "label"), "cluster_id").select("key", "label")
    return labels.select(F.col("node").alias("key")).join(named, "key", "left").select("key", F.coalesce("label", F.lit(-1)).alias("label"))


def cluster_summary(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, size, mean and sd of surprisal, proficiency shares, top tag and word; noise (-1) left out; largest first."""
    r = rows.filter(F.col(label) >= 0)
    per = r.groupBy(label).agg(
        F.count(F.lit(1)).alias("size"), F.avg("surprisal").alias("mean_surprisal"), F.stddev_samp("surprisal").alias("sd_surprisal"),
        *[F.try_divide(F.count_if(F.col("prof") == p), F.count("prof")).alias(f"{p}_share") for p in ("low", "mid", "high")],
    )
    tag = modes(r, [label], "pos_tag").select(label, F.col("pos_tag").alias("top_pos"))
    word = modes(r, [label], "token_text").select(label, F.col("token_text").alias("top_token"))
    return per.join(tag, label, "left").join(word, label, "left").orderBy(F.desc("size"), label)


def noise_share(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.agg(F.count_distinct(F.when(F.col(label) >= 0, F.col(label))).alias("n_clusters"), F.count_if(F.col(label) < 0).alias("n_noise"), F.try_divide(100 * F.count_if(F.col(label) >= 0), F.count(F.lit(1))).alias("pct_clustered"))


def lemma_residual(df: DataFrame, lemma: str, vec: str, dim: int) -> DataFrame:
    """Vectors minus their lemma's mean vector."""
    m = centroids(df, [lemma], vec, dim)
    return df.join(m, lemma).withColumn("residual", F.zip_with(vec, "centroid", lambda x, y: x - y)).drop("centroid")
