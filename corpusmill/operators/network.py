"""Partial-correlation networks: estimation, centrality, communities, bootstraps and comparison.

Spark reduces rows to moments (a few numbers per pair of variables, and per replicate); the solvers work on matrices of a
few dozen variables.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.stats import complete


def lasso_precision(s: np.ndarray, lam: float, start: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 50, tol: float = 1e-4) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Sparse inverse of a correlation matrix (graphical lasso, diagonal unpenalised): (precision, state for the next penalty).

    Column by column a lasso regression on the others by coordinate descent, until the covariance settles.
    """
    p = len(s)
    w, beta = (s.copy(), np.zeros((p, p))) if start is None else (start[0].copy(), start[1].copy())
    np.fill_diagonal(w, np.diag(s))
    others = [np.flatnonzero(np.arange(p) != j) for j in range(p)]
    for _ in range(rounds):
        old = w.copy()
        for j in range(p):
            o = others[j]
            v, b = w[np.ix_(o, o)], beta[o, j]
            left = s[o, j] - v @ b  # what the regression leaves of each covariance
            for _ in range(50):
                most = 0.0
                for k in range(p - 1):
                    d = v[k, k]
                    x = left[k] + d * b[k]
                    new = (x - lam if x > lam else x + lam if x < -lam else 0.0) / d
                    step = new - b[k]
                    if step:
                        left -= v[k] * step
                        b[k] = new
                        most = max(most, abs(step))
                if most < tol:
                    break
            beta[o, j] = b
            w[o, j] = w[j, o] = s[o, j] - left
        if np.abs(w - old).max() < tol:
            break
    k = np.zeros((p, p))
    for j in range(p):
        o = others[j]
        k[j, j] = 1 / (w[j, j] - w[o, j] @ beta[o, j])
        k[o, j] = -beta[o, j] * k[j, j]
    return (k + k.T) / 2, (w, beta)


def partial_correlations(r: np.ndarray, n: float, gamma: float = 0.5, steps: int = 30) -> np.ndarray:
    """The network with the least extended BIC over a path of penalties; an undefined matrix gives no edges."""
    p = len(r)
    if not np.isfinite(r).all() or n <= 2:
        return np.zeros((p, p))
    off = ~np.eye(p, dtype=bool)
    top = max(np.abs(r[off]).max(), 1e-4)
    best, state, chosen = np.inf, None, np.eye(p)
    for lam in np.geomspace(top, top / 100, steps):
        k, state = lasso_precision(r, lam, state)
        sign, logdet = np.linalg.slogdet(k)
        if sign <= 0:
            continue
        edges = (np.abs(k[off]) > 1e-8).sum() / 2
        ebic = -n * (logdet - np.trace(r @ k)) + edges * np.log(n) + 4 * edges * gamma * np.log(p)
        if ebic < best:
            best, chosen = ebic, k
    d = np.sqrt(np.diag(chosen))
    net = -chosen / np.outer(d, d)
    net[np.abs(net) < 1e-8] = 0
    np.fill_diagonal(net, 0)
    return net


# --- moments by replicate -------------------------------------------------------------------------------------------


def moments(df: DataFrame, columns: Sequence[str], key: str, replicates: int, weight: Callable[[np.ndarray, np.ndarray, pd.Series | None], np.ndarray], seed: int = 42, group: str | None = None) -> DataFrame:
    """replicate, m: weighted sums of 1, x and x x' of every replicate, in one pass over the rows.

    ``weight`` gives the weights (rows x replicates) from uniform numbers that depend on row key, replicate and seed only,
    so the result doesn't depend on partitioning, and from the group column.  What is shuffled are sums per task, never rows.
    """
    cols = list(columns)
    p = len(cols)
    iu = np.triu_indices(p)
    d = complete(df, cols).select(F.xxhash64(F.lit(seed), F.col(key)).alias("_k"), *([F.col(group).alias("_g")] if group else []), *cols)

    def run(batches):
        total = np.zeros((replicates, 1 + p + len(iu[0])))
        some = False
        for b in batches:
            t = b.to_pandas()
            for i in range(0, len(t), 4096):
                q = t.iloc[i : i + 4096]
                x = q[cols].to_numpy(float)
                w = weight(_uniform(q["_k"].to_numpy(), replicates), np.arange(replicates), q["_g"] if group else None)
                total += w.T @ np.hstack([np.ones((len(x), 1)), x, x[:, iu[0]] * x[:, iu[1]]])
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(list(total), pa.list_(pa.float64()))], names=["replicate", "m"])

    parts = d.mapInArrow(run, "replicate long, m array<double>").select("replicate", F.posexplode("m").alias("i", "v"))
    sums = parts.groupBy("replicate", "i").agg(F.sum("v").alias("v"))
    return sums.groupBy("replicate").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("m"))


def correlation_of(m: np.ndarray, p: int) -> tuple[np.ndarray, float]:
    """(correlation matrix, weight) from the sums of :func:`moments`."""
    n, mean = m[0], m[1 : 1 + p] / max(m[0], 1e-9)
    c = np.zeros((p, p))
    c[np.triu_indices(p)] = m[1 + p :] / max(n, 1e-9)
    c = c + np.triu(c, 1).T - np.outer(mean, mean)
    d = np.sqrt(np.maximum(np.diag(c), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return c / np.outer(d, d), float(n)


def once(u, reps, g):
    return np.ones_like(u)


def poisson(u, reps, g):
    """Poisson(1) counts from uniform numbers: the bootstrap without gathering rows; replicate 0 is the sample."""
    w, edge, term = np.zeros_like(u), np.exp(-1), np.exp(-1)
    for k in range(1, 9):
        w += u > edge
        term /= k
        edge += term
    w[:, 0] = 1
    return w


def network(df: DataFrame, columns: Sequence[str], key: str, gamma: float = 0.5) -> np.ndarray:
    r, n = correlation_of(np.array(moments(df, columns, key, 1, once).first()["m"]), len(columns))
    return partial_correlations(r, n, gamma)


def edges(spark: SparkSession, net: np.ndarray, columns: Sequence[str]) -> DataFrame:
    """src, dst, weight of every non-zero edge, src before dst in the columns' order."""
    i, j = np.nonzero(np.triu(net, 1))
    return spark.createDataFrame([(columns[a], columns[b], float(net[a, b])) for a, b in zip(i, j)], "src string, dst string, weight double")


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def strength(e: DataFrame) -> DataFrame:
    """node, strength (sum of absolute weights), expected_influence (sum of weights)."""
    return both_ways(e).groupBy(F.col("src").alias("node")).agg(F.sum(F.abs("weight")).alias("strength"), F.sum("weight").alias("expected_influence"))


def bridge(e: DataFrame, community: DataFrame) -> DataFrame:
    """The same sums over edges that leave the node's community (node, community); nodes without one have 0."""
    c = both_ways(e).join(community.select(F.col("node").alias("src"), F.col("community").alias("_a")), "src").join(community.select(F.col("node").alias("dst"), F.col("community").alias("_b")), "dst")
    out = c.filter("_a != _b").groupBy(F.col("src").alias("node")).agg(F.sum(F.abs("weight")).alias("s"), F.sum("weight").alias("x"))
    return community.join(out, "node", "left").select("node", "community", F.coalesce("s", F.lit(0.0)).alias("bridge_strength"), F.coalesce("x", F.lit(0.0)).alias("bridge_influence"))


def paths(net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(betweenness, closeness) over shortest paths of length 1 / |weight| (Brandes' accumulation)."""
    p = len(net)
    between, close = np.zeros(p), np.zeros(p)
    for s in range(p):
        dist, sigma, before, order = np.full(p, np.inf), np.zeros(p), [[] for _ in range(p)], []
        dist[s], sigma[s], queue, done = 0, 1, [(0.0, s)], set()
        while queue:
            d, v = heapq.heappop(queue)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for w in np.flatnonzero(net[v]):
                x = d + 1 / abs(net[v, w])
                if x < dist[w] - 1e-12:
                    dist[w], sigma[w], before[w] = x, sigma[v], [v]
                    heapq.heappush(queue, (x, w))
                elif abs(x - dist[w]) <= 1e-12 and v not in before[w]:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = np.zeros(p)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                between[w] += delta[w]
        far = dist[np.isfinite(dist)].sum()
        close[s] = 1 / far if far > 0 else 0
    return between / 2, close


def walktrap(net: np.ndarray, steps: int = 4) -> np.ndarray:
    """Communities by random walks: Ward merges of neighbouring groups by walk distance, cut at the best modularity."""
    a = np.abs(net)
    p = len(a)
    loops = a + np.diag(np.where(a.sum(1) > 0, a.sum(1) / np.maximum((a > 0).sum(1), 1), 1.0))
    d = loops.sum(1)
    walk = np.linalg.matrix_power(loops / d[:, None], steps)
    groups = {i: [i] for i in range(p)}
    mean = {i: walk[i] for i in range(p)}
    total = max(a.sum(), 1e-12)

    def modularity(g) -> float:
        return sum(a[np.ix_(m, m)].sum() / total - (a[m].sum() / total) ** 2 for m in g.values())

    best, cut = modularity(groups), {k: list(v) for k, v in groups.items()}
    while len(groups) > 1:
        pick = None
        for i in groups:
            for j in groups:
                if i < j and a[np.ix_(groups[i], groups[j])].any():
                    n, m = len(groups[i]), len(groups[j])
                    x = n * m / (n + m) * (((mean[i] - mean[j]) ** 2) / d).sum()
                    if pick is None or x < pick[0] - 1e-15:
                        pick = (x, i, j)
        if pick is None:
            break
        _, i, j = pick
        n, m = len(groups[i]), len(groups[j])
        mean[i] = (n * mean[i] + m * mean[j]) / (n + m)
        groups[i] += groups.pop(j)
        if (q := modularity(groups)) > best + 1e-12:
            best, cut = q, {k: list(v) for k, v in groups.items()}
    out = np.zeros(p, int)
    for k, m in enumerate(sorted(cut.values(), key=min), 1):
        out[m] = k
    return out


# --- replicates -----------------------------------------------------------------------------------------------------


def spread(sums: DataFrame) -> DataFrame:
    """One small row per replicate, on all cores: the solvers are what takes time."""
    return sums.repartition(max(8, sums.sparkSession.sparkContext.defaultParallelism), "replicate")


def replicate_edges(sums: DataFrame, columns: Sequence[str], gamma: float = 0.5) -> DataFrame:
    """replicate, src, dst, weight (zeros too) of the network of each replicate's moments."""
    cols = list(columns)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        net = partial_correlations(*correlation_of(np.asarray(pdf["m"].iloc[0]), len(cols)), gamma)
        i, j = np.triu_indices(len(cols), 1)
        return pd.DataFrame({"replicate": pdf["replicate"].iloc[0], "src": [cols[a] for a in i], "dst": [cols[b] for b in j], "weight": net[i, j]})

    def each(pdfs):
        for pdf in pdfs:
            for k in range(len(pdf)):
                yield fit(pdf.iloc[k : k + 1])

    return spread(sums).mapInPandas(each, "replicate long, src string, dst string, weight double")


def bootstrap_edges(df: DataFrame, columns: Sequence[str], key: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Per edge: the sample's weight, 95 % bootstrap interval, and how often it is not zero."""
    e = replicate_edges(moments(df, columns, key, replicates + 1, poisson, seed), columns)
    boot = F.col("replicate") > 0
    q = F.percentile(F.when(boot, F.col("weight")), F.array(F.lit(0.025), F.lit(0.975)))
    return e.groupBy("src", "dst").agg(F.max(F.when(~boot, F.col("weight"))).alias("weight"), q[0].alias("low"), q[1].alias("high"), F.avg(F.when(boot, (F.col("weight") != 0).cast("int"))).alias("kept"))


def case_dropping(df: DataFrame, columns: Sequence[str], key: str, replicates: int = 1000, shares: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7), seed: int = 42) -> DataFrame:
    """dropped, correlation: per replicate, the strength correlation with the full sample after dropping a share of the rows."""
    drop = np.resize(np.array(shares), replicates + 1)
    drop[0] = 0.0

    def keep(u, reps, g):
        return (u >= drop[reps][None, :]).astype(float)

    e = replicate_edges(moments(df, columns, key, replicates + 1, keep, seed), columns)
    ends = e.select("replicate", F.col("src").alias("node"), "weight").unionByName(e.select("replicate", F.col("dst").alias("node"), "weight"))
    s = ends.groupBy("replicate", "node").agg(F.sum(F.abs("weight")).alias("s"))
    full = s.filter("replicate = 0").select("node", F.col("s").alias("_f"))
    c = s.filter("replicate > 0").join(F.broadcast(full), "node").groupBy("replicate").agg(F.corr("s", "_f").alias("correlation"))
    n = len(shares)
    at = F.get(F.array(*[F.lit(float(x)) for x in shares]), (F.col("replicate") % n).cast("int"))
    return c.select("replicate", at.alias("dropped"), "correlation")


def stability_coefficient(dropped: DataFrame, least: float = 0.7, sure: float = 0.95) -> DataFrame:
    """The largest dropped share at which the correlation is at least ``least`` in ``sure`` of the replicates; 0 if none."""
    per = dropped.groupBy("dropped").agg(F.avg((F.coalesce("correlation", F.lit(0.0)) >= least).cast("int")).alias("_ok"))
    return per.agg(F.coalesce(F.max(F.when(F.col("_ok") >= sure, F.col("dropped"))), F.lit(0.0)).alias("cs_coefficient"))


def parametric_communities(net_r: np.ndarray, n: float, columns: Sequence[str], spark: SparkSession, replicates: int = 500, seed: int = 42) -> DataFrame:
    """replicate, node, community of networks of normal samples with a given correlation matrix.

    A sample enters only by its covariance, drawn directly (Bartlett's decomposition of the Wishart distribution).
    """
    cols, lower = list(columns), np.linalg.cholesky(net_r + 1e-9 * np.eye(len(net_r)))
    p = len(cols)

    def one(pdfs):
        for pdf in pdfs:
            rows = []
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                a = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(n - 1 - np.arange(p))))
                c = lower @ a @ a.T @ lower.T
                d = np.sqrt(np.diag(c))
                rows += [(int(k), c_, int(g)) for c_, g in zip(cols, walktrap(partial_correlations(c / np.outer(d, d), n)))]
            yield pd.DataFrame(rows, columns=["replicate", "node", "community"])

    return spark.range(replicates).repartition(max(8, spark.sparkContext.defaultParallelism)).mapInPandas(one, "replicate long, node string, community int")


def item_stability(communities: DataFrame, final: DataFrame) -> DataFrame:
    """node, stability: how often a replicate puts the node where the final solution has it.

    A replicate's communities are first named after the final ones by their overlap, largest first, each name once: numbers alone would shift
    when one node moves.  One group holds the nodes of one replicate.
    """
    last = {r["node"]: r["community"] for r in final.select("node", "community").collect()}  # one row per variable

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        overlap = pd.crosstab(pdf["community"], pdf["node"].map(last))
        name: dict = {}
        for _, a, b in sorted(((-overlap.loc[a, b], a, b) for a in overlap.index for b in overlap.columns)):
            if a not in name and b not in name.values():
                name[a] = b
        same = [float(name.get(c) == last[x]) for c, x in zip(pdf["community"], pdf["node"])]
        return pd.DataFrame({"node": pdf["node"], "same": same})

    return communities.groupBy("replicate").applyInPandas(align, "node string, same double").groupBy("node").agg(F.avg("same").alias("stability"))


def community_counts(communities: DataFrame) -> DataFrame:
    """n_communities, n_replicates, share, modal: how often the replicates have how many communities; the mode (ties to fewer) is marked."""
    per = communities.groupBy("replicate").agg(F.count_distinct("community").alias("n_communities")).groupBy("n_communities").agg(F.count(F.lit(1)).alias("n_replicates"))
    whole = Window.partitionBy(F.lit(0))  # a handful of rows
    return per.withColumn("share", F.col("n_replicates") / F.sum("n_replicates").over(whole)).withColumn("modal", F.row_number().over(whole.orderBy(F.desc("n_replicates"), "n_communities")) == 1)


def bridge_groups(found: DataFrame, theory: DataFrame) -> DataFrame:
    """The communities found, or the groups of the theory (node, community) where only one was found."""
    return found if found.select("community").distinct().count() > 1 else theory


def _uniform(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Uniform numbers (rows x replicates) that depend on row key and replicate only."""
    h = keys.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def thresholds(df: DataFrame, columns: Sequence[str], key: str, replicates: int, size: int, seed: int = 42, passes: int = 5, bins: int = 256) -> np.ndarray:
    """For every replicate the number below which exactly ``size`` of the rows' uniform numbers lie.

    Each pass counts the numbers in ``bins`` parts of the interval still open, so what is shuffled are counts; after five passes the interval is
    2^-40 wide and two numbers rarely share it.
    """
    d = complete(df, columns).select(F.xxhash64(F.lit(seed), F.col(key)).alias("_k"))
    low, width, left = np.zeros(replicates), np.ones(replicates), np.full(replicates, size, np.int64)
    for _ in range(passes):

        def count(batches, low=low, width=width):
            total = np.zeros((replicates, bins), np.int64)
            for b in batches:
                keys = b.column(0).to_numpy()
                for i in range(0, len(keys), 2048):
                    part = (_uniform(keys[i : i + 2048], replicates) - low) / width
                    at = np.floor(part * bins).astype(np.int64)
                    r = np.broadcast_to(np.arange(replicates), at.shape)
                    ok = (at >= 0) & (at < bins)
                    np.add.at(total, (r[ok], at[ok]), 1)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([0], pa.int32())], names=["v", "g"])

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v, np.int64) for v in t.column("v").to_pylist())
            return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

        got = d.mapInArrow(count, "v binary, g int").groupBy("g").applyInArrow(add, "v binary").first()
        if got is None:
            break
        counts = np.frombuffer(got["v"], np.int64).reshape(replicates, bins)
        upto = np.cumsum(counts, axis=1)
        at = np.minimum((upto < left[:, None]).sum(1), bins - 1)
        left = left - np.where(at > 0, upto[np.arange(replicates), at - 1], 0)
        width = width / bins
        low = low + at * width
    return low + width


def comparison_test(df: DataFrame, columns: Sequence[str], key: str, group: str, a: str, b: str, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """Two groups' networks against permuted labels: statistic, observed, p_value.

    Statistics: ``max_difference`` over edges, ``strength_difference`` of global strength, ``edge src-dst`` each, and strength, betweenness and
    closeness of each node.  A permutation gives the first group as many rows as it has, those with the smallest uniform numbers; replicate 0
    has the true labels.
    """
    cols = list(columns)
    d = complete(df.filter(F.col(group).isin(a, b)), cols)
    size = d.filter(F.col(group) == a).count()
    edge = thresholds(d, cols, key, permutations + 1, size, seed)

    def first(u, reps, g):
        w = (u < edge[None, :]).astype(float)
        w[:, 0] = (g == a).to_numpy(float)
        return w

    one = moments(d, cols, key, permutations + 1, first, seed, group)
    whole = moments(d, cols, key, 1, once, seed).first()
    total = np.array(whole["m"]) if whole else None
    p = len(cols)

    def fit(pdfs):
        for pdf in pdfs:
            rows = []
            for k, m in zip(pdf["replicate"], pdf["m"]):
                m = np.asarray(m)
                x, y = (partial_correlations(*correlation_of(z, p)) for z in (m, total - m))
                i, j = np.triu_indices(p, 1)
                diff = np.abs(x - y)[i, j]
                rows += [(k, "max_difference", diff.max()), (k, "strength_difference", abs(np.abs(x[i, j]).sum() - np.abs(y[i, j]).sum()))]
                rows += [(k, f"edge {cols[s]}-{cols[t]}", v) for s, t, v in zip(i, j, diff)]
                for name, s, t in zip(("strength", "betweenness", "closeness"), (np.abs(x).sum(0), *paths(x)), (np.abs(y).sum(0), *paths(y))):
                    rows += [(k, f"{name} {c}", float(v)) for c, v in zip(cols, np.abs(s - t))]
            yield pd.DataFrame(rows, columns=["replicate", "statistic", "value"])

    v = spread(one).mapInPandas(fit, "replicate long, statistic string, value double")
    return v.groupBy("statistic").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("observed"), F.collect_list(F.when(F.col("replicate") > 0, F.col("value"))).alias("_v")).select(
        "statistic", "observed", ((F.size(F.filter("_v", lambda x: x >= F.col("observed"))) + 1) / (F.size("_v") + 1)).alias("p_value")
    )


def significant(test: DataFrame, node: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Edges of a comparison whose p_value is below alpha, of one node if given: src, dst, observed, p_value."""
    e = test.filter(F.col("statistic").startswith("edge ") & (F.col("p_value") < alpha))
    ends = F.split(F.substring("statistic", 6, 1000), "-")
    out = e.select(ends[0].alias("src"), ends[1].alias("dst"), "observed", "p_value").filter("src != dst")
    return out if node is None else out.filter((F.col("src") == node) | (F.col("dst") == node))


def sparsity(e: DataFrame, n_nodes: int) -> DataFrame:
    """n_edges that are not zero, and the share of possible edges that is missing."""
    possible = n_nodes * (n_nodes - 1) / 2
    return e.agg(F.count_if(F.col("weight") != 0).alias("n_edges"), (1 - F.count_if(F.col("weight") != 0) / possible).alias("sparsity"))


def edge_differences(a: DataFrame, b: DataFrame, node: str) -> DataFrame:
    """partner, weight in both networks and their difference for all edges of one node, largest difference first."""
    x, y = (both_ways(e).filter(F.col("src") == node).select(F.col("dst").alias("partner"), F.col("weight").alias(n)) for e, n in ((a, "weight_a"), (b, "weight_b")))
    j = x.join(y, "partner", "full").fillna(0.0, ["weight_a", "weight_b"])
    d = F.col("weight_a") - F.col("weight_b")
    return j.withColumn("difference", d).orderBy(F.desc(F.abs("difference")), "partner")
