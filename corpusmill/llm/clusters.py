"""Hierarchical density clustering of vectors: neighbour graph, distributed Borůvka forest, condensed hierarchy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import vectors as V
from corpusmill.operators.graph import clusters_at, condense, condensed_clusters, dense_forest, spanning_forest
from corpusmill.shared import arrow_rows, cut

#: most rows of a cell that one task takes from either side; it holds the similarities of all of them
BLOCK = 1536

__all__ = ["condensed_clusters", "density_forest", "describe", "linked_clusters", "neighbour_graph"]


def in_blocks(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Rows by the tasks that compare them: (cell, lo, hi) for every pair of blocks of a cell.

    A cell of more than ``block`` rows is split by a hash of the key, so no task gets more than about two blocks whatever the
    share of rows in one cell; the pairs of a cell are all compared, as every block meets every other (a cell of one block itself).
    """
    each = rows.select(*columns, F.explode("cells").alias("cell"))
    sizes = cut(rows.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_k")), "cells")
    return (
        each.join(sizes, "cell")
        .withColumn("_b", F.pmod(F.xxhash64("key"), F.col("_k")).cast("int"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .filter((F.col("_j") != F.col("_b")) | (F.col("_k") == 1))
        .select("cell", F.least("_b", "_j").alias("lo"), F.greatest("_b", "_j").alias("hi"), *columns)
    )


def neighbour_graph(rows: DataFrame, dim: int, least: float, min_samples: int = 1, block: int = BLOCK) -> DataFrame:
    """Links (a, b, w) whose maximum spanning forest is that of all pairs sharing a cell with mutual reachability >= least.

    ``w`` is the mutual reachability on the similarity scale: the least of the pair's similarity and both rows' core similarity, that of
    their min_samples-th nearest other row among those that share a cell.  With min_samples 1 a row's core similarity is that of its
    nearest row, never below the pair's, so w is the similarity.  Each task sends only the spanning forest of its
    block, so dense groups give links in proportion to their rows, not to their pairs.
    """
    columns = ["key", "vec"]
    if min_samples > 1:

        def near(t: pa.Table) -> pa.Table:
            key, x = _unique(t, dim)
            s = x @ x.T
            np.fill_diagonal(s, -1)
            k = min(min_samples, max(len(key) - 1, 1))
            j = np.argpartition(-s, k - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(len(key)), k)
            return pa.table({"key": key[i], "other": key[j.ravel()], "s": s[i, j.ravel()].astype(np.float64)})

        got = in_blocks(rows, columns, block).groupBy("cell", "lo", "hi").applyInArrow(near, "key long, other long, s double")
        got = got.filter("key != other").groupBy("key", "other").agg(F.max("s").alias("s"))
        core = got.groupBy("key").agg(F.reverse(F.sort_array(F.collect_list("s"))).alias("_s")).select("key", F.try_element_at("_s", F.lit(min_samples)).cast("float").alias("core"))
        rows = cut(rows.join(core, "key", "left").withColumn("core", F.coalesce("core", F.lit(-1.0).cast("float"))), "core")
        columns = [*columns, "core"]

    def forest(t: pa.Table) -> pa.Table:
        key, x, *core = _unique(t, dim, *columns[2:])
        s = x @ x.T
        for c in core:
            s = np.minimum(np.minimum(s, c[:, None]), c[None, :])
        i, j = dense_forest(s, least)
        # the links' weights exactly, as the products above are in single precision
        w = (x[i].astype(np.float64) * x[j]).sum(1)
        for c in core:
            w = np.minimum(w, np.minimum(c[i], c[j]))
        a, b = key[i], key[j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "w": w})

    return in_blocks(rows, columns, block).groupBy("cell", "lo", "hi").applyInArrow(forest, "a long, b long, w double")


def _unique(t: pa.Table, dim: int, *more: str):
    key, first = np.unique(t.column("key").to_numpy(), return_index=True)
    x = V.unpack(t.column("vec").take(pa.array(first)).to_pylist(), dim)
    return key, V.unit(x), *[t.column(c).to_numpy()[first] for c in more]


def density_forest(
    vectors: DataFrame, least: float, min_samples: int = 1, key: str = "row_id", vec: str = "delta", dim: int = 768, n_cells: int = 2, rows_per_cell: int = 600, seed: int = 42, block: int = BLOCK
) -> tuple[DataFrame, DataFrame] | None:
    """Index all valid rows, link them inside their n_cells nearest cells, and span the links; None if there is no valid vector."""
    fitted = V.fit_index(vectors, key, vec, dim, seed, rows_per_cell)
    if fitted is None:
        return None
    rows = index_only(vectors, key, vec, fitted[0], n_cells)
    return spanning_forest(neighbour_graph(rows, dim, least, min_samples, block))


def index_only(vectors: DataFrame, key: str, vec: str, index: V.Index, n_cells: int) -> DataFrame:
    """key, cells and lossless vec of every valid row, without codes."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def place(batches):
        ix = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                p = b.slice(lo, 2048)
                at, x = V.dense(p.column(1), ix.dim)
                cells = ix.cells(V.unit(x), n_cells) if len(x) else np.zeros((0, 1), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [p.column(0).take(pa.array(at)).cast(pa.int64()), pa.array(list(cells), pa.list_(pa.int64())), pa.array(V.pack(x), pa.binary())],
                    names=["key", "cells", "vec"],
                )

    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), vec)
    with arrow_rows(vectors.sparkSession, 1024):
        return cut(rows.mapInArrow(place, "key long, cells array<long>, vec binary"), "placed")


def linked_clusters(vectors: DataFrame, least: float = 0.33, min_rows: int = 10, key: str = "row_id", vec: str = "delta", dim: int = 768, **more) -> DataFrame:
    """The condensed hierarchy cut at one similarity: key, cluster_id (smallest key) of every member of a cluster of min_rows or more.

    Rows of one key are one vector; invalid vectors take no part; equal vectors are linked.  No valid vector: no rows.
    """
    got = density_forest(vectors, least, 1, key, vec, dim, **more)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "key long, cluster_id long")
    return clusters_at(*condense(got[0], min_rows), least)


def describe(members: DataFrame, clusters: DataFrame, tags: DataFrame, n_exemplars: int = 3) -> DataFrame:
    """cluster_id, n_rows, stability, exemplars (most persistent keys, of equal ones those with the strongest link), tags (value and count, most frequent first)."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("persistence"), F.desc("core"), "key")
    best = members.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n_exemplars)
    best = best.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "key"))), lambda x: x["key"]).alias("exemplars"))
    found = members.join(tags.dropDuplicates(["key"]), "key").groupBy("cluster_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))), lambda x: F.struct(x["tag"].alias("tag"), (-x["m"]).alias("n"))).alias("tags"))
    return clusters.join(best, "cluster_id", "left").join(found, "cluster_id", "left")
