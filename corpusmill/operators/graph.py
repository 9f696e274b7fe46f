"""Spanning forests and condensed hierarchies of weighted graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import chase, cut, discard, ranked


def dense_forest(s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum spanning forest of a dense similarity matrix over links of at least ``least``: (i, j), by Borůvka rounds."""
    n = len(s)
    s = np.where(s >= least, s, -np.inf)
    np.fill_diagonal(s, -np.inf)
    comp = np.arange(n)
    ends: list[tuple[int, int]] = []
    while True:
        j = s.argmax(1)
        w = s[np.arange(n), j]
        order = np.argsort(-w, kind="stable")
        order = order[np.isfinite(w[order])]
        if not len(order):
            break
        _, first = np.unique(comp[order], return_index=True)
        parent = {int(c): int(c) for c in np.unique(comp)}

        def root(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in order[np.sort(first)]:  # a component's best link; what ties would close to a cycle is skipped
            a, b = root(int(comp[i])), root(int(comp[j[i]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                ends.append((int(i), int(j[i])))
        comp = np.array([root(int(c)) for c in comp])
        s[comp[:, None] == comp[None, :]] = -np.inf
    e = np.array(ends, np.int64).reshape(-1, 2)
    return e[:, 0], e[:, 1]


def spanning_forest(links: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Maximum spanning forest by Borůvka rounds: (forest a, b, w; labels node, root).

    In each round every component takes its best link (ties by the ends, so no cycle arises but a pair taking the same link), the choices are
    chased to their roots by pointer jumping, and links inside a component drop out.  The components at least halve in each round; if links
    are left after most_rounds it is an error.
    """
    links = links.groupBy("a", "b").agg(F.max("w").alias("w")).withColumns({"u": F.col("a"), "v": F.col("b")})
    links = cut(links, "links")
    labels = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    forest = None
    for _ in range(most_rounds):
        both = links.unionByName(links.withColumns({"u": F.col("v"), "v": F.col("u")}))
        best = cut(both.groupBy("u").agg(F.max(F.struct("w", "a", "b", "v")).alias("m")).select("u", "m.*"), "best")
        if best.isEmpty():
            break
        taken = best.select("a", "b", "w").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        back = best.select(F.col("u").alias("v"), F.col("v").alias("_back"))
        # two components that took the same link: the smaller is the root
        up = best.select("u", "v").join(back, "v", "left").select("u", F.when((F.col("_back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p"))
        ends = cut(chase(up.filter("u != p")).unionByName(up.filter("u = p").select("u", F.col("p").alias("root"))), "ends")
        up = ends.withColumnRenamed("root", "p")
        old = labels
        labels = cut(labels.join(up.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        at_u, at_v = up.select("u", F.col("p").alias("_u")), up.select(F.col("u").alias("v"), F.col("p").alias("_v"))
        rest = cut(links.join(at_u, "u").join(at_v, "v").filter("_u != _v").select("a", "b", "w", F.col("_u").alias("u"), F.col("_v").alias("v")), "links")
        discard(links)
        discard(old)
        links = rest
    else:
        raise RuntimeError(f"the forest was not finished in {most_rounds} rounds")
    if forest is None:
        forest = links.select("a", "b", "w")
    return forest, labels


#: links that one task merges in order; the hierarchy of more is built range by range
RANGE_LINKS = 250_000

_STATE = "kind int, u long, p long, w double, size long, node long, mass double, below double"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_MAP, _COMP, _NODE, _JOIN = range(4)


def _density(w: float) -> float:
    return 1 / (1 - w)


def _merge_range(number: int, min_rows: int):
    """Links of one range, best first, merged one by one over what the ranges before have left of their ends.

    In: ca, cb (components of both ends), w, and of each its size, node, mass, below (NULL for a single row).  Out, by kind: components that
    became part of others (u, p); components as they are now (u, size, node, mass, below); nodes that ended in a merge (node, parent p,
    w, size, mass = stability, below); small components that joined a node (u, node, w).
    """

    def run(batches):
        parent: dict[int, int] = {}
        state: dict[int, list] = {}  # root: size, node or None, mass, below, small components that wait for a node
        fresh = number << 40
        out: list[tuple] = []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            c = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for ca, cb, w, *of in zip(*c):
                for x, (size, node, mass, below) in ((ca, of[:4]), (cb, of[4:])):
                    if x not in parent:
                        parent[x] = x
                        state[x] = [size or 1, node, mass or 0.0, below or 0.0, [] if node is not None else [x]]
                x, y = root(ca), root(cb)
                if x == y:
                    continue
                x, y = min(x, y), max(x, y)
                parent[y] = x
                one, two = state[x], state.pop(y)
                size, lam = one[0] + two[0], _density(w)
                if one[1] is not None and two[1] is not None:
                    fresh += 1
                    best = 0.0
                    for s in (one, two):
                        own = s[2] - s[0] * lam
                        best += max(own, s[3])
                        out.append((_NODE, None, fresh, w, s[0], s[1], own, s[3]))
                    state[x] = [size, fresh, size * lam, best, []]
                elif one[1] is not None or two[1] is not None:
                    big, small = (one, two) if one[1] is not None else (two, one)
                    out += [(_JOIN, u, None, w, None, big[1], None, None) for u in small[4]]
                    state[x] = [size, big[1], big[2] + small[0] * lam, big[3], []]
                elif size >= min_rows:
                    fresh += 1
                    out += [(_JOIN, u, None, w, None, fresh, None, None) for u in one[4] + two[4]]
                    state[x] = [size, fresh, size * lam, 0.0, []]
                else:
                    state[x] = [size, None, 0.0, 0.0, one[4] + two[4]]
        out += [(_MAP, u, root(u), None, None, None, None, None) for u in parent if parent[u] != u]
        out += [(_COMP, u, None, None, s[0], s[1], s[2], s[3]) for u, s in state.items()]
        for i in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 50_000]), _TYPES)], names=_NAMES)

    return run


def condense(forest: DataFrame, min_rows: int = 10, range_links: int = RANGE_LINKS) -> tuple[DataFrame, DataFrame]:
    """The condensed single-linkage hierarchy of a forest (a, b, w), exactly: (nodes, rows).

    Links are merged in the order of their weights (ties by the ends).  A component becomes a node when it reaches min_rows; two nodes that
    merge end in a parent node; a smaller component that merges with a node joins it.  nodes: node, parent and w (the similarity of the
    merge that ended it; NULL at a root), n_rows, stability, below.  Densities are lambda = 1 / (1 - w), w held below 1 - 1e-6;
    stability is the sum over the node's rows of the densities between their joining and the node's end (a root's end is the weakest link
    of the forest), below the best that the nodes under it reach together.  rows: key, node, w (the similarity at which the row's
    component joined).  Rows of components that never reach min_rows are in no node.

    One task takes range_links links, contracted by what the ranges before have merged, so its memory is bounded at every size; ranges follow
    each other, their number being links / range_links.
    """
    links = forest.select("a", "b", F.least(F.col("w").cast("double"), F.lit(1 - 1e-6)).alias("w"))
    links = cut(ranked(links.withColumn("_o", -F.col("w")), [], ["_o", "a", "b"]).drop("_o"), "order")
    top = links.agg(F.max("rank"), F.min("w")).first()
    spark = forest.sparkSession
    if top[0] is None:
        return spark.createDataFrame([], "node long, parent long, w double, n_rows long, stability double, below double"), spark.createDataFrame([], "key long, node long, w double")
    labels = comps = nodes = rows = None
    for k in range(top[0] // range_links + 1):
        part = links.filter((F.col("rank") >= k * range_links) & (F.col("rank") < (k + 1) * range_links))
        for end in "ab":
            if labels is None:
                part = part.withColumn(f"c{end}", F.col(end))
                part = part.withColumns({f"{x}{end}": F.lit(None).cast(t) for x, t in (("size", "long"), ("node", "long"), ("mass", "double"), ("below", "double"))})
            else:
                part = part.join(labels.select(F.col("key").alias(end), F.col("comp").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
                part = part.join(comps.select(F.col("u").alias(f"c{end}"), *[F.col(x).alias(f"{x}{end}") for x in ("size", "node", "mass", "below")]), f"c{end}", "left")
        part = part.select("ca", "cb", "w", *[f"{x}{end}" for end in "ab" for x in ("size", "node", "mass", "below")], "rank")
        got = cut(part.repartition(1).sortWithinPartitions("rank").drop("rank").mapInArrow(_merge_range(k + 1, min_rows), _STATE), "merged")
        moved = got.filter(F.col("kind") == _MAP).select(F.col("u").alias("comp"), F.col("p").alias("_to"))
        joined = got.filter(F.col("kind") == _JOIN).select(F.col("u").alias("comp"), "node", "w")
        ended = got.filter(F.col("kind") == _NODE).select("node", F.col("p").alias("parent"), "w", F.col("size").alias("n_rows"), F.col("mass").alias("stability"), "below")
        now = got.filter(F.col("kind") == _COMP).select("u", "size", "node", "mass", "below")
        if labels is None:
            entered = joined.select(F.col("comp").alias("key"), "node", "w")
            labels = moved.select(F.col("comp").alias("key"), F.col("_to").alias("comp"))
            comps = now
        else:
            # rows that no range has moved yet stand for themselves
            known = labels.select("key", "comp")
            alone = got.filter(F.col("kind").isin(_MAP, _JOIN)).select(F.col("u").alias("key")).distinct().join(known, "key", "left_anti").select("key", F.col("key").alias("comp"))
            every = cut(known.unionByName(alone), "labels")
            entered = every.join(joined, "comp").select("key", "node", "w")
            labels = cut(every.join(moved, "comp", "left").select("key", F.coalesce("_to", "comp").alias("comp")), "labels")
            gone = moved.select(F.col("comp").alias("u")).unionByName(now.select("u")).distinct()
            comps = cut(comps.join(gone, "u", "left_anti").unionByName(now), "comps")
        nodes = ended if nodes is None else nodes.unionByName(ended)
        rows = entered if rows is None else rows.unionByName(entered)
    end = F.lit(_density(top[1]))
    roots = comps.filter(F.col("node").isNotNull()).select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("w"), F.col("size").alias("n_rows"), (F.col("mass") - F.col("size") * end).alias("stability"), "below")
    return cut(nodes.unionByName(roots), "nodes"), cut(rows, "entered")


def clusters_at(nodes: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The condensed hierarchy cut at one similarity: key, cluster_id (smallest key) of the rows in components of min_rows or more."""
    top = chase(nodes.filter(F.col("w") >= least).select(F.col("node").alias("u"), F.col("parent").alias("p")))
    at = rows.filter(F.col("w") >= least).join(top.withColumnRenamed("u", "node"), "node", "left").select("key", F.coalesce("root", "node").alias("_c"))
    at = cut(at, "at")
    return at.join(at.groupBy("_c").agg(F.min("key").alias("cluster_id")), "_c").select("key", "cluster_id")


def condensed_clusters(forest: DataFrame, min_rows: int = 10, method: str = "eom", range_links: int = RANGE_LINKS) -> tuple[DataFrame, DataFrame]:
    """Clusters of the condensed hierarchy: (members key, cluster_id, persistence, core; clusters cluster_id, n_rows, stability).

    ``eom``: the topmost nodes whose stability is at least what the nodes under them reach together (excess of mass), also at the top;
    ``leaf``: the nodes without nodes under them.  cluster_id is the smallest key.  Persistence is the density at which a member's component
    joined; rows that founded a node together tie, so ``core``, a member's strongest link, tells them apart.
    """
    nodes, rows = condense(forest, min_rows, range_links)
    chosen = F.col("stability") >= F.col("below") if method == "eom" else F.col("below") == 0
    # topmost chosen node on the way from each node to its root, by pointer doubling
    up = cut(nodes.select("node", F.col("parent").alias("p"), F.when(chosen, F.col("node")).alias("top")), "up")
    while not up.filter("p is not null").isEmpty():
        far = up.select(F.col("node").alias("p"), F.col("p").alias("_q"), F.col("top").alias("_top"))
        new = cut(up.join(far, "p", "left").select("node", F.col("_q").alias("p"), F.coalesce("_top", "top").alias("top")), "up")
        discard(up)
        up = new
    mine = rows.join(up.filter("top is not null").select("node", "top"), "node").select("key", "top", (1 / (1 - F.col("w"))).alias("persistence"))
    strongest = forest.select(F.col("a").alias("key"), "w").unionByName(forest.select(F.col("b").alias("key"), "w")).groupBy("key").agg(F.max("w").alias("core"))
    mine = cut(mine.join(strongest, "key"), "members")
    named = mine.groupBy("top").agg(F.min("key").alias("cluster_id"), F.count(F.lit(1)).alias("n_rows")).join(nodes.select(F.col("node").alias("top"), "stability"), "top")
    named = cut(named, "clusters")
    return mine.join(named.select("top", "cluster_id"), "top").select("key", "cluster_id", "persistence", "core"), named.select("cluster_id", "n_rows", "stability")
