import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import clusters as C
from corpusmill.llm import vectors as V

DIM = 64
SCHEMA = "row_id long, delta array<float>, key int, cells string"


def _data(n_clusters=4, seed=0):
    rng = np.random.default_rng(seed)
    x = []
    for c in range(n_clusters):
        centre = rng.standard_normal(DIM)
        x += [2 * centre + 0.8 * rng.standard_normal(DIM) for _ in range(30 + 20 * c)]
    x += [rng.standard_normal(DIM) for _ in range(60)]
    for i in range(20):
        x.append(x[i * 3] + 0.2 * rng.standard_normal(DIM))
    return np.round(np.array(x) * 16) / 256


def _df(spark, x, more=()):
    rows = [(i, [float(v) for v in r], 1, "c") for i, r in enumerate(x)]
    rows += [(i, [float(v) for v in x[i]], 1, "c") for i in (0, 1)]
    bad = [(9001, None), (9002, []), (9003, [1.0] * (DIM - 1)), (9004, [0.0] * DIM), (9005, [float("nan")] * DIM), (9006, [None] * DIM), (None, [1.0] * DIM)]
    return spark.createDataFrame([*rows, *[(k, v, 1, "c") for k, v in bad], *more], SCHEMA)


def _sims(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s


def test_dense_and_pack():
    a = pa.array([[0.5, -0.25], None, [1.0], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [1e-9, 3.3]], pa.list_(pa.float64()))
    at, x = V.dense(a, 2)
    assert list(at) == [0, 6]
    assert (V.unpack(V.pack(x), 2) == x).all() and len(V.pack(x)[0]) == 3 and len(V.pack(x)[1]) == 9
    assert V.dense(pa.array([], pa.list_(pa.float32())), 2)[1].shape == (0, 2)


def test_quantiser_prefers_parallel_accuracy():
    rng = np.random.default_rng(1)
    r = rng.standard_normal((600, DIM)).astype(np.float32)
    d = r / np.linalg.norm(r, axis=1, keepdims=True)

    def parallel(eta):
        book = V.fit_codebook(r, eta, 0)
        e = r - book[np.arange(DIM // V.SUB)[None, :], V.assign(r, book, eta)].reshape(r.shape)
        return np.abs((e * d).sum(1)).mean(), (e * e).sum(1).mean()

    (plain, loss), (aware, more) = parallel(1.0), parallel(8.0)
    assert aware < plain / 2 and more < 2 * loss
    codes = V.assign(r, V.fit_codebook(r, 1.0, 0), 1.0)
    assert (V.unpack_codes(V.pack_codes(codes)) == codes).all() and codes.max() < 16


def test_close_neighbours_equal_brute_force(spark):
    x = _data()
    got = {(r["key"], r["neighbour"], r["rank"]) for r in V.close_neighbours(_df(spark, x), 5, 0.7, dim=DIM).collect()}
    s = _sims(x)
    want = set()
    for i in range(len(x)):
        for rank, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:5], 1):
            if s[i, j] >= 0.7:
                want.add((i, int(j), rank))
    assert got == want


def test_equal_vectors(spark):
    x = _data(1)
    same = [(100_000 + i, [float(v) for v in x[0]], 1, "c") for i in range(40)]
    n = V.close_neighbours(_df(spark, x, same), 5, 0.7, dim=DIM)
    rows = [r for r in n.collect() if r["key"] >= 100_000]
    assert len(rows) == 200 and all(abs(r["similarity"] - 1) < 1e-6 for r in rows)
    assert {r["neighbour"] for r in rows if r["key"] == 100_039} == {0, *range(100_000, 100_004)}


def test_search_recall(spark):
    x = _data()
    df = _df(spark, x)
    got = V.search(df, df.filter("row_id % 10 = 0"), 5, dim=DIM).collect()
    s = _sims(x)
    hits = sum(r["neighbour"] in np.argsort(-s[r["key"]])[:5] for r in got)
    assert {r["key"] for r in got} == set(range(0, len(x), 10)) and hits / len(got) >= 0.9


def test_clusters_equal_brute_force(spark):
    x = _data()
    s = _sims(x)
    label = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([label[i], *[label[j] for j in np.flatnonzero(s[i] >= 0.6)]]) for i in range(len(x))]
        if new == label:
            break
        label = new
    want = {(i, c) for i, c in enumerate(label) if label.count(c) >= 10}
    got = {(r["key"], r["cluster_id"]) for r in C.linked_clusters(_df(spark, x), 0.6, 10, dim=DIM).collect()}
    assert got == want and len({c for _, c in want}) == 4


def test_split_cells_give_the_same_clusters(spark):
    x = _data()
    whole = {tuple(r) for r in C.linked_clusters(_df(spark, x), 0.6, 10, dim=DIM).collect()}
    assert {tuple(r) for r in C.linked_clusters(_df(spark, x), 0.6, 10, dim=DIM, block=40).collect()} == whole


def test_hierarchy(spark):
    x = _data()
    forest, _ = C.density_forest(_df(spark, x), 0.2, 3, dim=DIM)
    members, found = C.condensed_clusters(forest, 10)
    rows = members.collect()
    keys = [r["key"] for r in rows]
    assert len(keys) == len(set(keys))
    sizes = {r["cluster_id"]: r["n_rows"] for r in found.collect()}
    assert all(n >= 10 for n in sizes.values()) and sum(sizes.values()) == len(rows)
    tags = spark.createDataFrame([(k, "t") for k in range(100)] + [(0, "again")], "key long, tag string")
    d = C.describe(members, found, tags).collect()
    assert all(0 < len(r["exemplars"]) <= 3 for r in d)
    first = {i: k for k, lo, hi in (("a", 0, 30), ("b", 30, 80), ("c", 80, 150), ("d", 150, 240)) for i in range(lo, hi)}
    by = {}
    for r in rows:
        by.setdefault(r["cluster_id"], set()).add(first.get(r["key"]))
    assert all(len(v - {None}) <= 1 for v in by.values())


@pytest.mark.parametrize("keep", [0, 1, 2])
def test_few_rows(spark, keep):
    x = _data(1)[:keep]
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, "c") for i, r in enumerate(x)], SCHEMA)
    assert V.close_neighbours(df, 5, 0.99999, dim=DIM).count() == 0
    assert C.linked_clusters(df, 0.5, 2, dim=DIM).count() == (2 if keep == 2 else 0)
    assert V.search(df, df, 3, dim=DIM).count() == keep * (keep - 1)


@pytest.mark.parametrize(("rows_per_cell", "most"), [(30, 1024), (6, 8), (3, 2)])
def test_many_cells(spark, monkeypatch, rows_per_cell, most):
    """More cells than centroids: planes split them; clusters stay whole and few neighbours are missed."""
    x = _data()
    df = _df(spark, x)
    fit = V.fit_index
    monkeypatch.setattr(V, "fit_index", lambda v, key, vec, dim, seed=42, *a: fit(v, key, vec, dim, seed, rows_per_cell, most))
    monkeypatch.setattr(V, "SHELF", 20)
    monkeypatch.setattr(V, "BLOCK", 15)
    index, _ = V.fit_index(df, "row_id", "delta", DIM)
    assert len(index.centroids) <= most and index.n_cells >= 320 / rows_per_cell / 1.5 and len(index.planes) >= 1
    got = {(r["key"], r["neighbour"]) for r in V.close_neighbours(df, 5, 0.7, dim=DIM).collect()}
    s = _sims(x)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:5] if s[i, j] >= 0.7}
    assert len(want & got) >= 0.98 * len(want)
    found = V.search(df, df.filter("row_id % 10 = 0"), 5, dim=DIM).collect()
    assert sum(r["neighbour"] in np.argsort(-s[r["key"]])[:5] for r in found) >= 0.9 * 5 * len({r["key"] for r in found})


def test_cells_are_the_nearest_of_all():
    rng = np.random.default_rng(3)
    c, u = (V.unit(rng.standard_normal((n, DIM))) for n in (40, 30))
    planes = np.linalg.qr(rng.standard_normal((DIM, 3)))[0].T
    index = V.Index(DIM, c, planes, np.arange(40) // 4, 1, np.zeros((DIM // V.SUB, 16, V.SUB), np.float32), 1.0)
    side = (u[:, None] - c[None]) @ planes.T
    code = (np.arange(8)[:, None] >> np.arange(3)) & 1
    score = ((u @ c.T)[:, :, None] - (np.abs(side)[:, :, None] * ((side > 0)[:, :, None] != code)).sum(3)).reshape(len(u), -1)
    for n in (1, 2, 96, 200, 500):
        got = index.cells(u, n)
        assert got.shape == (30, min(n, 320)) and all(len(set(g)) == len(g) for g in got.tolist())
        assert np.allclose(np.take_along_axis(score, got, 1), -np.sort(-score, axis=1)[:, :n], atol=1e-5) or n < 40
        assert ((u @ c.T).argmax(1) == got[:, 0] >> 3).all()
    assert set(index.shelves(np.arange(320)).tolist()) == {s * 4 + p for s in range(10) for p in range(4)}


def test_probes_follow_the_measured_recall():
    rng = np.random.default_rng(4)
    u = V.unit(rng.standard_normal((2000, DIM)))
    index = V.Index(DIM, V.fit_cells(u, 60, 0), np.linalg.qr(rng.standard_normal((DIM, 2)))[0].T, np.zeros(60, int), 2, None, 1.0)
    few, many = (V.measured_probes(index, *V.pairs_at(u, t), 0.95, True) for t in (0.9, 0.5))
    assert few < many <= index.n_cells
    a, b = V.pairs_at(u, 0.6)
    assert np.allclose((a * b).sum(1), 0.6, atol=1e-3)


def test_table_scan_is_the_product():
    rng = np.random.default_rng(5)
    book = rng.standard_normal((DIM // 2, 16, 2)).astype(np.float32) / 20
    x, q = rng.integers(0, 16, (DIM // 2, 50)), rng.standard_normal((30, DIM)).astype(np.float32) / 8
    tables = np.rint(book @ np.ascontiguousarray(q.reshape(30, -1, 2).transpose(1, 2, 0)) * V.SCALE).astype(np.int16)
    out, buffer = np.empty((2, 50, 30), np.int16)
    V.scan_tables(tables.__getitem__, x.astype(np.intp), range(DIM // 2), out, buffer)
    whole = book[np.arange(DIM // 2)[None], x.T].reshape(50, DIM) @ q.T
    assert np.abs(out / V.SCALE - whole).max() < 0.005


def test_only_visitors_in_doubt_are_scanned(monkeypatch):
    """Visitors like the rows at home pass by their mean estimate and only the others are looked up; what is found is what the codes' products say."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(DIM)
    like = lambda n, c, e: V.unit(c + e * rng.standard_normal((n, DIM)))
    u = np.vstack([like(40, centre, 0.6), like(30, centre, 0.6), like(50, -centre, 0.6)])
    index = V.Index(DIM, u[:1], np.zeros((0, DIM), np.float32), np.zeros(1, int), 0, V.fit_codebook(u, 1.0, 0), 1.0)
    codes = index.encode(u)
    x = index.decode(codes)
    err = np.linalg.norm(u - x, axis=1).astype(np.float32)
    home = [0] * 40 + [None] * 80
    t = pa.table({
        "key": pa.array(np.arange(120)), "cell": pa.array(home, pa.int64()), "cells": pa.array([None if h == 0 else [0] for h in home], pa.list_(pa.int32())),
        "code": pa.array([r.tobytes() for r in V.pack_codes(codes)], pa.binary()), "err": pa.array(err),
    })
    scanned, scan = [], V.scan_tables
    monkeypatch.setattr(V, "scan_tables", lambda tables, codes, *a: scanned.append((codes.shape[1], tables(0).shape)) or scan(tables, codes, *a))
    got = V.meetings(t, index, 0.7, 3.0)
    bound = 0.7 - 3 * np.sqrt((err[:40, None] ** 2 + err[None, 40:] ** 2) / DIM)
    a, b = np.nonzero(x[:40] @ x[40:].T >= bound)
    assert set(zip(got["a"].to_pylist(), got["b"].to_pylist())) == set(zip(a.tolist(), (b + 40).tolist())) and len(a) > 900
    assert scanned == [(50, (16, 40))]


def test_only_visitors_and_rows_at_home_are_decoded(monkeypatch):
    """Visitors of a task are decoded once and the rows at home once a cell: nobody is decoded for a comparison that never comes."""
    rng = np.random.default_rng(7)
    u = V.unit(rng.standard_normal((90, DIM)))
    index = V.Index(DIM, u[:2], np.zeros((0, DIM), np.float32), np.zeros(2, int), 0, V.fit_codebook(u, 1.0, 0), 1.0)
    codes = index.encode(u)
    home = [0] * 20 + [1] * 30 + [None] * 40
    t = pa.table({
        "key": pa.array(np.arange(90) // 2), "cell": pa.array(home, pa.int64()), "cells": pa.array([[0, 1] if h is None else None for h in home], pa.list_(pa.int32())),
        "code": pa.array([r.tobytes() for r in V.pack_codes(codes)], pa.binary()), "err": pa.array(np.zeros(90, np.float32)),
    })
    decoded, decode = [], V.Index.decode
    monkeypatch.setattr(V.Index, "decode", lambda self, codes: decoded.append(len(codes)) or decode(self, codes))
    V.meetings(t, index, 0.7, 3.0)
    assert sorted(decoded) == [20, 30, 40]
    # no codeword is read from another subspace: in parts, too, what is found is what the codes' products say
    monkeypatch.setattr(V, "GUESTS", 7)
    monkeypatch.setattr(V, "AT_HOME", 8)
    monkeypatch.setattr(V, "AT_ONCE", 3)
    got = V.meetings(t, index, 0.2, 3.0)
    x = decode(index, codes)
    a, b = np.nonzero(x[:50] @ x[50:].T >= 0.2)
    want = {(int(min(p, q)), int(max(p, q))) for p, q in zip(a // 2, (b + 50) // 2) if p != q}
    assert set(zip(got["a"].to_pylist(), got["b"].to_pylist())) == want and len(want) > 20


def test_wider_shelves_are_two_neighbours():
    rng = np.random.default_rng(8)
    planes = np.linalg.qr(rng.standard_normal((DIM, 3)))[0].T
    for low in range(4):
        index = V.Index(DIM, V.unit(rng.standard_normal((10, DIM))), planes, np.arange(10) // 2, low, np.zeros((DIM // V.SUB, 16, V.SUB), np.float32), 1.0)
        assert (index.wider().shelves(np.arange(80)) == index.shelves(np.arange(80)) >> 1).all()


def test_a_shelf_is_split_only_beyond_its_tasks_share(spark, monkeypatch):
    """40 rows at home are one task's for three blocks of 15 and three tasks' for one; every visitor meets every row at home once."""
    monkeypatch.setattr(V, "BLOCK", 15)
    homes = spark.createDataFrame([(0, i, 1) for i in range(40)], "shelf long, key long, home long")
    visitors = spark.createDataFrame([(0, i, [1]) for i in range(50)], "shelf long, key long, cells array<int>")
    for blocks, split in ((3, 1), (1, 3)):
        rows = V.in_tasks(homes, visitors, ["key"], blocks).collect()
        assert {r["block"] for r in rows} == set(range(split))
        at = {(r["block"], r["guests"], r["key"]) for r in rows if r["cell"] is not None}
        met = [(h, r["key"]) for r in rows if r["cell"] is None for b, g, h in at if (b, g) == (r["block"], r["guests"])]
        assert sorted(met) == sorted((h, v) for h in range(40) for v in range(50))


def test_distinct_vectors_need_no_sort_of_the_codes(spark):
    x = _data()
    df = _df(spark, x, [(500, [float(v) for v in x[3]], 1, "c"), (2, [float(v) for v in x[2]], 1, "c")])
    index, _ = V.fit_index(df, "row_id", "delta", DIM)
    firsts, members = V.distinct_vectors(V.index_rows(df, "row_id", "delta", index, 1))
    assert sorted(r["key"] for r in firsts.select("key").collect()) == list(range(len(x)))
    assert sorted(map(tuple, members.collect())) == sorted([*((i, i) for i in range(len(x))), (3, 500)])
    assert "SortAggregate" not in firsts._jdf.queryExecution().executedPlan().toString()


def test_search_looks_past_any_number_of_copies(spark):
    """2,000 copies of the query's nearest vector are one candidate, and of them the smallest keys are given."""
    x = _data(1)
    near = [float(v) for v in x[0] + 0.05 * x[1]]
    same = [(100_000 + i, near, 1, "c") for i in reversed(range(2000))]
    df = _df(spark, x, same)
    got = sorted((r["rank"], r["neighbour"]) for r in V.search(df, df.filter("row_id = 0"), 5, dim=DIM).collect())
    assert got == [(i + 1, 100_000 + i) for i in range(5)]
