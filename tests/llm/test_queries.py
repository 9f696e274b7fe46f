"""The registered queries over the smallest tables: equal to their SQL, or with rows that must hold."""

import glob
import os

import duckdb
import pytest

from corpusmill.llm import queries as Q

QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, cur.fetchall())


def _unique(rows, *keys):
    return len({tuple(r[k] for k in keys) for r in rows}) == len(rows) > 0


HOLDS = {
    "p1_sample": lambda r: _unique(r, "plan_id", "field", "category", "key"),
    "p1_report": lambda r: _unique(r, "plan_id", "category") and all(x["drawn"] <= x["available"] for x in r),
    "p2_clusters": lambda r: all(x["n_rows"] >= 10 and 1 <= len(x["exemplars"]) <= 3 and x["cluster_id"] <= min(x["exemplars"]) for x in r),
    "p4_neighbours": lambda r: _unique(r, "key", "neighbour") and all(x["key"] % 50 == 0 and 1 <= x["rank"] <= 10 and x["similarity"] <= 1 + 1e-6 for x in r),
    "p6_cleaned": lambda r: _unique(r, "doc_id") and all((x["cleaned"] is None) == (x["verdict"] == "drop") and 0 < x["coverage"] <= 1 and x["longest"] >= 12 for x in r),
    "p6_report": lambda r: _unique(r, "item_id") and all(x["n_docs"] >= 1 and x["longest"] >= 12 for x in r),
    "p7_selection": lambda r: _unique(r, "mix_id", "source", "key") and all(x["times"] >= 1 for x in r),
    "p7_report": lambda r: _unique(r, "mix_id", "source") and all(x["tokens"] <= max(x["target"], 0) + 1e-6 or x["tokens"] <= x["capacity"] for x in r),
    "p8_found": lambda r: _unique(r, "doc_id"),
    "p8_restored": lambda r: _unique(r, "doc_id") and all(x["restorable"] == (x["n_lost"] == 0) for x in r),
}


def test_every_query_is_checked():
    assert set(HOLDS) == set(QUERIES) - set(SQL)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_holds(spark, data, name):
    assert HOLDS[name](QUERIES[name](spark, data).collect())


def test_neighbours_of_the_small_table(spark, data):
    """Recall of the search against brute force: all rows of the smallest table are in few cells."""
    import numpy as np

    from corpusmill.llm import vectors as V

    t = spark.read.parquet(f"{data}/pilot_deltas.parquet").dropDuplicates(["row_id"]).select("row_id", "delta").toArrow()
    at, x = V.dense(t.column(1), 768)
    key, u = t.column(0).to_numpy()[at], V.unit(x)
    got = {}
    for r in Q.p4_neighbours(spark, data).collect():
        got.setdefault(r["key"], set()).add(r["neighbour"])
    hits = total = 0
    for i in np.flatnonzero(key % 50 == 0):
        s = u @ u[i]
        s[i] = -2
        want = set(key[np.argsort(-s)[:10]].tolist())
        hits, total = hits + len(want & got[key[i]]), total + 10
    assert hits >= 0.9 * total > 0
