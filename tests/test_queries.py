"""Every query with SQL against DuckDB over the smallest tables; the others run and keep their schema."""

import glob
import math
import os

import duckdb
import pytest

from corpusmill.plans import analysis, catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(_value(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name, monkeypatch):
    if name == "nmf_error":
        monkeypatch.setitem(analysis.SIZES, "rounds", 60)
    df = QUERIES[name](spark, data)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, cur.fetchall())


NODES = set(analysis.ALL)
#: what must hold of the rows of a query without SQL
HOLDS = {
    "all_features": lambda r: len({x["doc_id"] for x in r}) == len(r) > 0 and all(x["lexical_density"] is None or 0 <= x["lexical_density"] <= 1 for x in r) and any(x["mtld"] for x in r),
    "mtld": lambda r: len({x["doc_id"] for x in r}) == len(r) > 0 and all(x["mtld"] is None or x["mtld"] >= 1 for x in r),
    "glasso_network": lambda r: all(x["src"] < x["dst"] or x["src"] != x["dst"] for x in r) and all(abs(x["weight"]) <= 1 for x in r),
    "centrality": lambda r: {x["node"] for x in r} == NODES and all(x["betweenness"] >= 0 and x["closeness"] >= 0 for x in r),
    "communities": lambda r: {x["node"] for x in r} == NODES and {x["community"] for x in r} == set(range(1, 1 + len({x["community"] for x in r}))),
    "bootstrap_edges": lambda r: len(r) == 21 and all(x["low"] <= x["high"] and 0 <= x["kept"] <= 1 for x in r),
    "case_dropping": lambda r: len(r) == 1 and 0 <= r[0]["cs_coefficient"] <= 0.7,
    "bootstrap_communities": lambda r: {x["node"] for x in r} == NODES and all(0 <= x["stability"] <= 1 for x in r),
    "community_counts": lambda r: abs(sum(x["share"] for x in r) - 1) < 1e-9 and sum(x["modal"] for x in r) == 1,
    "network_comparison": lambda r: len(r) == 2 + 15 + 18 and all(0 < x["p_value"] <= 1 and x["observed"] >= 0 for x in r),
    "significant_edges": lambda r: all("cohesion" in (x["src"], x["dst"]) and x["p_value"] < 0.05 for x in r),
    "edge_differences": lambda r: all(abs(x["difference"] - (x["weight_a"] - x["weight_b"])) < 1e-12 and x["partner"] != "cohesion" for x in r),
    "network_summary": lambda r: {x["node"] for x in r} == NODES,
    "nmf_fit": lambda r: len(r) == 500 and all(min(x["loadings"]) >= 0 for x in r),
    "nmf_summary": lambda r: all(0 <= x["sparsity"] <= 1 and (x["rho"] is None or abs(x["rho"]) <= 1) for x in r),
    "umap_layout": lambda r: len(r) == 500 and all(len(x["y"]) == 2 and all(map(math.isfinite, x["y"])) for x in r),
    "hdbscan_labels": lambda r: len(r) == 500 and {x["label"] for x in r} - {-1} == set(range(len({x["label"] for x in r} - {-1}))),
    "leaf_labels": lambda r: len(r) == 500,
}


def test_every_query_is_checked():
    assert set(HOLDS) == set(QUERIES) - set(SQL)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_holds(spark, data, name, monkeypatch):
    for k, n in {"edges": 30, "cases": 35, "communities": 20, "permutations": 20, "k": 6, "rounds": 15}.items():
        monkeypatch.setitem(analysis.SIZES, k, n)
    assert HOLDS[name](QUERIES[name](spark, data).collect())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
