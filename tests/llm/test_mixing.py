import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import mixing as M
from corpusmill.shared import ws_count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 150))
def test_budget_is_fitted_exactly(items, budget):
    lengths, counts = (np.array(x, np.int64) for x in zip(*items))
    take = M.fit_budget(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {sum(int(k) * int(n) for k, n in zip(c, lengths)) for c in itertools.product(*[range(c + 1) for c in counts])}
    got = int((take * lengths).sum())
    assert got <= budget
    # the proportional part is taken first, so the best sum is that of what remains
    base = (counts.astype(object) * budget // max(int((lengths * counts).sum()), 1)).astype(np.int64) if budget < (lengths * counts).sum() else counts
    rest = {int((base * lengths).sum()) + s for s in {sum(int(k) * int(n) for k, n in zip(c, lengths)) for c in itertools.product(*[range(int(c - b) + 1) for c, b in zip(counts, base)])}}
    assert got == max(x for x in rest if x <= budget)
    assert got in sums


def test_large_budget():
    lengths, counts = np.array([1, 900, 1_000_000]), np.array([50, 4000, 3])
    take = M.fit_budget(lengths, counts, 2_345_678)
    assert 0 <= 2_345_678 - int((take * lengths).sum()) < 900


MIX = "mix_id string, source string, target_share double, max_repeats int, total_factor double"


def _docs(spark):
    rows = [(i, "big", "w " * (1 + i % 9)) for i in range(900)] + [(1000 + i, " Small\t", "w " * 5) for i in range(4)] + [(2000, None, "w"), (2001, "big", None), (2002, "empty", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("length", F.lit(-1)).withColumn("key", F.lit("clash"))


def test_mix(spark):
    docs = M.sized(_docs(spark), ws_count)
    mix = spark.createDataFrame([("m", "big", 0.9, 1, 0.5), ("m", "small", 0.1, 3, 0.5), ("m", "none", 0.0, 1, 0.5), ("m", "empty", 0.0, 2, 0.5)], MIX)
    sel, report = M.mix_sources(docs, mix)
    rep = {r["source"]: r for r in report.collect()}
    size = sum(1 + i % 9 for i in range(900)) + 20
    assert rep["big"]["size"] == size - 20 and rep["small"]["size"] == 20 and rep["none"]["size"] == 0
    assert rep["small"]["unmet"] and rep["small"]["tokens"] == 60 and not rep["big"]["unmet"]
    assert rep["big"]["tokens"] == int(0.45 * size)
    rows = sel.collect()
    assert all(r["times"] == 3 for r in rows if r["source"] == "small") and sum(r["source"] == "small" for r in rows) == 4
    length = {r["key"]: r["length"] for r in docs.collect()}
    assert sum(length[r["key"]] * r["times"] for r in rows if r["source"] == "big") == rep["big"]["tokens"]
    assert len({r["key"] for r in rows}) == len(rows)


def test_empty(spark):
    docs = M.sized(_docs(spark).limit(0), ws_count)
    sel, report = M.mix_sources(docs, spark.createDataFrame([("m", "a", 1.0, 1, 1.0), ("m", None, None, None, None)], MIX))
    assert sel.count() == 0 and {(r["source"], r["size"], r["unmet"]) for r in report.collect()} == {("a", 0, False), (None, 0, False)}


def test_tokenizer_sizes(spark):
    tok = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", M.bpe_sizes(F.col("text"), M.tokenizer_path(), tok.PATTERN)).collect()}
    assert got == {1: 2, 2: 0, 3: 0}
