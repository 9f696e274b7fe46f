import math

import pytest

from corpusmill.llm.proportions import sample_to_targets

RECORDS = "field string, category string, key string, rank int"
PLANS = "plan_id string, field string, category string, target_share double, min_rows int, sample_fraction double, note string"


def _run(spark, records, plans, seed=1):
    s, r = sample_to_targets(spark.createDataFrame(records, RECORDS), spark.createDataFrame(plans, PLANS), seed)
    return s.collect(), {(x["plan_id"], x["category"]): x for x in r.collect()}


def test_shares_floors_and_reports(spark):
    records = [("f", "a", f"a{i}", i) for i in range(600)] + [("f", "b", f"b{i}", i) for i in range(60)] + [("f", "c", "c0", 0)]
    plans = [("p", "f", "a", 0.7, 1, 0.5, None), ("p", "f", "b", 0.29, 1, 0.5, None), ("p", "f", "c", 0.01, 5, 0.5, None), ("q", "f", "b", 1.0, 0, 0.05, None)]
    sample, report = _run(spark, records, plans)
    n = len(records)
    keys = [(x["plan_id"], x["key"]) for x in sample]
    assert len(keys) == len(set(keys))
    for (plan, cat), share, floor in ((("p", "a"), 0.7 * 0.5, 1), (("p", "b"), 0.29 * 0.5, 1), (("q", "b"), 0.05, 0)):
        need = max(floor, share * n)
        got = sum(x["plan_id"] == plan and x["category"] == cat for x in sample)
        available = 600 if cat == "a" else 60
        assert got == report[plan, cat]["drawn"]
        assert got in (math.floor(min(need, available)), math.ceil(min(need, available)))
        assert report[plan, cat]["unmet"] == (available < need)
    assert report["p", "c"]["unmet"] and report["p", "c"]["drawn"] == 1


def test_same_seed_same_sample(spark):
    records = [("f", "a", f"k{i}", 0) for i in range(100)]
    plans = [("p", "f", "a", 1.0, 0, 0.3, None)]
    assert sorted(_run(spark, records, plans, 3)[0]) == sorted(_run(spark, records, plans, 3)[0])
    assert sorted(_run(spark, records, plans, 3)[0]) != sorted(_run(spark, records, plans, 4)[0])


def test_inclusion_is_even(spark):
    """Every record is drawn about as often as its probability says."""
    records = [("f", c, f"{c}{i}", 0) for c in "ab" for i in range(20)]
    plans = [(f"p{j}", "f", c, 0.5, 0, 0.25, None) for j in range(60) for c in "ab"]
    sample, _ = _run(spark, records, plans)
    assert len(sample) == 60 * 10


def test_nulls_and_empty(spark):
    sample, report = _run(spark, [("f", None, "x", 1), ("f", "a", None, 1), (None, "a", "y", 1)], [("p", "f", "a", None, None, 0.5, None), ("p", "f", "b", 0.5, 2, None, None)])
    assert sample == []
    assert report["p", "a"]["available"] == 0 and not report["p", "a"]["unmet"]
    assert report["p", "b"]["unmet"] and report["p", "b"]["drawn_share"] is None
    assert _run(spark, [], []) == ([], {})


@pytest.mark.parametrize("n", [1, 2, 50])
def test_tiny(spark, n):
    sample, report = _run(spark, [("f", "a", str(i), 0) for i in range(n)], [("p", "f", "a", 1.0, 3, 1.0, None)])
    assert len(sample) == n and report["p", "a"]["unmet"] == (n < 3)
