"""Samples that match target shares per category (systematic unequal-probability sampling)."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import cut, ranked, seeded


def allocate(counts: DataFrame, plans: DataFrame) -> DataFrame:
    """Expected sample size of every category of every plan.

    ``counts``: field, category, available.  ``plans``: plan_id, field, category, target_share, min_rows,
    sample_fraction.  ``required`` is the larger of min_rows and target_share * sample_fraction * N, N being all counted
    records of the plan's field; ``expected`` is that, held to what is available.  A category without records has 0 available.  NULL numbers in a plan count as 0.
    """
    total = counts.groupBy("field").agg(F.sum("available").alias("n_field"))
    p = plans.select(
        "plan_id", "field", "category",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("target_share", "min_rows", "sample_fraction")],
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        p.join(counts, ["field", "category"], "left")
        .join(total, "field", "left")
        .withColumn("available", zero("available"))
        .withColumn("required", F.greatest("min_rows", F.col("target_share") * F.col("sample_fraction") * zero("n_field")))
        .withColumn("expected", F.least(F.col("required"), F.col("available").cast("double")))
    )


def sample_to_targets(records: DataFrame, plans: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Draw one sample per plan; returns (sample, report).

    ``records``: field, category, key, one row per record; rows with a NULL in any of the three are not counted, other
    columns are ignored.  Records are put in seeded random order inside sorted categories; the inclusion probability of a record is
    expected / available of its category; the probabilities are prefix-summed over the whole order (the partitions'
    counts shift each partition's own numbering) and a record is drawn where the sum crosses an integer, counted from
    one random start per plan.  A category that still has fewer than its floor gets its next records in the order.
    Repeated (field, key) rows must be removed before.  An empty table gives an empty sample and a report of zeros.

    sample: plan_id, field, category, key.  report: one row per plan and category with target_share, required,
    available, drawn, drawn_share (NULL where a plan draws nothing) and unmet: the sample holds every record of the category
    and still fewer than required.
    """
    spark = records.sparkSession
    records = records.select("field", "category", "key").dropna()
    order = ranked(records.withColumn("_r", seeded(seed, "field", "key")), ["field", "category"], ["_r", "key"])
    order = cut(order.select("field", "category", "key", "rank"), "order")
    counts = order.groupBy("field", "category").agg(F.count(F.lit(1)).alias("available"))
    # the plan table has one row per plan and category and is bounded by what users write by hand
    alloc = allocate(counts, plans).collect()
    rows, base = [], {}
    for r in sorted(alloc, key=lambda r: (r["plan_id"], r["field"], r["category"])):
        start = base.get(r["plan_id"], random.Random(f"{seed}/{r['plan_id']}").random())
        rows.append((r["plan_id"], r["field"], r["category"], r["target_share"], r["min_rows"], r["required"], r["available"], start, r["expected"]))
        base[r["plan_id"]] = start + r["expected"]
    plan = spark.createDataFrame(
        rows,
        "plan_id string, field string, category string, target_share double, min_rows double, required double,"
        " available long, start double, expected double",
    )
    pi = F.col("expected") / F.col("available")
    # integers passed by the running sum before and after this record, counted from the category's first record
    passed = lambda k: F.floor(F.col("start") + k * pi) - F.floor("start")
    drawn = (
        order.join(F.broadcast(plan), ["field", "category"])
        .withColumn("_before", passed(F.col("rank")))
        .withColumn("_hit", F.when(F.col("rank") + 1 == F.col("available"), F.floor(F.col("start") + F.col("expected")) - F.floor("start")).otherwise(passed(F.col("rank") + 1)) > F.col("_before"))
    )
    whole = F.floor(F.col("start") + F.col("expected")) - F.floor("start")
    lacking = F.least(F.ceil("min_rows"), F.col("available")) - whole
    sample = drawn.filter(F.col("_hit") | (F.col("rank") - F.col("_before") < lacking)).select("plan_id", "field", "category", "key")
    got = sample.groupBy("plan_id", "field", "category").agg(F.count(F.lit(1)).alias("drawn"))
    report = plan.join(got, ["plan_id", "field", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    per = report.groupBy("plan_id").agg(F.sum("drawn").alias("_all"))
    report = report.join(per, "plan_id").select(
        "plan_id", "field", "category", "target_share", "required", "available", "drawn",
        F.when(F.col("_all") > 0, F.col("drawn") / F.col("_all")).alias("drawn_share"),
        ((F.col("drawn") == F.col("available")) & (F.col("drawn") < F.col("required"))).alias("unmet"),
    )
    return sample, report
