from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill.llm import frequencies as Q
from corpusmill.llm import queries

T0 = datetime(2025, 1, 1)
SCHEMA = "shard string, w string, count long, loaded_at timestamp, term string"


def _df(spark, rows):
    return spark.createDataFrame([(s, w, c, T0 + timedelta(days=d), "clash") for s, w, c, d in rows], SCHEMA)


def test_latest_counts_and_marks(spark):
    df = _df(spark, [("s", "The", 2, 0), ("s", "The", 5, 1), ("t", " the ", 1, 0), ("s", "café", 1, 0), ("s", "Café", 2, 0), ("s", None, 9, 0), ("s", " \t", 9, 0), ("s", "x", 0, 0), ("s", "y", None, 0), ("s", "y", 1, -1)])
    c = Q.count_terms([(df, ["shard", "w"], {"f": "w"})])
    got = {(r["field"], r["term"]): (r["total"], r["n_rows"]) for r in c.collect()}
    assert got == {("f", "the"): (6, 2), ("f", "café"): (3, 2)}
    marks = {(r["term"], r["mark"]) for r in Q.mark_terms(c).collect()}
    assert marks == {("the", "common"), ("café", "rare"), ("café", "common")}


def _kept(spark, path, deliveries, deleted=None):
    rows, counts = Q.kept_rows(spark, f"{path}/rows", ["w"], 3), Q.kept_counts(spark, f"{path}/counts", 5)
    for d in deliveries:
        Q.apply_delivery(rows, counts, d, ["shard", "w"], {"f": "w"}, deleted=deleted)
    return rows, counts


def _rows(df):
    return sorted(map(tuple, df.select("field", "term", "total", "n_rows").collect()))


def test_increments_equal_recount(spark, tmp_path):
    first = [("s", f"w{i % 7}", i + 1, 0) for i in range(7)] + [(None, "w1", 4, 0), ("w1", None, 4, 0)]
    second = [("s", "w1", 50, 1), ("s", "w2", None, 1), (None, "w1", 4, 1), ("u", "new", 2, 1), ("s", "w3", 4, 2), ("s", "w4", 9, -3)]
    rows, counts = _kept(spark, tmp_path, [_df(spark, first), _df(spark, second), _df(spark, second[:2]), _df(spark, [])])
    assert _rows(counts.read()) == _rows(Q.count_terms([(_df(spark, first + second), ["shard", "w"], {"f": "w"})]))
    assert rows.read().count() == 10
    # what is kept is found again by another session
    assert _rows(Q.kept_counts(spark, f"{tmp_path}/counts", 5).read()) == _rows(counts.read())


def test_deleted_rows(spark, tmp_path):
    old = _df(spark, [("s", "a", 1, 0), ("s", "b", 2, 0), ("t", "b", 5, 0)]).withColumn("dead", F.lit(None).cast("boolean"))
    cut = _df(spark, [("s", "a", 1, 1), ("s", "b", None, 1), ("x", "never", 1, 1), ("t", "b", 5, -1)]).withColumn("dead", F.lit(True))
    back = _df(spark, [("s", "a", 7, 2)]).withColumn("dead", F.lit(False))
    _, counts = _kept(spark, tmp_path, [old, cut], "dead")
    assert _rows(counts.read()) == [("f", "b", 5, 1)]
    _, counts = _kept(spark, tmp_path, [back], "dead")
    assert _rows(counts.read()) == [("f", "a", 7, 1), ("f", "b", 5, 1)]


def test_only_touched_partitions_are_written(spark, tmp_path):
    _, counts = _kept(spark, tmp_path, [_df(spark, [("s", f"w{i}", 1, 0) for i in range(40)])])
    before = dict(counts.at)
    _, counts = _kept(spark, tmp_path, [_df(spark, [("s", "w3", 2, 1)])])
    changed = {b for b in counts.at if counts.at[b] != before.get(b)}
    assert len(changed) == 1 and len(before) == 5 and set(counts.at) == set(before)


def test_empty(spark):
    c = Q.count_terms([(_df(spark, []), ["shard", "w"], {"f": "w"})])
    assert c.count() == 0 and Q.mark_terms(c).count() == 0


def test_hot_term(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("shard"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("w"), F.lit(2).cast("long").alias("count"), F.lit(T0).alias("loaded_at"))
    top = Q.mark_terms(Q.count_terms([(df, ["shard", "w"], {"f": "w"})])).filter("mark = 'common'").collect()
    assert [(r["term"], r["total"], r["n_rows"]) for r in top] == [("hot", 2000, 1000)]


def test_increments_of_all_fields_with_rows_of_no_date(spark, data, tmp_path):
    for t in ("trigrams", "depgrams"):
        df = spark.read.parquet(f"{data}/{t}.parquet")
        df.withColumn("loaded_at", F.when(F.pmod(F.xxhash64(*df.columns), F.lit(5)) > 0, F.col("loaded_at"))).write.parquet(str(tmp_path / f"{t}.parquet"))
    got, one, want = (sorted(map(tuple, f(spark, str(tmp_path)).select("field", "term", "total", "n_rows").collect())) for f in (queries.p5_increments, queries.p5_incremental, queries.p5_counts))
    assert got == want and len({r[0] for r in got}) == 3
    assert one == [r for r in want if r[0] == "trigrams.token_2"]
