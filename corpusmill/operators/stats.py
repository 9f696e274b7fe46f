"""Descriptive statistics and robust preprocessing, as aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.shared import ranked, with_one


def number(name: str) -> Column:
    """A numeric column with NaN as NULL."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns})


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without an undefined value in the columns (listwise deletion)."""
    return numbers(df, columns).dropna(how="any", subset=list(columns))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, n, mean, sd, min, q25, median, q75, max, skew, kurtosis (sample-size corrected), one row per column.

    Skewness and excess kurtosis are the population ones times ((n-1)/n)^1.5 and, before subtracting 3, ((n-1)/n)^2.
    """
    long = numbers(df, columns).select(*columns).unpivot([], list(columns), "variable", "x").filter("x is not null")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = (F.count("x") - 1) / F.count("x")
    return long.groupBy("variable").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"),
        F.max("x").alias("max"), (F.skewness("x") * F.pow(s, F.lit(1.5))).alias("skew"), ((F.kurtosis("x") + 3) * s * s - 3).alias("kurtosis"),
    )


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, by: str | None = None) -> DataFrame:
    """Values held between two linear quantiles, of all rows or of each group; NULL stays NULL."""
    d = numbers(df, columns)
    edges = d.groupBy(*([by] if by else [])).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_e_{c}") for c in columns])
    if by:
        edges = edges.withColumnRenamed(by, "_by")
        d = d.join(edges, d[by].eqNullSafe(edges["_by"])).drop("_by")
    else:
        d = with_one(d, edges)
    held = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_e_{c}")[0]), F.col(f"_e_{c}")[1])) for c in columns}
    return d.withColumns(held).drop(*[f"_e_{c}" for c in columns])


def residualize(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Values minus their group's mean; groups are aggregated first and joined, so a hot group is no single task."""
    d = numbers(df, columns)
    means = d.groupBy(by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns]).withColumnRenamed(by, "_by")
    out = d.join(means, d[by].eqNullSafe(means["_by"]))
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop("_by", *[f"_m_{c}" for c in columns])


def r_squared(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Share of each variable's variance that the groups explain: 1 - within / total sum of squares."""
    long = numbers(df, columns).select(by, *columns).unpivot([by], list(columns), "variable", "x").filter("x is not null")
    g = long.groupBy("variable", by).agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.var_pop("x").alias("v"))
    within = F.sum(F.col("n") * F.col("v"))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    return g.groupBy("variable").agg(F.try_divide(between, within + between).alias("r2"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise complete Pearson correlations, one pass: x, y, r."""
    pairs = list(combinations_with_replacement(columns, 2))
    d = numbers(df, columns)
    one = d.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "_p", "r")
    part = F.split("_p", r"\|")
    return long.select(part[0].alias("x"), part[1].alias("y"), "r")


def average_ranks(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Ranks from 1 with ties averaged: a distributed running sum over the histogram of values."""
    h = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    h = ranked(h, [], [value], "_before", "_n").select(value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.select(key, value).join(h, value).select(key, out)


def spearman(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns over rows where both are defined: rho, n."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = average_ranks(d, key, x, "_rx").join(average_ranks(d, key, y, "_ry"), key)
    return both.agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_by(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rank correlation inside every group over rows where both are defined: group, rho, n; ties have their average rank.

    A group in which one side is constant has no correlation: rho is NaN, as in SQL, and no error of the division by zero.  Ranks are running sums over each group's histogram of values, so a group of any size is spread.
    """
    d = df.select(group, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        h = d.groupBy(group, c).agg(F.count(F.lit(1)).alias("_n"))
        h = ranked(h, [group], [c], "_before", "_n").select(group, c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_r_{c}"))
        d = d.join(h, [group, c])
    a, b = f"_r_{x}", f"_r_{y}"
    # constancy is asked of the ranks themselves: merged moments of equal ranks may differ from zero in their last bits
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    rho = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    return d.groupBy(group).agg(F.when(varies, rho).otherwise(F.lit(float("nan"))).alias("rho"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 to bins + 1), n: values clipped at the upper end count in the last bin."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.width_bucket(F.least(F.col(value), F.lit(high)), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rater_mean(a: Column, b: Column) -> Column:
    """Mean of two ratings, of the one given if one is missing."""
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return F.try_divide(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), n)


def proficiency(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score <= 2.5, "Low").when(score >= 4.0, "High").otherwise("Mid")


def shares(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Counts of values and their share of the group."""
    n = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def top_shares(df: DataFrame, group: Sequence[str], column: str, n: int = 3) -> DataFrame:
    """The n most frequent values of each group as one text, value(percent) by frequency, ties to the smaller value: group, column.

    Percentages are of all rows of the group.
    """
    size = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    c = df.filter(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*group).orderBy(F.desc("_n"), column)
    best = c.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).join(size, list(group))
    pct = F.floor(100 * F.col("_n") / F.col("_all") + 0.5).cast("string")
    said = best.select(*group, F.struct("_k", F.concat(column, F.lit("("), pct, F.lit("%)")).alias("s")).alias("_v"))
    return said.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_v")), lambda x: x["s"]), ",").alias(column))


def modes(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """The most frequent value of each group, ties to the smaller value."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(column))).alias("_b")).select(*group, F.col(f"_b.{column}").alias(column), (-F.col("_b.m")).alias("n"))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, n_distinct, sd and whether it is constant."""
    one = df.agg(*[F.struct(F.count_distinct(c).alias("n_distinct"), F.stddev_samp(c).alias("sd")).alias(c) for c in columns])
    long = one.unpivot([], list(columns), "variable", "_s")
    return long.select("variable", "_s.n_distinct", "_s.sd", (F.col("_s.n_distinct") <= 1).alias("constant"))
