"""Correlation, percentiles, rollups over seeds, confusion and agreement. Undefined is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranks(pairs: DataFrame, x: str, group: list[str], name: str) -> DataFrame:
    """(group..., x, name): the mean rank of each distinct value; ties share it. A rank is a running sum over distinct
    values, so neither ties nor repeated rows are sorted one by one."""
    counts = pairs.groupBy(*group, x).agg(F.sum("__c").alias("__k"))
    w = Window.partitionBy(*group).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, x, (F.coalesce(F.sum("__k").over(w), F.lit(0)) + (F.col("__k") + 1) / 2.0).alias(name))


def spearman(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """(group..., n, rho): rank correlation within each group; null below 3 rows or where a side is constant.

    Rows are first counted by their pair of values: x and y are computed once, and a frequent value is one row."""
    key = group or ["__one"]
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.select(*[F.col(g) for g in group or []], F.col(x).alias("__x"), F.col(y).alias("__y"))
    d = d if group else d.withColumn("__one", F.lit(1))
    pairs = d.groupBy(*key, "__x", "__y").agg(F.count("*").alias("__c"))
    r = pairs.join(_ranks(pairs, "__x", key, "__rx"), [*key, "__x"]).join(_ranks(pairs, "__y", key, "__ry"), [*key, "__y"])
    c, rx, ry = F.col("__c"), F.col("__rx"), F.col("__ry")
    s = r.groupBy(*key).agg(F.sum("__c").alias("n"), F.sum(c * rx * ry).alias("xy"), F.sum(c * rx * rx).alias("xx"), F.sum(c * ry * ry).alias("yy"))
    mean = (F.col("n") + 1) / 2.0
    cov = lambda k: F.col(k) / F.col("n") - mean * mean
    flat = (cov("xx") <= 1e-9 * mean * mean) | (cov("yy") <= 1e-9 * mean * mean)
    rho = F.when((F.col("n") >= 3) & ~flat, F.try_divide(cov("xy"), F.sqrt(F.greatest(cov("xx"), F.lit(0.0))) * F.sqrt(F.greatest(cov("yy"), F.lit(0.0)))))
    return s.select(*(group or []), "n", rho.alias("rho"))


def percentiles(df: DataFrame, x: str) -> DataFrame:
    """p50, p95 with linear interpolation, mean, n"""
    c = F.col(x)
    return df.agg(F.count(c).alias("n"), F.percentile(c, 0.5).alias("p50"), F.percentile(c, 0.95).alias("p95"), F.avg(c).alias("mean"))


def throughput(df: DataFrame, seconds: str, tokens: str) -> DataFrame:
    """(n, p50_ms, p95_ms, mean_ms, tokens_per_s) of timed rows; without time no rate"""
    ms = F.col(seconds) * 1000.0
    return df.agg(
        F.count(seconds).alias("n"), F.percentile(ms, 0.5).alias("p50_ms"), F.percentile(ms, 0.95).alias("p95_ms"), F.avg(ms).alias("mean_ms"),
        F.try_divide(F.sum(F.when(F.col(seconds).isNotNull(), F.col(tokens))), F.nullif(F.sum(seconds), F.lit(0.0))).alias("tokens_per_s"),
    )


def labelled(df: DataFrame, *labels: str) -> DataFrame:
    """Human y/n labels as booleans; raises if one is blank or anything else, as a sheet half filled in says nothing."""
    low = {c: F.lower(F.trim(F.col(c))) for c in labels}
    fine = F.lit(True)
    for c in labels:
        fine = fine & F.coalesce(low[c].isin("y", "yes", "n", "no"), F.lit(False))
    if not df.filter(~fine).isEmpty():
        raise ValueError(f"labels {', '.join(labels)} must be y or n in every row")
    return df.withColumns({c: low[c].isin("y", "yes") for c in labels})


def seed_rollup(runs: DataFrame, name: str, metrics: list[str], order: str) -> DataFrame:
    """Runs that differ by a _seed<N> ending as one row: mean and sample deviation of the values there are,
    whether some are missing, and the system of the first."""
    base = F.regexp_replace(F.col(name), r"_seed\d+$", "")
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), ((F.count(m) < F.count("*")) & (F.count(m) > 0)).alias(f"{m}_partial")]
    return runs.groupBy(base.alias("base")).agg(F.min_by("system", order).alias("system"), F.count("*").alias("seeds"), *aggs)


def confusion(df: DataFrame, predicted: Column, gold: Column, task: str, stratum: str) -> DataFrame:
    """Counts, precision, recall, F1, accuracy and kappa, per task over all and per stratum, in one pass of grouping sets."""
    d = df.select(F.col(task).alias("task"), F.col(stratum).alias("stratum"), predicted.alias("p"), gold.alias("g"))
    sets = d.groupingSets([["task"], ["task", "stratum"]], "task", "stratum")
    got = sets.agg(
        F.grouping("stratum").alias("__all"),
        F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(F.col("p") & ~F.col("g")).alias("fp"),
        F.count_if(~F.col("p") & F.col("g")).alias("fn"), F.count_if(~F.col("p") & ~F.col("g")).alias("tn"),
    )
    got = got.withColumn("stratum", F.when(F.col("__all") == 1, "overall").otherwise(F.col("stratum"))).drop("__all")
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    got = got.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    got = got.withColumn("f1", F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")))
    got = got.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), n))
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))).cast("double")
    return got.withColumn("kappa", F.try_divide((F.col("tp") + F.col("tn")) * n - chance, n.cast("double") * n - chance))
