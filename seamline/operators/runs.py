"""Runs: metrics trees as long rows, gaps, projections, rollups over seeds, key sets across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.operators import stats

STATUSES = ["unavailable", "disabled", "blocked"]


def flatten(metrics: DataFrame, body: str = "body", key: str = "run_dir") -> DataFrame:
    """Documents -> (key, path, value, status, reason): a row a leaf; a leaf is a number, null, or a status record.

    Levels are unfolded one by one as maps of text, so keys need not be known beforehand, until none is left."""
    level = metrics.select(key, F.lit(None).cast("string").alias("path"), F.get_json_object(body, "$.metrics").alias("v"))
    leaves = None
    while leaves is None or not level.isEmpty():
        kids = level.select(key, "path", F.explode_outer(F.from_json("v", "map<string,string>")).alias("k", "v"))
        kids = kids.filter("k IS NOT NULL").select(key, F.concat_ws(".", "path", "k").alias("path"), "v")
        status = F.get_json_object("v", "$.status")
        done = ~F.coalesce(F.col("v").startswith("{"), F.lit(False)) | status.isNotNull()
        leaf = kids.filter(done).select(key, "path", F.expr("try_cast(v AS double)").alias("value"), status.alias("status"), F.get_json_object("v", "$.reason").alias("reason"))
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        level = kids.filter(~done)
    return leaves


def gaps(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("status").isin(STATUSES)).select("run_dir", "path", "status", "reason")


def project(metrics: DataFrame, paths: dict[str, str]) -> DataFrame:
    """One row a run with the wanted leaves as numbers; anything else than a number is null."""
    num = lambda p: F.expr(f"try_cast(get_json_object(body, '$.metrics.{p}') AS double)")
    sys = F.coalesce(F.get_json_object("body", "$.run.system"), F.get_json_object("body", "$.run.generator"))
    return metrics.select("run_dir", F.get_json_object("body", "$.run.name").alias("name"), sys.alias("system"), *[num(p).alias(n) for n, p in paths.items()])


def reportable(runs: DataFrame, name: str = "name") -> DataFrame:
    """without fixture and smoke runs"""
    return runs.filter(~F.coalesce(F.col(name).endswith("_mini") | F.col(name).startswith("smoke_"), F.lit(False)))


def results(metrics: DataFrame, paths: dict[str, str]) -> DataFrame:
    return stats.seed_rollup(reportable(project(metrics, paths)), "name", list(paths), "run_dir")


def first_per_base(runs: DataFrame, name: str, order: str) -> DataFrame:
    """seed repeats dropped: the first of each base name"""
    base = F.regexp_replace(F.col(name), r"_seed\d+$", "")
    return runs.groupBy(base.alias("base")).agg(F.min(order).alias(order))


def common_keys(generations: DataFrame, runs: list[str], key: list[str]) -> DataFrame:
    """keys that all the runs generated: one aggregation, however many runs"""
    wanted = generations.filter(F.col("run_dir").isin(runs)).select(*key, "run_dir").distinct()
    return wanted.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") == len(set(runs))).select(*key)


def violations_per_100(checked: DataFrame, run: str = "run_dir") -> DataFrame:
    """(run, slot, per_100): violations by shown slot in 100 texts of the run"""
    n = checked.groupBy(run).agg(F.count("*").alias("n"))
    v = checked.select(run, F.explode("violations").alias("v")).groupBy(run, F.col("v.slot").alias("slot")).agg(F.count("*").alias("c"))
    return v.join(n, run).select(run, "slot", F.round(F.col("c") * 100.0 / F.col("n"), 2).alias("per_100"))
