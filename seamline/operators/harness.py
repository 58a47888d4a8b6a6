"""Evaluation of generations end to end: fact check of both texts in one pass, validation that gates calibration,
overlap, diversity. Results are long rows (path, value, status, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import rules
from seamline.operators import diversity, excitement, factcheck, stats, surface
from seamline.session import cut


def aligned(generations: DataFrame, dataset: DataFrame, key: list[str]) -> DataFrame:
    """generations with the record and features of their ball, by key (never by place); of several rows of a ball the one
    of least row_id. Rows without a ball are left out: misses() tells them, complete() refuses them."""
    d = dataset.groupBy(*[F.col("record." + k).alias(k) for k in key]).agg(F.min_by(F.struct("record", "features"), "row_id").alias("__d"))
    return generations.join(d, key).select("*", "__d.record", "__d.features").drop("__d")


def misses(generations: DataFrame, dataset: DataFrame, key: list[str]) -> DataFrame:
    """(what, n): balls of the dataset without a generation, and generations without a ball"""
    g, b = generations.select(*key).distinct(), dataset.select(*[F.col("record." + k).alias(k) for k in key]).distinct()
    one = lambda x, what: x.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one(b.join(g, key, "left_anti"), "ball_without_generation").unionByName(one(g.join(b, key, "left_anti"), "generation_without_ball"))


def complete(generations: DataFrame, dataset: DataFrame, key: list[str]) -> DataFrame:
    """generations, if every ball of the dataset has one; raises otherwise, as for an empty dataset"""
    if dataset.isEmpty():
        raise ValueError("nothing to evaluate: the dataset has no rows")
    lack = {r["what"]: r["n"] for r in misses(generations, dataset, key).collect()}["ball_without_generation"]
    if lack:
        raise ValueError(f"{lack} balls have no generation")
    return generations


def identity(generations: DataFrame, dataset: DataFrame, key: list[str]) -> DataFrame:
    """Stored generations of balls in the dataset, with input_differs and reference_differs: whether theirs is none of those that the dataset holds for the ball"""
    d = dataset.groupBy(*[F.col("record." + k).alias(k) for k in key]).agg(F.collect_set("linearized_input").alias("__i"), F.collect_set("target_commentary").alias("__r"))
    x = generations.join(d, key)
    other = lambda c, s: F.col(c).isNotNull() & ~F.array_contains(s, F.col(c))
    return x.select(*generations.columns, other("linearized_input", "__i").alias("input_differs"), other("reference", "__r").alias("reference_differs"))


def identical(generations: DataFrame, dataset: DataFrame, key: list[str]) -> DataFrame:
    """generations, if they belong to this dataset; raises with how many do not"""
    bad = identity(generations, dataset, key).filter("input_differs OR reference_differs").count()
    if bad:
        raise ValueError(f"{bad} stored generations are of other inputs or references")
    return generations


LONG = "path string, value double, status string, reason string"


def _long(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f"{prefix}.{c}").alias("path"), F.col(c).cast("double").alias("value")) for c in columns])
    none = F.lit(None).cast("string")
    return df.select(F.explode(pairs).alias("p")).select("p.path", "p.value", none.alias("status"), none.alias("reason"))


def evaluate(
    rows: DataFrame, group: list[str], order: list[str], distinct: tuple[int, ...] = (1, 2), repeated: int = 4, surface_metrics: bool = True, bertscore: str = "auto", seconds: str | None = None
) -> DataFrame:
    """rows(record, features, reference, generation, key...) -> all metrics. A constant or short group has no correlation;
    where references do not follow the match, calibration is blocked instead of reported; what is switched off or cannot
    be had is a row with its status. bertscore: auto or off, or require, which raises. seconds: a column with each row's time.

    The check of both texts, their excitement and tokens are written once; every metric reads narrow columns of that table."""
    # the alignment is a join of wide records: written once, as far as it is read
    record = F.struct(*[F.col(f"record.{c}").alias(c) for c in factcheck.READ])
    features = F.struct("features.event_salience", "features.tension")
    rows = cut(rows.select(*group, *order, record.alias("record"), features.alias("features"), "generation", "reference", *([seconds] if seconds else [])), "aligned")
    src = F.explode(F.array(F.struct(F.lit("generation").alias("src"), F.col("generation").alias("text")), F.struct(F.lit("reference").alias("src"), F.col("reference").alias("text"))))
    both = rows.select("*", src.alias("s")).select("record", "features", *group, *order, "s.src", F.coalesce("s.text", F.lit("")).alias("text"))
    checked = factcheck.check(both, "text").select(
        *group, *order, "src", "text", F.struct("record.wicket", "record.runs_batter").alias("record"), F.transform("claims", lambda c: F.struct(c["slot"].alias("slot"), c["false"].alias("false"))).alias("claims"),
        F.transform("violations", lambda v: v["slot"]).alias("violations"), "omissions", excitement.score(F.col("text")).alias("excitement"), (F.col("features.event_salience") * F.col("features.tension")).alias("signal"),
    )
    checked = cut(checked, "checked")
    if checked.isEmpty():
        raise ValueError("nothing to evaluate: no aligned rows")
    fact = cut(factcheck.summary(checked, ["src"]), "fact")
    cols = ["n", "hallucination_rate", "faithfulness_score", "omission_rate", "wicket_recall", "boundary_recall"]
    out = _long(fact.filter("src = 'generation'"), "faithfulness", cols).unionByName(_long(fact.filter("src = 'reference'"), "reference", cols))
    none = F.lit(None).cast("string")
    slots = factcheck.slot_precision(checked.filter("src = 'generation'")).select(F.concat(F.lit("faithfulness.per_slot."), "slot", F.lit(".precision")).alias("path"), F.col("precision").alias("value"), none.alias("status"), none.alias("reason"))
    kinds = checked.filter("src = 'generation'").select(F.explode("violations").alias("slot")).groupBy("slot").agg(F.count("*").alias("value"))
    kinds = kinds.select(F.concat(F.lit("faithfulness.violations_by_type."), "slot").alias("path"), F.col("value").cast("double").alias("value"), none.alias("status"), none.alias("reason"))
    out = out.unionByName(slots).unionByName(kinds)
    rho = stats.spearman(checked, "excitement", "signal", ["src"]).withColumn("passed", F.coalesce(F.col("rho") > 0, F.lit(False)))
    rho = cut(rho, "rho")
    valid = rho.filter("src = 'reference'").select(F.col("passed").alias("ok"), F.lit(1).alias("j"))
    cal = rho.filter("src = 'generation'").withColumn("j", F.lit(1)).join(F.broadcast(valid), "j", "left")
    blocked = ~F.coalesce("ok", F.lit(False))
    cal = cal.select(
        F.lit("excitement.rho").alias("path"),
        F.when(~blocked, F.col("rho")).alias("value"),
        F.when(blocked, "blocked").alias("status"),
        F.when(blocked, "references do not follow the match").alias("reason"),
    )
    out = out.unionByName(cal).unionByName(_long(rho.filter("src = 'reference'"), "reference_validation", ["rho"]))
    spark = rows.sparkSession
    status = [("faithfulness.ner", None, "unavailable", "no weights of a name recogniser"), ("excitement.model", None, "unavailable", "no weights of an excitement model")]
    if surface_metrics:
        gen = rows.select(F.coalesce("generation", F.lit("")).alias("generation"), "reference", F.monotonically_increasing_id().alias("__k"))
        out = out.unionByName(_long(surface.bleu(gen, "generation", "reference"), "surface", ["bleu"]))
        out = out.unionByName(_long(surface.rouge_l(gen, "generation", "reference", "__k").agg(F.avg("rouge_l").alias("rouge_l")), "surface", ["rouge_l"]))
    else:
        status += [("surface.bleu", None, "disabled", "switched off"), ("surface.rouge_l", None, "disabled", "switched off")]
    status += surface.bertscore_status("off" if not surface_metrics else bertscore)
    text = checked.filter("src = 'generation'")
    for n in distinct:
        out = out.unionByName(_long(diversity.distinct_mean(text, "text", group, n).withColumnRenamed("mean_ratio", f"distinct_{n}"), "diversity", [f"distinct_{n}"]))
    name = f"repetition_{repeated}gram_rate"
    out = out.unionByName(_long(diversity.repetition(text, "text", group, order, repeated).withColumnRenamed("rate", name), "diversity", [name]))
    out = out.unionByName(_long(diversity.self_bleu(text, "text", group, order), "diversity", ["self_bleu"]))
    if seconds:
        t = stats.throughput(rows.select(seconds, rules.word_count(F.coalesce("generation", F.lit(""))).alias("__n")), seconds, "__n")
        out = out.unionByName(_long(t, "latency", ["p50_ms", "p95_ms", "mean_ms", "tokens_per_s"]))
    else:
        status.append(("latency", None, "unavailable", "no generator ran"))
    return out.unionByName(spark.createDataFrame(status, LONG))
