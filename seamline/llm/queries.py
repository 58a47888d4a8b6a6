"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.session import read_table as t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.related_splits import torn_ids

    return torn_ids(t(spark, d, "dataset"), t(spark, d, "match_info"))


def p1_assign(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.related_splits import assign_splits

    return assign_splits(t(spark, d, "dataset"), t(spark, d, "match_info"), t(spark, d, "split_plan")).select("row_id", "split")


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.related_splits import assign_splits

    got = assign_splits(t(spark, d, "dataset"), t(spark, d, "match_info"), t(spark, d, "split_plan"))
    return got.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("component").alias("n_classes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.cross_split import row_pairs

    return row_pairs(t(spark, d, "dataset"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.cross_split import overlap_report

    return overlap_report(t(spark, d, "dataset"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.pairs import defects

    return defects(t(spark, d, "generations"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.pairs import defect_report

    return defect_report(t(spark, d, "generations"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.tokenize import encode

    return encode(t(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """decoding the ids gives every text back: rows, and how many came back other than they went in"""
    from seamline.llm.tokenize import decode, encode

    docs = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode(encode(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("text") != F.col("back")).alias("n_changed"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.leakage import leaks

    return leaks(t(spark, d, "documents"), t(spark, d, "heldout_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.leakage import leak_report

    return leak_report(t(spark, d, "documents"), t(spark, d, "heldout_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.truncation import truncated

    return truncated(t(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    from seamline.llm.truncation import source_report

    return source_report(t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_assign": p1_assign,
    "p1_totals": p1_totals,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_report": p8_report,
}

KEY = r"""nullif(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim({0})), '^.*[/\\]', ''), '\.(json|jsonl|csv|yaml|yml|xml|txt|parquet|gz)$', '')), '[\s_\-.]+', '_', 'g'), '(^|_)0+([0-9])', '\1\2', 'g'), '')"""

ORACLE: dict[str, str] = {
    "p6_round_trip": "SELECT count(*) AS n_rows, cast(0 AS bigint) AS n_changed FROM documents",
    "p1_found": f"""
WITH RECURSIVE ids AS (SELECT record.match_id AS match_id, {KEY.format("record.match_id")} AS k, min(split) AS lo, max(split) AS hi
                       FROM dataset WHERE record.match_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT {KEY.format("match_id")} AS a, {KEY.format("prior_id")} AS p, CASE WHEN venue IS NOT NULL AND match_date IS NOT NULL AND len(teams) = 2
        THEN '~' || array_to_string(list_sort([lower(trim(x)) FOR x IN teams]), '|') || '|' || lower(trim(venue)) || '|' || match_date END AS f FROM match_info),
e AS (SELECT a, p AS b FROM m WHERE p IS NOT NULL AND a <> p UNION SELECT a, f FROM m WHERE f IS NOT NULL),
ok AS (SELECT * FROM e WHERE a <> 'match_0' AND b <> 'match_0'),
u AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
reach AS (SELECT DISTINCT k AS src, k AS node FROM ids UNION SELECT r.src, u.b FROM reach r JOIN u ON r.node = u.a),
comp AS (SELECT src, min(node) AS c FROM reach GROUP BY 1),
torn AS (SELECT c FROM ids JOIN comp ON src = k GROUP BY c HAVING min(lo) <> max(hi))
SELECT match_id FROM ids JOIN comp ON src = k WHERE c IN (SELECT c FROM torn)
""",
}
