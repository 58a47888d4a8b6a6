"""JSON-lines, text and report files: strict readers and plain writers."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One record a line, blank lines skipped. strict raises on a bad line; else bad lines come out in `_corrupt_record`."""
    r = spark.read.schema(schema)
    if strict:
        return r.option("mode", "FAILFAST").json(path)
    s = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(schema.fields)
    return spark.read.schema(s.add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)


class JsonlError(ValueError):
    """a line of a file is no record"""


def check_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """read_jsonl, after a pass over the lines that raises JsonlError with file and line number of a bad one, or with the
    file whose bytes are not UTF-8. Files are searched in parallel; only the first bad file is numbered, by one pass over it."""
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    torn = ~F.is_valid_utf8("value")
    bad = F.col("value").isNotNull() & (F.from_json("value", StructType([*s.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull() | torn)
    first = text.filter(bad).agg(F.min(F.struct("file", torn.alias("torn"), F.make_valid_utf8("value").alias("value"))).alias("x")).first()["x"]
    if first is not None:
        if first["torn"]:
            raise JsonlError(f"{first['file']} is not UTF-8: write it in that encoding first")
        lines = spark.read.text(first["file"]).rdd.zipWithIndex().filter(lambda x: x[0][0] == first["value"]).map(lambda x: x[1])
        raise JsonlError(f"{first['file']}:{lines.min() + 1}: no record")
    return read_jsonl(spark, path, s)


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> int:
    """UTF-8, one record a line, nulls kept; returns the rows written. one_file only for small results."""
    d = df.coalesce(1) if one_file else df
    d.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.text(path).count()


def write_stats(df: DataFrame, path: str) -> dict:
    """The one row of df (counts and shares) as a JSON file beside a dataset."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("statistics are one row")
    got = row[0].asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(got, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
    return got


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _number(x) -> str:
    return "–" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


#: what fits a page that people read
PAGE_ROWS = 10_000


def _page(df: DataFrame) -> list:
    """all rows of a report, which raises rather than leave some out"""
    rows = df.limit(PAGE_ROWS + 1).collect()
    if len(rows) > PAGE_ROWS:
        raise ValueError(f"more than {PAGE_ROWS} rows are no page: write them as a table")
    return rows


def report(metrics: DataFrame, title: str) -> str:
    """Long metric rows of one run as a page: a table of values, then what is missing and why. One run's rows only."""
    rows = _page(metrics.orderBy("path"))
    out = [f"# {title}", "", "| metric | value |", "|-|-|"]
    out += [f"| {r['path']} | {_number(r['value'])} |" for r in rows if r["status"] is None]
    gaps = [r for r in rows if r["status"] is not None]
    if gaps:
        out += ["", "## Not measured", ""] + [f"- {r['path']}: {r['status']} ({r['reason']})" for r in gaps]
    return "\n".join(out) + "\n"


def results_table(rollup: DataFrame, metrics: list[str], tex: bool = False) -> str:
    """The rollup over seeds as Markdown or LaTeX: mean with deviation where there are several."""
    rows = _page(rollup.orderBy("base"))

    def cell(r, m: str) -> str:
        mean, std = r[f"{m}_mean"], r[f"{m}_std"]
        if mean is None:
            return "--" if tex else "–"
        pm = r" $\pm$ " if tex else " ± "
        return f"{mean:.3f}" + (f"{pm}{std:.3f}" if std is not None else "") + ("*" if r[f"{m}_partial"] else "")

    if tex:
        esc = lambda s: str(s).replace("_", r"\_")
        body = "\n".join(" & ".join([esc(r["base"]), esc(r["system"]), *[cell(r, m) for m in metrics]]) + r" \\" for r in rows)
        return "\\begin{tabular}{ll" + "r" * len(metrics) + "}\n" + " & ".join(["run", "system", *map(esc, metrics)]) + " \\\\ \\hline\n" + body + "\n\\end{tabular}\n"
    out = ["| run | system | " + " | ".join(metrics) + " |", "|" + "-|" * (len(metrics) + 2)]
    return "\n".join(out + [f"| {r['base']} | {r['system']} | " + " | ".join(cell(r, m) for m in metrics) + " |" for r in rows]) + "\n"


def examples_table(rows: DataFrame, category: str, order: list[str], columns: list[str], k: int = 2, tex: bool = False) -> str:
    """The first k rows of each category side by side, as Markdown or LaTeX."""
    from seamline.operators.sampling import per_category

    got = _page(per_category(rows, category, order, k).orderBy(category, *order))
    names = [category, *columns]
    if tex:
        esc = lambda x: "" if x is None else str(x).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("&", r"\&").replace("%", r"\%").replace("#", r"\#")
        body = "\n".join(" & ".join(esc(r[c]) for c in names) + r" \\" for r in got)
        return "\\begin{tabular}{" + "l" * len(names) + "}\n" + " & ".join(map(esc, names)) + " \\\\ \\hline\n" + body + "\n\\end{tabular}\n"
    cell = lambda x: "" if x is None else str(x).replace("|", r"\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *["| " + " | ".join(cell(r[c]) for c in names) + " |" for r in got]]) + "\n"


def guard_long_run(rows: int, probed_rows: int, probed_seconds: float, passes: int = 2, most_minutes: float = 30.0) -> float:
    """Minutes a generator would take over all rows, by a probe of a few; raises beyond the limit."""
    minutes = rows * passes * probed_seconds / max(probed_rows, 1) / 60
    if minutes > most_minutes:
        raise RuntimeError(f"about {minutes:.0f} minutes over {rows} rows, more than {most_minutes:.0f}")
    return minutes


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, body) of every <dir>/metrics.json under root; no root, or none in it, gives no rows."""
    local = root.removeprefix("file://")
    if "://" not in local and not (os.path.isdir(local) and any(os.path.exists(os.path.join(local, d, "metrics.json")) for d in os.listdir(local))):
        return spark.createDataFrame([], "run_dir string, body string")
    d = spark.read.option("wholetext", True).text(f"{root}/*/metrics.json").withColumn("p", F.col("_metadata.file_path"))
    return d.select(F.element_at(F.split("p", "/"), -2).alias("run_dir"), F.col("value").alias("body")).orderBy("run_dir")


def sheet(rows: list[dict]) -> str:
    """rows as CSV text"""
    f = io.StringIO()
    w = csv.DictWriter(f, list(rows[0]) if rows else [])
    w.writeheader()
    w.writerows(rows)
    return f.getvalue()


SIMULATED = "match_id string, innings int, over_no int, delivery_seq int, is_legal boolean, batting_team string, bowling_team string, batter string, bowler string, non_striker string, runs_batter int, runs_total int, extras int, extras_type string, wicket boolean, wicket_type string, player_out string, fielders array<string>, target int, innings_balls_total int, squad array<string>, wickets_here int"


def simulate(spark: SparkSession, matches: int, overs: int = 20, seed: int = 13) -> DataFrame:
    """Made-up matches, one generator a match, each from its own seed: repeatable and parallel over matches."""

    def innings(rng, match: str, no: int, sides: list[list[str]], names: list[str], target: int | None) -> tuple[list, int]:
        bat, field = sides[no - 1], sides[2 - no]
        squad = sorted({*bat, *field})
        rows, score, out, legal = [], 0, 0, 0
        on, off, nxt = 0, 1, 2
        for over in range(1, overs + 1):
            seq = in_over = 0
            while in_over < 6:
                seq += 1
                hot = over > overs * 0.75
                what = rng.choice(["dot", "1", "2", "3", "4", "6", "w", "wide", "nb"], p=[0.3, 0.34, 0.07, 0.01, 0.11, 0.05, 0.05, 0.05, 0.02] if not hot else [0.22, 0.31, 0.09, 0.01, 0.14, 0.1, 0.07, 0.05, 0.01])
                runs = int(what) if what.isdigit() else 0
                ext = 1 if what in ("wide", "nb") else 0
                wicket = what == "w"
                kind = str(rng.choice(["caught", "bowled", "lbw", "run out", "stumped"], p=[0.55, 0.2, 0.12, 0.08, 0.05])) if wicket else ""
                bowler = field[5 + over % 6]
                keeper = [str(rng.choice(field))] if kind in ("caught", "run out", "stumped") else []
                total = runs + ext
                score += total
                legal_ball = not ext
                legal += legal_ball
                in_over += legal_ball
                rows.append((match, no, over, seq, legal_ball, names[no - 1], names[2 - no], bat[on], bowler, bat[off], runs, total, ext, {"wide": "wides", "nb": "noballs"}.get(what, "none"), wicket, kind, bat[on] if wicket else "", keeper, target, overs * 6, squad, int(wicket)))
                if wicket:
                    out += 1
                    if out == 10:
                        return rows, score
                    on, nxt = nxt, nxt + 1
                elif runs % 2:
                    on, off = off, on
                if target is not None and score >= target:
                    return rows, score
            on, off = off, on
        return rows, score

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SIMULATED.split(", ")]
        for b in batches:
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                sides = [[f"Player {i}-{s}-{k}" for k in range(11)] for s in "ab"]
                names = [f"Side {i}-a", f"Side {i}-b"]
                one, made = innings(rng, f"sim_{i}", 1, sides, names, None)
                two, _ = innings(rng, f"sim_{i}", 2, sides, names, made + 1)
                yield pd.DataFrame(one + two, columns=cols).astype({"target": "Int32"})

    return spark.range(matches, numPartitions=max(1, min(matches, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, SIMULATED)
