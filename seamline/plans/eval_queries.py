"""Queries over generations and runs: fact check, overlap, templates, prompts, rollups, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import rules
from seamline.operators import factcheck, generate, harness, runs, sampling, surface
from seamline.plans.ball_queries import KS
from seamline.session import read_table as t
from seamline.session import spread

KEY = KS.split(", ")
PATHS = {"hallucination": "faithfulness.hallucination_rate", "omission": "faithfulness.omission_rate", "rho": "excitement.rho", "bleu": "surface.bleu", "p50": "latency.p50_ms"}


def _checked(spark, d):
    return factcheck.check(spread(t(spark, d, "dataset").select("row_id", "record", "target_commentary")), "target_commentary")


def claims_by_slot(spark, d):
    return factcheck.slot_precision(_checked(spark, d)).select("slot", "n_claims", "n_false")


def hallucination(spark, d):
    x = _checked(spark, d).withColumn("phase", F.when(F.col("record.over_no") <= 6, "powerplay").otherwise("later"))
    return factcheck.summary(x, ["phase"])


def violation_rates(spark, d):
    g = t(spark, d, "generations").select(*KEY, "run_dir", "generation")
    x = harness.aligned(g, t(spark, d, "dataset"), KEY)
    return runs.violations_per_100(factcheck.check(x, "generation"))


def omissions(spark, d):
    """what SQL can state of the check: boundaries that no boundary word mentions"""
    x = t(spark, d, "dataset").select("row_id", F.col("record.runs_batter").alias("b"), F.coalesce("target_commentary", F.lit("")).alias("x"))
    return x.filter(F.col("b").isin(4, 6) & ~F.col("x").rlike(factcheck.MENTION)).select("row_id", "b")


def templates(spark, d):
    ds = t(spark, d, "dataset")
    line = generate.template(lambda c: F.col("record." + c), lambda c: F.col("features." + c))
    return ds.select("row_id", line.alias("line"))


def template_faithful(spark, d):
    """templates state only what the record holds: none may be a hallucination"""
    ds = spread(t(spark, d, "dataset").select("row_id", "record", "features"))
    line = generate.template(lambda c: F.col("record." + c), lambda c: F.col("features." + c))
    x = factcheck.check(ds.withColumn("line", line), "line")
    return x.agg(F.count("*").alias("n_rows"), F.count_if(F.size("violations") > 0).alias("n_hallucinated"))


def prompt_block(spark, d):
    ds = t(spark, d, "dataset").filter("split = 'train' AND target_commentary IS NOT NULL AND linearized_input IS NOT NULL")
    r = lambda k: F.col("record." + k)
    x = ds.select("row_id", "linearized_input", "target_commentary", sampling.outcome_class(r("wicket"), r("runs_batter"), r("extras_type"), r("runs_total")).alias("klass"))
    ex = sampling.few_shot(x, "klass", "row_id", 4)
    return generate.prompts(t(spark, d, "dataset").filter("split = 'test'"), ex, "row_id")


def chat_format(spark, d):
    ds = t(spark, d, "dataset").filter("linearized_input IS NOT NULL AND target_commentary IS NOT NULL")
    m = generate.chat(F.col("linearized_input"), F.col("target_commentary"))
    return ds.select("row_id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("chat"), generate.seq2seq(F.col("linearized_input")).alias("seq2seq"))


def bleu(spark, d):
    g = t(spark, d, "generations").filter("generation IS NOT NULL AND reference IS NOT NULL")
    return surface.bleu(g, "generation", "reference", ["innings"])


def bleu_sums(spark, d):
    """what corpus BLEU is made of: lengths, and matches and totals of n-grams for n = 1..4, by innings"""
    g = t(spark, d, "generations").filter("generation IS NOT NULL AND reference IS NOT NULL")
    return surface.bleu_counts(g, "generation", "reference", ["innings"])


def example_categories(spark, d):
    """the first two rows of each category by their ball"""
    r, f = (lambda k: F.col("record." + k)), (lambda k: F.col("features." + k))
    x = t(spark, d, "dataset").select("row_id", *[r(k).alias(k) for k in KEY], sampling.category(r("wicket"), r("runs_batter"), r("runs_total"), f("phase"), r("target"), f("tension")).alias("category"))
    return sampling.per_category(x.filter("category IS NOT NULL"), "category", [*KEY, "row_id"], 2).select("category", "row_id")


def references(spark, d):
    """lines of the reference writer, checked against their record: none may be a hallucination"""
    ds = t(spark, d, "dataset").select("row_id", "record", "features")
    line = generate.reference(lambda c: F.col("record." + c), lambda c: F.col("features." + c))
    x = factcheck.check(ds.withColumn("line", line), "line")
    return x.agg(F.count("*").alias("n_rows"), F.count_if(F.size("violations") > 0).alias("n_hallucinated"))


def generation_misses(spark, d):
    return harness.misses(t(spark, d, "generations"), t(spark, d, "dataset"), KEY)


def generation_identity(spark, d):
    """stored generations by innings: checked, and those whose input or reference is none of their ball's"""
    x = harness.identity(t(spark, d, "generations").select(*KEY, "linearized_input", "reference"), t(spark, d, "dataset"), KEY)
    return x.groupBy("innings").agg(F.count("*").alias("n_checked"), F.count_if("input_differs").alias("n_inputs"), F.count_if("reference_differs").alias("n_references"))


def rouge(spark, d):
    g = t(spark, d, "generations")
    return surface.rouge_l(g, "generation", "reference", "gen_id").select("gen_id", F.round("rouge_l", 6).alias("rouge_l"))


def metrics_long(spark, d):
    return runs.flatten(t(spark, d, "metrics")).select("run_dir", "path", rules.scaled(F.col("value"), 4).alias("value_e4"), "status", "reason")


def metric_gaps(spark, d):
    return runs.gaps(runs.flatten(t(spark, d, "metrics"))).groupBy("path", "status").agg(F.count("*").alias("n"))


def seed_rollup(spark, d):
    got = runs.results(t(spark, d, "metrics"), PATHS)
    cols = [rules.scaled(F.col(f"{p}_{k}"), 6).alias(f"{p}_{k}") for p in PATHS for k in ("mean", "std")]
    return got.select("base", "system", "seeds", *cols, *[f"{p}_partial" for p in PATHS])


def first_runs(spark, d):
    x = t(spark, d, "metrics").select("run_dir", F.get_json_object("body", "$.run.name").alias("name"))
    return runs.first_per_base(x, "name", "run_dir")


def evaluation(spark, d):
    x = harness.aligned(t(spark, d, "generations").select(*KEY, "gen_id", "reference", "generation"), t(spark, d, "dataset"), KEY)
    got = harness.evaluate(x, ["match_id", "innings"], ["over_no", "delivery_seq", "gen_id"])
    return got.select("path", F.round("value", 6).alias("value"), "status", "reason")


def annotation_sheet(spark, d):
    g = harness.aligned(t(spark, d, "generations").select(*KEY, "gen_id", "generation"), t(spark, d, "dataset"), KEY)
    x = factcheck.check(g, "generation").select("gen_id", *KEY, "generation", (F.size("violations") > 0).alias("hallucination"), (F.size("omissions") > 0).alias("omission"))
    return sampling.annotation(x, ["hallucination", "omission"], "gen_id", 150)


NUM = lambda p: f"try_cast(json_extract_string(body, '$.metrics.{p}') AS double)"
QUERIES = {
    "claims_by_slot": claims_by_slot,
    "hallucination_omission": hallucination,
    "violations_per_100": violation_rates,
    "boundary_omissions": omissions,
    "template_generate": templates,
    "template_faithfulness": template_faithful,
    "prompt_block": prompt_block,
    "chat_format": chat_format,
    "bleu_corpus": bleu,
    "bleu_ngram_sums": bleu_sums,
    "rouge_l": rouge,
    "example_categories": example_categories,
    "reference_faithfulness": references,
    "generation_misses": generation_misses,
    "generation_identity": generation_identity,
    "metrics_flatten": metrics_long,
    "metric_gaps": metric_gaps,
    "seed_rollup": seed_rollup,
    "first_run_per_base": first_runs,
    "evaluate_generations": evaluation,
    "annotation_sheet": annotation_sheet,
}
_FLAT = """WITH RECURSIVE l AS (SELECT run_dir, k AS path, json_extract(body, '$.metrics."' || k || '"') AS v FROM (SELECT run_dir, body, unnest(json_keys(body, '$.metrics')) AS k FROM metrics)
 UNION ALL SELECT run_dir, path || '.' || k, json_extract(v, '$."' || k || '"') FROM (SELECT run_dir, path, v, unnest(json_keys(v)) AS k FROM l WHERE json_type(v) = 'OBJECT' AND json_extract(v, '$.status') IS NULL)),
 f AS (SELECT run_dir, path, try_cast(v::varchar AS double) AS value, json_extract_string(v, '$.status') AS status, json_extract_string(v, '$.reason') AS reason FROM l WHERE json_type(v) <> 'OBJECT' OR json_extract(v, '$.status') IS NOT NULL)"""
_AGG = ", ".join(
    f"cast(floor(avg({p}) * 1000000 + 0.5) AS bigint) AS {p}_mean, cast(floor(stddev_samp({p}) * 1000000 + 0.5) AS bigint) AS {p}_std, count({p}) < count(*) AND count({p}) > 0 AS {p}_partial" for p in PATHS
)
def _tokens_sql(c: str) -> str:
    x = f"' ' || replace(replace(replace(replace({c}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
    for pattern, by in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return rf"list_filter(regexp_split_to_array({x}, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"


def _bleu_sql() -> str:
    """lengths, and clipped matches and totals of n-grams, by innings"""
    parts = [f"WITH k AS (SELECT gen_id, innings, {_tokens_sql('generation')} AS h, {_tokens_sql('reference')} AS r FROM generations WHERE generation IS NOT NULL AND reference IS NOT NULL)"]
    parts.append("l AS (SELECT innings, cast(sum(len(h)) AS bigint) AS sys_len, cast(sum(len(r)) AS bigint) AS ref_len, " + ", ".join(f"cast(sum(greatest(len(h) - {n - 1}, 0)) AS bigint) AS t{n}" for n in range(1, 5)) + " FROM k GROUP BY innings)")
    for n in range(1, 5):
        for s in "hr":
            gram = f"unnest(list_transform(range(1, len({s}) - {n - 2}), lambda i: array_to_string({s}[i:i + {n - 1}], ' ')))"
            parts.append(f"{s}{n} AS (SELECT gen_id, innings, g, count(*) AS c FROM (SELECT gen_id, innings, {gram} AS g FROM k) GROUP BY ALL)")
        parts.append(f"s{n} AS (SELECT h.innings, cast(sum(least(h.c, r.c)) AS bigint) AS m{n} FROM h{n} h JOIN r{n} r ON h.gen_id = r.gen_id AND h.g = r.g GROUP BY 1)")
    joins = " ".join(f"LEFT JOIN s{n} ON l.innings IS NOT DISTINCT FROM s{n}.innings" for n in range(1, 5))
    return ", ".join(parts) + f" SELECT l.*, {', '.join(f'coalesce(m{n}, 0) AS m{n}' for n in range(1, 5))} FROM l {joins}"


def _template_sql() -> str:
    """the template generator over dataset: pools and order as stated by operators.generate"""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    draw = lambda what: f"(('0x' || substr(sha256(concat_ws('|', '13', r.match_id, r.innings, r.over_no, r.delivery_seq, '{what}')), 1, 13))::bigint / 4503599627370496.0::double)"
    pick = lambda pool: f"([{', '.join(map(q, pool))}])[floor(u * {len(pool)})::int + 1]"
    line = "CASE what " + " ".join(f"WHEN {q(n)} THEN " + (f"CASE WHEN hot THEN {pick(generate.EXCITED[n])} ELSE {pick(p)} END" if n in generate.EXCITED else pick(p)) for n, p in generate.PLAIN.items()) + " END"
    word = "CASE r.runs_batter WHEN 1 THEN 'a single' WHEN 2 THEN 'two runs' WHEN 3 THEN 'three runs' WHEN 5 THEN 'five runs' ELSE r.runs_batter || ' runs' END"
    slots = {
        "{batter}": "r.batter", "{bowler}": "r.bowler", "{out}": "coalesce(nullif(r.player_out, ''), r.batter)", "{by}": "CASE WHEN coalesce(r.fielders[1], '') <> '' THEN ' by ' || r.fielders[1] ELSE '' END",
        "{runs}": "word", "{Runs}": "upper(word[1]) || word[2:]",
    }
    full = "raw"
    for k, v in slots.items():
        full = f"replace({full}, '{k}', coalesce({v}, ''))"
    crossed = lambda m: f"r.batter_runs_after >= {m} AND r.batter_runs_after - r.runs_batter < {m}"
    return f"""WITH a AS (SELECT row_id, record AS r, {draw('variant').replace('r.', 'record.')} AS u, {draw('score').replace('r.', 'record.')} AS v, coalesce(features.event_salience * features.tension > 0.45, false) AS hot, split_part(record.extras_type, '+', 1) AS kind FROM dataset),
 b AS (SELECT *, {word} AS word, CASE WHEN r.wicket THEN CASE WHEN r.wicket_type IN ('bowled', 'caught', 'lbw', 'run out', 'stumped') THEN r.wicket_type ELSE 'caught' END WHEN contains(r.extras_type, 'noballs') AND r.runs_batter = 6 THEN 'no ball six'
 WHEN contains(r.extras_type, 'noballs') AND r.runs_batter = 4 THEN 'no ball four' WHEN r.extras_type <> 'none' THEN CASE WHEN kind IN ('wides', 'noballs', 'byes', 'legbyes', 'penalty') THEN kind ELSE 'penalty' END
 WHEN r.runs_batter = 6 THEN 'six' WHEN r.runs_batter = 4 THEN 'four' WHEN r.runs_total = 0 THEN 'dot' ELSE 'runs' END AS what FROM a), c AS (SELECT *, {line} AS raw FROM b)
 SELECT row_id, concat_ws(' ', {full}, CASE WHEN {crossed(100)} THEN 'A century for ' || r.batter || '.' WHEN {crossed(50)} THEN 'Fifty for ' || r.batter || '.' END,
 CASE WHEN v < 0.2 THEN 'Score ' || r.team_score || '/' || r.team_wickets || '.' END) AS line FROM c"""


ORACLE = {
    "boundary_omissions": r"SELECT row_id, record.runs_batter AS b FROM dataset WHERE record.runs_batter IN (4, 6) AND NOT regexp_matches(coalesce(target_commentary, ''), '(?i)\bsix(?:es)?\b|\bfours?\b|\bboundar(?:y|ies)\b|\bmaximum\b')",
    "template_faithfulness": "SELECT count(*) AS n_rows, 0 AS n_hallucinated FROM dataset",
    "chat_format": "SELECT row_id, 'system: Describe the ball in one line.' || chr(10) || 'user: ' || linearized_input || chr(10) || 'assistant: ' || target_commentary AS chat, 'commentary: ' || linearized_input AS seq2seq FROM dataset WHERE linearized_input IS NOT NULL AND target_commentary IS NOT NULL",
    "prompt_block": """WITH s AS (SELECT row_id, linearized_input AS i, target_commentary AS c, CASE WHEN record.wicket THEN 'wicket' WHEN record.runs_batter = 6 THEN 'six' WHEN record.runs_batter = 4 THEN 'four' WHEN record.extras_type <> 'none' THEN 'extra' WHEN record.runs_total = 0 THEN 'dot' ELSE 'runs' END AS klass, sha256('13|' || row_id) AS h
 FROM dataset WHERE split = 'train' AND target_commentary IS NOT NULL AND linearized_input IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY klass ORDER BY h, row_id) AS r FROM s), e AS (SELECT * FROM r ORDER BY (r > 1)::int, h, row_id LIMIT 4),
 b AS (SELECT string_agg('Input: ' || i || chr(10) || 'Commentary: ' || c, chr(10) || chr(10) ORDER BY row_id) AS block FROM e) SELECT row_id, block || chr(10) || chr(10) || 'Input: ' || linearized_input || chr(10) || 'Commentary:' AS prompt FROM dataset, b WHERE split = 'test'""",
    "bleu_ngram_sums": _bleu_sql(),
    "template_generate": _template_sql(),
    "example_categories": """WITH c AS (SELECT row_id, record.match_id AS m, record.innings AS i, record.over_no AS o, record.delivery_seq AS q, CASE WHEN record.wicket THEN 'wicket' WHEN record.runs_batter = 6 THEN 'six' WHEN record.runs_batter = 4 THEN 'four'
 WHEN record.runs_total = 0 AND features.phase = 'death' THEN 'dot_death' WHEN record.target IS NOT NULL AND features.tension > 0.6 THEN 'tense_chase' END AS category FROM dataset)
 SELECT category, row_id FROM c WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY m NULLS FIRST, i NULLS FIRST, o NULLS FIRST, q NULLS FIRST, row_id) <= 2""",
    "generation_misses": f"""WITH g AS (SELECT DISTINCT {KS} FROM generations), b AS (SELECT DISTINCT record.match_id AS match_id, record.innings AS innings, record.over_no AS over_no, record.delivery_seq AS delivery_seq FROM dataset)
 SELECT 'ball_without_generation' AS what, count(*) AS n FROM b ANTI JOIN g USING (match_id, innings, over_no, delivery_seq) UNION ALL SELECT 'generation_without_ball', count(*) FROM g ANTI JOIN b USING (match_id, innings, over_no, delivery_seq)""",
    "generation_identity": """WITH d AS (SELECT record.match_id AS match_id, record.innings AS innings, record.over_no AS over_no, record.delivery_seq AS delivery_seq, list(DISTINCT linearized_input) FILTER (linearized_input IS NOT NULL) AS i,
 list(DISTINCT target_commentary) FILTER (target_commentary IS NOT NULL) AS r FROM dataset GROUP BY 1, 2, 3, 4), x AS (SELECT innings, linearized_input IS NOT NULL AND NOT coalesce(list_contains(i, linearized_input), false) AS input_differs,
 reference IS NOT NULL AND NOT coalesce(list_contains(r, reference), false) AS reference_differs FROM generations JOIN d USING (match_id, innings, over_no, delivery_seq)) SELECT innings, count(*) AS n_checked, count(*) FILTER (input_differs) AS n_inputs, count(*) FILTER (reference_differs) AS n_references FROM x GROUP BY 1""",
    "metrics_flatten": f"{_FLAT} SELECT run_dir, path, cast(floor(value * 10000 + 0.5) AS bigint) AS value_e4, status, reason FROM f",
    "metric_gaps": f"{_FLAT} SELECT path, status, count(*) AS n FROM f WHERE status IN ('unavailable', 'disabled', 'blocked') GROUP BY 1, 2",
    "seed_rollup": f"""WITH p AS (SELECT run_dir, json_extract_string(body, '$.run.name') AS name, coalesce(json_extract_string(body, '$.run.system'), json_extract_string(body, '$.run.generator')) AS system, {", ".join(f"{NUM(p)} AS {n}" for n, p in PATHS.items())} FROM metrics),
 q AS (SELECT *, regexp_replace(name, '_seed\\d+$', '') AS base FROM p WHERE NOT coalesce(ends_with(name, '_mini') OR starts_with(name, 'smoke_'), false)) SELECT base, arg_min(system, run_dir) AS system, count(*) AS seeds, {_AGG} FROM q GROUP BY base""",
    "first_run_per_base": "SELECT regexp_replace(json_extract_string(body, '$.run.name'), '_seed\\d+$', '') AS base, min(run_dir) AS run_dir FROM metrics GROUP BY 1",
}
