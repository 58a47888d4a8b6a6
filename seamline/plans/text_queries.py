"""Queries over texts: cleaning, splits, samples, statistics, diversity, excitement."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import rules
from seamline.operators import diversity, excitement, sampling, stats, texts
from seamline.plans.ball_queries import BALLS, KS, balls
from seamline.session import read_table as t


def strip_html(spark, d):
    return t(spark, d, "documents").select("doc_id", rules.strip_html(F.col("text")).alias("text"))


def strip_html_full(spark, d):
    from seamline.functions.html import strip_html as full

    return t(spark, d, "documents").select("doc_id", full(F.col("text")).alias("text"))


def reason_counts(spark, d):
    got = texts.clean(t(spark, d, "dataset")).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason"))
    return got.agg(F.count("*").alias("n"))


def dedup_first(spark, d):
    x = t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.trim("text").alias("text"))
    return texts.first_occurrence(x, "text", ["doc_id"]).filter("is_first").select("doc_id")


SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def split_by_group(spark, d):
    return texts.split_by_group(t(spark, d, "match_info"), "match_id", SHARES)


def stratified_sample(spark, d):
    x = balls(spark, d)
    c = F.col
    x = x.select(F.concat_ws("/", *[c(k).cast("string") for k in KS.split(", ")]).alias("key"), sampling.outcome_class(c("wicket"), c("runs_batter"), c("extras_type"), c("runs_total")).alias("klass"))
    return sampling.stratified(x, "klass", "key", 200, floor=16)


def few_shot(spark, d):
    x = t(spark, d, "dataset").filter("split = 'train'")
    r = lambda k: F.col("record." + k)
    x = x.select("row_id", sampling.outcome_class(r("wicket"), r("runs_batter"), r("extras_type"), r("runs_total")).alias("klass"))
    return sampling.few_shot(x, "klass", "row_id", 8)


def text_join(spark, d):
    keys = ["match_id", "innings", "over_no", "delivery_seq"]
    x = t(spark, d, "dataset").select(*[F.col("record." + k).alias(k) for k in keys]).distinct()
    got = texts.join_texts(balls(spark, d).select(*keys), x, keys)
    return got.groupBy("innings").agg(F.count("*").alias("n_balls"), F.count_if("has_text").alias("n_with_text"))


def key_intersection(spark, d):
    k = ["match_id", "innings", "over_no", "delivery_seq"]
    a = t(spark, d, "generations").select(*k)
    b = t(spark, d, "dataset").select(*[F.col("record." + c).alias(c) for c in k])
    return a.intersect(b)


def alignment(spark, d):
    """both ways of an anti join: keys of generations without a ball, and matches of the info without a ball"""
    k = ["match_id", "innings", "over_no", "delivery_seq"]
    b = t(spark, d, "deliveries").select(*k).distinct()
    a = t(spark, d, "generations").select(*k).distinct().join(b, k, "left_anti").agg(F.count("*").alias("n")).select(F.lit("generation_without_ball").alias("what"), "n")
    m = t(spark, d, "match_info").select("match_id").join(b.select("match_id").distinct(), "match_id", "left_anti").agg(F.count("*").alias("n"))
    return a.unionByName(m.select(F.lit("info_without_ball").alias("what"), "n"))


def spearman_overall(spark, d):
    x = t(spark, d, "dataset").select(F.col("features.tension").alias("x"), F.col("features.momentum").alias("y"))
    return stats.spearman(x, "x", "y").select("n", rules.scaled(F.col("rho"), 6).alias("rho_micro"))


def spearman_by_group(spark, d):
    x = t(spark, d, "dataset").select(F.col("features.phase").alias("phase"), F.col("features.tension").alias("x"), F.col("features.event_salience").alias("y"))
    return stats.spearman(x, "x", "y", ["phase"]).select("phase", "n", rules.scaled(F.col("rho"), 6).alias("rho_micro"))


def percentiles(spark, d):
    got = stats.percentiles(t(spark, d, "events"), "value")
    return got.select("n", rules.scaled(F.col("p50"), 4).alias("p50"), rules.scaled(F.col("p95"), 4).alias("p95"))


def confusion(spark, d):
    """does a generation repeat its reference's outcome words? a checker's verdict against the record's, by innings"""
    g = t(spark, d, "generations").filter("generation IS NOT NULL AND reference IS NOT NULL")
    verdict, truth = F.lower("generation").contains("four"), F.lower("reference").contains("four")
    x = g.select(F.lit("four").alias("task"), F.least("innings", F.lit(3)).cast("string").alias("stratum"), verdict.alias("v"), truth.alias("w"))
    got = stats.confusion(x, F.col("v"), F.col("w"), "task", "stratum")
    return got.select("task", "stratum", "tp", "fp", "fn", "tn", *[rules.scaled(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "kappa")])


def distinct_n(spark, d):
    x = t(spark, d, "dataset").select(F.col("record.match_id").alias("match_id"), F.col("record.innings").alias("innings"), "target_commentary")
    got = diversity.distinct_by_group(x, "target_commentary", ["match_id", "innings"], 2)
    return got.select("match_id", "innings", "grams", "distinct_grams")


def distinct_n_mean(spark, d):
    x = t(spark, d, "dataset").select(F.col("record.match_id").alias("match_id"), F.col("record.innings").alias("innings"), "target_commentary")
    got = diversity.distinct_mean(x, "target_commentary", ["match_id", "innings"], 1)
    return got.select("n_groups", rules.scaled(F.col("mean_ratio"), 6).alias("mean_micro"))


def repetition(spark, d):
    x = t(spark, d, "dataset").select("row_id", F.col("record.match_id").alias("match_id"), F.col("record.innings").alias("innings"), "target_commentary")
    return diversity.repetition(x, "target_commentary", ["match_id", "innings"], ["row_id"], 4).select("pairs", "repeated")


def pair_similarity(spark, d):
    x = t(spark, d, "dataset").select("row_id", F.col("record.match_id").alias("match_id"), "target_commentary").filter("target_commentary IS NOT NULL")
    p = diversity.sampled_pairs(x, "target_commentary", ["match_id"], "row_id")
    return p.select("match_id", "key_a", "key_b", rules.scaled(diversity.jaccard(F.col("text_a"), F.col("text_b")), 6).alias("jaccard_micro"))


def excitement_parts(spark, d):
    p = excitement.parts(F.col("text"))
    x = t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", *[c.alias(k) for k, c in p.items()], rules.scaled(excitement.score(F.col("text")), 6).alias("score_micro"))
    return x


def excitement_validation(spark, d):
    got = excitement.correlate(t(spark, d, "dataset").filter("target_commentary IS NOT NULL"), "target_commentary", group=["features.phase"])
    return got.select("phase", "n", rules.scaled(F.col("rho"), 6).alias("rho_micro"), "passed")


STRIP = "text"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
    STRIP = f"replace({STRIP}, '{_a}', '{_b}')"
STRIP = f"trim(regexp_replace(regexp_replace({STRIP}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')"
TARGET = STRIP.replace("(text,", "(coalesce(target_commentary, ''),")
SURNAME = r"regexp_extract(trim(x), '(\S+)$', 1)"
TOK = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"
RANKS = """r AS (SELECT *, rank() OVER ({p}ORDER BY x) + (count(*) OVER (PARTITION BY {q}x) - 1) / 2.0 AS rx, rank() OVER ({p}ORDER BY y) + (count(*) OVER (PARTITION BY {q}y) - 1) / 2.0 AS ry FROM d)"""
RHO = "cast(floor(CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END * 1000000 + 0.5) AS bigint) AS rho_micro"
_LOW = r"' ' || array_to_string(regexp_extract_all(lower({0}), '[a-z0-9_]+|[^a-z0-9_\s]'), '  ') || ' '"


def _parts_sql(c: str) -> str:
    hits = " + ".join(f"((length(low) - length(replace(low, ' {'  '.join(p.split())} ', ''))) // {len('  '.join(p.split())) + 2})" for p in excitement.INTENSIFIERS)
    return f"length({c}) - length(replace({c}, '!', '')) AS bangs, {hits} AS intensifiers, len(list_filter(regexp_extract_all({c}, '[A-Za-z]+'), lambda w: length(w) >= 3 AND upper(w) = w)) AS caps"


SCORE = "(0.4::double * (least(bangs, 3) / 3.0::double) + 0.4::double * (least(intensifiers, 3) / 3.0::double) + 0.2::double * (least(caps, 2) / 2.0::double))"
CLASS = "CASE WHEN {0}wicket THEN 'wicket' WHEN {0}runs_batter = 6 THEN 'six' WHEN {0}runs_batter = 4 THEN 'four' WHEN {0}extras_type <> 'none' THEN 'extra' WHEN {0}runs_total = 0 THEN 'dot' ELSE 'runs' END"


def _strat(source: str, n: int, floor: int) -> str:
    return f"""{source}, k AS (SELECT *, sha256('13|' || key) AS h FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY klass ORDER BY h, key) AS r FROM k)
 SELECT * EXCLUDE (h, r) FROM r ORDER BY (r > {floor})::int, h, key LIMIT {n}"""


def _micro(c: str) -> str:
    return f"cast(floor({c} * 1000000 + 0.5) AS bigint)"


QUERIES = {
    "clean_strip_html": strip_html,
    "clean_strip_html_full": strip_html_full,
    "clean_reason_counts": reason_counts,
    "clean_dedup_first": dedup_first,
    "split_by_group": split_by_group,
    "stratified_sample": stratified_sample,
    "fewshot_selection": few_shot,
    "text_left_join_coverage": text_join,
    "key_set_intersection": key_intersection,
    "antijoin_alignment": alignment,
    "spearman_overall": spearman_overall,
    "spearman_by_group": spearman_by_group,
    "latency_percentiles": percentiles,
    "confusion_kappa_sets": confusion,
    "distinct_n_by_group": distinct_n,
    "distinct_n_mean": distinct_n_mean,
    "repetition_rate": repetition,
    "self_pair_similarity": pair_similarity,
    "excitement_heuristic": excitement_parts,
    "excitement_by_phase": excitement_validation,
}

ORACLE = {
    "clean_strip_html": f"SELECT doc_id, {STRIP} AS text FROM documents",
    "clean_reason_counts": rf"""WITH a AS (SELECT row_id, record.match_id AS m, record.innings AS i, record.over_no AS o, record.delivery_seq AS q, {TARGET} AS text,
  list_filter(list_distinct([{SURNAME} FOR x IN list_concat([record.batter, record.bowler, record.non_striker, record.player_out], coalesce(record.fielders, []))]), lambda y: y <> '') AS inv,
  list_filter(list_distinct([{SURNAME} FOR x IN coalesce(record.squad, [])]), lambda y: y <> '') AS squad FROM dataset),
 b AS (SELECT *, regexp_extract_all(text, '[A-Z][a-z]+') AS w, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n FROM a),
 c AS (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN n < 4 THEN 'too_short' WHEN n > 80 THEN 'too_long' WHEN list_has_any(w, list_filter(squad, lambda y: NOT list_contains(inv, y))) AND NOT list_has_any(w, inv) THEN 'entity_mismatch' END AS reason FROM b),
 e AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, lower(text) ORDER BY m, i, o, q, row_id) > 1 THEN 'duplicate' END AS dup FROM c)
 SELECT coalesce(reason, dup, 'kept') AS reason, count(*) AS n FROM e GROUP BY 1""",
    "clean_dedup_first": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY lower(trim(text, ' '))",
    "split_by_group": """WITH g AS (SELECT DISTINCT match_id FROM match_info WHERE match_id IS NOT NULL), r AS (SELECT match_id, row_number() OVER (ORDER BY sha256('13|' || match_id)) - 1 AS r FROM g),
 n AS (SELECT count(*) AS n FROM g), k AS (SELECT n, floor(n * 0.8::double)::bigint AS tr, greatest(floor(n * 0.1::double)::bigint, 1) AS va, greatest(floor(n * 0.1::double)::bigint, 1) AS te FROM n)
 SELECT match_id, CASE WHEN r < n - va - te THEN 'train' WHEN r < n - te THEN 'val' ELSE 'test' END AS split FROM r, k""",
    "stratified_sample": _strat(f"{BALLS}, s AS (SELECT concat_ws('/', match_id, innings, over_no, delivery_seq) AS key, {CLASS.format('')} AS klass FROM balls)", 200, 16),
    "fewshot_selection": f"""WITH s AS (SELECT row_id, {CLASS.format('record.')} AS klass FROM dataset WHERE split = 'train'), k AS (SELECT *, sha256('13|' || row_id) AS h FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY klass ORDER BY h, row_id) AS r FROM k)
 SELECT row_id, klass FROM r ORDER BY (r > 1)::int, h, row_id LIMIT 8""",
    "text_left_join_coverage": f"""{BALLS}, x AS (SELECT DISTINCT record.match_id AS match_id, record.innings AS innings, record.over_no AS over_no, record.delivery_seq AS delivery_seq FROM dataset)
 SELECT b.innings, count(*) AS n_balls, count(x.match_id) AS n_with_text FROM balls b LEFT JOIN x ON b.match_id = x.match_id AND b.innings = x.innings AND b.over_no = x.over_no AND b.delivery_seq = x.delivery_seq GROUP BY 1""",
    "key_set_intersection": f"SELECT {KS} FROM generations INTERSECT SELECT record.match_id, record.innings, record.over_no, record.delivery_seq FROM dataset",
    "antijoin_alignment": f"""SELECT 'generation_without_ball' AS what, count(*) AS n FROM (SELECT DISTINCT {KS} FROM generations g WHERE NOT EXISTS (SELECT 1 FROM deliveries b WHERE b.match_id = g.match_id AND b.innings = g.innings AND b.over_no = g.over_no AND b.delivery_seq = g.delivery_seq))
 UNION ALL SELECT 'info_without_ball', count(*) FROM match_info m WHERE NOT EXISTS (SELECT 1 FROM deliveries b WHERE b.match_id = m.match_id)""",
    "spearman_overall": f"WITH d AS (SELECT features.tension AS x, features.momentum AS y FROM dataset WHERE features.tension IS NOT NULL AND features.momentum IS NOT NULL), {RANKS.format(p='', q='')} SELECT count(*) AS n, {RHO} FROM r",
    "spearman_by_group": f"WITH d AS (SELECT features.phase AS phase, features.tension AS x, features.event_salience AS y FROM dataset WHERE features.tension IS NOT NULL AND features.event_salience IS NOT NULL), {RANKS.format(p='PARTITION BY phase ', q='phase, ')} SELECT phase, count(*) AS n, {RHO} FROM r GROUP BY phase",
    "latency_percentiles": "SELECT count(value) AS n, cast(floor(quantile_cont(value, 0.5) * 10000 + 0.5) AS bigint) AS p50, cast(floor(quantile_cont(value, 0.95) * 10000 + 0.5) AS bigint) AS p95 FROM events",
    "confusion_kappa_sets": f"""WITH d AS (SELECT 'four' AS task, least(innings, 3)::varchar AS stratum, contains(lower(generation), 'four') AS p, contains(lower(reference), 'four') AS g FROM generations WHERE generation IS NOT NULL AND reference IS NOT NULL),
 c AS (SELECT task, CASE WHEN grouping(stratum) = 1 THEN 'overall' ELSE stratum END AS stratum, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn FROM d GROUP BY GROUPING SETS ((task), (task, stratum))),
 e AS (SELECT *, (tp + fp + fn + tn)::double AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))::double AS ch FROM c)
 SELECT task, stratum, tp, fp, fn, tn, {_micro('tp / nullif(tp + fp, 0)::double')} AS precision, {_micro('tp / nullif(tp + fn, 0)::double')} AS recall, {_micro('2.0::double * tp / nullif(2 * tp + fp + fn, 0)')} AS f1, {_micro('(tp + tn) / nullif(n, 0)')} AS accuracy, {_micro('((tp + tn) * n - ch) / nullif(n * n - ch, 0)')} AS kappa FROM e""",
    "distinct_n_by_group": f"""WITH a AS (SELECT record.match_id AS match_id, record.innings AS innings, {TOK.format('target_commentary')} AS t FROM dataset), g AS (SELECT match_id, innings, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS g FROM a)
 SELECT match_id, innings, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM g GROUP BY 1, 2""",
    "distinct_n_mean": f"""WITH a AS (SELECT record.match_id AS match_id, record.innings AS innings, unnest({TOK.format('target_commentary')}) AS g FROM dataset), b AS (SELECT count(DISTINCT g) / count(*)::double AS q FROM a GROUP BY match_id, innings)
 SELECT count(*) AS n_groups, {_micro('avg(q)')} AS mean_micro FROM b""",
    "repetition_rate": f"""WITH a AS (SELECT row_id, record.match_id AS m, record.innings AS i, {TOK.format('target_commentary')} AS t FROM dataset), b AS (SELECT t, lag(t) OVER (PARTITION BY m, i ORDER BY row_id) AS p FROM a),
 c AS (SELECT *, t = p AS same, len(t) >= 4 AND len(p) >= 4 AS lng FROM b WHERE p IS NOT NULL), e AS (SELECT same OR list_has_any([array_to_string(t[j:j + 3], ' ') FOR j IN range(1, len(t) - 2)], [array_to_string(p[j:j + 3], ' ') FOR j IN range(1, len(p) - 2)]) AS hit FROM c WHERE same OR lng)
 SELECT count(*) AS pairs, count(*) FILTER (hit) AS repeated FROM e""",
    "self_pair_similarity": f"""WITH a AS (SELECT row_id, record.match_id AS match_id, target_commentary AS x, sha256('13|' || row_id) AS h FROM dataset WHERE target_commentary IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY h, row_id) AS r FROM a),
 l AS (SELECT *, lead(row_id) OVER w AS kb, lead(x) OVER w AS y FROM r WHERE r <= 51 WINDOW w AS (PARTITION BY match_id ORDER BY h, row_id)), s AS (SELECT *, list_distinct({TOK.format('x')}) AS tx, list_distinct({TOK.format('y')}) AS ty FROM l WHERE kb IS NOT NULL)
 SELECT match_id, row_id AS key_a, kb AS key_b, {_micro('len(list_intersect(tx, ty)) / nullif(len(list_distinct(list_concat(tx, ty))), 0)::double')} AS jaccard_micro FROM s""",
    "excitement_heuristic": f"WITH a AS (SELECT doc_id, text, {_LOW.format('text')} AS low FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, {_parts_sql('text')} FROM a) SELECT doc_id, bangs, intensifiers, caps, {_micro(SCORE)} AS score_micro FROM b",
    "excitement_by_phase": f"""WITH a AS (SELECT features, target_commentary AS text, {_LOW.format('target_commentary')} AS low FROM dataset WHERE target_commentary IS NOT NULL), b AS (SELECT features, {_parts_sql('text')} FROM a),
 d AS (SELECT features.phase AS phase, {SCORE} AS x, features.event_salience * features.tension AS y FROM b WHERE features.event_salience * features.tension IS NOT NULL), {RANKS.format(p='PARTITION BY phase ', q='phase, ')}, z AS (SELECT phase, count(*) AS n, {RHO} FROM r GROUP BY phase) SELECT *, coalesce(rho_micro > 0, false) AS passed FROM z""",
}
