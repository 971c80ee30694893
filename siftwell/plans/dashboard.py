"""Registered queries of the analysis operators: each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import states as st
from ..functions import text as tx
from ..operators import analysis as an
from . import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


_ENGINE = "CASE WHEN len(string_split({0}, '_')) >= 3 THEN upper({0}[1]) || lower(string_split({0}, '_')[1][2:]) || ' (' || upper(string_split({0}, '_')[2]) || ' / ' || upper(string_split({0}, '_')[3]) || ')' ELSE {0} END"
e1, e2 = _ENGINE.format("a.engine_text"), _ENGINE.format("b.engine_text")

add("A26_engine_overlap", lambda s, d: an.engine_overlap(ad.result(s, d)), ad.with_views("result", f"""
WITH seen AS (SELECT DISTINCT query, engine_text, normalized_url FROM result WHERE position IS NULL OR position <= 5),
cnt AS (SELECT query, engine_text, count(*) AS n FROM seen GROUP BY ALL),
both_ AS (SELECT x.query, x.engine_text AS p, y.engine_text AS q, count(*) AS n FROM seen x JOIN seen y ON x.query = y.query AND x.normalized_url = y.normalized_url AND x.engine_text < y.engine_text GROUP BY ALL)
SELECT {e1} AS engine_1, {e2} AS engine_2, CAST(sum(a.n - coalesce(o.n, 0)) AS BIGINT) AS exclusive_1, CAST(sum(b.n - coalesce(o.n, 0)) AS BIGINT) AS exclusive_2,
  CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS overlap, CAST(sum(a.n + b.n - coalesce(o.n, 0)) AS BIGINT) AS total
FROM cnt a JOIN cnt b ON a.query = b.query AND a.engine_text < b.engine_text LEFT JOIN both_ o ON o.query = a.query AND o.p = a.engine_text AND o.q = b.engine_text
GROUP BY a.engine_text, b.engine_text"""))

_FINAL = "(progress = 1 OR (progress = -1 AND counter >= 3))"
_PCT = "CAST(round_even(100.0 * {0} / {1}, 0) AS BIGINT)"
add("A03_collection_progress", lambda s, d: an.collection_progress(ad.result(s, d)), ad.with_views("result", f"""
SELECT study, count(*) AS n_results, count(*) FILTER (progress = 1) AS n_done, count(*) FILTER (progress = -1 AND counter >= 3) AS n_failed,
  count(*) FILTER (progress = -1 AND counter < 3) AS n_retry, count(*) FILTER (NOT {_FINAL}) AS n_open,
  {_PCT.format(f'count(*) FILTER ({_FINAL})', 'count(*)')} AS percent, count(DISTINCT engine_text) AS n_engines, count(DISTINCT main) AS n_domains
FROM result GROUP BY study"""))
_NAMES = ["n_results", "n_done", "n_failed", "n_retry", "n_open", "n_engines", "n_domains"]
add("A01_result_statistics", lambda s, d: an.long_counters(an.collection_progress(ad.result(s, d)), ["study"], _NAMES), ad.with_views("result", f"""
WITH c AS (SELECT study, count(*) AS n_results, count(*) FILTER (progress = 1) AS n_done, count(*) FILTER (progress = -1 AND counter >= 3) AS n_failed,
  count(*) FILTER (progress = -1 AND counter < 3) AS n_retry, count(*) FILTER (NOT {_FINAL}) AS n_open, count(DISTINCT engine_text) AS n_engines, count(DISTINCT main) AS n_domains FROM result GROUP BY study),
u AS (""" + " UNION ALL ".join(f"SELECT study, '{n}' AS metric, {n} AS value FROM c" for n in _NAMES) + ") SELECT * FROM u WHERE value <> 0"))
add("A02_distinct_engines", lambda s, d: ad.result(s, d).where("engine_text is not null").groupBy("study").agg(F.countDistinct("engine_text").alias("n_engines")), ad.with_views("result", "SELECT study, count(DISTINCT engine_text) AS n_engines FROM result GROUP BY study"))
add("A04_collection_percent", lambda s, d: ad.result(s, d).groupBy("study").agg(st.percentage_text(F.count_if(F.col("progress") == 1), F.count(F.lit(1))).alias("percent")), ad.with_views("result", f"SELECT study, CAST({_PCT.format('count(*) FILTER (progress = 1)', 'count(*)')} AS VARCHAR) || ' %' AS percent FROM result GROUP BY study"))
_EVAL = f"count(*) FILTER (status = 1) AS n_done, count(*) FILTER (status = 2) AS n_skipped, count(*) AS n_all, {_PCT.format('count(*) FILTER (status IN (1, 2))', 'count(*)')} AS percent, count(*) FILTER (status = 2) // 5 AS skipped_items"
add("A05_evaluation", lambda s, d: an.evaluation(ad.answer(s, d), ["study"], 5), ad.with_views("answer", f"SELECT study, {_EVAL} FROM answer GROUP BY study"))
add("A37_page_counters", lambda s, d: an.evaluation(ad.answer(s, d), ["study", "kind"], 5), ad.with_views("answer", f"SELECT study, kind, {_EVAL} FROM answer GROUP BY study, kind"))
_DASH = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in st.DASHBOARD_LABELS.items()) + " ELSE 'Unknown' END"
_EXP = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in st.EXPORT_LABELS.items()) + " ELSE 'Unknown' END"
add("A06_finished_by_kind", lambda s, d: an.finished_by_kind(ad.answer(s, d), 5), ad.with_views("answer", f"SELECT {_DASH} AS result_type, count(*) // 5 AS n_items FROM answer WHERE status = 1 GROUP BY kind"))
add("A07_named_answers", lambda s, d: an.answers_of_participants(ad.answer(s, d)).groupBy("study").agg(F.count(F.lit(1)).alias("n")), ad.with_views("answer", "SELECT study, count(*) AS n FROM answer a WHERE participant IS NOT NULL OR NOT EXISTS (SELECT 1 FROM answer b WHERE b.study = a.study AND b.participant IS NOT NULL) GROUP BY study"))
add("A08_indicator_distribution", lambda s, d: an.distinct_items(ad.indicator(s, d), ["indicator", "value"]), ad.with_views("indicator", "SELECT kind, indicator, value, count(DISTINCT item) AS n_items FROM indicator GROUP BY ALL"))
add("A09_classifier_distribution", lambda s, d: an.distinct_items(ad.classifier_result(s, d), ["value"]), ad.with_views("classifier_result", "SELECT kind, value, count(DISTINCT item) AS n_items FROM classifier_result GROUP BY ALL"))
_JSON = "SELECT kind, replace(indicator, 'LLM_', '') AS indicator, 'k' AS key, json_extract_string(value, '$.k') AS value FROM indicator"
add("A10_json_distribution", lambda s, d: an.json_distribution(ad.indicator(s, d)), ad.with_views("indicator", f"WITH e AS ({_JSON}) SELECT kind, indicator, key, value, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL"))
_NUM = "TRY_CAST(trim(string_split(value, ':')[-1]) AS DOUBLE)"
_FOLD = """CASE WHEN lower(trim(value)) IN ('error', 'source_failed', 'classifier_error', 'excluded', 'error_api', 'error_timeout', 'error_empty', 'error_no_config', 'error_no_study')
    OR starts_with(lower(trim(value)), 'error_') THEN 'Error' WHEN lower(trim(value)) = 'in process' THEN 'In Process' ELSE trim(value) END"""
_RANGE = "CASE WHEN x BETWEEN 0 AND 20 THEN '0-20' WHEN x > 20 AND x <= 40 THEN '21-40' WHEN x > 40 AND x <= 60 THEN '41-60' WHEN x > 60 AND x <= 80 THEN '61-80' WHEN x > 80 AND x <= 100 THEN '81-100' ELSE value END"
_BUCKETED = f"""f AS (SELECT kind, {_FOLD} AS value, count(*) AS n FROM classifier_result GROUP BY ALL),
g AS (SELECT kind, value, n, {_NUM} AS x FROM f),
r AS (SELECT *, max(x) OVER (PARTITION BY kind) > 10 AS big FROM g),
c AS (SELECT kind, count(DISTINCT x) > 10 AS many FROM g GROUP BY kind),
h AS (SELECT r.kind, CASE WHEN big AND many AND x IS NOT NULL THEN {_RANGE} ELSE value END AS label, CAST(sum(n) AS BIGINT) AS n FROM r JOIN c ON r.kind = c.kind GROUP BY ALL)"""
add("A13_bucketed_distribution", lambda s, d: an.bucketed_distribution(ad.classifier_result(s, d), ["kind"]), ad.with_views("classifier_result", f"WITH {_BUCKETED} SELECT kind, label, n, 100.0 * n / sum(n) OVER (PARTITION BY kind) AS share FROM h"))
add("A11_folded_states", lambda s, d: ad.classifier_result(s, d).groupBy("kind", an.folded(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n")), ad.with_views("classifier_result", f"SELECT kind, {_FOLD} AS value, count(*) AS n FROM classifier_result GROUP BY ALL"))
add("A12_needs_ranges", lambda s, d: ad.classifier_result(s, d).groupBy("kind").agg(F.max(tx.last_number(F.col("value"))).alias("largest"), F.countDistinct(tx.last_number(F.col("value"))).alias("n_numbers")), ad.with_views("classifier_result", f"SELECT kind, max({_NUM}) AS largest, count(DISTINCT {_NUM}) AS n_numbers FROM classifier_result GROUP BY kind"))
add("A14_top_and_other", lambda s, d: an.fold_tail(ad.indicator(s, d).groupBy("kind", F.col("value").alias("label")).agg(F.count(F.lit(1)).alias("n")), ["kind"]), ad.with_views("indicator", """
WITH g AS (SELECT kind, value AS label, count(*) AS n FROM indicator GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) AS rn FROM g)
SELECT kind, CASE WHEN rn <= 15 THEN label ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL"""))
add("A15_raw_numbers", lambda s, d: an.fold_tail(ad.classifier_result(s, d).select("kind", tx.last_number(F.col("value")).alias("label")).where("label is not null").groupBy("kind", F.col("label").cast("int").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")), ["kind"], k=1000), ad.with_views("classifier_result", f"SELECT kind, CAST(CAST({_NUM} AS INTEGER) AS VARCHAR) AS label, count(*) AS n FROM classifier_result WHERE {_NUM} IS NOT NULL GROUP BY ALL"))
add("A16_errors_under_keys", lambda s, d: an.errors_under_every_key(an.json_distribution(ad.indicator(s, d).withColumn("value", F.when(F.col("id") % 11 == 0, F.lit("error_api")).otherwise(F.col("value"))))), ad.with_views("indicator", """
WITH i AS (SELECT kind, replace(indicator, 'LLM_', '') AS indicator, CASE WHEN id % 11 = 0 THEN '' ELSE 'k' END AS key, CASE WHEN id % 11 = 0 THEN 'error_api' ELSE json_extract_string(value, '$.k') END AS value FROM indicator),
e AS (SELECT kind, indicator, key, value, count(*) AS n FROM i GROUP BY ALL), k AS (SELECT DISTINCT kind, indicator, key FROM e WHERE key <> ''),
u AS (SELECT * FROM e WHERE key <> '' UNION ALL SELECT k.kind, k.indicator, k.key, e.value, e.n FROM e JOIN k ON e.kind = k.kind AND e.indicator = k.indicator WHERE e.key = '')
SELECT kind, indicator, key, value, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL"""))
_TOP = "WITH g AS (SELECT {0} AS domain, count(*) AS n, avg(position) AS avg_position FROM result WHERE {0} <> '' GROUP BY 1) SELECT domain, n, 100.0 * n / (SELECT sum(n) FROM g) AS share, avg_position FROM g ORDER BY n DESC, domain LIMIT 10"
add("A17_top_domains", lambda s, d: an.top_domains(ad.result(s, d)), ad.with_views("result", _TOP.format("main")))
add("A18_top_source_urls", lambda s, d: an.top_domains(ad.result(s, d), domain="normalized_url"), ad.with_views("result", _TOP.format("normalized_url")))
add("A48_domain_sheet", lambda s, d: an.top_domains(ad.result(s, d), None).select("domain", "n", F.coalesce(F.round("avg_position", 4).cast("string"), F.lit("N/A")).alias("position")), ad.with_views("result", "SELECT main AS domain, count(*) AS n, coalesce(CAST(round(avg(position), 4) AS VARCHAR), 'N/A') AS position FROM result WHERE main <> '' GROUP BY main"))
_DIST = "WITH a AS (SELECT * FROM answer WHERE status = 1), t AS (SELECT question, kind, count(*) AS m FROM a GROUP BY ALL), g AS (SELECT question, kind, trim(value) AS value, count(*) AS n FROM a GROUP BY ALL) SELECT g.question, g.kind, value, n, 100.0 * n / m AS share FROM g JOIN t ON g.question = t.question AND g.kind = t.kind"
add("A19_answer_distribution", lambda s, d: an.answer_distribution(ad.answer(s, d)), ad.with_views("answer", _DIST))
add("A20_multi_select", lambda s, d: an.answer_distribution(ad.answer(s, d).withColumn("value", F.concat(F.col("value"), F.lit(", "), F.col("query").cast("string"))), split=True), ad.with_views("answer", """
WITH a AS (SELECT question, kind, unnest(string_split(value || ', ' || CAST(query AS VARCHAR), ',')) AS value FROM answer WHERE status = 1), t AS (SELECT question, kind, count(*) AS m FROM answer WHERE status = 1 GROUP BY ALL),
g AS (SELECT question, kind, trim(value) AS value, count(*) AS n FROM a GROUP BY ALL) SELECT g.question, g.kind, value, n, 100.0 * n / m AS share FROM g JOIN t ON g.question = t.question AND g.kind = t.kind"""))
add("A21_likert", lambda s, d: an.likert(ad.answer(s, d)).withColumn("std_dev", F.round("std_dev", 6)), ad.with_views("answer", "SELECT question, avg(CAST(value AS DOUBLE)) AS mean, round(stddev_pop(CAST(value AS DOUBLE)), 6) AS std_dev, count(*) AS n FROM answer WHERE status = 1 GROUP BY question"))
add("A22_scale", lambda s, d: an.scale(ad.answer(s, d)), ad.with_views("answer", "SELECT question, count(*) AS n, avg(CAST(value AS DOUBLE)) AS mean, min(CAST(value AS DOUBLE)) AS min, max(CAST(value AS DOUBLE)) AS max FROM answer WHERE status = 1 GROUP BY question"))
add("A23_free_text", lambda s, d: ad.classifier_result(s, d).where(st.filled(F.trim("value"))).select("kind", F.trim("value").alias("value")).distinct(), ad.with_views("classifier_result", "SELECT DISTINCT kind, trim(value) AS value FROM classifier_result WHERE trim(value) <> ''"))
add("A24_item_type_label", lambda s, d: ad.answer(s, d).groupBy(st.kind_label(F.col("kind"), st.DASHBOARD_LABELS, "SERPs").alias("label")).agg(F.count(F.lit(1)).alias("n")), ad.with_views("answer", f"SELECT {_DASH.replace('Unknown', 'SERPs')} AS label, count(*) AS n FROM answer GROUP BY 1"))
add("A25_flat_statistics", lambda s, d: an.answer_distribution(ad.answer(s, d)).select("question", F.expr("stack(2, 'Count', cast(n as string), 'Share (%)', cast(cast(round(share, 2) as decimal(9,2)) as string)) as (name, value)"), F.col("kind"), F.col("value").alias("answer_value")), ad.with_views("answer", f"WITH x AS ({_DIST.replace('WITH a AS', 'WITH a AS')}) SELECT question, 'Count' AS name, CAST(n AS VARCHAR) AS value, kind, value AS answer_value FROM x UNION ALL SELECT question, 'Share (%)', CAST(CAST(round(share, 2) AS DECIMAL(9,2)) AS VARCHAR), kind, value FROM x"))
add("A27_query_progress", lambda s, d: an.query_progress(ad.result(s, d), ad.answer(s, d), 5), ad.with_views("result answer", """
WITH i AS (SELECT query, count(*) AS n_items FROM result GROUP BY query), a AS (SELECT query, count(DISTINCT participant) AS p, count(*) FILTER (status IN (1, 2)) AS f, count(*) FILTER (status = 0) AS o FROM answer GROUP BY query)
SELECT i.query, n_items, coalesce(p, 0) AS n_participants, coalesce(f, 0) AS n_finished, coalesce(o, 0) AS n_open, n_items * 5 * coalesce(p, 0) AS n_expected,
  CASE WHEN coalesce(p, 0) > 0 THEN 100.0 * f / (n_items * 5 * p) ELSE 0.0 END AS percent FROM i LEFT JOIN a ON i.query = a.query"""))
add("A28_participant_by_query", lambda s, d: an.participant_progress(ad.answer(s, d), 5, True), ad.with_views("answer", "SELECT participant, count(DISTINCT query) AS n_seen, count(DISTINCT query) FILTER (status <> 0) AS n_closed, count(DISTINCT query) FILTER (status = 0) AS n_open FROM answer GROUP BY participant"))
_PART = f"SELECT participant, count(*) // 5 AS n_seen, count(*) FILTER (status <> 0) // 5 AS n_closed, greatest(count(*) // 5 - count(*) FILTER (status <> 0) // 5, 0) AS n_open, least(100, {_PCT.format('count(*) FILTER (status <> 0)', 'count(*)')}) AS percent FROM answer GROUP BY participant"
add("A29_participant_by_item", lambda s, d: an.participant_progress(ad.answer(s, d), 5, False), ad.with_views("answer", _PART))
add("A30_progress_panel", lambda s, d: an.participant_progress(ad.answer(s, d).where("participant = 7"), 5, False), ad.with_views("answer", _PART.replace("FROM answer", "FROM answer WHERE participant = 7")))
add("A31_active_query_progress", lambda s, d: an.state_counts(ad.answer(s, d), ["participant", "query"], {"n_open": F.col("status") == 0, "n_closed": F.col("status") != 0}), ad.with_views("answer", "SELECT participant, query, count(*) FILTER (status = 0) AS n_open, count(*) FILTER (status <> 0) AS n_closed FROM answer GROUP BY ALL"))
add("A32_participants_per_query", lambda s, d: ad.answer(s, d).groupBy("query").agg(F.countDistinct("participant").alias("n")), ad.with_views("answer", "SELECT query, count(DISTINCT participant) AS n FROM answer GROUP BY query"))
add("A33_assignments_per_item", lambda s, d: ad.answer(s, d).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n")), ad.with_views("answer", "SELECT kind, item, count(*) AS n FROM answer GROUP BY ALL"))


def _completion(s, d):
    g = ad.result(s, d).groupBy("study").agg(F.count(F.lit(1)).alias("total"), F.count_if(st.is_final(F.col("progress"), F.col("counter"))).alias("finished"))
    return g.select("study", "total", "finished", st.study_status(F.col("study") % 5, F.col("total"), F.col("finished"), F.lit(True)).alias("status"))


add("A34_study_completion", _completion, ad.with_views("result", f"""
WITH g AS (SELECT study, count(*) AS total, count(*) FILTER ({_FINAL}) AS finished FROM result GROUP BY study)
SELECT *, CASE WHEN study % 5 = 4 THEN 4 WHEN study % 5 = 2 THEN 2 WHEN finished >= total THEN 2 WHEN study % 5 = 0 THEN 1 ELSE study % 5 END AS status FROM g"""))


def _runs(s, d):
    tasks = ad.read(s, d, "nation").select(F.col("n_name").alias("task"), F.when(F.col("n_nationkey") % 3 == 0, "all").when(F.col("n_nationkey") % 3 == 1, "result").otherwise("serp").alias("target"))
    names = ad.query(s, d).select(F.col("id").alias("query"), F.col("query").alias("task"))
    done = ad.answer(s, d).where("status = 1").join(names, "query").select("task")
    return an.expected_runs(tasks, ad.answer(s, d), done)


add("A35_classifier_progress", _runs, ad.with_views("answer", f"""
WITH n AS (SELECT kind, count(*) AS c FROM answer GROUP BY kind), t AS (SELECT n_nationkey, n_name AS task, CASE n_nationkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'result' ELSE 'serp' END AS target FROM nation),
e AS (SELECT n_nationkey, task, CAST(sum(c) AS BIGINT) AS n_expected FROM t JOIN n ON target = 'all' OR target = kind GROUP BY ALL), f AS (SELECT query, count(*) AS c FROM answer WHERE status = 1 GROUP BY query)
SELECT task, n_expected, coalesce(f.c, 0) AS n_done, least(100, {_PCT.format('coalesce(f.c, 0)', 'n_expected')}) AS percent,
  CASE WHEN coalesce(f.c, 0) >= n_expected THEN 'Finished' ELSE 'Progress: ' || coalesce(f.c, 0) || '/' || n_expected END AS status FROM e LEFT JOIN f ON f.query = e.n_nationkey"""))
QUERIES["A44_llm_task_status"], SQL["A44_llm_task_status"] = QUERIES["A35_classifier_progress"], SQL["A35_classifier_progress"]
add("A36_failed_fetches", lambda s, d: an.state_counts(ad.result(s, d), ["engine_text"], {"n_failed": F.col("progress") == -1, "n_final": (F.col("progress") == -1) & (F.col("counter") >= 3)}), ad.with_views("result", "SELECT engine_text, count(*) FILTER (progress = -1) AS n_failed, count(*) FILTER (progress = -1 AND counter >= 3) AS n_final FROM result GROUP BY ALL"))
add("A38_result_types", lambda s, d: ad.answer(s, d).select("kind").union(ad.indicator(s, d).select("kind")).distinct(), ad.with_views("indicator", "SELECT kind FROM answer UNION SELECT kind FROM indicator"))
_SAMP = "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 4 = 1) AS n_done, floor(100.0 * count(*) FILTER (event_id % 4 = 1) / count(*))::BIGINT AS percent FROM events GROUP BY event_type"
add("A39_sampler_progress", lambda s, d: ad.read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 4 == 1).alias("n_done"), F.floor(100.0 * F.count_if(F.col("event_id") % 4 == 1) / F.count(F.lit(1))).cast("long").alias("percent")), _SAMP)
add("A40_sampler_status", lambda s, d: an.state_counts(ad.read(s, d, "events"), ["event_type"], {f"n_state_{k}": F.col("event_id") % 4 == k for k in range(4)}), "SELECT event_type, " + ", ".join(f"count(*) FILTER (event_id % 4 = {k}) AS n_state_{k}" for k in range(4)) + " FROM events GROUP BY event_type")
add("A41_waiting_jobs", lambda s, d: ad.result(s, d).where("progress = 2").select("study").unionAll(ad.answer(s, d).where("status = 0").select("study")).unionAll(ad.indicator(s, d).where("id % 5 = 0").select("study")).agg(F.count(F.lit(1)).alias("n")), ad.with_views("result indicator", "SELECT (SELECT count(*) FROM result WHERE progress = 2) + (SELECT count(*) FROM answer WHERE status = 0) + (SELECT count(*) FROM indicator WHERE id % 5 = 0) AS n"))
add("A43_max_id", lambda s, d: ad.answer(s, d).agg(F.max("participant").alias("max_id")), ad.with_views("answer", "SELECT max(participant) AS max_id FROM answer"))
add("A45_indicators_per_item", lambda s, d: ad.indicator(s, d).groupBy("kind", "item").agg(F.countDistinct("indicator").alias("n")), ad.with_views("indicator", "SELECT kind, item, count(DISTINCT indicator) AS n FROM indicator GROUP BY ALL"))
add("A46_session_progress", lambda s, d: ad.answer(s, d).groupBy("participant").agg(F.count_if(F.col("status") == 1).alias("n_done"), F.count(F.lit(1)).alias("n_all")), ad.with_views("answer", "SELECT participant, count(*) FILTER (status = 1) AS n_done, count(*) AS n_all FROM answer GROUP BY participant"))
add("A47_participant_cockpit", lambda s, d: an.participant_progress(ad.answer(s, d).withColumn("participant", F.struct("participant", "study")), 5, True).select("participant.*", "n_seen", "n_closed", "n_open"), ad.with_views("answer", "SELECT participant, study, count(DISTINCT query) AS n_seen, count(DISTINCT query) FILTER (status <> 0) AS n_closed, count(DISTINCT query) FILTER (status = 0) AS n_open FROM answer GROUP BY participant, study"))
add("A49_study_metadata", lambda s, d: ad.study(s, d).select("id", F.expr("stack(3, 'Name', name, 'Depth', cast(result_count as string), 'Description', 'N/A') as (property, value)")), "SELECT r_regionkey AS id, unnest(['Name', 'Depth', 'Description']) AS property, unnest([r_name, '5', 'N/A']) AS value FROM region")

# predicates and labels
_CASES = "SELECT study, count(*) FILTER ({0}) AS n FROM result GROUP BY study"
for _n, _p, _q in (
    ("P01_scope", lambda: F.col("study") == 2, "study = 2"),
    ("P02_final", lambda: st.is_final(F.col("progress"), F.col("counter")), _FINAL),
    ("P03_retry", lambda: st.is_retry(F.col("progress"), F.col("counter")), "progress = -1 AND counter < 3"),
    ("P04_url_filter", lambda: F.exists(F.array(F.lit("17"), F.lit("42")), lambda x: F.contains(F.col("normalized_url"), x)) & ~F.contains(F.col("normalized_url"), F.lit("9")), "(contains(normalized_url, '17') OR contains(normalized_url, '42')) AND NOT contains(normalized_url, '9')"),
    ("P06_ranges", lambda: st.in_ranges(F.col("position"), [(1, 2), (5, 6)]), "position BETWEEN 1 AND 2 OR position BETWEEN 5 AND 6"),
    ("P07_depth", lambda: st.within_depth(F.col("position"), 5), "position <= 5"),
    ("P08_depth_keeps_null", lambda: st.within_depth(F.when(F.col("position") != 7, F.col("position")), 5, True), "position = 7 OR position <= 5"),
    ("P09_source_gate", lambda: st.assessable(F.col("progress"), False, True), "progress IN (1, -1)"),
    ("P10_filled", lambda: st.filled(F.nullif(F.col("normalized_url"), F.lit("17"))), "normalized_url <> '17'"),
):
    add(_n, lambda s, d, p=_p: ad.result(s, d).groupBy("study").agg(F.count_if(p()).alias("n")), ad.with_views("result", _CASES.format(_q)))
add("P11_has_errors", lambda s, d: ad.classifier_result(s, d).groupBy("kind").agg(F.bool_or(an.has_errors(F.col("value"))).alias("has_errors"), F.count_if(an.has_errors(F.col("value"))).alias("n_errors")), ad.with_views("classifier_result", """
SELECT kind, bool_or(value IN ('error_api', 'error_timeout', 'error_empty', 'error_invalid_json', 'error_no_config', 'error_no_study')) AS has_errors,
  count(*) FILTER (value IN ('error_api', 'error_timeout', 'error_empty', 'error_invalid_json', 'error_no_config', 'error_no_study')) AS n_errors
FROM classifier_result GROUP BY kind"""))
add("P12_dashboard_label", lambda s, d: ad.answer(s, d).groupBy(st.kind_label(F.col("kind"), st.DASHBOARD_LABELS).alias("label")).agg(F.count(F.lit(1)).alias("n")), ad.with_views("answer", f"SELECT {_DASH} AS label, count(*) AS n FROM answer GROUP BY 1"))
add("P13_export_label", lambda s, d: ad.answer(s, d).groupBy(st.kind_label(F.col("kind"), st.EXPORT_LABELS).alias("label")).agg(F.count(F.lit(1)).alias("n")), ad.with_views("answer", f"SELECT {_EXP} AS label, count(*) AS n FROM answer GROUP BY 1"))
_FKS = lambda: [F.when(F.col("kind") == k, F.col("item")) for k in ad.KINDS]
add("P14_polymorphic_id", lambda s, d: ad.answer(s, d).select("id", F.coalesce(*_FKS()).alias("item")), ad.with_views("answer", "SELECT id, item FROM answer"))
add("P15_answer_label", lambda s, d: ad.answer(s, d).select("id", st.answer_label(F.when(F.col("id") % 2 == 0, "likert_scale").otherwise("short_text"), F.when(F.col("value") != "3", F.concat(F.lit("option "), F.col("value"))), F.col("value")).alias("label")), ad.with_views("answer", "SELECT id, CASE WHEN id % 2 = 0 THEN coalesce(CASE WHEN value <> '3' THEN 'option ' || value END, value) ELSE value END AS label FROM answer"))
add("P16_url_coalesce", lambda s, d: ad.result(s, d).select("item", "position", F.coalesce(F.when(F.col("progress") == 1, F.col("main")), F.col("normalized_url")).alias("url")), ad.with_views("result", "SELECT item, position, CASE WHEN progress = 1 THEN main ELSE normalized_url END AS url FROM result"))
add("P17_available_sheets", lambda s, d: an.available({"results": ad.result(s, d), "answers": ad.answer(s, d), "nothing": ad.answer(s, d).where("status = 9")}), ad.with_views("result answer", "SELECT 'results' AS sheet, count(*) > 0 AS available FROM result UNION ALL SELECT 'answers', count(*) > 0 FROM answer UNION ALL SELECT 'nothing', count(*) > 0 FROM answer WHERE status = 9"))
add("P18_visible_studies", lambda s, d: ad.study(s, d).join(ad.query(s, d).where("id % 7 = 3").select(F.col("study").alias("id")), "id", "left_semi"), ad.with_views("study query", "SELECT * FROM study WHERE id IN (SELECT study FROM query WHERE id % 7 = 3)"))
add("P19_engine_name", lambda s, d: ad.result(s, d).select("engine_text").distinct().select("engine_text", st.engine_name(F.col("engine_text")).alias("name")), ad.with_views("result", f"SELECT DISTINCT engine_text, {_ENGINE.format('engine_text')} AS name FROM result"))
add("P20_slug", lambda s, d: ad.read(s, d, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug")), "SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-') AS slug FROM part")
add("P21_file_name", lambda s, d: ad.read(s, d, "part").select("p_partkey", tx.file_name(F.col("p_name")).alias("name")), "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM part")
add("P25_fetch_outcome", lambda s, d: ad.result(s, d).groupBy(st.fetch_outcome(F.when(F.col("progress") == -1, 404).otherwise(200), F.when(F.col("counter") == 2, "error").otherwise("html"), F.col("main"), F.when(F.col("counter") == 4, "Timed out")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")), ad.with_views("result", "SELECT CASE WHEN progress = -1 OR counter IN (2, 4) THEN -1 ELSE 1 END AS outcome, count(*) AS n FROM result GROUP BY 1"))
add("P26_composite_id", lambda s, d: ad.answer(s, d).select("id", st.composite_id(F.col("kind"), F.col("item")).alias("cid")).select("id", "cid", st.parse_composite(F.when(F.col("id") % 2 == 0, F.col("cid")).otherwise("77"))["kind"].alias("kind")), ad.with_views("answer", "SELECT id, kind || ':' || item AS cid, CASE WHEN id % 2 = 0 THEN kind ELSE 'result' END AS kind FROM answer"))
_NOW = lambda: F.to_timestamp(F.lit("2024-07-01 00:00:00"))
_QNOW = "TIMESTAMP '2024-07-01 00:00:00'"
add("P27_expired_leases", lambda s, d: ad.result(s, d).where(st.lease_expired(F.col("progress"), F.col("counter"), F.when(F.col("counter") == 1, "me").when(F.col("counter") == 2, "you"), F.col("created_at"), _NOW(), "me")).groupBy("study").agg(F.count(F.lit(1)).alias("n")), ad.with_views("result", f"SELECT study, count(*) AS n FROM result WHERE progress IN (2, -1) AND counter < 3 AND counter <> 2 AND created_at < {_QNOW} - INTERVAL 10 MINUTE GROUP BY study"))
add("P28_lost_leases", lambda s, d: ad.result(s, d).where(st.lease_lost(F.col("progress"), F.col("counter"), F.col("created_at"), _NOW())).groupBy("study").agg(F.count(F.lit(1)).alias("n")), ad.with_views("result", f"SELECT study, count(*) AS n FROM result WHERE counter >= 3 AND (progress = -1 OR (progress IN (0, 2) AND created_at < {_QNOW} - INTERVAL 10 MINUTE)) GROUP BY study"))
add("P29_required_answers", lambda s, d: ad.answer(s, d).where(~F.col("question").isin("click", "view") & (F.col("value") == "0")).select("id"), ad.with_views("answer", "SELECT id FROM answer WHERE question NOT IN ('click', 'view') AND value = '0'"))
add("P30_task_targets", lambda s, d: ad.answer(s, d).groupBy("kind").agg(F.sum(tx.active_tasks(F.lit('[{"name":"a"},{"name":"b","target_type":"serp"},{"name":"c","active":false},{"name":"d","target_type":"all"}]'), "serp")).alias("n")), ad.with_views("answer", "SELECT kind, count(*) * 3 AS n FROM answer GROUP BY kind"))
add("P31_allowed_kinds", lambda s, d: ad.answer(s, d).join(s.createDataFrame([(" Result ",), ("SERP",)], "name string").select(F.lower(F.trim("name")).alias("kind")), "kind", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n")), ad.with_views("answer", "SELECT kind, count(*) AS n FROM answer WHERE kind IN ('result', 'serp') GROUP BY kind"))
add("P32_deletable_queries", lambda s, d: ad.query(s, d).join(ad.answer(s, d).where("status = 1 and value = '6'").select(F.col("query").alias("id")), "id", "left_anti").join(ad.result(s, d).where("position = 7 and counter = 0").select(F.col("query").alias("id")), "id", "left_anti"), ad.with_views("query answer result", "SELECT * FROM query WHERE id NOT IN (SELECT query FROM answer WHERE status = 1 AND value = '6') AND id NOT IN (SELECT query FROM result WHERE position = 7 AND counter = 0)"))
