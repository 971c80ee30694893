"""Registered queries of joins, windows, sets, sorts, upserts and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import states as st
from ..functions import text as tx
from ..operators import relations as rl
from . import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


v = ad.with_views
n_rows = lambda: F.count(F.lit(1)).alias("n")
R, A, I, Q, S, C = ad.result, ad.answer, ad.indicator, ad.query, ad.study, ad.classifier_result  # noqa: E741

add("J01_result_sources", lambda s, d: R(s, d).groupBy("study", "progress").agg(n_rows()), v("result", "SELECT study, progress, count(*) AS n FROM result GROUP BY ALL"))
add("J02_answer_dimensions", lambda s, d: A(s, d).join(Q(s, d).select(F.col("id").alias("query"), F.col("query").alias("query_text")), "query").join(S(s, d).select(F.col("id").alias("study"), "name"), "study", "left").select("id", "query_text", "name", "value"), v("answer query study", "SELECT a.id, q.query AS query_text, s.name, a.value FROM answer a JOIN query q ON q.id = a.query LEFT JOIN study s ON s.id = a.study"))


def _spine(s, d):
    a = A(s, d)
    return rl.item_spine({k: a.where(F.col("kind") == k).select("item", "study", "query").distinct() for k in ad.KINDS})


_SPINE = "spine AS (SELECT DISTINCT kind, item, study, query FROM answer)"
add("J03_indicator_items", lambda s, d: I(s, d).drop("query", "study").join(_spine(s, d), ["kind", "item"], "left").groupBy("kind", "study").agg(n_rows()), v("indicator", f"WITH {_SPINE} SELECT i.kind, s.study, count(*) AS n FROM indicator i LEFT JOIN spine s ON s.kind = i.kind AND s.item = i.item GROUP BY ALL"))
add("J04_export_study_scope", lambda s, d: I(s, d).where(F.col("study").isin(1, 2)).select("id", st.kind_label(F.col("kind"), st.EXPORT_LABELS).alias("item_type"), "indicator", tx.truncated(F.col("value")).alias("value")), v("indicator", "SELECT id, CASE kind WHEN 'result' THEN 'Organic Result' WHEN 'result_ai' THEN 'AI Overview' WHEN 'serp' THEN 'Unknown' ELSE 'Image Result' END AS item_type, indicator, value FROM indicator WHERE study IN (1, 2)"))
add("J05_criteria", lambda s, d: ad.read(s, d, "supplier").join(ad.read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(ad.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(n_rows()), "SELECT r_name, n_name, count(*) AS n FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ALL")
add("J06_exists_any", lambda s, d: rl.in_any(Q(s, d).withColumnRenamed("id", "key"), "key", [A(s, d).where("item = 5").select(F.col("query").alias("key")), R(s, d).where("position = 7 and counter = 3").select(F.col("query").alias("key"))]), v("query answer result", "SELECT id AS key, study, query FROM query q WHERE EXISTS (SELECT 1 FROM answer a WHERE a.query = q.id AND item = 5) OR EXISTS (SELECT 1 FROM result r WHERE r.query = q.id AND position = 7 AND counter = 3)"))
add("J07_not_exists", lambda s, d: R(s, d).select("item").distinct().join(A(s, d).select("item"), "item", "left_anti"), v("result answer", "SELECT DISTINCT item FROM result r WHERE NOT EXISTS (SELECT 1 FROM answer a WHERE a.item = r.item)"))
_TOL = lambda s, d: A(s, d).select(F.when(F.col("id") % 2 == 0, F.col("query") + F.when(F.col("query") % 4 == 1, 0).otherwise(1000)).alias("query"), F.when(F.col("id") % 2 > 0, F.concat("kind", F.when(F.col("kind") == "result_ai", "").otherwise(" (old)"))).alias("kind"))
add("J08_null_tolerant_anti", lambda s, d: rl.null_tolerant_anti(A(s, d).select("id", "query", "kind"), _TOL(s, d), ["query", "kind"]), v("answer", "SELECT id, query, kind FROM answer a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN query + CASE WHEN query % 4 = 1 THEN 0 ELSE 1000 END END AS query, CASE WHEN id % 2 > 0 THEN kind || CASE WHEN kind = 'result_ai' THEN '' ELSE ' (old)' END END AS kind FROM answer) t WHERE (t.query = a.query OR t.query IS NULL) AND (t.kind = a.kind OR t.kind IS NULL))"))
add("J09_in_subquery", lambda s, d: R(s, d).join(S(s, d).where("name like 'A%'").select(F.col("id").alias("study")), "study", "left_semi").groupBy("study").agg(n_rows()), v("result study", "SELECT study, count(*) AS n FROM result WHERE study IN (SELECT id FROM study WHERE name LIKE 'A%') GROUP BY study"))
add("J10_not_seen", lambda s, d: Q(s, d).join(A(s, d).where("participant = 7").select(F.col("query").alias("id")), "id", "left_anti"), v("query answer", "SELECT * FROM query WHERE id NOT IN (SELECT query FROM answer WHERE participant = 7)"))
add("J11_scalar_count", lambda s, d: R(s, d).select("item").distinct().join(A(s, d).groupBy("item").agg(F.count(F.lit(1)).alias("c")), "item", "left").where(F.coalesce("c", F.lit(0)) < 3).select("item"), v("result answer", "SELECT DISTINCT item FROM result r WHERE (SELECT count(*) FROM answer a WHERE a.item = r.item) < 3"))
_FIRSTQ = lambda s, d: Q(s, d).agg(F.min_by("query", "id").alias("first_query"))
add("J12_query_fallback", lambda s, d: A(s, d).withColumn("query", F.when(F.col("id") % 5 != 0, F.col("query"))).join(Q(s, d).select(F.col("id").alias("query"), F.col("query").alias("text")), "query", "left").crossJoin(_FIRSTQ(s, d)).select("id", F.coalesce("text", "first_query").alias("text")), v("answer query", "SELECT a.id, coalesce(q.query, (SELECT query FROM query ORDER BY id LIMIT 1)) AS text FROM answer a LEFT JOIN query q ON q.id = a.query AND a.id % 5 <> 0"))
QUERIES["J26_serp_registry"], SQL["J26_serp_registry"] = QUERIES["J12_query_fallback"], SQL["J12_query_fallback"]
add("J13_items_per_query", lambda s, d: _spine(s, d).groupBy("query").agg(n_rows()), v("answer", f"WITH {_SPINE} SELECT query, count(*) AS n FROM spine GROUP BY query"))
_EDGES = lambda s, d: R(s, d).select(F.concat_ws("-", "query", "item").alias("segment"), F.col("main").alias("source"))
add("J14_first_of_bridge", lambda s, d: rl.first_per_key(_EDGES(s, d), ["segment"], ["source"]), v("result", "SELECT query || '-' || item AS segment, min(main) AS source FROM result GROUP BY 1"))
add("J15_siblings", lambda s, d: rl.siblings(_EDGES(s, d)), v("result", "WITH e AS (SELECT DISTINCT query || '-' || item AS segment, main AS source FROM result) SELECT a.source AS x, count(DISTINCT b.source) AS n_siblings FROM e a JOIN e b ON a.segment = b.segment AND a.source <> b.source GROUP BY 1"))
add("J16_duplicate_results", lambda s, d: rl.duplicate_groups(R(s, d), ["query", "normalized_url"]), v("result", "SELECT query, normalized_url, count(*) AS n, min(item) AS first_item FROM result GROUP BY query, normalized_url HAVING count(*) > 1"))
_OPT = lambda s: s.range(7).select(F.col("id").cast("string").alias("value"), F.concat(F.lit("option "), F.col("id").cast("string")).alias("label"))
add("J17_option_labels", lambda s, d: A(s, d).join(_OPT(s).crossJoin(A(s, d).select("question").distinct().where("question <> 'click'")), ["question", "value"], "left").select("id", F.coalesce("label", "value").alias("label")), v("answer", "SELECT id, CASE WHEN question <> 'click' THEN 'option ' || value ELSE value END AS label FROM answer"))
_HOSTS = ("1", "23", "77")
add("J18_host_lists", lambda s, d: R(s, d).select("main").distinct().select("main", F.exists(F.array(*[F.lit(f"s{h}.") for h in _HOSTS]), lambda h: F.contains(F.col("main"), h)).alias("listed")), v("result", "SELECT DISTINCT main, " + " OR ".join(f"contains(main, 's{h}.')" for h in _HOSTS) + " AS listed FROM result"))
add("J20_query_engine_grid", lambda s, d: Q(s, d).select("id").crossJoin(R(s, d).select("engine_text").distinct()), v("query result", "SELECT id, engine_text FROM query, (SELECT DISTINCT engine_text FROM result)"))
add("J21_engine_pairs", lambda s, d: R(s, d).select(F.col("engine_text").alias("a")).distinct().join(R(s, d).select(F.col("engine_text").alias("b")).distinct(), F.col("a") < F.col("b")), v("result", "WITH e AS (SELECT DISTINCT engine_text FROM result) SELECT a.engine_text AS a, b.engine_text AS b FROM e a JOIN e b ON a.engine_text < b.engine_text"))
_NOW = lambda: F.to_timestamp(F.lit("1998-01-01 00:00:00"))
_LATEST = "l AS (SELECT *, row_number() OVER (PARTITION BY normalized_url, study ORDER BY created_at DESC, item, position) AS rn FROM result WHERE progress = 1)"
add("J22_reusable_source", lambda s, d: rl.reusable_sources(R(s, d).select("normalized_url", "study").distinct(), R(s, d).where("progress = 1"), ["normalized_url", "study"], _NOW(), 24 * 200).select("normalized_url", "study", "created_at"), v("result", f"WITH {_LATEST} SELECT normalized_url, study, created_at FROM l WHERE rn = 1 AND created_at BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 200 DAY AND TIMESTAMP '1998-01-01'"))
add("J23_copied_content", lambda s, d: R(s, d).where("progress = 2").select("item", "normalized_url", "study").distinct().join(rl.latest(R(s, d).where("progress = 1"), ["normalized_url", "study"], "created_at", "item", "position").select("normalized_url", "study", "main"), ["normalized_url", "study"]), v("result", f"WITH {_LATEST} SELECT DISTINCT r.item, r.normalized_url, r.study, l.main FROM result r JOIN l ON l.rn = 1 AND l.normalized_url = r.normalized_url AND l.study = r.study WHERE r.progress = 2"))
add("J24_expected_keys", lambda s, d: I(s, d).select("id", tx.expected_entries(F.col("value"), tx.prompt_keys(F.lit('Answer {"K": 1, "other" : 2}'))).alias("m")).select("id", F.col("m")["k"].alias("k")), v("indicator", "SELECT id, json_extract_string(value, '$.k') AS k FROM indicator"))
add("J25_citation_match", lambda s, d: ad.read(s, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")).groupBy(F.regexp_replace("host", r"^(www|m)\.", "").alias("key")).agg(n_rows(), F.min("page_id").alias("first")), "SELECT regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^(www|m)\\.', '') AS key, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1")
_WIDE = lambda s, d: A(s, d).withColumn("query", F.when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.col("query")))
_TEXTS = lambda s, d: Q(s, d).select(F.col("id").alias("query"), F.col("query").alias("text"))


def _export_joins(s, d):
    """Overviews only with their query; organic and image results also without."""
    a = _WIDE(s, d)
    parts = [a.where(F.col("kind") == k).join(_TEXTS(s, d), "query", how).select("id", "kind", "text") for k, how in (("result_ai", "inner"), ("result", "left"), ("result_image", "left"))]
    return reduce(DataFrame.unionByName, parts)


add("J27_export_joins", _export_joins, v("answer query", "SELECT a.id, kind, q.query AS text FROM answer a JOIN query q ON q.id = a.query AND a.id % 6 <> 1 WHERE kind = 'result_ai' UNION ALL SELECT a.id, kind, q.query FROM answer a LEFT JOIN query q ON q.id = a.query AND a.id % 6 <> 1 WHERE kind IN ('result', 'result_image')"))
add("J28_engine_lookup", lambda s, d: I(s, d).join(R(s, d).groupBy("item").agg(F.min("engine_text").alias("engine_text")).withColumn("kind", F.lit("result")), ["kind", "item"], "left").select("id", F.coalesce("engine_text", F.lit("N/A")).alias("engine")), v("indicator result", "SELECT i.id, coalesce(r.e, 'N/A') AS engine FROM indicator i LEFT JOIN (SELECT item, min(engine_text) AS e FROM result GROUP BY item) r ON i.kind = 'result' AND r.item = i.item"))

# windows
add("W01_fair_queue", lambda s, d: rl.fair_queue(A(s, d).where("status = 0"), "study", ["id"], 20).select("id", "study", "turn"), v("answer", "WITH r AS (SELECT id, study, row_number() OVER (PARTITION BY study ORDER BY id) AS turn FROM answer WHERE status = 0) SELECT * FROM r ORDER BY turn, study DESC, id LIMIT 20"))
add("W02_first_classifier_row", lambda s, d: rl.first_per_key(I(s, d), ["kind", "item", "indicator"], ["id"]).select("kind", "item", "indicator", "id"), v("indicator", "SELECT kind, item, indicator, min(id) AS id FROM indicator GROUP BY ALL"))
add("W03_latest_answer", lambda s, d: rl.latest(A(s, d), ["participant", "question"], "created_at", "id").select("participant", "question", "id"), v("answer", "SELECT participant, question, id FROM (SELECT *, row_number() OVER (PARTITION BY participant, question ORDER BY created_at DESC, id) AS rn FROM answer) WHERE rn = 1"))
add("W04_least_assigned_queries", lambda s, d: rl.least_assigned(A(s, d).groupBy("study", "query").agg(F.countDistinct("participant").alias("n")), "query", 3).select("study", "rank", "n"), v("answer", "SELECT study, row_number() OVER (PARTITION BY study ORDER BY n) AS rank, n FROM (SELECT study, query, count(DISTINCT participant) AS n FROM answer GROUP BY ALL)"))
add("W05_least_assigned_items", lambda s, d: rl.least_assigned(A(s, d).groupBy("study", "item").agg(F.count(F.lit(1)).alias("n")), "item", 3).select("study", "rank", "n"), v("answer", "SELECT study, row_number() OVER (PARTITION BY study ORDER BY n) AS rank, n FROM (SELECT study, item, count(*) AS n FROM answer GROUP BY ALL)"))
add("W06_balanced_quota", lambda s, d: rl.balanced_quota(A(s, d), 8, 1).groupBy("study", "kind").agg(n_rows()), v("answer", "SELECT DISTINCT study, kind, CAST(2 AS BIGINT) AS n FROM answer"))
add("W07_running_rank", lambda s, d: rl.running_rank(R(s, d).select("query", "engine_text", "position", "item", "normalized_url").distinct(), ["query", "engine_text"], "position", ["item", "normalized_url"]).select("query", "engine_text", "item", "normalized_url", "position", "rank"), v("result", "SELECT query, engine_text, item, normalized_url, position, row_number() OVER (PARTITION BY query, engine_text ORDER BY position, item, normalized_url) AS rank FROM (SELECT DISTINCT query, engine_text, position, item, normalized_url FROM result)"))
add("W08_cap_in_priority", lambda s, d: rl.cap_in_priority(R(s, d), F.col("position"), 5, ["query"], ["position", "item"]).select("query", "normalized_url", "position", "rank"), v("result", "WITH o AS (SELECT query, normalized_url, position, item, row_number() OVER (PARTITION BY query, normalized_url ORDER BY position, item) AS k FROM result), r AS (SELECT query, normalized_url, position, row_number() OVER (PARTITION BY query ORDER BY position, item, normalized_url) AS rank FROM o WHERE k = 1) SELECT * FROM r WHERE rank <= 5"))
add("W10_next_open_answer", lambda s, d: A(s, d).where("status = 0").groupBy("participant").agg(F.min("id").alias("id")), v("answer", "SELECT participant, min(id) AS id FROM answer WHERE status = 0 GROUP BY participant"))
add("C16_balanced_assignment", lambda s, d: rl.assign(A(s, d), A(s, d), 5, 1).groupBy("study", "participant").agg(F.countDistinct("item").alias("n_items")), v("answer", "SELECT DISTINCT study, participant, CAST(least(5, (SELECT count(DISTINCT item) FROM answer b WHERE b.study = a.study)) AS BIGINT) AS n_items FROM answer a"))
add("A42_allocation_spread", lambda s, d: rl.allocation_spread(rl.assign(A(s, d), A(s, d), 5, 1)).select("study", (F.col("range") <= 1).alias("even")), v("answer", "SELECT DISTINCT study, true AS even FROM answer"))

# sorts and pages
for _n, _o, _q in (
    ("O01_two_keys", lambda: [F.asc_nulls_last("question"), F.asc_nulls_last("id")], "question NULLS LAST, id NULLS LAST"),
    ("O03_three_keys", lambda: [F.asc("kind"), F.asc("question"), F.asc("id")], "kind, question, id"),
):
    add(_n, lambda s, d, o=_o: A(s, d).orderBy(*o()).select("id", "question"), v("answer", f"SELECT id, question FROM answer ORDER BY {_q}"))
for _n, _o, _q in (
    ("O07_paging", lambda: [F.asc("id")], "id"),
    ("O08_newest_first", lambda: [F.desc("created_at"), F.asc("id")], "created_at DESC, id"),
):
    add(_n, lambda s, d, o=_o: rl.page_of(A(s, d), o(), 3).select("id", "question"), v("answer", f"SELECT id, question FROM answer ORDER BY {_q} LIMIT 10 OFFSET 20"))
add("O02_registry_order", lambda s, d: R(s, d).select("query", "position", "engine_text").distinct().orderBy("query", "position", "engine_text"), v("result", "SELECT DISTINCT query, position, engine_text FROM result ORDER BY ALL"))
add("O04_top_k", lambda s, d: R(s, d).groupBy("main").agg(n_rows()).orderBy(F.desc("n"), "main").limit(25), v("result", "SELECT main, count(*) AS n FROM result GROUP BY main ORDER BY n DESC, main LIMIT 25"))
add("O05_ordered_batch", lambda s, d: reduce(DataFrame.union, [A(s, d).where((F.col("kind") == k) & (F.col("status") == 0)).orderBy("id").limit(10).select("id", "kind") for k in ad.KINDS]).orderBy("id").limit(10), v("answer", "SELECT id, kind FROM answer WHERE status = 0 ORDER BY id LIMIT 10"))
add("O06_seeded_order", lambda s, d: Q(s, d).orderBy(F.xxhash64(F.lit(5), "id")).select("id"), v("query", "SELECT id FROM query"))
add("O09_first_five", lambda s, d: Q(s, d).orderBy("id").limit(5), v("query", "SELECT * FROM query ORDER BY id LIMIT 5"))
add("O10_by_percent", lambda s, d: A(s, d).groupBy("query").agg((100.0 * F.count_if(F.col("status") == 1) / F.count(F.lit(1))).alias("pct")).orderBy("pct", "query"), v("answer", "SELECT query, 100.0 * count(*) FILTER (status = 1) / count(*) AS pct FROM answer GROUP BY query ORDER BY pct, query"))
add("O11_by_count", lambda s, d: A(s, d).groupBy("value").agg(n_rows()).orderBy(F.desc("n"), "value"), v("answer", "SELECT value, count(*) AS n FROM answer GROUP BY value"))
add("O12_first_by_kind", lambda s, d: rl.first_per_key(A(s, d).where("status = 0").withColumn("_k", F.array_position(F.array(*[F.lit(k) for k in ad.KINDS]), F.col("kind"))), ["participant"], ["_k", "id"]).select("participant", "kind", "id"), v("answer", "SELECT participant, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY CASE kind WHEN 'result' THEN 1 WHEN 'result_ai' THEN 2 WHEN 'serp' THEN 3 ELSE 4 END, id) AS rn FROM answer WHERE status = 0) WHERE rn = 1"))

# sets
add("U01_union_of_kinds", lambda s, d: reduce(DataFrame.unionByName, [A(s, d).where(F.col("kind") == k).select("id", F.lit(k).alias("kind")) for k in ad.KINDS]), v("answer", "SELECT id, kind FROM answer"))
add("U02_pending_items", lambda s, d: A(s, d).where("status = 0").select("kind", "item").unionByName(I(s, d).where("id % 5 = 0").select("kind", "item")), v("indicator", "SELECT kind, item FROM answer WHERE status = 0 UNION ALL SELECT kind, item FROM indicator WHERE id % 5 = 0"))
add("U03_leases", lambda s, d: R(s, d).where("progress = 2").select("item", F.lit("result").alias("kind")).unionByName(A(s, d).where("status = 0").select("item", "kind")).groupBy("kind").agg(n_rows()), v("result answer", "SELECT kind, count(*) AS n FROM (SELECT 'result' AS kind FROM result WHERE progress = 2 UNION ALL SELECT kind FROM answer WHERE status = 0) GROUP BY kind"))
add("U04_row_dedup", lambda s, d: R(s, d).select("query", "main", "position").dropDuplicates(), v("result", "SELECT DISTINCT query, main, position FROM result"))


def _set_sizes(s, d):
    g = R(s, d).groupBy("query").agg(F.collect_set(F.when(F.col("engine_text") == "a_xx_f", F.col("position"))).alias("a"), F.collect_set(F.when(F.col("engine_text") == "n_xx_o", F.col("position"))).alias("b"))
    return g.select("query", F.size(F.array_except("a", "b")).cast("long").alias("only_a"), F.size(F.array_intersect("a", "b")).cast("long").alias("both"), F.size(F.array_union("a", "b")).cast("long").alias("either"))


add("U05_set_sizes", _set_sizes, v("result", "WITH a AS (SELECT DISTINCT query, position, engine_text = 'a_xx_f' AS in_a, engine_text = 'n_xx_o' AS in_b FROM result), g AS (SELECT query, position, bool_or(in_a) AS x, bool_or(in_b) AS y FROM a GROUP BY ALL) SELECT query, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (x AND y) AS both, count(*) FILTER (x OR y) AS either FROM g GROUP BY query"))
add("U06_distinct_engines", lambda s, d: R(s, d).select("query", "engine_text").distinct(), v("result", "SELECT DISTINCT query, engine_text FROM result"))
add("U07_distinct_keywords", lambda s, d: ad.read(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct(), "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part")
add("U09_removed_tasks", lambda s, d: I(s, d).select("indicator").distinct().join(I(s, d).where("id % 2 = 0 and indicator <> 'LLM_click'").select("indicator"), "indicator", "left_anti"), v("indicator", "SELECT DISTINCT indicator FROM indicator WHERE indicator NOT IN (SELECT indicator FROM indicator WHERE id % 2 = 0 AND indicator <> 'LLM_click')"))
add("U10_orphans", lambda s, d: ad.read(s, d, "pages").select(F.lower("url").alias("path")).where("path not like '%/.%'").distinct().join(ad.read(s, d, "pages").where("page_id % 3 > 0").select(F.lower("url").alias("path")), "path", "left_anti"), "SELECT DISTINCT lower(url) AS path FROM pages WHERE lower(url) NOT LIKE '%/.%' AND lower(url) NOT IN (SELECT lower(url) FROM pages WHERE page_id % 3 > 0)")

# writes as whole frames
_OLD = lambda s, d: C(s, d).select("item", "classifier", "value")
_NEW = lambda s, d: C(s, d).where("item % 3 = 0").select(F.when(F.col("item") % 2 == 0, F.col("item")).otherwise(F.col("item") + 1000000).alias("item"), "classifier", F.lit("new").alias("value"))
_UP = "WITH old AS (SELECT item, classifier, value FROM classifier_result), new AS (SELECT CASE WHEN item % 2 = 0 THEN item ELSE item + 1000000 END AS item, classifier, 'new' AS value FROM classifier_result WHERE item % 3 = 0) "
add("D01_upsert_in_states", lambda s, d: rl.upsert(_OLD(s, d), _NEW(s, d), ["item", "classifier"], F.col("value").isin("in process", "error")), v("classifier_result", _UP + "SELECT o.item, o.classifier, CASE WHEN n.item IS NOT NULL AND o.value IN ('in process', 'error') THEN 'new' ELSE o.value END AS value FROM old o LEFT JOIN new n ON n.item = o.item UNION ALL SELECT * FROM new WHERE item NOT IN (SELECT item FROM old)"))
add("D02_upsert_indicator", lambda s, d: rl.upsert(_OLD(s, d), _NEW(s, d), ["item", "classifier"]), v("classifier_result", _UP + "SELECT * FROM old WHERE item NOT IN (SELECT item FROM new) UNION ALL SELECT * FROM new"))
QUERIES["D03_update_or_insert"], SQL["D03_update_or_insert"] = QUERIES["D02_upsert_indicator"], SQL["D02_upsert_indicator"]
add("D04_cascade_delete", lambda s, d: rl.cascade({"answer": (A(s, d), "study")}, S(s, d).where("id in (1, 3)"), "id")["answer"].groupBy("study").agg(n_rows()), v("answer", "SELECT study, count(*) AS n FROM answer WHERE study NOT IN (1, 3) GROUP BY study"))
add("D05_delete_participant", lambda s, d: A(s, d).join(A(s, d).where("participant % 10 = 3").select("participant").distinct(), "participant", "left_anti").select("id"), v("answer", "SELECT id FROM answer WHERE participant % 10 <> 3"))
add("D06_lease_update", lambda s, d: R(s, d).select("study", F.when(st.lease_expired(F.col("progress"), F.col("counter"), F.lit(None).cast("string"), F.col("created_at"), F.to_timestamp(F.lit("2030-01-01 00:00:00")), "me"), 0).otherwise(F.col("progress")).alias("progress")).groupBy("study", "progress").agg(n_rows()), v("result", "SELECT study, CASE WHEN progress IN (2, -1) AND counter < 3 THEN 0 ELSE progress END AS progress, count(*) AS n FROM result GROUP BY ALL"))
add("D07_answer_write", lambda s, d: A(s, d).withColumn("status", F.when((F.col("participant") == 7) & (F.col("status") == 0), 1).otherwise(F.col("status"))).groupBy("status").agg(n_rows()), v("answer", "SELECT CASE WHEN participant = 7 AND status = 0 THEN 1 ELSE status END AS status, count(*) AS n FROM answer GROUP BY 1"))
add("D08_replace_settings", lambda s, d: Q(s, d).where("study <> 2").unionByName(Q(s, d).where("study = 2").withColumn("query", F.lower("query"))), v("query", "SELECT id, study, CASE WHEN study = 2 THEN lower(query) ELSE query END AS query FROM query"))
add("D09_point_lookup", lambda s, d: I(s, d).where("kind = 'serp' and item = 12").groupBy("indicator").agg(n_rows()), v("indicator", "SELECT indicator, count(*) AS n FROM indicator WHERE kind = 'serp' AND item = 12 GROUP BY indicator"))
add("D10_merge_json", lambda s, d: I(s, d).select("id", F.get_json_object(rl.merge_json(F.col("value"), F.lit("study"), F.col("study").cast("string")), "$.study").alias("study"), F.get_json_object(rl.merge_json(F.col("value"), F.lit("study"), F.lit("x")), "$.k").alias("k")), v("indicator", "SELECT id, CAST(study AS VARCHAR) AS study, json_extract_string(value, '$.k') AS k FROM indicator"))
add("D11_archive_study", lambda s, d: S(s, d).select("id", "name", F.when(F.col("id") == 2, 4).otherwise(1).alias("status")), v("study", "SELECT id, name, CASE WHEN id = 2 THEN 4 ELSE 1 END AS status FROM study"))
add("C08_duplicate_propagation", lambda s, d: rl.propagate(A(s, d).select("id", "kind", "item", F.when(F.col("status") == 1, F.col("value")).alias("value")), ["kind", "item"], "value").select("id", "value"), v("answer", "SELECT id, coalesce(CASE WHEN status = 1 THEN value END, min(CASE WHEN status = 1 THEN value END) OVER (PARTITION BY kind, item)) AS value FROM answer"))
QUERIES["C09_llm_propagation"], SQL["C09_llm_propagation"] = QUERIES["C08_duplicate_propagation"], SQL["C08_duplicate_propagation"]
QUERIES["C17_answer_propagation"], SQL["C17_answer_propagation"] = QUERIES["C08_duplicate_propagation"], SQL["C08_duplicate_propagation"]
add("C10_dead_sources", lambda s, d: rl.dead_sources(R(s, d).where("progress = -1"), A(s, d), ["item"]), v("result answer", "SELECT DISTINCT item, 'source_failed' AS value FROM result WHERE progress = -1 AND item NOT IN (SELECT item FROM answer)"))
add("C11_pending_work", lambda s, d: _spine(s, d).join(I(s, d).where("id % 2 = 0").select("kind", "item"), ["kind", "item"], "left_anti").groupBy("study").agg(n_rows()), v("indicator", f"WITH {_SPINE} SELECT study, count(*) AS n FROM spine s WHERE NOT EXISTS (SELECT 1 FROM indicator i WHERE i.id % 2 = 0 AND i.kind = s.kind AND i.item = s.item) GROUP BY study"))
add("C12_pending_batch", lambda s, d: _spine(s, d).where(F.col("kind").isin("result", "serp")).join(I(s, d).where("id % 2 = 0").select("kind", "item"), ["kind", "item"], "left_anti").orderBy("kind", "item", "study", "query").limit(10), v("indicator", f"WITH {_SPINE} SELECT * FROM spine s WHERE kind IN ('result', 'serp') AND NOT EXISTS (SELECT 1 FROM indicator i WHERE i.id % 2 = 0 AND i.kind = s.kind AND i.item = s.item) ORDER BY kind, item, study, query LIMIT 10"))
add("C14_error_reset", lambda s, d: C(s, d).where(~F.col("value").isin("error", "source_failed")).select("item", "value"), v("classifier_result", "SELECT item, value FROM classifier_result WHERE value NOT IN ('error', 'source_failed')"))
add("C15_task_states", lambda s, d: R(s, d).select(F.when((F.col("progress") == -1) & (F.col("counter") < 3), "retry").when(F.col("progress") == -1, "failed").when(F.col("progress") == 2, "running").otherwise("done").alias("state"), st.backoff_minutes(F.col("counter")).alias("wait")).groupBy("state", "wait").agg(n_rows()), v("result", "SELECT CASE WHEN progress = -1 AND counter < 3 THEN 'retry' WHEN progress = -1 THEN 'failed' WHEN progress = 2 THEN 'running' ELSE 'done' END AS state, CASE WHEN counter = 0 THEN 5 WHEN counter = 1 THEN 15 WHEN counter = 2 THEN 30 ELSE 60 END AS wait, count(*) AS n FROM result GROUP BY ALL"))

# exports and imports over the tables
add("S13_preview", lambda s, d: reduce(DataFrame.unionByName, [A(s, d).where(F.col("kind") == k).orderBy("id").limit(n).select("id", "kind") for k, n in (("result", 5), ("result_ai", 3), ("serp", 3), ("result_image", 3))]), v("answer", "WITH r AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM answer) SELECT id, kind FROM r WHERE rn <= CASE WHEN kind = 'result' THEN 5 ELSE 3 END"))
add("S05_type_router", lambda s, d: A(s, d).groupBy(F.when(F.col("kind").isin("result", "result_ai"), F.col("kind")).otherwise("ignored").alias("route")).agg(n_rows()), v("answer", "SELECT CASE WHEN kind IN ('result', 'result_ai') THEN kind ELSE 'ignored' END AS route, count(*) AS n FROM answer GROUP BY 1"))
for _n, _k in (("S06_insert_organic", ["study", "query", "position", "engine_text"]), ("S07_insert_overview", ["study", "query", "engine_text"]), ("S10_insert_image", ["study", "query", "normalized_url", "engine_text"])):
    add(_n, lambda s, d, k=_k: rl.insert_absent(R(s, d).where("item % 2 = 0"), R(s, d).where("item % 2 = 1"), k, ["item", "position", "normalized_url"]).select(*k), v("result", f"SELECT DISTINCT {', '.join(_k)} FROM result WHERE item % 2 = 1 AND ({', '.join(_k)}) NOT IN (SELECT ({', '.join(_k)}) FROM result WHERE item % 2 = 0)"))
add("S08_insert_source", lambda s, d: R(s, d).where("position > 3").select("study", "query", "engine_text", "main").distinct().join(R(s, d).where("position = 1").select("study", "query", "engine_text").distinct(), ["study", "query", "engine_text"]).withColumn("source_type", F.lit("carousel")), v("result", "SELECT DISTINCT r.study, r.query, r.engine_text, main, 'carousel' AS source_type FROM result r JOIN (SELECT DISTINCT study, query, engine_text FROM result WHERE position = 1) o ON o.study = r.study AND o.query = r.query AND o.engine_text = r.engine_text WHERE position > 3"))
add("S09_segment_links", lambda s, d: ad.read(s, d, "part").select("p_partkey", F.explode(F.split(F.replace("p_name", F.lit(" "), F.lit("|")), r"\|")).alias("url")).select("p_partkey", F.trim("url").alias("url")).distinct(), "SELECT DISTINCT p_partkey, trim(unnest(string_split(replace(p_name, ' ', '|'), '|'))) AS url FROM part")
add("S11_query_ids", lambda s, d: ad.read(s, d, "documents").select("source").distinct().join(Q(s, d).select(F.col("query").alias("source")), "source", "left_anti").select("source", (F.row_number().over(rl.W.orderBy("source")) + 24).alias("id")), v("query", "SELECT source, row_number() OVER (ORDER BY source) + 24 AS id FROM (SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT query FROM query))"))
add("S15_seed_merge", lambda s, d: ad.read(s, d, "part").select(F.explode(F.split("p_type", " ")).alias("k")).union(s.createDataFrame([("  one\ntwo \n\n",)], "t string").select(F.explode(F.split("t", "\n")))).select(F.trim("k").alias("keyword")).where("keyword <> ''").distinct(), "SELECT DISTINCT trim(k) AS keyword FROM (SELECT unnest(string_split(p_type, ' ')) AS k FROM part UNION ALL SELECT unnest(['  one', 'two ', ''])) WHERE trim(k) <> ''")
add("S18_keyword_workbook", lambda s, d: ad.read(s, d, "part").select(F.col("p_brand").alias("seed"), F.col("p_name").alias("idea"), F.col("p_size").alias("searches")).orderBy("seed", F.desc("searches"), "idea"), "SELECT p_brand AS seed, p_name AS idea, p_size AS searches FROM part ORDER BY seed, searches DESC, idea")
add("S19_questionnaire", lambda s, d: A(s, d).groupBy("question").agg(F.array_sort(F.collect_set("value")).alias("o")).select("question", F.to_json("o").alias("options")), v("answer", "SELECT question, '[' || string_agg('\"' || value || '\"', ',' ORDER BY value) || ']' AS options FROM (SELECT DISTINCT question, value FROM answer) GROUP BY question"))
add("S20_questionnaire_import", lambda s, d: A(s, d).groupBy("question").agg(F.array_sort(F.collect_set("value")).alias("o")).select("question", F.posexplode(F.from_json(F.to_json("o"), "array<string>")).alias("position", "value")), v("answer", "SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY value) - 1 AS INTEGER) AS position, value FROM (SELECT DISTINCT question, value FROM answer)"))
add("S22_drop_null_rows", lambda s, d: A(s, d).select("id", F.nullif("value", F.lit("3")).alias("value")).na.drop("any"), v("answer", "SELECT id, value FROM answer WHERE value <> '3'"))
add("F25_json_columns", lambda s, d: rl.widen(I(s, d).select("id", F.explode(F.from_json("value", "map<string,string>")).alias("name", "val")), ["id"], "name", "val", ["k"]).withColumnRenamed("k", "value_k"), v("indicator", "SELECT id, json_extract_string(value, '$.k') AS value_k FROM indicator"))
add("F26_indicator_columns", lambda s, d: I(s, d).where(~F.col("value").startswith("error")).select("id", F.map_entries(tx.expected_entries(F.col("value"), F.array(F.lit("K")))).alias("e")).select("id", F.size("e").alias("n")), v("indicator", "SELECT id, 1 AS n FROM indicator"))
add("F28_survey_pivot", lambda s, d: rl.widen(A(s, d).where("status = 1").select("participant", F.concat(F.lit("PRE_"), F.col("question")).alias("title"), "value"), ["participant"], "title", "value", ["PRE_click", "PRE_view"]), v("answer", "SELECT participant, min(value) FILTER (question = 'click') AS \"PRE_click\", min(value) FILTER (question = 'view') AS \"PRE_view\" FROM answer WHERE status = 1 GROUP BY participant"))
