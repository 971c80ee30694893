"""The search-result entities, read from the test tables.

Operators take these frames as arguments, so real data can stand in.  Each view has a Spark form and
the same in SQL; ``with_views`` puts the SQL views a query needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Odd values that every eleventh classifier result takes in turn: states in any case, with white space, and others that look like states.
ODD_VALUES = ("error", "in process", "source_failed", " Error ", "excluded", "error_no_config", "ERROR_NO_STUDY", "error_invalid_json", "classifier_error", "error_quota", "In Process", "Progress: 1/2", "skipped_timeout", "error_api", "error_timeout", "error_empty")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def study(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(5).alias("result_count"))


def query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("study"), F.col("n_name").alias("query"))


def result(spark: SparkSession, d: str) -> DataFrame:
    """Organic results: line items, their query the customer's nation.  Dimensions are joined without
    hints; the planner broadcasts those that it knows to be small."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("l_orderkey").alias("item"),
        F.col("n_regionkey").alias("study"),
        F.col("c_nationkey").alias("query"),
        F.col("l_linenumber").alias("position"),
        F.concat(F.lower("l_returnflag"), F.lit("_xx_"), F.lower("l_linestatus")).alias("engine_text"),
        F.col("l_partkey").cast("string").alias("normalized_url"),
        F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example/")).alias("main"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(-1).alias("progress"),
        (F.col("l_quantity").cast("int") % 5).alias("counter"),
    )


def answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers of participants to questions; a third is open, done and skipped each."""
    e = read(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("participant"),
        F.col("event_type").alias("question"),
        kind.alias("kind"),
        (F.col("event_id") % 25).cast("int").alias("query"),
        (F.col("event_id") % 5).cast("int").alias("study"),
        (F.col("event_id") % 997).alias("item"),
        F.floor(F.col("value") % 7).cast("int").cast("string").alias("value"),
        (F.col("event_id") % 3).cast("int").alias("status"),
        F.col("ts").alias("created_at"),
    )


def indicator(spark: SparkSession, d: str) -> DataFrame:
    """Classifier indicators: JSON values on items of several kinds."""
    a = answer(spark, d)
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "props")
    return a.join(e, "id").select("id", "kind", "item", "study", "query", F.concat(F.lit("LLM_"), F.col("question")).alias("indicator"), F.col("props").alias("value"), "created_at")


def classifier_result(spark: SparkSession, d: str) -> DataFrame:
    """Values of two classifiers on documents: quality and a score from 0 to 100, with error states."""
    x = read(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    state = F.when(F.col("doc_id") % 11 == 0, F.element_at(F.array(*[F.lit(v) for v in ODD_VALUES]), (F.floor(F.col("doc_id") / 11) % len(ODD_VALUES) + 1).cast("int")))
    value = F.coalesce(state, F.concat(F.lit("score: "), (F.col("n_chars") % 101).cast("string")))
    return x.select(F.col("doc_id").alias("item"), F.col("source").alias("study_name"), F.col("lang").alias("kind"), F.lit("seo_score").alias("classifier"), value.alias("value"))


#: Item kinds of answers and indicators (fixed values).
KINDS = ("result", "result_ai", "serp", "result_image")

SQL = {
    "study": "SELECT r_regionkey AS id, r_name AS name, 5 AS result_count FROM region",
    "query": "SELECT n_nationkey AS id, n_regionkey AS study, n_name AS query FROM nation",
    "result": """SELECT l_orderkey AS item, n_regionkey AS study, c_nationkey AS query, l_linenumber AS position,
        lower(l_returnflag) || '_xx_' || lower(l_linestatus) AS engine_text, CAST(l_partkey AS VARCHAR) AS normalized_url,
        'https://s' || CAST(l_suppkey AS VARCHAR) || '.example/' AS main, l_shipdate AS created_at,
        CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE -1 END AS progress, CAST(trunc(l_quantity) AS INTEGER) % 5 AS counter
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "answer": """SELECT event_id AS id, user_id AS participant, event_type AS question,
        CASE event_id % 4 WHEN 0 THEN 'result' WHEN 1 THEN 'result_ai' WHEN 2 THEN 'serp' ELSE 'result_image' END AS kind,
        CAST(event_id % 25 AS INTEGER) AS query, CAST(event_id % 5 AS INTEGER) AS study, event_id % 997 AS item,
        CAST(CAST(floor(value % 7) AS INTEGER) AS VARCHAR) AS value, CAST(event_id % 3 AS INTEGER) AS status, ts AS created_at
      FROM events""",
    "indicator": """SELECT a.id, kind, item, study, query, 'LLM_' || question AS indicator, e.props AS value, created_at
      FROM answer a JOIN events e ON e.event_id = a.id""",
    "classifier_result": """SELECT doc_id AS item, source AS study_name, lang AS kind, 'seo_score' AS classifier,
        CASE WHEN doc_id % 11 = 0 THEN [""" + ", ".join(f"'{v}'" for v in ODD_VALUES) + f"""][CAST(doc_id // 11 % {len(ODD_VALUES)} + 1 AS INTEGER)]
             ELSE 'score: ' || CAST(n_chars % 101 AS VARCHAR) END AS value
      FROM documents""",
}
_NEEDS = {"indicator": ("answer",)}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (separated by spaces) as common table expressions before it."""
    want: list[str] = []
    for n in names.split():
        want += [x for x in (*_NEEDS.get(n, ()), n) if x not in want]
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in want)
    body = body.strip()
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"
