"""Aggregations behind the dashboards: overlap, domains, distributions, progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import states as st
from ..functions import text as tx


def engine_overlap(results: DataFrame, cap: int | None = 5, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """URLs that two engines share, summed over queries, for each pair of engines.

    A row of sets for each (query, URL): the engines that have it.  Pairs come from a list of engines
    (few) next to counts for each query, so no join of results with results is made and nothing is
    collected that grows with a query.
    """
    r = results.where(F.col("engine_text").isNotNull() & st.filled(F.col("normalized_url")))
    if cap is not None:
        r = r.where(st.within_depth(F.col("position"), cap, keep_null=True))
    seen = r.groupBy(*by, "normalized_url").agg(F.sort_array(F.collect_set("engine_text")).alias("engines"))
    # at most as many rows as sets of engines and queries
    sets = seen.groupBy(*by, "engines").agg(F.count(F.lit(1)).alias("n"))
    per = sets.select(*by, F.explode("engines").alias("e"), "n").groupBy(*by, "e").agg(F.sum("n").alias("n"))
    left = per.select(*by, F.col("e").alias("engine_1"), F.col("n").alias("n_1"))
    right = per.select(*by, F.col("e").alias("engine_2"), F.col("n").alias("n_2"))
    pairs = left.join(right, list(by)).where("engine_1 < engine_2")
    both = sets.select(*by, F.explode("engines").alias("engine_1"), "engines", "n").select(*by, "engine_1", F.explode("engines").alias("engine_2"), "n").where("engine_1 < engine_2").groupBy(*by, "engine_1", "engine_2").agg(F.sum("n").alias("both"))
    out = pairs.join(both, [*by, "engine_1", "engine_2"], "left").fillna(0, ["both"])
    g = out.groupBy("engine_1", "engine_2").agg(F.sum("n_1").alias("n_1"), F.sum("n_2").alias("n_2"), F.sum("both").alias("overlap"))
    return g.select(st.engine_name(F.col("engine_1")).alias("engine_1"), st.engine_name(F.col("engine_2")).alias("engine_2"), (F.col("n_1") - F.col("overlap")).alias("exclusive_1"), (F.col("n_2") - F.col("overlap")).alias("exclusive_2"), "overlap", (F.col("n_1") + F.col("n_2") - F.col("overlap")).alias("total"))


def top_domains(results: DataFrame, k: int | None = 10, domain: str = "main") -> DataFrame:
    """Domains by count, with their share of all results and their mean position; ties by name."""
    g = results.where(st.filled(F.col(domain))).groupBy(F.col(domain).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.avg("position").alias("avg_position"))
    total = g.agg(F.sum("n").alias("all"))
    out = g.crossJoin(total).select("domain", "n", (100.0 * F.col("n") / F.col("all")).alias("share"), "avg_position").orderBy(F.desc("n"), "domain")
    return out if k is None else out.limit(k)


def collection_progress(results: DataFrame) -> DataFrame:
    """Counts of each source state for each study, and the percentage that is final."""
    p, c = F.col("progress"), F.col("counter")
    return results.groupBy("study").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.count_if(p == 1).alias("n_done"),
        F.count_if((p == -1) & (c >= st.TRIES)).alias("n_failed"),
        F.count_if(st.is_retry(p, c)).alias("n_retry"),
        F.count_if(~st.is_final(p, c)).alias("n_open"),
        st.percentage(F.count_if(st.is_final(p, c)), F.count(F.lit(1))).alias("percent"),
        F.countDistinct("engine_text").alias("n_engines"),
        F.countDistinct("main").alias("n_domains"),
    )


def long_counters(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value) for the counters that aren't zero."""
    stack = ", ".join(f"'{n}', cast({n} as bigint)" for n in names)
    return df.select(*keys, F.expr(f"stack({len(names)}, {stack}) as (metric, value)")).where("value <> 0")


def evaluation(answers: DataFrame, keys: list[str], n_questions: int) -> DataFrame:
    """Done, skipped and all answers, the percentage that is closed, and whole items skipped."""
    s = F.col("status")
    return answers.groupBy(*keys).agg(
        F.count_if(s == 1).alias("n_done"),
        F.count_if(s == 2).alias("n_skipped"),
        F.count(F.lit(1)).alias("n_all"),
        st.percentage(F.count_if(s.isin(1, 2)), F.count(F.lit(1))).alias("percent"),
        F.floor(F.count_if(s == 2) / n_questions).cast("long").alias("skipped_items"),
    )


def answers_of_participants(answers: DataFrame) -> DataFrame:
    """Anonymous answers don't count in studies that have participants."""
    has = answers.where("participant is not null").select("study").distinct().withColumn("_has", F.lit(True))
    return answers.join(has, "study", "left").where("participant is not null or _has is null").drop("_has")


def finished_by_kind(answers: DataFrame, n_questions: int) -> DataFrame:
    g = answers.where("status = 1").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return g.select(st.kind_label(F.col("kind"), st.DASHBOARD_LABELS).alias("result_type"), F.floor(F.col("n") / n_questions).cast("long").alias("n_items"))


def distinct_items(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct items for each kind and key."""
    return facts.groupBy("kind", *keys).agg(F.countDistinct("item").alias("n_items"))


def json_distribution(facts: DataFrame) -> DataFrame:
    """Counts of the values of each key of JSON objects; what isn't an object counts as it is."""
    value = F.from_json("value", "map<string,string>")
    name = F.regexp_replace("indicator", "^LLM_", "")
    counted = facts.groupBy("kind", "indicator", "value").agg(F.count(F.lit(1)).alias("n"))
    entries = F.when(F.col("value").rlike(r"^\s*\{"), F.map_entries(value)).otherwise(F.array(F.struct(F.lit("").alias("key"), F.col("value").alias("value"))))
    long = counted.select("kind", name.alias("indicator"), "n", F.explode(entries).alias("e"))
    return long.groupBy("kind", "indicator", F.col("e.key").alias("key"), F.col("e.value").alias("value")).agg(F.sum("n").alias("n"))


#: States that a distribution shows as one, beside all that begin with ``error_`` (fixed values).
ERROR_STATES = ("error", "source_failed", "classifier_error", "excluded", "error_api", "error_timeout", "error_empty", "error_no_config", "error_no_study")
#: Values that mark a study as one with classifier errors (fixed values).
ERROR_VALUES = ("error_api", "error_timeout", "error_empty", "error_invalid_json", "error_no_config", "error_no_study")


def folded(value: Column) -> Column:
    """Errors and work in process under one label each, whatever their case and white space; other
    values without the white space around them."""
    bare = F.trim(value)
    low = F.lower(bare)
    return F.when(low.isin(*ERROR_STATES) | low.startswith("error_"), "Error").when(low == "in process", "In Process").otherwise(bare)


def has_errors(value: Column) -> Column:
    """Whether an indicator's value is one of ``ERROR_VALUES``."""
    return value.isin(*ERROR_VALUES)


def bucketed_distribution(results: DataFrame, keys: list[str]) -> DataFrame:
    """Values folded to states and to five score ranges where a group needs ranges, with shares.

    A group needs ranges if its largest number is over 10 and it has more than 10 numbers.
    """
    g = results.groupBy(*keys, folded(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    num = tx.last_number(F.col("value"))
    need = g.groupBy(*keys).agg(((F.max(num) > 10) & (F.countDistinct(num) > 10)).alias("_ranges"))
    label = F.when(F.col("_ranges") & num.isNotNull(), tx.score_range(num)).otherwise(F.col("value"))
    h = g.join(need, keys).groupBy(*keys, F.coalesce(label, F.col("value")).alias("label")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    return h.select(*keys, "label", "n", (100.0 * F.col("n") / total).alias("share"))


def fold_tail(dist: DataFrame, keys: list[str], k: int = 15, label: str = "label") -> DataFrame:
    """The k most frequent labels and the rest as ``Other``; ties by label."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), label))
    r = dist.where("n > 0").withColumn("_rn", rn)
    return r.groupBy(*keys, F.when(F.col("_rn") <= k, F.col(label)).otherwise("Other").alias(label)).agg(F.sum("n").alias("n"))


def errors_under_every_key(dist: DataFrame) -> DataFrame:
    """Error rows (empty key) are added to the distribution of each key of their indicator."""
    keys = dist.where("key <> ''").select("kind", "indicator", "key").distinct()
    errors = dist.where("key = ''").select("kind", "indicator", "value", "n").join(keys, ["kind", "indicator"])
    return dist.where("key <> ''").unionByName(errors).groupBy("kind", "indicator", "key", "value").agg(F.sum("n").alias("n"))


def answer_distribution(answers: DataFrame, split: bool = False) -> DataFrame:
    """Counts and shares of values for each question and kind; with ``split`` values are comma lists
    and the share is of answers, so shares can add up to more than 100."""
    keys = ["question", "kind"]
    done = answers.where("status = 1")
    total = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_answers"))
    if split:
        done = done.withColumn("value", F.explode(F.split("value", ",")))
    g = done.groupBy(*keys, F.trim("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(total, keys).select(*keys, "value", "n", (100.0 * F.col("n") / F.col("n_answers")).alias("share"))


def likert(answers: DataFrame) -> DataFrame:
    """Mean, population deviation and number, for questions whose values are all numbers."""
    num = tx.plain_number(F.col("value"))
    g = answers.where("status = 1").groupBy("question").agg(F.avg(num).alias("mean"), F.stddev_pop(num).alias("std_dev"), F.count(F.lit(1)).alias("n"), F.bool_and(num.isNotNull()).alias("_all"))
    return g.where("_all").drop("_all")


def scale(answers: DataFrame) -> DataFrame:
    num = tx.plain_number(F.col("value"))
    return answers.where("status = 1").where(num.isNotNull()).groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.avg(num).alias("mean"), F.min(num).alias("min"), F.max(num).alias("max"))


def query_progress(items: DataFrame, answers: DataFrame, n_questions: int) -> DataFrame:
    """For each query: items, participants, finished and open answers, expected ones, percent."""
    i = items.groupBy("query").agg(F.count(F.lit(1)).alias("n_items"))
    a = answers.groupBy("query").agg(F.countDistinct("participant").alias("n_participants"), F.count_if(F.col("status").isin(1, 2)).alias("n_finished"), F.count_if(F.col("status") == 0).alias("n_open"))
    j = i.join(a, "query", "left").fillna(0, ["n_participants", "n_finished", "n_open"])
    expected = F.col("n_items") * n_questions * F.col("n_participants")
    return j.select("query", "n_items", "n_participants", "n_finished", "n_open", expected.alias("n_expected"), F.when(expected > 0, 100.0 * F.col("n_finished") / expected).otherwise(0.0).alias("percent"))


def participant_progress(answers: DataFrame, n_questions: int, by_query: bool) -> DataFrame:
    """For each participant, queries or whole items that were seen, are closed and open."""
    s = F.col("status")
    if by_query:
        return answers.groupBy("participant").agg(F.countDistinct("query").alias("n_seen"), F.countDistinct(F.when(s != 0, F.col("query"))).alias("n_closed"), F.countDistinct(F.when(s == 0, F.col("query"))).alias("n_open"))
    g = answers.groupBy("participant").agg(F.count(F.lit(1)).alias("all"), F.count_if(s != 0).alias("closed"))
    seen, closed = F.floor(F.col("all") / n_questions).cast("long"), F.floor(F.col("closed") / n_questions).cast("long")
    return g.select("participant", seen.alias("n_seen"), closed.alias("n_closed"), F.greatest(seen - closed, F.lit(0)).alias("n_open"), F.least(F.lit(100), st.percentage(F.col("closed"), F.col("all"))).alias("percent"))


def state_counts(df: DataFrame, keys: list[str], names: dict[str, Column]) -> DataFrame:
    """One counter for each named predicate."""
    return df.groupBy(*keys).agg(*[F.count_if(p).alias(n) for n, p in names.items()])


def expected_runs(tasks: DataFrame, items: DataFrame, done: DataFrame) -> DataFrame:
    """Progress of tasks over items: a task runs on every item of its kind, or on all kinds."""
    n = items.groupBy("kind").agg(F.count(F.lit(1)).alias("n_items"))
    e = tasks.join(n, (F.col("target") == "all") | (F.col("target") == F.col("kind"))).groupBy("task").agg(F.sum("n_items").alias("n_expected"))
    d = done.groupBy("task").agg(F.count(F.lit(1)).alias("n_done"))
    j = e.join(d, "task", "left").fillna(0, ["n_done"])
    pct = F.least(F.lit(100), st.percentage(F.col("n_done"), F.col("n_expected")))
    return j.select("task", "n_expected", "n_done", pct.alias("percent"), F.when(F.col("n_done") >= F.col("n_expected"), "Finished").otherwise(F.concat(F.lit("Progress: "), F.col("n_done").cast("string"), F.lit("/"), F.col("n_expected").cast("string"))).alias("status"))


def available(frames: dict[str, DataFrame]) -> DataFrame:
    """(sheet, available) for each frame; looks at one row of each."""
    rows = [df.limit(1).agg((F.count(F.lit(1)) > 0).alias("available")).select(F.lit(name).alias("sheet"), "available") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, rows)
