"""Predicates and labels over states, kinds and engines: pure column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Final after so many failed tries (fixed value).
TRIES = 3


def is_final(progress: Column, counter: Column) -> Column:
    """Done, or failed for good."""
    return (progress == 1) | ((progress == -1) & (counter >= TRIES))


def is_retry(progress: Column, counter: Column) -> Column:
    return (progress == -1) & (counter < TRIES)


def within_depth(position: Column, cap: Column | int, keep_null: bool = False) -> Column:
    """Position up to the cap; null positions are dropped unless ``keep_null``."""
    ok = position <= cap
    return position.isNull() | ok if keep_null else F.coalesce(ok, F.lit(False))


def in_ranges(position: Column, ranges: list[tuple[int, int]]) -> Column:
    """Position inside any of the ranges; no range lets everything pass."""
    return reduce(lambda a, b: a | b, [position.between(a, b) for a, b in ranges]) if ranges else F.lit(True)


def assessable(progress: Column, live: bool, failed_too: bool) -> Column:
    """Which sources may be assessed: all in live mode, else done ones, or failed ones as well."""
    return F.lit(True) if live else progress.isin(1, -1) if failed_too else progress == 1


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


#: Labels of item kinds: the dashboard's and the export's differ (fixed values).
DASHBOARD_LABELS = {"result": "Organic Results", "result_ai_source": "AI Sources", "result_ai": "AI Answers", "result_chatbot": "Chatbots", "result_image": "Images"}
EXPORT_LABELS = {"result": "Organic Result", "result_ai": "AI Overview", "result_chatbot": "Chatbot", "result_ai_source": "AI Source", "result_image": "Image Result"}


def kind_label(kind: Column, labels: dict[str, str], other: str = "Unknown") -> Column:
    chain = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(labels.items())[1:], F.when(kind == next(iter(labels)), next(iter(labels.values()))))
    return chain.otherwise(other)


def engine_name(engine: Column) -> Column:
    """``a_b_c`` is ``A (B / C)``; two parts or one are title case."""
    p = F.split(engine, "_")
    three = F.concat(F.initcap(F.get(p, F.lit(0))), F.lit(" ("), F.upper(F.get(p, F.lit(1))), F.lit(" / "), F.upper(F.get(p, F.lit(2))), F.lit(")"))
    return F.when(F.size(p) >= 3, three).otherwise(F.initcap(F.replace(engine, F.lit("_"), F.lit(" "))))


def composite_id(kind: Column, item: Column) -> Column:
    return F.concat_ws(":", kind, item.cast("string"))


def parse_composite(c: Column) -> Column:
    """struct<kind, item>; without a colon the kind is ``result``."""
    has = F.contains(c, F.lit(":"))
    return F.struct(F.when(has, F.split_part(c, F.lit(":"), F.lit(1))).otherwise("result").alias("kind"), F.when(has, F.split_part(c, F.lit(":"), F.lit(2))).otherwise(c).alias("item"))


def answer_label(kind: Column, label: Column, value: Column) -> Column:
    """The option's label for closed questions, else the value."""
    return F.when(kind.isin("true_false", "likert_scale", "multiple_choice"), F.coalesce(label, value)).otherwise(value)


def study_status(status: Column, total: Column, finished: Column, has_data: Column) -> Column:
    """The next state.  New (0), collecting (1) and transitional (3) become finished (2) when all
    tasks are done, or when there is data and no task; new becomes collecting when there is data.
    Finished and archived (4) stay."""
    done = ((total > 0) & (finished >= total)) | ((total == 0) & has_data)
    return F.when(status.isin(0, 1, 3) & done, 2).when((status == 0) & has_data, 1).otherwise(status)


def percentage(value: Column, total: Column) -> Column:
    """Whole percent, half to even; null where there is no total."""
    return F.when(total > 0, F.bround(100.0 * value / total).cast("long"))


def percentage_text(value: Column, total: Column) -> Column:
    return F.when(total > 0, F.concat(percentage(value, total).cast("string"), F.lit(" %"))).otherwise("-")


def fetch_outcome(status: Column, content_type: Column, path: Column, error: Column) -> Column:
    """1 for a page that was fetched, -1 for a bad status, an error type, no file or a timeout."""
    bad = (F.coalesce(status, F.lit(0)) != 200) | (F.coalesce(content_type, F.lit("")) == "error") | path.isNull() | F.coalesce(error, F.lit("")).rlike("(?i)timed out|timeout|partial content")
    return F.when(bad, -1).otherwise(1)


def backoff_minutes(tries: Column) -> Column:
    """5, 15, 30, then 60 minutes (fixed values)."""
    return F.element_at(F.array(*[F.lit(x) for x in (5, 15, 30, 60)]), F.least(tries + 1, F.lit(4)).cast("int"))


def lease_expired(progress: Column, counter: Column, server: Column, since: Column, now: Column, mine: str, minutes: int = 10) -> Column:
    """Running or failed, tries left, held by me or nobody, and older than the cut-off."""
    return progress.isin(2, -1) & (counter < TRIES) & (server.isNull() | (server == mine)) & (since < now - F.make_dt_interval(mins=F.lit(minutes)))


def lease_lost(progress: Column, counter: Column, since: Column, now: Column, minutes: int = 10) -> Column:
    """No tries left, and failed or stale."""
    return (counter >= TRIES) & ((progress == -1) | (progress.isin(0, 2) & (since < now - F.make_dt_interval(mins=F.lit(minutes)))))
