"""Joins, queues, assignment, upserts and exports over the search-result entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def item_spine(frames: dict[str, DataFrame]) -> DataFrame:
    """(kind, item, study, query): all item tables as one, for one join instead of one for each."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "item", "study", "query") for k, df in frames.items()])


def in_any(left: DataFrame, key: str, branches: list[DataFrame]) -> DataFrame:
    """Rows whose key is in one of several frames: a union of keys and one semi-join."""
    keys = reduce(DataFrame.union, [b.select(key) for b in branches]).distinct()
    return left.join(keys, key, "left_semi")


def null_tolerant_anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` that no row of ``right`` matches, where a null on the right matches all.

    For each pattern of nulls on the right there is one equi-join on the keys that are filled, so no
    pairs are formed.  There are at most 2**len(keys) patterns; those without rows cost little."""
    out = left
    for bits in range(1 << len(keys)):
        on = [k for i, k in enumerate(keys) if bits >> i & 1]
        some = right.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() if k in on else F.col(k).isNull() for k in keys]))
        if on:
            out = out.join(some.select(*on).distinct(), on, "left_anti")
        else:
            out = out.join(some.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_anti")
    return out


def latest(df: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    """The last row of each key; ties by further columns, ascending."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(time), *ties))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def reusable_sources(wanted: DataFrame, sources: DataFrame, keys: list[str], now: Column, hours: float = 48) -> DataFrame:
    """As-of lookup: the latest source of each wanted key if it is young enough."""
    age = F.timestamp_diff("SECOND", F.col("created_at"), now) / 3600.0
    return wanted.join(latest(sources, keys, "created_at", "item", "position").where(age.between(0, hours)), keys)


def siblings(edges: DataFrame, left: str = "segment", right: str = "source") -> DataFrame:
    """How many other members of its groups each member meets, repeats not counted.

    Equal sets of members are counted once, whatever the number of groups that have them.  A group is
    the segment of one answer, so its set is small and is held as an array; pairs are made where the set
    is, without a join, and repeats are dropped before the shuffle."""
    sets = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left).agg(F.sort_array(F.collect_set(right)).alias("s"))
    sets = sets.where(F.size("s") > 1).select("s").distinct()
    met = sets.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y")).where("x <> y").distinct()
    return met.groupBy("x").agg(F.count(F.lit(1)).alias("n_siblings"))


def duplicate_groups(results: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several results have, with how many and the first of them."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first_item")).where("n > 1")


def propagate(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Missing values are filled from results with the same key: the smallest value that is there."""
    v = results.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("_v"))
    return results.join(v, keys, "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")


def fair_queue(df: DataFrame, owner: str, order: list[str], k: int) -> DataFrame:
    """The first k rows when owners take turns."""
    rn = F.row_number().over(W.partitionBy(owner).orderBy(*order))
    # none of a later turn is among the first k, and with the filter each task keeps k rows of an owner
    return df.withColumn("turn", rn).where(F.col("turn") <= k).orderBy("turn", F.desc(owner), *order).limit(k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def least_assigned(counts: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows ranked by assignments, ties by a seeded hash of the key (repeatable, unlike ``rand``)."""
    return counts.select("*", F.row_number().over(W.partitionBy("study").orderBy("n", F.xxhash64(F.lit(seed), F.col(key)), key)).alias("rank"))


def balanced_quota(items: DataFrame, quota: int, seed: int) -> DataFrame:
    """Up to ``quota`` items of each study, kinds taking turns, in a seeded order."""
    deal = F.xxhash64(F.lit(seed), "kind", "item")
    i = items.select("study", "kind", "item").distinct().withColumn("nth", F.row_number().over(W.partitionBy("study", "kind").orderBy(deal, "item")))
    r = i.withColumn("rank", F.row_number().over(W.partitionBy("study").orderBy("nth", F.xxhash64(F.lit(seed + 1), "kind"), "kind")))
    return r.where(F.col("rank") <= quota)


def assign(participants: DataFrame, items: DataFrame, per_participant: int, seed: int) -> DataFrame:
    """Each participant gets ``per_participant`` different items of the study, all items equally often
    to within one: participants and items are numbered and dealt round."""
    key = lambda c: F.row_number().over(W.partitionBy("study").orderBy(F.xxhash64(F.lit(seed), c), c)) - 1
    p = participants.select("study", "participant").distinct().withColumn("_p", key("participant"))
    i = items.select("study", "item").distinct().withColumn("_i", key("item"))
    n = i.groupBy("study").agg(F.count(F.lit(1)).alias("_n"))
    slots = p.join(n, "study").withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_participant).cast("long"), F.col("_n")) - 1)))
    return slots.withColumn("_i", (F.col("_p") * per_participant + F.col("_k")) % F.col("_n")).join(i.withColumn("_i", F.col("_i").cast("long")), ["study", "_i"]).select("study", "participant", "item")


def allocation_spread(assigned: DataFrame) -> DataFrame:
    g = assigned.groupBy("study", "item").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("study").agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") - F.min("n")).alias("range"), F.stddev_samp("n").alias("std_dev"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key, or are added.

    With ``only``, a condition on the old row, others aren't replaced.  If ``new`` repeats a key, its
    smallest row wins; rows of ``old`` that repeat a key are all replaced by one."""
    cols = old.columns
    one = new.select(*cols).groupBy(*keys).agg(F.min(F.struct(*[c for c in cols if c not in keys])).alias("_s")).select(*keys, "_s.*").select(*cols)
    free = old.where(only) if only is not None else old
    fixed = old.where(~F.coalesce(only, F.lit(False))) if only is not None else old.limit(0)
    if only is not None:
        one = one.join(fixed.select(*keys), keys, "left_anti")
    return free.join(one.select(*keys), keys, "left_anti").unionByName(fixed).unionByName(one)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to add: the first of each key that ``old`` lacks."""
    return first_per_key(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti")


def cascade(children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each child frame without the rows that belong to deleted parents."""
    return {n: df.join(gone.select(F.col(key).alias(fk)), fk, "left_anti") for n, (df, fk) in children.items()}


def merge_json(old: Column, key: Column, value: Column) -> Column:
    """A JSON object with one entry set."""
    m = F.coalesce(F.from_json(old, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.to_json(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value)))


def cap_in_priority(df: DataFrame, priority: Column, quota: int, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct URLs of each key, first come first, cut to a quota in order of priority."""
    one = first_per_key(df, [*keys, "normalized_url"], order)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(priority, *order, "normalized_url"))
    return one.withColumn("rank", rank).where(F.col("rank") <= quota)


def running_rank(df: DataFrame, keys: list[str], page: str, order: list[str]) -> DataFrame:
    """Rank over pages: what earlier pages hold, plus the place in the page."""
    size = df.groupBy(*keys, page).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(page).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = size.select(*keys, page, before.alias("_before"))
    place = F.row_number().over(W.partitionBy(*keys, page).orderBy(*order))
    return df.join(at, [*keys, page]).withColumn("rank", F.col("_before") + place).drop("_before")


def page_of(df: DataFrame, order: list, page: int, size: int = 10) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def widen(long: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column for each of the names, the smallest value where a key repeats."""
    return long.groupBy(*keys).pivot(name, names).agg(F.min(value))


def dead_sources(results: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    """A ``source_failed`` row for each result without a source that has no row yet."""
    return results.select(*keys).distinct().join(flagged.select(*keys), keys, "left_anti").withColumn("value", F.lit("source_failed"))
