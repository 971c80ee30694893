"""Classifier plug-ins: an object with ``indicators(df)`` and ``score(df)``, found by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import salvaged_json


class Classifier(Protocol):
    def indicators(self, docs: DataFrame) -> DataFrame: ...
    def score(self, docs: DataFrame) -> DataFrame: ...


REGISTRY: dict[str, Callable[[], Classifier]] = {}


def register(name: str):
    def put(cls):
        REGISTRY[name] = cls
        return cls

    return put


def classify(docs: DataFrame, name: str) -> DataFrame:
    """Run a plug-in; an unknown name is an error before anything runs."""
    if name not in REGISTRY:
        raise KeyError(f"no classifier named {name}")
    c = REGISTRY[name]()
    return c.score(c.indicators(docs))


@register("length")
class LengthClassifier:
    """An example: a text's number of words and whether it is long."""

    def indicators(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("n_words", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")))

    def score(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("value", F.when(F.col("n_words") >= 100, "long").otherwise("short"))


def llm_tasks(items: DataFrame, tasks: DataFrame, done: DataFrame, client: Callable[[str, str], str], max_context: int = 3000, attempts: int = 3) -> DataFrame:
    """(task, item, value) for tasks on items of their kind that aren't done.

    ``client(prompt, text)`` is called in Python workers, three times at most for one item; an answer
    must hold a JSON object.  Items are read once for each source."""
    todo = items.join(tasks, (F.col("target") == "all") | (F.col("target") == F.col("kind"))).join(done.select("task", "item"), ["task", "item"], "left_anti")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for task, item, prompt, text in zip(p["task"], p["item"], p["prompt"], p["text"], strict=True):
                got = "error_api"
                for _ in range(attempts):
                    try:
                        got = client(prompt, text) or "error_empty"
                        break
                    except TimeoutError:
                        got = "error_timeout"
                    except Exception:  # noqa: BLE001 - a client may fail in any way; the state says so
                        got = "error_api"
                out.append((task, item, got))
            yield pd.DataFrame(out, columns=["task", "item", "raw"])

    raw = todo.select("task", "item", "prompt", F.substring(F.coalesce("text", F.lit("")), 1, max_context).alias("text")).mapInPandas(ask, "task string, item long, raw string")
    return raw.select("task", "item", F.when(F.col("raw").startswith("error_"), F.col("raw")).otherwise(F.coalesce(salvaged_json(F.col("raw")), F.lit("error_invalid_json"))).alias("value"))
