"""Readers and writers: import files, archives, questionnaires, sheets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of an import file, and those it can't lack (fixed values).
IMPORT_COLUMNS = ("query", "engine", "country", "lang", "page", "type", "rank", "title", "url", "snippet", "image_url", "ai_full_text", "source_type")
REQUIRED = ("query", "engine", "country", "lang")
DEFAULTS = {"query": "URL import", "engine": "import", "country": "xx", "lang": "xx", "type": "organic", "title": "", "page": "1"}


def read_import_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, with ``file_row`` from 0 in file order; rows with too many fields are
    dropped, short rows are filled with nulls."""
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    names = list(pd.read_csv(io.StringIO(head[0].value), nrows=0).columns) if head and head[0].value.strip() else []
    if not names:
        raise ValueError("the file is empty")
    schema = ", ".join(f"`{n}` string" for n in names) + ", `_corrupt_record` string"
    raw = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", multiLine=True, escape='"', encoding=encoding).csv(path)
    numbered = raw.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(schema + ", file_row long")  # the one place that needs file order
    too_many = F.col("_corrupt_record").isNotNull() & (F.size(F.split(F.regexp_replace("_corrupt_record", '"[^"]*"', ""), ",")) > len(names))
    return numbered.where(~F.coalesce(too_many, F.lit(False))).drop("_corrupt_record")


def with_defaults(df: DataFrame) -> DataFrame:
    """A file with addresses alone becomes a whole import file; its rank is the row number."""
    if "url" in df.columns and not set(REQUIRED) <= set(df.columns):
        if len(df.columns) <= 2:
            for c, v in DEFAULTS.items():
                if c not in df.columns:
                    df = df.withColumn(c, F.lit(v))
            if "rank" not in df.columns:
                df = df.withColumn("rank", (F.col("file_row") + 1).cast("string"))
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def read_zip_members(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """(archive, member, content) of archives; what isn't an archive gives no rows."""

    def unzip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, data in zip(p["path"], p["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows += [(name, m, z.read(m)) for m in z.namelist() if m.endswith(suffix)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "archive string, member string, content binary")


def asset_of(members: DataFrame, order: tuple[str, ...] = ("png", "gif", "jpg", "pdf", "html")) -> DataFrame:
    """The member of each archive to show: pictures before documents."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.lower(F.element_at(F.split("member", r"\."), -1)))
    rn = F.row_number().over(W.partitionBy("archive").orderBy(rank, "member"))
    return members.where(rank > 0).withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def match_assets(results: DataFrame, files: DataFrame) -> DataFrame:
    """Result pages to files: by the end of the name, else by the query's first 20 letters, the engine
    and the page, all reduced to letters and digits.  Both are equi-joins."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    f = files.withColumn("_base", F.element_at(F.split("file", "/"), -1))
    exact = results.join(f.select("file", F.col("_base").alias("asset")), "asset")
    key = F.concat(F.substring(plain("query"), 1, 20), plain("engine"), F.lit("p"), F.col("page"))
    rest = results.join(exact.select("asset").distinct(), "asset", "left_anti").withColumn("_key", key)
    loose = rest.join(f.withColumn("_key", plain(F.regexp_replace("_base", r"\.[^.]*$", ""))).select("file", "_key"), "_key").drop("_key")
    return exact.select(*results.columns, "file").unionByName(loose.select(*results.columns, "file"))


def write_sheets(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """One folder for each sheet that has rows; returns their names."""
    written = []
    for name, df in sheets.items():
        if not df.isEmpty():
            getattr(df.write.mode("overwrite").option("header", True), fmt)(f"{path}/{name}")
            written.append(name)
    return written


def read_questionnaire(spark: SparkSession, path: str) -> DataFrame:
    """(position, title, type, option_position, option) of a questionnaire in JSON."""
    q = spark.read.schema("questions array<struct<title:string,type:string,options:array<string>>>").option("multiLine", True).json(path)
    one = q.select(F.posexplode("questions").alias("position", "q"))
    return one.select("position", "q.title", "q.type", F.posexplode_outer("q.options").alias("option_position", "option"))
