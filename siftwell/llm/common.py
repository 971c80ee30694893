"""What the training-data operators share: tables, shared scratch space, small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the contracts strip or split at.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(c, _UPPER, _UPPER.lower())


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and the master is local, as
    in tests on one machine, a folder under /tmp is set for ``checkpoint()`` too.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all machines share")
        where = "file:///tmp/checkpoints/siftwell"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/siftwell-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Scratch paths that this driver has handed out and not removed.
_made: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove all scratch of this driver.  Call it when the results of operators have been written."""
    remove(spark, *_made)


#: Spark's switch that removes the shuffle files of a query when it ends.
_ENDED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, compression: str = "zstd", *, release: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; return it reread, and its path.

    This cuts the lineage: a later loss of executors costs no more than rereading the table.  With
    ``release`` the shuffle files of this write go when it ends, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    before = spark.conf.get(_ENDED, "false")
    if release:
        spark.conf.set(_ENDED, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if release:
            spark.conf.set(_ENDED, before)
    return spark.read.schema(schema).parquet(path), path


def release_since(spark: SparkSession, before: set[str], *keep: str) -> None:
    """Remove the scratch handed out since ``before``, a copy of what there was, but for ``keep``."""
    remove(spark, *[p for p in _made if p not in before and p not in keep])


def made() -> set[str]:
    """The scratch paths handed out and not removed."""
    return {*_made}


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    paths = {*paths}
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = [p for p in _made if p not in paths]
