"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what the one before it kept, as Parquet, and all but the last return the columns of
``documents``: doc_id, text, lang, source, n_chars.  Null and empty texts are empty documents and rows
that share an id are rows of their own throughout; further columns pass through, whatever their names.
An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import jaccard, lines, packing, quality, secrets
from siftwell.llm.common import fresh, made, release_since, store, table


def _with_text(df: DataFrame, text: Column | str, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with a new text and, where there was one, its length.  A null text stays null."""
    name = fresh(df, "new")
    out = df.withColumn(name, F.col(text) if isinstance(text, str) else text)
    new = {"text": F.col(name), "n_chars": F.length(name).cast("long")}
    return out.select(*[new[c.lower()].alias(c) if c.lower() in new else F.col(c) for c in like.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that aren't held out."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).where("score >= 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have; a document may become empty."""
    return _with_text(lines.drop_frequent_lines(docs), "text", docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-gram Jaccard similarities of 0.8 or more hold together."""
    return jaccard.keep_representatives(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    found = secrets.scan(docs)
    return _with_text(found, secrets.redact(F.col("text"), F.col("secrets")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids, sequences and offsets."""
    import public_tokenizers

    return packing.pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scan", redact_secrets),
    ("best-fit packing", pack),
]

#: The classifier and the packing aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = made()
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs, path = store(out, f"stage{k}", "snappy")
        release_since(spark, before, path)
    return docs
