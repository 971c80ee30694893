"""Line de-duplication: lines whose normalised form stands in many documents go.

Lines are exploded with their positions, their keys hashed to 128 bits, distinct documents counted
for each hash, and each document is put together again from the positions that stay.  The text
itself is shuffled at most once, in the last join; everything before moves hashes and positions.

Counting combines before it shuffles, so a line that stands everywhere is a row for each task there.
In the join of positions with the lines that go, its rows would meet in one task.  So the lines of
``HOT`` documents or more are broadcast: of D pairs of a document and a line there are at most D / HOT
of them, and a line below gives a task that many documents' positions, whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, fresh


#: Lines of so many documents are looked up where they stand: some 64 MB of hashes for 10^12 pairs.
HOT = 1_000_000


def line_key(line: Column) -> Column:
    """The line without ASCII white space at either end, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Keys (as ``line_hash``) found in at least ``min_docs`` distinct documents, with ``n_docs``.

    A null id is one document, a null text one empty line; an empty table gives no rows.  Rows that
    share an id and other columns don't matter."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col(text_col)), line_key), lambda k: F.length(k) >= min_chars), F.md5))
    pairs = docs.select(F.col(id_col).alias("_id"), F.explode(keys).alias("_key")).distinct()
    return pairs.groupBy("_key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select(F.col("_key").alias("line_hash"), "n_docs")


def drop_frequent_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, hot: int = HOT) -> DataFrame:
    """``docs`` with ``text_col`` replaced, and ``n_lines`` and ``n_dropped`` (long) added.

    Null and empty texts are one empty line.  Keys shorter than ``min_chars`` code points never go.
    Rows that share an id count as one document and each keep their row; a null id is one document.
    A document that loses every line has the empty text.  Other columns pass through, whatever their
    names; columns named ``n_lines`` or ``n_dropped`` are replaced.  Names of columns are told apart
    without regard to case, as the session does.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    text = F.coalesce(F.col(text_col), F.lit(""))
    own_id, own_hash, own_gone, own_lines, row_hash = (fresh(docs, f"_{c}") for c in ("id", "hash", "gone", "lines", "row_hash"))
    ident = [F.col(id_col).alias(own_id), F.xxhash64(text).alias(own_hash)]
    at = docs.select(*ident, F.posexplode(F.transform(_lines(F.col(text_col)), line_key)).alias("_pos", "_line")).where(F.length("_line") >= min_chars)
    frequent = frequent_lines(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars)
    at = at.select(own_id, own_hash, "_pos", F.md5("_line").alias("line_hash"))
    often = frequent.where(F.col("n_docs") >= hot).select("line_hash", F.lit(True).alias("_hot"))
    at = at.join(F.broadcast(often), "line_hash", "left")
    # what is found is spread over the tasks of the next join, where it has no partner
    spread = F.when(F.col("_hot"), F.md5(F.concat("line_hash", F.col(own_hash).cast("string"), F.col("_pos").cast("string")))).otherwise(F.col("line_hash"))
    rest = frequent.where(F.col("n_docs") < hot).select(F.col("line_hash").alias("_key"), F.lit(True).alias("_found"))
    gone = at.withColumn("_key", spread).join(rest, "_key", "left").where("_hot OR _found")
    # identical rows give the same positions, hence the set
    gone = gone.groupBy(own_id, own_hash).agg(F.collect_set("_pos").alias(own_gone))
    row = docs.withColumn(own_lines, _lines(F.col(text_col))).withColumn(row_hash, F.xxhash64(text))
    joined = row.join(gone, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(row_hash) == F.col(own_hash)), "left")
    lines, lost = F.col(own_lines), F.col(own_gone)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    kept = F.when(lost.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    dropped = F.when(lost.isNull(), 0).otherwise(F.size(lost)).cast("long")
    return joined.select(*[kept.alias(c) if c.lower() == text_col.lower() else F.col(c) for c in docs.columns], F.size(lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
