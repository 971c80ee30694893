"""Columns of any name, null and repeated rows, through the operators that keep a table's columns, and the stages."""

import re
from pathlib import Path

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from siftwell.llm import common, jaccard, lines, quality, secrets

ROOT = Path(lines.__file__).parent
#: Every name in quotes that the modules use, and some that they make.
NAMES = sorted({n for f in ("lines", "secrets", "jaccard", "quality", "common") for n in re.findall(r'"(_\w+|[a-z]\w*)"', (ROOT / f"{f}.py").read_text())} | {"_m_assign", "_ok", "_g_hex", "_s_hex", "_new", "new", "_gone", "gone", "_id", "_hash", "_lines", "_row_hash", "_pos"})
OWN = {"doc_id", "text", "id", "score", "n_lines", "n_dropped", "secrets", "base_secrets", "lang", "source", "n_chars"}
TEXTS = [*["one shared line\nown words of text number %d are here to stay" % i for i in range(12)], None, "", "password = hunter2secret and more words", "one shared line"]


def frame(spark, text="text"):
    names = [n for n in NAMES if n.lower() not in OWN]
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[4])]
    df = spark.createDataFrame(rows, f"doc_id long, {text} string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length(text).cast("long")})
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in names]), names


KEEPS = {
    "lines": lambda df, t: lines.drop_frequent_lines(df, text_col=t),
    "secrets": lambda df, t: secrets.scan(df, text_col=t),
    "jaccard": lambda df, t: jaccard.keep_representatives(df, text_col=t),
    "quality": lambda df, t: quality.score(df, quality.train(df, df.sparkSession.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int"), text_col=t), text_col=t),
}


@pytest.mark.parametrize("name", KEEPS)
@pytest.mark.parametrize("text", ["text", "Text"])
def test_columns_pass_through(spark, name, text):
    df, names = frame(spark, text)
    out = KEEPS[name](df, "text")
    assert set(df.columns) <= set(out.columns) and len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows and (name == "jaccard" or len(rows) == df.count())
    assert all(r[n] == f"mine {n}" for r in rows for n in names)
    if name == "lines":
        assert {r[text] for r in rows if r.doc_id in (0, 15)} == {"own words of text number 0 are here to stay", ""}


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:-1]], ids=[n for n, _ in cp.STAGES[:-1]])
def test_stages_keep_columns(spark, sf_dir, stage):
    df, names = frame(spark)
    out = stage(spark, df, sf_dir)
    assert out.columns == df.columns
    assert all(r[n] == f"mine {n}" for r in out.collect() for n in names)
    assert stage(spark, df.limit(0), sf_dir).count() == 0


def test_packing_stage_takes_any_columns(spark, sf_dir):
    df, _ = frame(spark)
    out = cp.STAGES[-1][1](spark, df, sf_dir).collect()
    assert len(out) == df.count()


def test_scratch_is_removed(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    before = common.made()
    _, path = common.store(jaccard.keep_representatives(df), "test")
    common.release_since(spark, before, path)
    assert common.made() == before | {path}
    common.remove(spark, path)


def test_caches_are_bounded():
    from siftwell.llm.cache import LONGEST, Recent

    asked = []
    c = Recent(lambda w: asked.append(w) or len(w), 10)
    for i in range(100):
        assert c[f"w{i}"] == len(f"w{i}") and c["often"] == 5 and c["x" * (LONGEST + 1 + i)] == LONGEST + 1 + i
        assert len(c) <= 10 and len(c.old) <= 10 and max(map(len, [*c, *c.old])) <= LONGEST
    assert asked.count("often") == 1
