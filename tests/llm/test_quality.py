"""The classifier on held-out labels and odd rows."""

import numpy as np

from siftwell.llm import quality


def test_held_out_accuracy(spark):
    from siftwell.llm.registry import queries

    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()["op8_quality_classifier"](spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    test = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert sum(p == 1 for p, y in test if y == 1) / sum(y for _, y in test) > 0.97


def test_ftrl_learns():
    f, m = quality.Features(), quality.FTRL()
    texts = [(f"good fine word{i}", 1) for i in range(50)] + [(f"bad awful thing{i}", 0) for i in range(50)]
    for _ in range(5):
        for x, y in texts:
            m.update(*f(x), y)
    w = m.weights()
    s = lambda x: quality.sigmoid(float(w[f(x)[0]] @ f(x)[1]))
    assert s("good fine day") > 0.7 > 0.3 > s("bad awful day")


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x y " * 50000, 0), (3, "a", 0), (3, "a", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    w = quality.train(df, labels)
    out = quality.score(df, w).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = quality.train(df, labels.limit(0))
    assert not none.any() and {r.score for r in quality.score(df, none).collect()} == {0.5}
    assert quality.score(df.limit(0), none).count() == 0
    assert isinstance(none, np.ndarray)
