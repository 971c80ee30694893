"""Each stage of the pipeline against brute force on its own input."""

from collections import defaultdict

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
from siftwell.llm import jaccard
from siftwell.llm.common import store
from tokenizers import Tokenizer

from .test_jaccard import brute as groups
from .test_secrets import base, entropy
from .test_tokens import check_packing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = []
    for name, stage in cp.STAGES:
        docs, _ = store(stage(spark, docs, sf_dir), "test")
        seen.append({r.doc_id: r for r in docs.collect()} if name != cp.STAGES[-1][0] else docs.collect())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    good, lined, single, clean, packed = seen
    assert sum(i in good for i, y in labels.items() if y == 1) > 0.95 * sum(labels.values())
    at = defaultdict(set)
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, r in good.items():
        for x in r.text.split("\n"):
            at[key(x)].add(i)
    for i, r in good.items():
        assert lined[i].text == "\n".join(x for x in r.text.split("\n") if not key(x) or len(at[key(x)]) < 10)
        assert lined[i].n_chars == len(lined[i].text)
    top, _ = groups([(i, r.text) for i, r in lined.items()], jaccard.Join())
    assert set(single) == {i for i in lined if top[i] == i}
    for i, r in single.items():
        spans = sorted((s[0], s[2]) for s in base(r.text) + entropy(r.text))
        text, at_ = "", 0
        for a, b in spans:
            if a > at_ or not text and not at_:
                text += r.text[at_:a] + "[REDACTED]"
            at_ = max(at_, b)
        assert clean[i].text == text + r.text[at_:]
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    check_packing([(r.sequence_id, r.offset, r.length) for r in packed], 2048)
    ids = defaultdict(list)
    for r in sorted(packed, key=lambda r: r.start):
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert ids == {i: [*lib.encode(r.text, add_special_tokens=False).ids, 0] for i, r in clean.items()}


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
