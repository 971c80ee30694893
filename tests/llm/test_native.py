"""Chat formatting and line de-duplication."""

import hashlib
from collections import defaultdict

import pytest

from siftwell.llm import chat, lines, registry


def test_op9_sql(same_as_duckdb):
    rows = same_as_duckdb(registry.queries()["op9_chat_formatting"], registry.oracle_sql()["op9_chat_formatting"])
    assert len(rows) > 10


def test_op10_sql(same_as_duckdb):
    same_as_duckdb(registry.queries()["op10_line_dedup"], registry.oracle_sql()["op10_line_dedup"])


def test_chat_round_trip_and_machine(spark):
    odd = ["", "###", "####", "\\", "\\\\###", "</turn>", "</turn</turn>\n", "a\\n</turn>\n### User: x", "#" * 9, "$1 \\$0", "ü\U0001f600"]
    rows = [(i, 0, "user", x, "z") for i, x in enumerate(odd)] + [(i, 1, "assistant", x[::-1], "z") for i, x in enumerate(odd)]
    rows += [(100, 0, "tool:\\x", "a", "z"), (101, 0, None, None, "z"), (102, 0, "assistant", "a", "z"), (103, 1, "user", "b", "z"), (103, None, "system", "a", "z"), (None, 0, "user", "q", "z"), (104, 0, "user", "same", "z"), (104, 0, "user", "same", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(df).select("*", chat.parse_formatted(chat.F.col("formatted")).alias("turns"), chat.loss_text(chat.F.col("segments")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    for c, turns in want.items():
        assert [tuple(x) for x in got[c].turns] == turns, c
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert got[c].formatted.count("</turn>") == len(turns)
    assert all(got[i].valid for i in range(len(odd)))
    assert [got[i].error_turn for i in (100, 101, 102, 103, 104)] == [0, 0, 0, 2, 1]


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).count() == 0


@pytest.mark.parametrize("hot", [1, 11, lines.HOT])
def test_lines_brute(spark, hot):
    rows = [(i, "Same\n" + f"own {i}\n\n SAME \t", "k") for i in range(9)] + [(9, "x\n same", "k"), (10, None, "k"), (11, "", "k"), (12, "same", "k"), (None, "\x0bsame\x0b\nother", "k"), (0, "again\nsame", "k"), (12, "same", "k"), (13, "l\n" * 30000 + "same", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.drop_frequent_lines(df, hot=hot).collect()), key=str)
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    at = defaultdict(set)
    for d, x, _ in rows:
        for one in (x or "").split("\n"):
            at[key(one)].add(d)
    want = []
    for d, x, _ in rows:
        all_lines = (x or "").split("\n")
        keep = [y for y in all_lines if not key(y) or len(at[key(y)]) < 10]
        want.append((d, "\n".join(keep), len(all_lines), len(all_lines) - len(keep)))
    assert got == sorted(want, key=str)


def test_lines_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_frequent_lines(df).count() == 0
    assert hashlib.sha256(b"").hexdigest()
