"""Generated answers: text to HTML and back, and their parts by citation."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_to_html(c: Column) -> Column:
    """Escaped; lines that begin with a bullet become list items, a text before three or more spaces a
    bold heading, other line feeds breaks."""
    e = F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    e = F.regexp_replace(e, r"(?m)^[ \t]*[•*-][ \t]+(.*)$", "<li>$1</li>")
    e = F.regexp_replace(e, r"((?:<li>[^\n]*</li>\n?)+)", "<ul>$1</ul>")
    e = F.regexp_replace(e, r"(?m)^(?!<)(\S[^\n]*?) {3,}(\S)", "<b>$1</b><br>$2")
    return F.regexp_replace(F.regexp_replace(e, r"</li>\n", "</li>"), r"\n", "<br>")


class _Plain(HTMLParser):
    BREAKS = {"p", "div", "br", "ul", "ol", "h1", "h2", "h3", "h4", "tr"}

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "li":
            self.out.append("\n• ")
        elif tag in self.BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_text(source: str | None) -> str:
    p = _Plain()
    p.feed(source or "")
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return "\n".join(x for x in lines if x)


def segments(answer: str | None) -> list[dict]:
    """Parts of an answer that end in citations ``[1]`` or ``[1][2]``: position, text, numbers.

    What follows the last citation is a part without numbers."""
    out, at = [], 0
    for m in re.finditer(r"(?:\s*\[\d+\])+", answer or ""):
        text = (answer or "")[at : m.start()].strip()
        numbers = [int(x) for x in re.findall(r"\d+", m[0])]
        if text:
            out.append({"position": len(out) + 1, "text": text, "sources": numbers})
        elif out:
            out[-1]["sources"] += numbers
        at = m.end()
    rest = (answer or "")[at:].strip()
    if rest:
        out.append({"position": len(out) + 1, "text": rest, "sources": []})
    return out


_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


def uuid_urls(raw: str | None) -> dict[str, list[str]]:
    """From nested JSON lists, the addresses that stand in a list with an identifier or below it."""
    found: dict[str, list[str]] = {}

    def walk(x, names: list[str]) -> None:
        if isinstance(x, dict):
            x = list(x.values())
        if isinstance(x, list):
            here = [v for v in x if isinstance(v, str) and _UUID.fullmatch(v)] or names
            for v in x:
                walk(v, here)
        elif isinstance(x, str) and re.match(r"https?://", x):
            for n in names:
                if x not in found.setdefault(n, []):
                    found[n].append(x)

    try:
        walk(json.loads(raw or "null"), [])
    except ValueError:
        return {}
    return found


def _texts(s: pd.Series) -> pd.Series:
    return s.map(html_to_text)


def _segments(s: pd.Series) -> pd.Series:
    return s.map(segments)


def plain_text(c: Column) -> Column:
    """HTML as lines of text with bullets; null is empty."""
    return F.pandas_udf(_texts, "string")(c)


def answer_segments(c: Column) -> Column:
    """array<struct<position, text, sources>> of an answer."""
    return F.pandas_udf(_segments, "array<struct<position:int,text:string,sources:array<int>>>")(c)
