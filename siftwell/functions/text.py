"""Text, number and JSON helpers: pure column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(c: Column) -> Column:
    """Digits with at most one point as a double; signs and exponents aren't numbers here."""
    return F.when(c.rlike(r"^(\d+\.?\d*|\.\d+)$"), c.try_cast("double"))


def last_number(c: Column) -> Column:
    """The number behind the last colon, or null."""
    return F.trim(F.element_at(F.split(c, ":"), -1)).try_cast("double")


def score_range(n: Column) -> Column:
    """Five ranges with inclusive ends; what is outside is null."""
    return F.when((n >= 0) & (n <= 20), "0-20").when((n > 20) & (n <= 40), "21-40").when((n > 40) & (n <= 60), "41-60").when((n > 60) & (n <= 80), "61-80").when((n > 80) & (n <= 100), "81-100")


def slug(c: Column) -> Column:
    """Lower case, runs of what isn't a letter, digit or underscore as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_]+", "-"), r"^-+|-+$", "")


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")


def truncated(c: Column, n: int = 30000, keep: int = 29900, mark: str = "... [Text truncated due to excessive length]") -> Column:
    """Texts over n characters cut to ``keep``, with a mark."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, keep), F.lit(mark))).otherwise(c)


def terms(c: Column) -> Column:
    """Lower-case words of a query."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def without_stop_words(words: Column, stop: list[str]) -> Column:
    """Order and repeats stay; if nothing would be left, all words stay."""
    kept = F.filter(words, lambda t: ~F.array_contains(F.array(*[F.lit(s) for s in stop]), t))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def terms_in(words: Column, text: Column) -> Column:
    """How many of the words are contained in the text."""
    return F.size(F.filter(words, lambda t: F.contains(F.lower(text), t)))


def phrase_density(text: Column, phrase: Column) -> Column:
    """Percent of words that belong to exact occurrences of the phrase, cut to two decimals."""
    t, p = F.lower(text), F.lower(F.trim(phrase))
    n = (F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.when((F.length(p) > 0) & (words > 0), F.floor(n * F.size(F.split(p, r"\s+")) / words * 10000) / 100).otherwise(0.0)


def wildcard_density(text: Column, word: Column) -> Column:
    """Whole percent of words that contain the query word; an empty query is null."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.contains(w, F.lower(word))))
    return F.when(F.length(F.trim(word)) > 0, F.when(F.size(words) > 0, F.floor(100.0 * hits / F.size(words)).cast("double")).otherwise(0.0))


def like_pattern(wildcard: str) -> str:
    """A file-name wildcard (``*`` and ``?``) as a LIKE pattern in lower case."""
    out = wildcard.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return out.replace("*", "%").replace("?", "_")


def matches_wildcard(text: Column, wildcard: str) -> Column:
    return F.lower(text).like(like_pattern(wildcard))


def distinct_percentages(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?\s*%"), F.lit(0))))


def distinct_years(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(19[5-9]\d|20[0-3]\d)\b"), F.lit(1))))


def quotation_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[\"“”„«»]"))


def chunks(text: Column, n: int = 150) -> Column:
    """The words in pieces of n."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w), F.lit(n)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def cosine_percent(x: Column, y: Column) -> Column:
    """Cosine as a percentage from 0 to 100, two decimals; zero vectors give 0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y))))), 2), F.lit(0.0))


def salvaged_json(c: Column) -> Column:
    """A JSON object from an answer: code fences go, else the widest braces; null if there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    wide = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    ok = lambda x: F.when(x.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(ok(bare), ok(wide))


def prompt_keys(prompt: Column) -> Column:
    """Quoted names before a colon inside the first braces of a prompt."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_extract(prompt, r"(?s)\{([^}]*)\}", 1), F.lit(r"""["']([A-Za-z_][A-Za-z0-9_ ]*)["']\s*:"""), F.lit(1)))


def expected_entries(json: Column, keys: Column) -> Column:
    """The entries of a JSON object whose keys are expected, case ignored; no keys let all pass."""
    low = F.transform(keys, F.lower)
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: (F.size(low) == 0) | F.array_contains(low, F.lower(k)))


def active_tasks(json: Column, kind: str) -> Column:
    """How many tasks of a JSON list are active (the default) and aim at the kind or at all."""
    t = F.from_json(json, "array<struct<name:string,target_type:string,active:boolean>>")
    return F.size(F.filter(t, lambda x: F.coalesce(x["active"], F.lit(True)) & (x["target_type"].isNull() | x["target_type"].isin("all", kind))))


def camel(name: str) -> str:
    """``snake_case`` as ``CamelCase``."""
    return "".join(p[:1].upper() + p[1:] for p in name.split("_"))


def hours_between(since: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", since, now) / 3600.0


def answer_as_text(c: Column) -> Column:
    """An AI answer as one line: line feeds end sentences, stars go."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("*"), F.lit("")), r"\n+", ". "))
