"""Secret scan with DataFrame functions only.

Known kinds are regular expressions.  Beside them, candidate strings are cut into runs of one
character class, a window slides over each run, and its Shannon entropy is kept up to date from
counts that change by one character in and one out; windows at or over the class's threshold make a
span, unless the run has an allowed shape or an allowed word stands near the window.

Positions come from splitting a text by the pattern that also extracts its matches: gaps and matches
alternate, so their lengths add up to code-point offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The known kinds, in the order in which ties are listed.
KINDS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_MIN = 6
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_PLACE = len(KINDS)  # entropy spans come behind the known kinds at the same start


@dataclass(frozen=True)
class CharClass:
    """A run of at least ``window`` characters of ``alphabet`` that has each of ``needs`` is slid
    over; ``bits`` is the least entropy per character of a window that counts."""

    name: str
    alphabet: str
    needs: tuple[str, ...]
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        inside = "".join(f"\\{c}" if not c.isalnum() else c for c in self.alphabet)
        return f"(?<![{inside}])[{inside}]{{{self.window},}}"


CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdef", ("[0-9]", "[a-f]"), 20, 2.9),
    CharClass("entropy_upper", _DIGITS + _LOWER.upper(), ("[0-9]", "[A-Z]"), 16, 3.2),
    CharClass("entropy_lower", _DIGITS + _LOWER, ("[g-z]", "([0-9]+[a-z]+){3}"), 20, 3.6),
    CharClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", ("[0-9]", "[a-z]", "[A-Z]"), 20, 3.6),
)
#: Runs of these shapes aren't secrets: UUIDs, paths.
ALLOW = (r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"^(/[A-Za-z0-9_-]*[a-z]{3}[A-Za-z0-9_-]*){2,}$")
#: Nor are windows within a window's length of one of these: sample keys, alphabets, repeats.  Farther
#: off in the same run, say in another part of a path, they don't clear a key.
ALLOW_NEAR = (r"(?i)example", r"(?i)0123456789|abcdefghij", r"(.)\1{7,}")


def _walk(matches: Column, gaps: Column, kind: str, rank: int, good: Column | None = None, carry: bool = False) -> Column:
    """Spans of matches and the gaps around them.  The arguments must be columns that are there
    already: what a lambda refers to is evaluated anew at each step.  ``good`` has a flag for each
    match.  With ``carry`` the spans hold the matched string in ``kind``."""
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(matches, i))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), (F.get(matches, i) if carry else F.lit(kind)).alias("kind"))
        held = F.concat(acc["spans"], F.array(span.cast(_SPAN)))
        return F.struct(end.alias("at"), (F.when(F.get(good, i), held).otherwise(acc["spans"]) if good is not None else held).alias("spans"))

    walk = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when((F.size(matches) > 0) & (F.size(gaps) > 0), walk).otherwise(empty)


def entropy_range(run: Column, c: CharClass) -> Column:
    """struct<first, last>: the first and the last start of a window of ``run`` at or over the
    threshold, null where there is none.  ``sum`` is the sum of n*log2(n) over the counts, so the
    entropy is log2(window) - sum/window; one character in and one out change it by two terms each."""
    import math

    place = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    limit = c.window * (math.log2(c.window) - c.bits) + 1e-9
    nlogn = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(c.window + 2)])
    g = lambda n: F.get(nlogn, n)
    zero = F.struct(F.array_repeat(F.lit(0), len(c.alphabet)).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, i: Column) -> Column:
        new, old = F.get(place, i), F.when(i >= c.window, F.get(place, i - c.window)).otherwise(-1)
        less = F.when(old >= 0, g(F.get(acc["n"], old) - 1) - g(F.get(acc["n"], old))).otherwise(0.0)
        have = F.get(acc["n"], new) - F.when(old == new, 1).otherwise(0)
        total = acc["sum"] + less + g(have + 1) - g(have)
        counts = F.transform(acc["n"], lambda n, k: n + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
        hot = (i >= c.window - 1) & (total <= limit)
        at = i - (c.window - 1)
        return F.struct(counts.alias("n"), total.alias("sum"), F.when(hot & (acc["first"] < 0), at).otherwise(acc["first"]).alias("first"), F.when(hot, at).otherwise(acc["last"]).alias("last"))

    done = lambda acc: F.when(acc["first"] >= 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), zero, step, done)


def entropy_spans(runs: Column, c: CharClass, rank: int, allow: tuple[str, ...] = ALLOW, allow_near: tuple[str, ...] = ALLOW_NEAR) -> Column:
    """Spans of the windows of one class that have high entropy; ``runs`` are spans that carry theirs.

    ``allow`` is matched with the whole run, ``allow_near`` with the span and a window before and behind it."""

    def wanted(s: Column) -> Column:
        ok = F.lit(True)
        for need in c.needs:
            ok = ok & s["kind"].rlike(need)
        for pattern in allow:
            ok = ok & ~s["kind"].rlike(pattern)
        return ok

    def unknown(s: Column) -> Column:
        first = F.greatest(s["at"]["first"] - c.window, F.lit(0))
        around = F.substr(s["run"], first + 1, s["at"]["last"] + 2 * c.window - first)
        ok = s["at"].isNotNull()
        for pattern in allow_near:
            ok = ok & ~around.rlike(pattern)
        return ok

    hot = F.transform(F.filter(runs, wanted), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("run"), entropy_range(s["kind"], c).alias("at")))
    return F.transform(
        F.filter(hot, unknown),
        lambda s: F.struct((s["start"] + s["at"]["first"]).alias("start"), F.lit(rank).alias("rank"), (s["start"] + s["at"]["last"] + c.window).alias("end"), F.lit(c.name).alias("kind")).cast(_SPAN),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, *, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, allow_near: tuple[str, ...] = ALLOW_NEAR) -> DataFrame:
    """``docs`` with ``secrets`` and ``base_secrets`` added, array<struct<start, end, kind>> by start.

    ``base_secrets`` has the known kinds alone.  Offsets are code points, ends exclusive.  A null text
    is empty and has no spans.  Columns of those names are replaced; all others, whatever their names,
    and all rows stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("secrets", "base_secrets")])
    own = "_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = KINDS | {c.name: c.pattern for c in classes}
    m, g, s, good = ({k: f"{own}{x}_{k}" for k in patterns} for x in ("m", "g", "s", "ok"))
    found = {m[k]: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()}
    got = docs.withColumns(found)
    # most texts have no match, and are neither split nor matched again
    there = lambda k: F.size(m[k]) > 0
    more = {g[k]: F.when(there(k), F.split(text, p, -1)) for k, p in patterns.items()}
    more[good["assign"]] = F.when(there("assign"), F.transform(F.regexp_extract_all(text, F.lit(KINDS["assign"]), F.lit(2)), lambda x: F.length(x) >= ASSIGN_MIN))
    got = got.withColumns(more)
    spans = {s[k]: _walk(F.col(m[k]), F.col(g[k]), k, i, F.col(good[k]) if k == "assign" else None, carry=i >= _PLACE) for i, k in enumerate(patterns)}
    got = got.withColumns(spans).withColumns({s[c.name]: entropy_spans(F.col(s[c.name]), c, _PLACE + i, allow, allow_near) for i, c in enumerate(classes)})
    tidy = lambda ks: F.transform(F.sort_array(F.concat(*[F.col(s[k]) for k in ks])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return got.withColumns({"secrets": tidy(patterns), "base_secrets": tidy(KINDS)}).drop(*found, *more, *spans)


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every stretch of overlapping or touching spans replaced by ``mark``.

    A null text stays null, and so does a text beside null spans."""
    piece = lambda a, b: F.substr(text, a + 1, b - a)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        apart = (s["start"] > acc["at"]) | ((acc["at"] == 0) & (acc["out"] == ""))
        out = F.when(apart, F.concat(acc["out"], piece(acc["at"], F.greatest(s["start"], acc["at"])), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    end = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, end)).otherwise(text)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[n(k) for k in KINDS], F.sha2(_joined(F.col("base_secrets")), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
