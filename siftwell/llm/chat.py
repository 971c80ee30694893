"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything is DataFrame functions.  A template states the roles, their headers, the closing mark,
which roles carry loss, and the transitions of the machine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``transitions`` maps a state to {role: next state}; ``start`` is the first state, ``final``
    the states a conversation may end in.  ``headers`` maps a declared role to its name in the
    output.  A turn is ``### Name: `` + escaped text + ``close``."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    close: str = "</turn>"
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )


DEFAULT = Template()
#: A backslash is put behind these characters, so that no control string is left in a text.
_CONTROL = r"\\|#(?=##)|<(?=/turn>)"


def escape(text: Column, t: Template = DEFAULT) -> Column:
    """Texts without control strings; ``unescape`` gives them back."""
    if t.close != "</turn>":
        raise ValueError("the closing mark is </turn>")
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _header(role: Column, t: Template) -> Column:
    """Roles the template doesn't declare are written behind a question mark, ``:`` and ``\\`` escaped."""
    other = F.concat(F.lit("?"), F.regexp_replace(role, r"[:\\]", r"\\$0"))
    return F.concat(F.lit("### "), F.coalesce(F.try_element_at(_literal_map(t.headers), role), other), F.lit(": "))


def format_conversations(turns: DataFrame, template: Template = DEFAULT, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id, valid, error_turn, segments, formatted``.

    ``segments`` is array<struct<role, kind, text, loss>> in order (kind: header, text, close), and
    ``formatted`` their texts in a row.  ``valid`` says whether the machine accepts the roles;
    ``error_turn`` is the index of the first turn it refuses (the number of turns if it only doesn't
    end in a final state), else null.  Refused conversations are formatted as well: the caller
    decides.  Turns go by ``turn``, ties by role and text, null turns first.  Null texts and roles
    are empty strings; repeated rows are repeated turns; rows without an id are one conversation
    with a null id.  Other columns are ignored.
    """
    t = template
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.select(F.col(conv_col).alias("conv_id"), row.alias("_t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    moves = _literal_map({f"{s}\n{r}": to for s, step in t.transitions.items() for r, to in step.items()})
    # state: where the machine is, turns taken, first refused turn
    zero = F.struct(F.lit(t.start).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["at"], F.lit("\n"), x["role"]))
        return F.struct(F.coalesce(to, F.lit("refused")).alias("at"), (acc["n"] + 1).alias("n"), F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"])).alias("bad"))

    def end(acc: Column) -> Column:
        return F.coalesce(acc["bad"], F.when(~acc["at"].isin(*t.final), acc["n"]))

    def segments(x: Column) -> Column:
        s = lambda kind, text, loss: F.struct(x["role"].alias("role"), F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))
        return F.array(s("header", _header(x["role"], t), F.lit(False)), s("text", escape(x["text"], t), x["role"].isin(*t.loss_roles)), s("close", F.lit(f"{t.close}\n"), F.lit(False)))

    out = grouped.select("conv_id", F.aggregate("_turns", zero, step, end).alias("error_turn"), F.flatten(F.transform("_turns", segments)).alias("segments"))
    return out.select("conv_id", F.col("error_turn").isNull().alias("valid"), "error_turn", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_formatted(formatted: Column, template: Template = DEFAULT) -> Column:
    """The array<struct<role, text>> that a formatted conversation was made from."""
    t = template
    known = _literal_map({name: role for role, name in t.headers.items()})
    parts = F.filter(F.split(formatted, f"{t.close}\n", -1), lambda p: p != "")
    head = r"(?s)^### (\?(?:[^:\\]|\\.)*|[^:?]+): (.*)$"

    def turn(p: Column) -> Column:
        name = F.regexp_extract(p, head, 1)
        role = F.when(name.startswith("?"), unescape(F.substring(name, 2, 2147483647))).otherwise(F.try_element_at(known, name))
        return F.struct(role.alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


#: The conversation that the query adds: both turns hold control strings.
_PROBE = "\\### Assistant: </turn> ok"


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    cols = ["conv_id", "turn", "role", "text"]
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"))
    out = format_conversations(table(spark, sf_dir, "conversations").select(*cols).unionByName(probe))
    back = out.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("_turns"), loss_text(F.col("segments")).alias("_loss"), "valid")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP9_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(text)
      + length(text) - length(replace(text, '\\', ''))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
      + 8 AS escaped_and_close,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(role) + length(regexp_replace(role, '[^:\\\\]', '', 'g')) END + 6 AS header,
    lag(role, 1, '^') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(header + escaped_and_close) AS BIGINT) AS formatted_chars,
  bool_and((before || '>' || role) IN ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user') AND (role <> 'system' OR nth = 1))
    AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM e GROUP BY conv_id
"""
