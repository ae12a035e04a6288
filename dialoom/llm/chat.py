"""Chat formatting: a finite-state machine over roles and a declarative template.

The template is data: how a turn begins and ends, which roles carry loss,
which role may follow which, and the control strings that texts must not
contain. All work is column expressions.

Defined results: a null text is empty; a null or unknown role is formatted
like any other and makes the order invalid; turns sort by (turn, role, text),
nulls first, so ties and repeated rows have one order; turns with a null
conversation id are one conversation; an empty table gives an empty one. Only
the four named columns are read. A conversation is one row of the result, so
it has to fit into a task, whatever its share of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """begin + role + after_role + text + end for each turn."""

    begin: str = "<|turn|>"
    after_role: str = "\n"
    end: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: First characters of these are broken up inside texts.
    control: tuple[str, ...] = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> role -> next state; anything else is an error.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "primed"),
        ("start", "user", "asked"),
        ("primed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("asked", "answered")

    def openers(self) -> list[str]:
        return sorted({c[0] for c in self.control})


def escape(text: Column, t: Template) -> Column:
    """Double each backslash, then put one after each character that can open a control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.openers():
        out = F.replace(out, F.lit(c), F.lit(c + "\\"))
    return out


def unescape(text: Column, t: Template) -> Column:
    out = text
    for c in reversed(t.openers()):
        out = F.replace(out, F.lit(c + "\\"), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def format_chat(turns: DataFrame, t: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its segments (text, loss), the formatted string and whether the order is valid.

    Roles are written URL-encoded, so any role reads back as it was.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("m"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    allowed = F.create_map(*[F.lit(x) for a, r, b in t.moves for x in (f"{a}\n{r}", b)])
    state = F.aggregate("turns", F.lit("start"), lambda s, m: F.coalesce(F.element_at(allowed, F.concat(s, F.lit("\n"), m["role"])), F.lit("error")))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda m: F.array(
                F.struct(F.concat(F.lit(t.begin), F.url_encode(m["role"]), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(m["text"], t).alias("text"), m["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return convs.select("conv_id", state.isin(*t.final).alias("valid_order"), segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, t: Template = Template()) -> DataFrame:
    """The turns (role, text) parsed from the formatted string, and the unescaped loss text of the segments."""
    pieces = F.filter(F.split("formatted", _literal(t.begin), -1), lambda p, i: i > 0)
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, t.after_role, 1)).alias("role"),
            unescape(F.substring_index(F.substr(p, F.length(F.substring_index(p, t.after_role, 1)) + F.lit(1 + len(t.after_role))), t.end, 1), t).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    return formatted.withColumn("parsed", parsed).withColumn("loss_text", loss)


def chat_digest(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """The digest columns of every conversation, read back from the output."""
    back = read_back(format_chat(turns, t), t)
    return back.select(
        "conv_id",
        F.size("parsed").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parsed", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid_order",
    )
