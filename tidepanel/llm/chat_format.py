"""Chat formatting by prefix-target expansion, in built-in functions only.

Every assistant turn becomes an example: all turns before it as context and its own reply, of which
only the reply's text is trainable (``loss_start`` to ``loss_end``, code points of ``formatted``).
Turns after the last assistant turn (or all, if there is none) become one example without a target, so
that a conversation can be read back whole.

The template wraps a turn as ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and texts
are broken by a backslash after their first character and backslashes are doubled, so a control
string in the output is always markup, and dropping one backslash of each pair undoes it.

Turns are ordered by turn, then role and text; nulls sort first. Null roles and texts are empty. A
null conv_id is a conversation of its own. An example is one string, so a conversation fits in a row
by nature; the output grows with the square of its number of assistant turns by definition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    turn_open: str = "<s>[INST]"
    role_close: str = "[/INST]"
    turn_close: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def _pattern(self) -> str:
        by_first: dict[str, list[str]] = {}
        for c in self.control:
            by_first.setdefault(c[0], []).append(_literal(c[1:]))
        parts = [f"{_literal(first)}(?=" + "|".join(rest) + ")" for first, rest in by_first.items()]
        return "(\\\\|" + "|".join(parts) + ")"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(self._pattern()), F.lit("$1\\\\"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))

    def turn_head(self, role: Column) -> Column:
        return F.concat(F.lit(self.turn_open), self.escape(role), F.lit(self.role_close))

    def turns(self, formatted: Column) -> Column:
        """Read back: array of (role, text) of a formatted string."""
        pieces = F.split(formatted, F.lit(_literal(self.turn_close)), -1)
        return F.transform(
            F.slice(pieces, 1, F.size(pieces) - 1),
            lambda p: F.struct(
                self.unescape(
                    F.substring(F.substring_index(p, self.role_close, 1), F.lit(len(self.turn_open) + 1), F.char_length(p))
                ).alias("role"),
                self.unescape(
                    F.substring(p, F.char_length(F.substring_index(p, self.role_close, 1)) + len(self.role_close) + 1, F.char_length(p))
                ).alias("text"),
            ),
        )


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


TEMPLATE = Template()


def expand(conversations: DataFrame, template: Template = TEMPLATE, target_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (from 0), target_turn, formatted, loss_start, loss_end, n_turns, is_last.

    One shuffle, by conv_id. ``target_turn`` and the loss bounds are null for an example without a
    target. Columns other than conv_id, turn, role and text are ignored.
    """
    c = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), c.alias("text"),
        ).alias("t"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    heads = gathered.select(
        "conv_id", "ts",
        F.transform(
            "ts",
            lambda t: F.struct(
                t["turn"].alias("turn"), t["role"].alias("role"),
                template.turn_head(t["role"]).alias("head"), template.escape(t["text"]).alias("body"),
            ),
        ).alias("parts"),
    ).select("conv_id", "parts", F.size("parts").alias("n_turns"))
    ends = F.filter(
        F.sequence(F.lit(1), F.col("n_turns")),
        lambda i: (F.get(F.col("parts"), i - 1)["role"] == target_role) | (i == F.col("n_turns")),
    )
    examples = heads.select("conv_id", "parts", "n_turns", F.posexplode(ends).alias("example", "upto"))
    reply = F.get("parts", F.col("upto") - 1)
    is_target = reply["role"] == target_role
    closed = F.concat_ws(
        "",
        F.transform(
            F.slice("parts", 1, F.col("upto") - 1),
            lambda p: F.concat(p["head"], p["body"], F.lit(template.turn_close)),
        ),
    )
    opened = examples.select(
        "conv_id", "example", "n_turns", "upto", reply["turn"].alias("turn"), is_target.alias("is_target"),
        F.concat(closed, reply["head"]).alias("before"), reply["body"].alias("body"),
    )
    start = F.char_length("before")
    return opened.select(
        "conv_id", "example", F.when(F.col("is_target"), F.col("turn")).alias("target_turn"),
        F.concat("before", "body", F.lit(template.turn_close)).alias("formatted"),
        F.when(F.col("is_target"), start).alias("loss_start"),
        F.when(F.col("is_target"), start + F.char_length("body")).alias("loss_end"),
        "n_turns", (F.col("upto") == F.col("n_turns")).alias("is_last"),
    )


def read_back(examples: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, from the examples alone: turns, text under the loss mask and sizes.

    Stays in the partitioning of ``expand``; the last example holds every turn.
    """
    loss = template.unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    return (
        examples.select(
            "conv_id", F.char_length("formatted").cast("bigint").alias("size"),
            F.struct("example", F.coalesce(loss, F.lit("")).alias("text")).alias("loss"),
            F.when(F.col("is_last"), F.col("formatted")).alias("whole"),
        )
        .groupBy("conv_id")
        .agg(
            F.max("whole").alias("whole"), F.sum("size").alias("formatted_chars"),
            F.concat_ws("", F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"])).alias("loss_text"),
        )
        .select("conv_id", template.turns(F.col("whole")).alias("turns"), "loss_text", "formatted_chars")
    )
