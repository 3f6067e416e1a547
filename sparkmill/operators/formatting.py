"""Instruction rows and chat rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chat template tags.
SYSTEM_TAG = "<|system|>"
USER_TAG = "<|user|>"
ASSISTANT_TAG = "<|assistant|>"
END_TAG = "<|end|>"


def instruction_format(df: DataFrame, *, user_column: str, assistant_column: str,
                       system_column: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Map columns to ``system``/``user``/``assistant`` strings.

    Rows survive only when both user and assistant are non-empty; ``system``
    is filled only when configured and present.  A null is treated as a
    missing value, so a null user or assistant drops the row (the reference
    would keep the text ``"None"``: documented divergence).
    """
    keep = keep or []
    cols = set(df.columns)

    def pick(name: str | None):
        return F.col(f"`{name}`").cast("string") if name and name in cols else F.lit(None).cast("string")

    out = df.select(*[F.col(f"`{c}`") for c in keep], pick(system_column).alias("system"), pick(user_column).alias("user"),
                    pick(assistant_column).alias("assistant"))
    return out.filter((F.coalesce(F.length("user"), F.lit(0)) > 0) &
                      (F.coalesce(F.length("assistant"), F.lit(0)) > 0))


def chat_template_render(df: DataFrame, *, null_system: str = "skip", keep: list[str] | None = None) -> DataFrame:
    """Render ``text`` with the chat tags, parts joined by newline.

    A frame with none of the role columns renders its ``text`` as is.
    ``null_system="skip"`` omits the system part of rows without one;
    ``"literal"`` renders it as ``None`` the way a column-batched loader would.
    """
    keep = keep or []
    cols = set(df.columns)
    parts = []
    if "system" in cols:
        sys_text = F.col("system") if null_system == "skip" else F.coalesce(F.col("system"), F.lit("None"))
        parts.append(F.concat(F.lit(SYSTEM_TAG + "\n"), sys_text))
    if "user" in cols:
        parts.append(F.concat(F.lit(USER_TAG + "\n"), F.coalesce(F.col("user"), F.lit("None"))))
    if "assistant" in cols:
        parts.append(F.concat(F.lit(ASSISTANT_TAG + "\n"), F.coalesce(F.col("assistant"), F.lit("None")),
                              F.lit(END_TAG)))
    if not parts:
        return df.select(*keep, F.col("text").cast("string").alias("text"))
    return df.select(*keep, F.concat_ws("\n", *parts).alias("text"))


def conversation_pairs(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> DataFrame:
    """User turns answered by the next turn's assistant, with the conversation's system turn.

    ``(conv_id, turn, system, user, assistant)``.  "Next turn" is an equi-join
    on ``(conv, turn + 1)`` (turns are dense), and the system prompt (turn 0
    with role system) a second equi-join: both keys are unique per row, so a
    very long conversation causes no skew.
    """
    c = conversations
    users = c.filter(F.col(role_col) == "user").select(conv_col, turn_col, F.col(text_col).alias("user"))
    answers = c.filter(F.col(role_col) == "assistant").select(
        conv_col, (F.col(turn_col) - 1).alias(turn_col), F.col(text_col).alias("assistant"))
    system = c.filter((F.col(role_col) == "system") & (F.col(turn_col) == 0)).select(
        conv_col, F.col(text_col).alias("system"))
    return (users.join(answers, [conv_col, turn_col])
            .join(system, conv_col, "left")
            .select(conv_col, turn_col, "system", "user", "assistant"))
