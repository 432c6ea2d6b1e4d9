"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged into runs of one role and concatenated. A run is

    user       [INST] text [SEP] text [/INST]
    assistant  <s>text[SEP]text</s>
    others     [ROLE]role[TEXT]text[SEP]text[/ROLE]

(without the spaces around [SEP]). A backslash in a text is doubled, and a control string gets one after its first
character, so no text can end its turn, and `parse` gives back every original turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQUARE, ANGLE = r"\[(/?(?:INST|ROLE|TEXT|SEP)\])", r"<(/?s>)"
RUN = r"(?s)\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\[/ROLE\]"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, SQUARE, r"[\\$1"), ANGLE, r"<\\$1")


def unescape(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, r"\[\\(/?(?:INST|ROLE|TEXT|SEP)\])", "[$1"), r"<\\(/?s>)", "<$1")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def _open(role: Column) -> Column:
    return F.when(role == "user", "[INST] ").when(role == "assistant", "<s>").otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[TEXT]")))


def _close(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").otherwise("[/ROLE]")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans) for every conversation.

    loss_spans are [first, last) positions, in code points of `formatted`, of the assistant's texts. Turns are ordered by
    turn, then role, then text; a null turn comes last. Null role and null text: empty. Rows with a null conv_id form one
    conversation. Repeated rows are turns of their own. Other columns are not read.
    """
    q = lambda c: F.col(f"`{c}`")
    rows = turns.select(
        q(conv_col).alias("conv_id"),
        F.struct(
            q(turn_col).isNull().alias("open"),
            q(turn_col).alias("turn"),
            F.coalesce(q(role_col), F.lit("")).alias("role"),
            F.coalesce(q(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    runs = sorted_turns.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                F.when((i > 0) & (F.get(F.col("turns"), i - 1)["role"] == t["role"]), F.lit("[SEP]")).otherwise(_open(t["role"])).alias("before"),
                escape(t["text"]).alias("body"),
                F.when(F.coalesce(F.get(F.col("turns"), i + 1)["role"] == t["role"], F.lit(False)), F.lit("")).otherwise(_close(t["role"])).alias("after"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ),
    )
    size = lambda p: F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])
    starts = F.aggregate("parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + size(p))))
    spans = F.transform(
        F.arrays_zip("parts", F.slice("starts", 1, F.size("parts")).alias("starts")),
        lambda z: F.struct(
            (z["starts"] + F.length(z["parts"]["before"])).alias("first"),
            (z["starts"] + F.length(z["parts"]["before"]) + F.length(z["parts"]["body"])).alias("last"),
            z["parts"]["loss"].alias("loss"),
        ),
    )
    return runs.withColumn("starts", starts).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of the original turns in a formatted conversation."""

    def turns(run: Column) -> Column:
        user, assistant = run.startswith("[INST] "), run.startswith("<s>")
        role = F.when(user, "user").when(assistant, "assistant").otherwise(unescape(F.regexp_extract(run, r"(?s)^\[ROLE\](.*?)\[TEXT\]", 1)))
        n = F.length(run)
        body = (
            F.when(user, F.substring(run, F.lit(8), n - 15))
            .when(assistant, F.substring(run, F.lit(4), n - 7))
            .otherwise(F.regexp_extract(run, r"(?s)^\[ROLE\].*?\[TEXT\](.*)\[/ROLE\]$", 1))
        )
        return F.transform(F.split(body, r"\[SEP\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(RUN), F.lit(0)), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["first"] + 1, s["last"] - s["first"]))), "")
