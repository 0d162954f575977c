"""Operator 6, chat formatting by grammar round trip (DataFrame functions only).

Grammar of a rendered conversation, one production per turn:

    conversation := turn*
    turn         := "### " role ": " text "</turn>\n"

`role` holds neither ":" nor a newline (percent codes stand for them), `text` holds no closing mark. Every conversation is first
rendered as it stands, parsed again and compared with its source; the turns that do not come back identical, or that hold a control
string, are rendered again with these strings stuffed (one more backslash), until the parse gives the source back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import let, table

HEAD, MID, END = "### ", ": ", "</turn>\n"
#: Control strings inside a text, with the backslashes that already stand there; stuffing adds one, unstuffing takes one.
STUFF = ((r"<(\\*)/turn>", r"<\\$1/turn>"), (r"(\\*)### ", r"\\$1### "))
UNSTUFF = ((r"<\\(\\*)/turn>", r"<$1/turn>"), (r"\\(\\*)### ", r"$1### "))


def _sub(text: Column, rules) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def _put_role(role: Column) -> Column:
    for raw, code in (("%", "%25"), (":", "%3A"), ("\n", "%0A")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _get_role(role: Column) -> Column:
    for raw, code in (("\n", "%0A"), (":", "%3A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def render(turns: Column, escaped: bool) -> Column:
    """Turns (array of struct with role and text) as one string."""
    body = (lambda t: _sub(t["text"], STUFF)) if escaped else (lambda t: t["text"])
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), _put_role(t["role"]), F.lit(MID), body(t), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The deterministic parser: what `render` wrote, as an array of struct(role, text)."""

    def turn(seg: Column) -> Column:
        at = F.instr(seg, MID)
        return F.struct(
            _get_role(F.substr(seg, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"),
            _sub(F.substr(seg, at + len(MID)), UNSTUFF).alias("text"),
        )

    return let(F.split(formatted, END, -1), lambda parts: F.transform(F.slice(parts, 1, F.size(parts) - 1), turn))


def chat_format(conversations: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, `formatted` (the rendered text), `turns` (read back from it), `escaped` (whether it needed stuffing).

    Defined results: a null text or role is empty; a null id is a conversation of its own (id null); turns go by order_col (nulls
    first), ties by role, then text, and repeated rows are repeated turns; an empty table gives no rows; other columns are not read.
    """
    src = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(order_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    grouped = src.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    conflict = F.exists("source", lambda t: t["text"].rlike(r"<\\*/turn>|### "))
    first = grouped.select("conv_id", "source", render(F.col("source"), False).alias("plain"), conflict.alias("conflict"))
    same = ~F.col("conflict") & (parse(F.col("plain")) == F.col("source"))
    second = first.select("conv_id", "source", F.when(same, F.col("plain")).otherwise(render(F.col("source"), True)).alias("formatted"), (~same).alias("escaped"))
    back = second.select("conv_id", "source", "formatted", "escaped", parse(F.col("formatted")).alias("turns"))
    # stuffing is reversible for every text, so the second round always agrees; a grammar change that broke this would raise here
    checked = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("chat grammar does not round-trip")).cast(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))))
    return back.select("conv_id", "formatted", checked.alias("turns"), "escaped")


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    out = chat_format(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), loss_text(F.col("turns")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT *, max(CASE WHEN regexp_matches(text, '<\\*/turn>|### ') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS hard,
         length(text) AS plain_len,
         length(regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '(\\*)### ', '\\\1### ', 'g')) AS stuffed_len
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '')) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + CASE WHEN hard = 1 THEN stuffed_len ELSE plain_len END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
