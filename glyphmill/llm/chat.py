"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context and only
this reply is trainable. A conversation is gathered once (one shuffle on conv_id) and expanded in
place by higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def expand(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, turn, n_context, prompt, target, train_start, train_end: an example for each turn of target_role.

    prompt is the rendered context and the opening of the reply; target is the reply and its end
    mark; [train_start, train_end) are the characters of prompt || target to learn from. A null text
    counts as empty, a null role as "unknown"; a null turn comes first; rows without conv_id give
    nothing. An empty reply is an example whose target is the end mark. Turns of one number are
    ordered by role, then text, and repeated rows are turns of their own. A conversation without
    such a turn gives no example.
    """
    base = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = base.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    wanted = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == target_role)
    each = turns.select("conv_id", "turns", F.explode(wanted).alias("at"))
    reply = F.element_at("turns", F.col("at"))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at") - 1), rendered), "")
    out = each.select("conv_id", reply["turn"].alias("turn"), (F.col("at") - 1).cast("long").alias("n_context"), F.concat(context, F.lit(f"<|{target_role}|>\n")).alias("prompt"), F.concat(reply["text"], F.lit("<|end|>\n")).alias("target"))
    return out.withColumns({"train_start": F.char_length("prompt").cast("long"), "train_end": (F.char_length("prompt") + F.char_length("target")).cast("long")})


EXPAND_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER w AS n,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '')
           OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, ''))),
e AS (
  SELECT conv_id, turn, (n - 1)::BIGINT AS n_context,
         coalesce(context, '') || '<|assistant|>' || chr(10) AS prompt, text || '<|end|>' || chr(10) AS target
  FROM t WHERE role = 'assistant')
SELECT *, length(prompt)::BIGINT AS train_start, (length(prompt) + length(target))::BIGINT AS train_end FROM e
"""
