"""Chat formatting by perspective rotation. Operator 7, of DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that participant as the assistant; the others are users, told apart by
their name, and the system's turns stay the system's. The mask tells which characters are to be learnt: the assistant's words
and the mark that ends each of its turns.

Participants are the roles of a conversation but `system`; one of system turns alone has no perspective and gives no row. Turns are ordered by turn, then
role, then text; repeated rows are turns of their own. A null role is the participant with the empty name, a null text is empty, a null turn comes first. Rows without
conv_id belong to no conversation and are left out. A dialogue is rendered in parts of PART turn numbers, from 0, so that one that holds
a large share of all rows is no single row; a part without a turn of the participant is rendered with an empty mask; part=None renders each dialogue whole. Empty tables give no rows.

No text or name can pass for a marker: where one holds `<|`, with or without backslashes between the two, a backslash goes before the `|`; so does, in names, one before the `>` of `|>`. Taking one
backslash out of each gives the original back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 4096
END = "<|end|>\n"


def escaped(text: Column, name: bool = False) -> Column:
    """text without the beginnings of markers; in a name without their ends as well."""
    text = F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")
    return F.regexp_replace(text, r"\|(\\*)>", r"|$1\\>") if name else text


def perspectives(conversations: DataFrame, part: int | None = PART) -> DataFrame:
    """conv_id, part, perspective, n_turns, n_learnt (turns), rendered, mask: an array of structs start and end, in characters."""
    turns = conversations.where("conv_id is not null").select(
        "conv_id", F.lit(0).cast("long").alias("part") if part is None else F.coalesce(F.floor(F.col("turn") / part), F.lit(0)).cast("long").alias("part"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    people = turns.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    whole = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.withColumn("turns", F.concat(F.filter("turns", lambda t: t["turn"].isNull()), F.filter("turns", lambda t: t["turn"].isNotNull())))
    each = whole.join(people, "conv_id")
    head = lambda t: F.when(t["role"] == F.col("perspective"), "<|assistant|>\n").when(t["role"] == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user:"), escaped(t["role"], True), F.lit("|>\n")))
    each = each.withColumn("pieces", F.transform("turns", lambda t: F.struct((t["role"] == F.col("perspective")).alias("own"), head(t).alias("head"), F.concat(escaped(t["text"]), F.lit(END)).alias("body"))))
    span = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(s["mask"], F.array(F.struct((s["at"] + F.char_length(p["head"])).alias("start"), (s["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) - 1).alias("end"))))).otherwise(s["mask"]).alias("mask"),
        ),
    )
    return each.select(
        "conv_id", "part", "perspective", F.size("pieces").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_learnt"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"), span["mask"].alias("mask"),
    )


ORACLE = r"""
WITH turns AS (SELECT conv_id, coalesce(floor(turn / 4096), 0)::BIGINT AS part, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
pieces AS (
    SELECT t.conv_id, part, perspective, t.role = perspective AS own, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' || chr(10) AS body,
        CASE WHEN t.role = perspective THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>' ELSE '<|user:' || regexp_replace(regexp_replace(t.role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') || '|>' END || chr(10) AS head,
        row_number() OVER (PARTITION BY t.conv_id, part, perspective ORDER BY turn NULLS FIRST, t.role, text) AS nth
    FROM turns t JOIN people USING (conv_id)),
placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, perspective ORDER BY nth) - length(body) AS body_at FROM pieces)
SELECT conv_id, part, perspective, count(*) AS n_turns, count(*) FILTER (own) AS n_learnt, string_agg(head || body, '' ORDER BY nth) AS rendered,
    coalesce(string_agg((body_at)::BIGINT || ':' || (body_at + length(body) - 1)::BIGINT, ' ' ORDER BY nth) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, part, perspective
"""
