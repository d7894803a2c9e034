"""Preference formatting: one prompt and two masked completions per pair of conversations.

The longest run of equal turns from the start of a chosen and a rejected
conversation is rendered once as the prompt; what follows in each is its
completion. Loss falls on what the assistant says, with the mark that ends the
turn; these stretches are given as character spans of each completion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>"


def _clean(text: Column) -> Column:
    """A text cannot contain a mark of the template: its ``<|`` becomes ``< |``."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def turns_of(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): the turns of each conversation in order, as (role, text).

    Turns with the same number stand in the order of role and text, and repeated
    rows stay; turns without a number come first. A NULL role or text is empty.
    Rows without a key belong to no conversation.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), _clean(F.col("text")).alias("text"))
    turns = conversations.select(F.col(key).alias(key), turn.alias("turn")).dropna(subset=[key])
    turns = turns.groupBy(key).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(left: Column, right: Column) -> Column:
    """Number of equal turns from the start of two arrays."""
    shorter = F.least(F.size(left), F.size(right))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda k: F.get(left, k - 1) != F.get(right, k - 1))
    return F.coalesce(F.array_min(differ) - 1, shorter)


def _before(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_before(t), t["text"], F.lit(END + MIDDLE))), "")


def _loss_spans(turns: Column) -> Column:
    """(start, end) of every assistant turn's text and end mark in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.char_length(_before(turn))
        end = begin + F.char_length(turn["text"]) + len(END)
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(MIDDLE)).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Per pair: pair_id, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans.

    ``pairs`` holds pair_id and the arrays chosen and rejected of turns_of; a
    NULL array is an empty conversation. Equal conversations give two empty
    completions; conversations that differ from the first turn on give an empty
    prompt. Rows that repeat a pair_id are formatted one by one.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select("pair_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    rows = rows.withColumn("shared", common_prefix(F.col("chosen"), F.col("rejected")))

    def after(side: str) -> Column:
        return F.slice(side, F.col("shared") + 1, F.size(side))

    return rows.select(
        "pair_id", F.col("shared").alias("prompt_turns"), _rendered(F.slice("chosen", F.lit(1), F.col("shared"))).alias("prompt"),
        _rendered(after("chosen")).alias("chosen"), _loss_spans(after("chosen")).alias("chosen_spans"),
        _rendered(after("rejected")).alias("rejected"), _loss_spans(after("rejected")).alias("rejected_spans"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: the rejected one ends with the partner's last answer.

    Chosen is a conversation up to its last assistant turn. Rejected is the same
    with that turn replaced by the last assistant turn of the conversation whose
    id differs in the lowest bit, or left out if there is none.
    """
    turns = turns_of(conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text"))
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.get("turns", k - 1)["role"] == "assistant")
    known = turns.withColumn("last", F.array_max(places)).filter("last IS NOT NULL")
    answers = known.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.array(F.element_at("turns", F.col("last"))).alias("answer"))
    joined = known.join(answers, "conv_id", "left")
    history = F.slice("turns", F.lit(1), F.col("last") - 1)
    return joined.select(
        F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("last")).alias("chosen"),
        F.when(F.col("answer").isNull(), history).otherwise(F.concat(history, "answer")).alias("rejected"),
    )


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the same one with another answer at its end."""
    pairs = format_pairs(swapped_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

    def digest(side: str) -> Column:
        spans = F.transform(f"{side}_spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
        return F.array_join(spans, ",").alias(f"{side}_spans")

    return pairs.select("pair_id", "prompt_turns", "prompt", "chosen", digest("chosen"), "rejected", digest("rejected"))


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), replace(coalesce(text, ''), '<|', '< |')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     a AS (SELECT conv_id, max(pos) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
     c AS (SELECT conv_id, pos, role, text FROM t JOIN a USING (conv_id) WHERE pos <= last),
     r AS (SELECT conv_id, pos, role, text FROM c JOIN a USING (conv_id) WHERE pos < last
           UNION ALL
           SELECT a.conv_id, a.last, t.role, t.text FROM a JOIN a b ON b.conv_id = xor(a.conv_id, 1) JOIN t ON t.conv_id = b.conv_id AND t.pos = b.last),
     e AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.pos, r.pos) AS pos,
                  c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
           FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.pos = r.pos),
     p AS (SELECT conv_id, coalesce(min(pos) FILTER (WHERE NOT same) - 1, max(pos)) AS shared FROM e GROUP BY conv_id),
     s AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
     g AS (SELECT side, s.conv_id, pos, role, pos <= shared AS before, '<|im_start|>' || role || chr(10) AS head,
                  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM s JOIN p USING (conv_id)),
     o AS (SELECT *, sum(length(line)) OVER (PARTITION BY side, conv_id, before ORDER BY pos)::BIGINT AS stop FROM g),
     f AS (SELECT conv_id, side,
                  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE before), '') AS prompt,
                  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE NOT before), '') AS rest,
                  coalesce(string_agg((stop - length(line) + length(head)) || '-' || (stop - 1), ',' ORDER BY pos) FILTER (WHERE NOT before AND role = 'assistant'), '') AS spans
           FROM o GROUP BY conv_id, side)
SELECT p.conv_id AS pair_id, p.shared::INTEGER AS prompt_turns, x.prompt, x.rest AS chosen, x.spans AS chosen_spans,
       coalesce(y.rest, '') AS rejected, coalesce(y.spans, '') AS rejected_spans
FROM p JOIN f x ON x.conv_id = p.conv_id AND x.side = 'c' LEFT JOIN f y ON y.conv_id = p.conv_id AND y.side = 'r'
"""

QUERIES = {"op6_preference_format": (op6_preference_format, SQL)}
