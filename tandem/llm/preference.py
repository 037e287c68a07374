r"""Preference formatting, in DataFrame functions alone.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is rendered once,
as the prompt; what remains of each is a completion with a mask, the character ranges to train on: the text and the closing mark of every assistant
turn. A turn is rendered as `<|im_start|>role`, a line break, its text, `<|im_end|>` and a line break.

Turns stand in order of turn, ties in order of role and text; repeated turn rows stay. Null roles and texts are empty ones; rows without pair, side or
turn are in no conversation. A pair of equal conversations has a prompt and two empty completions. A pair of which one side has no turns is not
emitted. Long conversations take time in proportion to their turns; one pair is in one task. Extra columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read
from .divergence import let

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "\n"
TRAINED = "assistant"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BREAK), t["text"], F.lit(CLOSE + BREAK))), "")


def mask(turns: Column) -> Column:
    """Ranges [start, end) in the rendered turns that are trained on; each turn brings `at`, where it starts in the whole conversation."""
    base = F.get(turns, F.lit(0))["at"]

    def span(t):
        start = t["at"] - base + len(OPEN) + F.length(t["role"]) + len(BREAK)
        return F.struct(start.cast("long").alias("start"), (start + F.length(t["text"]) + len(CLOSE)).cast("long").alias("end"))

    return F.transform(F.filter(turns, lambda t: t["role"] == TRAINED), span)


def common_turns(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(0), n), lambda i: (i >= n) | (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"])), True)
    return (differs - 1).cast("int")


def tagged(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Turns of the pairs (pair, chosen, rejected): pair, side (0 chosen, 1 rejected), turn, role, text."""
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.col("chosen").alias("id"), F.lit(0).alias("side")), F.struct(F.col("rejected").alias("id"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.select("pair", F.col("s.id").alias("_id"), F.col("s.side").alias("side"))
    return conversations.join(sides, F.col("conv_id") == F.col("_id")).select("pair", "side", "turn", "role", "text")


def format_pairs(turns: DataFrame) -> DataFrame:
    """pair, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask from the turns of pairs."""
    known = turns.where("pair is not null and side in (0, 1) and turn is not null").select("pair", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # one exchange by pair serves the running length and the grouping; masks then need no pass that grows with the square of the turns
    length = len(OPEN) + F.length("role") + len(BREAK) + F.length("text") + len(CLOSE + BREAK)
    before = F.sum(length.cast("long")).over(Window.partitionBy("pair").orderBy("side", "turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)) - length
    grouped = known.withColumn("at", before).groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("side", "turn", "role", "text", "at"))).alias("_all"))
    side = lambda s: F.transform(F.filter("_all", lambda t: t["side"] == s), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["at"].alias("at")))
    both = grouped.select("pair", side(0).alias("_a"), side(1).alias("_b")).where((F.size("_a") > 0) & (F.size("_b") > 0))
    split = both.withColumn("prompt_turns", let(F.struct("_a", "_b"), lambda x: common_turns(x["_a"], x["_b"])))
    rest = lambda c: F.slice(F.col(c), F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    return split.select(
        "pair", "prompt_turns", rendered(F.slice("_a", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        rendered(rest("_a")).alias("chosen"), mask(rest("_a")).alias("chosen_mask"), rendered(rest("_b")).alias("rejected"), mask(rest("_b")).alias("rejected_mask"),
    )


def op9_preference_pairs(spark, sf_dir):
    """Conversations 2n are chosen over 2n + 1."""
    pair = F.floor(F.col("conv_id") / 2)
    turns = read(spark, sf_dir, "conversations").select(pair.alias("pair"), (F.col("conv_id") - 2 * pair).cast("int").alias("side"), "turn", "role", "text")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return format_pairs(turns).select((2 * F.col("pair")).alias("chosen_id"), (2 * F.col("pair") + 1).alias("rejected_id"), "prompt_turns", "prompt", "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"))


SQL = r"""
with t as (select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn, coalesce(role, ''), coalesce(text, '')) as a
  from conversations where conv_id is not null and turn is not null group by conv_id),
p as (select c.conv_id as chosen_id, r.conv_id as rejected_id, c.a as a, r.a as b from t c join t r on r.conv_id = c.conv_id + 1 and c.conv_id % 2 = 0),
k as (select *, coalesce(list_position([a[i] = b[i] for i in range(1, least(len(a), len(b)) + 1)], false), 0) as d from p),
m as (select *, (case when d = 0 then least(len(a), len(b)) else d - 1 end)::int as prompt_turns from k),
s as (select *, a[1 : prompt_turns] as x, a[prompt_turns + 1 :] as y, b[prompt_turns + 1 :] as z from m),
w as (select *, [12 + len(v.r) + 1 + len(v.t) + 10 + 1 for v in y] as ly, [12 + len(v.r) + 1 + len(v.t) + 10 + 1 for v in z] as lz from s)
select chosen_id, rejected_id, prompt_turns,
  array_to_string(['<|im_start|>' || v.r || chr(10) || v.t || '<|im_end|>' || chr(10) for v in x], '') as prompt,
  array_to_string(['<|im_start|>' || v.r || chr(10) || v.t || '<|im_end|>' || chr(10) for v in y], '') as chosen,
  array_to_string([(coalesce(list_sum(ly[1 : i - 1]), 0) + 13 + len(y[i].r))::bigint::varchar || ':' || (list_sum(ly[1 : i]) - 1)::bigint::varchar for i in range(1, len(y) + 1) if y[i].r = 'assistant'], ',') as chosen_mask,
  array_to_string(['<|im_start|>' || v.r || chr(10) || v.t || '<|im_end|>' || chr(10) for v in z], '') as rejected,
  array_to_string([(coalesce(list_sum(lz[1 : i - 1]), 0) + 13 + len(z[i].r))::bigint::varchar || ':' || (list_sum(lz[1 : i]) - 1)::bigint::varchar for i in range(1, len(z) + 1) if z[i].r = 'assistant'], ',') as rejected_mask
from w
"""
