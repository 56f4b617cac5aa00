"""Preference formatting with DataFrame functions alone.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns (same role and same text) is rendered once
as the prompt; what follows in each is rendered as its completion. A mask lists the parts of prompt plus completion, in code
points, that a model is to be trained on: text and end mark of the assistant's turns in the completion.

Defined results: a null role or text counts as empty, and a null side or a null turn as none; turns are ordered by number, role and text, so that repeated rows stay as
repeated turns; rows without a conversation id belong to no conversation and are left out; a conversation without a reply of the
assistant has equal sides and empty completions; an empty table gives an empty result; other columns are ignored. A conversation
is one row of the result and is gathered as such; it is never gathered with others than its partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

ASSISTANT = "assistant"
END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns: Column, start: Column) -> Column:
    """Masked parts as ``start:end`` joined by commas, the end excluded."""
    # after each turn: the place reached, and the parts so far
    begin = F.struct(start.cast("int").alias("at"), F.lit("").alias("parts"))

    def step(state: Column, turn: Column) -> Column:
        text = state["at"] + F.length(_head(turn))
        end = text + F.length(turn["text"]) + F.lit(len(END))
        part = F.concat(F.when(state["parts"] == "", "").otherwise(","), text.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"] == ASSISTANT, F.concat(state["parts"], part)).otherwise(state["parts"]).alias("parts"))

    return F.aggregate(turns, begin, step, lambda state: state["parts"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns with which both begin."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Render ``chosen`` and ``rejected``, arrays of (role, text); other columns are passed on."""
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]

    def turns(side: str) -> Column:
        given = F.filter(F.col(side), lambda t: t.isNotNull())
        plain = F.transform(given, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
        return F.coalesce(plain, F.array().cast("array<struct<role:string,text:string>>"))

    pairs = pairs.withColumns({chosen: turns(chosen), rejected: turns(rejected)})
    rows = pairs.select(*rest, F.col(chosen).alias("_c"), F.col(rejected).alias("_r"), common_turns(F.col(chosen), F.col(rejected)).alias("n_prompt_turns"))
    after = F.col("n_prompt_turns") + 1
    rows = rows.select(
        *rest,
        "n_prompt_turns",
        _render(F.slice("_c", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        F.slice("_c", after, F.size("_c")).alias("_c"),
        F.slice("_r", after, F.size("_r") + 1).alias("_r"),
    )
    size = F.length("prompt")
    return rows.select(*rest, "n_prompt_turns", "prompt", _render(F.col("_c")).alias("chosen"), _render(F.col("_r")).alias("rejected"), _mask(F.col("_c"), size).alias("chosen_mask"), _mask(F.col("_r"), size).alias("rejected_mask"))


def with_other_reply(conversations: DataFrame) -> DataFrame:
    """Preference pairs from conversations: the rejected side ends with the partner's last reply instead of its own.

    Conversations 2k and 2k + 1 are partners. Where the partner has no reply, the rejected side lacks its last reply.
    """
    conversations = conversations.withColumn("conv_id", F.col("conv_id").cast("long"))
    turn = F.struct("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = conversations.filter("conv_id is not null").groupBy(F.shiftright("conv_id", 1).alias("_pair")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))

    def side(odd: int) -> Column:
        return F.transform(F.filter("_turns", lambda t: t["conv_id"].bitwiseAND(1) == odd), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    even, odd = side(0), side(1)
    pairs = F.array(
        F.struct((F.col("_pair") * 2).alias("conv_id"), even.alias("mine"), odd.alias("other")),
        F.struct((F.col("_pair") * 2 + 1).alias("conv_id"), odd.alias("mine"), even.alias("other")),
    )
    rows = both.select(F.explode(pairs).alias("_p")).select("_p.*").filter(F.size("mine") > 0)
    reply = F.get(F.reverse(F.filter("other", lambda t: t["role"] == ASSISTANT)), F.lit(0))["text"]
    last = F.array_max(F.transform("mine", lambda t, i: F.when(t["role"] == ASSISTANT, i)))
    rows = rows.select("conv_id", "mine", reply.alias("reply"), last.alias("last"))
    swapped = F.transform("mine", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("last"), F.col("reply")).otherwise(t["text"]).alias("text")))
    without = F.filter("mine", lambda t, i: i != F.col("last"))
    rejected = F.when(F.col("last").isNull(), F.col("mine")).when(F.col("reply").isNull(), without).otherwise(swapped)
    return rows.select("conv_id", F.col("mine").alias("chosen"), rejected.alias("rejected"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(with_other_reply(read_table(spark, sf_dir, "conversations")))


ORACLE = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), n AS (
    SELECT conv_id, count(*) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM t GROUP BY conv_id
), reply AS (
    SELECT t.conv_id, t.text FROM t JOIN n ON t.conv_id = n.conv_id AND t.i = n.last
), r AS (
    SELECT t.conv_id, t.role, CASE WHEN t.i = n.last THEN reply.text ELSE t.text END AS text,
        row_number() OVER (PARTITION BY t.conv_id ORDER BY t.i) AS i
    FROM t JOIN n ON t.conv_id = n.conv_id LEFT JOIN reply ON reply.conv_id = xor(t.conv_id, 1::BIGINT)
    WHERE NOT coalesce(t.i = n.last AND reply.text IS NULL, false)
), differ AS (
    SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, min(coalesce(t.i, r.i)) AS i
    FROM t FULL JOIN r ON t.conv_id = r.conv_id AND t.i = r.i
    WHERE t.conv_id IS NULL OR r.conv_id IS NULL OR t.role <> r.role OR t.text <> r.text GROUP BY 1
), p AS (
    SELECT n.conv_id, coalesce(differ.i - 1, n.n) AS lcp FROM n LEFT JOIN differ ON n.conv_id = differ.conv_id
), sides AS (
    SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r' AS side, conv_id, role, text, i FROM r
), rendered AS (
    SELECT *, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body FROM sides
), placed AS (
    SELECT *, sum(length(body)) OVER (PARTITION BY side, conv_id ORDER BY i) AS ends FROM rendered
), whole AS (
    SELECT placed.conv_id, side,
        coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE i <= lcp), '') AS prompt,
        coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE i > lcp), '') AS completion,
        coalesce(string_agg((ends - length(body) + length(head))::BIGINT || ':' || ends::BIGINT, ',' ORDER BY i)
            FILTER (WHERE i > lcp AND role = 'assistant'), '') AS mask
    FROM placed JOIN p ON placed.conv_id = p.conv_id GROUP BY 1, 2
)
SELECT p.conv_id, p.lcp::INTEGER AS n_prompt_turns, c.prompt, c.completion AS chosen, coalesce(r.completion, '') AS rejected,
    c.mask AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM p JOIN whole c ON p.conv_id = c.conv_id AND c.side = 'c' LEFT JOIN whole r ON p.conv_id = r.conv_id AND r.side = 'r'
"""
