"""Chat formatting: logged snapshots collapse into the longest version of each conversation.

A conversation is its turns in order. Rolling hashes name every prefix of it; one whose full hash is the hash of a
proper prefix of a longer conversation is dropped by an anti-join, and of equal ones the smallest id stays. What is left
is rendered by a template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import Scratch


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, turns (ordered array of role and text), hashes (rolling SHA-256 of each prefix).

    Null roles and texts count as empty. Rows of equal turn number are ordered by role and text, and exact repeats of a
    row count once. Rows with a null conv_id form one conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    step = lambda h, t: F.sha2(F.concat_ws("\x1f", h, F.length(t["role"]).cast("string"), t["role"], t["text"]), 256)
    rolled = F.aggregate(
        "turns", F.array(F.lit("")), lambda acc, t: F.concat(acc, F.array(step(F.element_at(acc, -1), t)))
    )
    return grouped.select("conv_id", "turns", F.slice(rolled, 2, F.size("turns")).alias("hashes"))


def maximal(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, turns and n_snapshots (logged conversations that equal it) of those that no longer one continues."""
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    convs = scratch.keep(hashed(turns).withColumn("full", F.element_at("hashes", -1)), "hashed")
    # One row for each different conversation, and each different proper prefix once: both pre-aggregated before the shuffle.
    firsts = convs.groupBy("full").agg(F.min("conv_id").alias("keep"), F.count(F.lit(1)).alias("n_snapshots"))
    prefixes = convs.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("full")).distinct()
    ends = firsts.join(prefixes, "full", "left_anti").select("keep", "n_snapshots")
    return convs.join(ends, convs["conv_id"].eqNullSafe(ends["keep"])).select("conv_id", "turns", "n_snapshots")


def render(convs: DataFrame, head: str = "<|", tail: str = "|>") -> DataFrame:
    """conv_id, n_turns, n_snapshots, rendered: `<|role|>\\ntext\\n` for each turn."""
    line = lambda t: F.concat(F.lit(head), t["role"], F.lit(f"{tail}\n"), t["text"], F.lit("\n"))
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_snapshots",
        F.array_join(F.transform("turns", line), "").alias("rendered"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered. An empty table gives no rows; extra columns are not read."""
    return render(maximal(turns))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(length(role) || chr(31) || role || chr(31) || text || chr(30), '' ORDER BY turn, role, text) AS code,
        string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS rendered
      FROM t GROUP BY conv_id),
f AS (SELECT code, min(conv_id) AS conv_id, count(*) AS n_snapshots FROM c GROUP BY code)
SELECT c.conv_id, c.n_turns, f.n_snapshots, c.rendered FROM f JOIN c USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM f l WHERE length(l.code) > length(f.code) AND starts_with(l.code, f.code))
"""
