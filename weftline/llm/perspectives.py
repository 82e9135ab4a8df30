"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
the others as named users; the mask lists the character spans (start, end) that a model is trained on,
which are the assistant's texts with their end marks. System turns are context in every perspective.

A dialogue is rendered in blocks of BLOCK_TURNS turns, so that no task gathers a whole conversation: a row is
(conversation, speaker, block). Ordinary conversations have one block. A dialogue is its blocks' texts in order;
`offset` is the place of a block in it, to which the block's spans are added.

Turns get their place in the conversation by numbering the whole table in ranges of its order, so neither a
conversation nor a turn number with a large part of all rows comes to one task.

Defined results: a null text is empty; a null role is a user named `unknown` and no perspective; turns with
a null number come last; equal turn numbers are ordered by role and text; repeated rows are repeated turns; a
null conv_id is a conversation of its own; a conversation without a participant (only system turns or null
roles) gives no rows; `<|` and `|>` within texts and roles are written `< |` and `| >`, so that none of them
passes for a mark; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import with_row_number
from .common import HOT_KEYS, join_by_key, persisted

BLOCK_TURNS = 64
#: Blocks whose lengths are added up together, and tasks over which a conversation with a large part of all rows is dealt.
RUN_BLOCKS, SALTS = 1024, 16
SYSTEM = "system"
END = "<|end|>\n"


def plain(text: Column) -> Column:
    """The text without anything that reads like a mark."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def head(role: Column, speaker: Column) -> Column:
    """What stands before a turn's text in the speaker's perspective."""
    other = F.concat(F.lit("<|user name="), plain(F.coalesce(role, F.lit("unknown"))), F.lit("|>\n"))
    return F.when(role == speaker, "<|assistant|>\n").when(role == SYSTEM, "<|system|>\n").otherwise(other)


def turn_blocks(turns: DataFrame, size: int = BLOCK_TURNS) -> DataFrame:
    """(key, conv_id, block, salt, long, turns): at most `size` turns per row, in order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = turns.select(key.alias("key"), "conv_id", "turn", F.col("role").cast("string").alias("role"), text.alias("text"))
    rows = with_row_number(rows, [F.col("key").asc(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()], "number")
    starts = rows.groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("rows"))
    starts = persisted(starts.withColumn("n", F.col("rows")), "turn-starts")
    total = rows.count()
    placed = join_by_key(rows, starts, "key", total).withColumn("place", F.col("number") - F.col("first"))
    block = F.floor(F.col("place") / size)
    salt = F.when(F.col("n") * HOT_KEYS > total, block % SALTS).otherwise(0)
    blocks = placed.groupBy("key", block.alias("block")).agg(F.first("conv_id").alias("conv_id"), F.first(salt).alias("salt"), F.first(F.col("n") > size).alias("long"), F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    speakers = rows.where(F.col("role") != SYSTEM).groupBy("key", F.col("role").alias("speaker")).agg(F.lit(1).alias("one"))
    speakers = speakers.join(starts, "key")
    salts = F.when(F.col("n") * HOT_KEYS > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return blocks.join(speakers.select("key", "speaker", F.explode(salts.cast("array<long>")).alias("salt")), ["key", "salt"])


def with_offsets(rendered: DataFrame) -> DataFrame:
    """Adds the offset of each block of conversations with several; lengths are added up in runs of blocks."""
    lengths = rendered.select("key", "speaker", "block", F.floor(F.col("block") / RUN_BLOCKS).alias("run"), F.length("text").cast("long").alias("n_chars"))
    within = F.sum("n_chars").over(W.partitionBy("key", "speaker", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    runs = lengths.groupBy("key", "speaker", "run").agg(F.sum("n_chars").alias("n_chars"))
    before = F.sum("n_chars").over(W.partitionBy("key", "speaker").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("key", "speaker", "run", F.coalesce(before, F.lit(0)).alias("before"))
    offsets = lengths.withColumn("within", F.coalesce(within, F.lit(0))).join(runs, ["key", "speaker", "run"])
    return rendered.join(offsets.select("key", "speaker", "block", (F.col("before") + F.col("within")).alias("offset")), ["key", "speaker", "block"])


def rotate(turns: DataFrame, size: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, speaker, block, offset, n_turns, text, mask array<struct<start, end>> for every participant."""
    speaker = F.col("speaker")
    pieces = F.transform(
        "turns", lambda t: F.struct(F.length(head(t["role"], speaker)).alias("before"), F.concat(head(t["role"], speaker), plain(t["text"]), F.lit(END)).alias("piece"), F.coalesce(t["role"] == speaker, F.lit(False)).alias("own"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        end = state["at"] + F.length(p["piece"])
        span = F.struct((state["at"] + p["before"]).alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    rendered = turn_blocks(turns, size).withColumn("pieces", pieces).select(
        "key",
        "conv_id",
        "speaker",
        "block",
        "long",
        F.size("pieces").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
        F.aggregate("pieces", start, step)["spans"].alias("mask"),
    )
    columns = ["conv_id", "speaker", "block", "offset", "n_turns", "text", "mask"]
    rendered = persisted(rendered, "turn-blocks")
    whole = rendered.where(~F.col("long")).withColumn("offset", F.lit(0).cast("long"))
    return whole.select(*columns).unionByName(with_offsets(rendered.where("long")).select(*columns))


def rotation_table(turns: DataFrame) -> DataFrame:
    """rotate() with the mask as text, start-end pairs joined by commas."""
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return rotate(turns).withColumn("n_chars", F.length("text").cast("long")).withColumn("n_turns", F.col("n_turns").cast("long")).withColumn("mask", spans)


def _plain_sql(text: str) -> str:
    return f"replace(replace({text}, '<|', '< |'), '|>', '| >')"


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{SYSTEM}'),
p AS (
  SELECT n.conv_id, s.speaker, CAST(n.place // {BLOCK_TURNS} AS BIGINT) AS block, n.place, coalesce(n.role = s.speaker, false) AS own,
         CASE WHEN n.role = s.speaker THEN '<|assistant|>' WHEN n.role = '{SYSTEM}' THEN '<|system|>'
              ELSE '<|user name=' || {_plain_sql("coalesce(n.role, 'unknown')")} || '|>' END || chr(10) AS head, {_plain_sql("n.text")} || '<|end|>' || chr(10) AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS origin FROM p),
b AS (SELECT *, min(origin) OVER (PARTITION BY conv_id, speaker, block) AS start FROM o)
SELECT conv_id, speaker, block, CAST(start AS BIGINT) AS "offset", count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(origin - start + length(head) AS BIGINT) || '-' || CAST(origin - start + length(head) + length(body) - 1 AS BIGINT) END, ',' ORDER BY place), '') AS mask,
       CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars
FROM b GROUP BY conv_id, speaker, block, start
"""
