"""Chat formatting with cumulative-snapshot collapse.

A logger that stores a conversation after every exchange leaves snapshots, each a
prefix of the next.  Only maximal conversations are rendered: a conversation is
dropped if its turns are the first turns of a longer one, or if another with the
same turns has a smaller conv_id.

Turns are taken in order of turn, then of the digest of role and text.  A prefix's
hash is the xor of its turns' hashes, each tagged with its place, twice with
different seeds (128 bits); xor lets a long conversation be hashed in blocks of turn
numbers, so no conversation is ever gathered in one task.  Prefixes of all
conversations are made distinct before they are compared, so a first turn that a
third of all logs share is one row.  The hash phase moves 32 bytes a turn; text
moves once, to the block it is rendered in.

A marker's beginning (``<|``) inside of a role or text is set apart by a space, so that no
turn can forge another.

A block is rendered in parts of at most ``PART_TURNS`` turns, numbered through the
conversation; a conversation's parts, joined in order, are its text.

Defined results: a null role or text is an empty one, a null turn comes first;
repeated rows are turns of their own; a null conv_id is a conversation, and the
smallest; an empty table gives no rows; other columns are ignored, whatever their
names; a very long text is rendered whole, in one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turn numbers that are ordered together, and turns in a rendered part.
BLOCK_TURNS = 256
PART_TURNS = 256

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"

_NULL_ID = -(1 << 63)


def _keyed(turns: DataFrame) -> DataFrame:
    """cid and block (never null, so that one partitioning serves windows and joins), turn, role, text, digest."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.col("turn").cast("long")
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NULL_ID)).alias("cid"),
        F.coalesce(F.floor(turn / BLOCK_TURNS), F.lit(_NULL_ID)).alias("block"),
        turn.alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(F.concat(role, F.lit("\x00"), text), 256)).alias("digest"),
    )


def _ahead():
    return Window.partitionBy("cid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _sizes(keyed: DataFrame, part_turns: int) -> DataFrame:
    """cid, block, ahead and parts_ahead (turns and parts of the blocks before it), total (turns of the conversation)."""
    sizes = keyed.groupBy("cid", "block").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / part_turns)
    return sizes.select(
        "cid",
        "block",
        F.coalesce(F.sum("n").over(_ahead()), F.lit(0)).alias("ahead"),
        F.coalesce(F.sum(parts).over(_ahead()), F.lit(0)).alias("parts_ahead"),
        F.sum("n").over(Window.partitionBy("cid")).alias("total"),
    )


def _nth():
    return F.row_number().over(Window.partitionBy("cid", "block").orderBy("turn", "digest"))


def prefixes(turns: DataFrame) -> DataFrame:
    """cid, at, p1, p2 (hash of the first ``at`` turns), total (turns of the conversation)."""
    keyed = _keyed(turns).drop("role", "text")
    placed = keyed.withColumn("nth", _nth()).join(_sizes(keyed, PART_TURNS).drop("parts_ahead"), ["cid", "block"])
    at = F.col("nth") + F.col("ahead")
    tagged = placed.select("cid", "block", "nth", at.alias("at"), "total", *[F.xxhash64(F.lit(i), "digest", at).alias(f"x{i}") for i in (1, 2)])
    inside = Window.partitionBy("cid", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("cid", "block", "at", "total", *[F.expr(f"bit_xor(x{i})").over(inside).alias(f"l{i}") for i in (1, 2)])
    blocks = tagged.groupBy("cid", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    before = blocks.select("cid", "block", *[F.coalesce(F.expr(f"bit_xor(b{i})").over(_ahead()), F.lit(0)).alias(f"a{i}") for i in (1, 2)])
    joined = local.join(before, ["cid", "block"])
    return joined.select("cid", "at", *[F.col(f"l{i}").bitwiseXOR(F.col(f"a{i}")).alias(f"p{i}") for i in (1, 2)], "total")


def maximal(turns: DataFrame) -> DataFrame:
    """cid, n_turns, n_collapsed (other conversations with the same turns) of the conversations that stay."""
    known = common.materialize(prefixes(turns), "prefixes")
    whole = known.where("at = total").groupBy("at", "p1", "p2").agg(F.min("cid").alias("cid"), F.count("*").alias("same"))
    longer = known.where("at < total").select("at", "p1", "p2").distinct()
    stays = whole.join(longer, ["at", "p1", "p2"], "left_anti")
    return stays.select("cid", F.col("at").alias("n_turns"), (F.col("same") - 1).alias("n_collapsed"))


def render(turns: DataFrame, kept: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part (from 0), n_turns, n_collapsed, rendered: the text of the kept conversations."""
    keyed = _keyed(turns)
    places = _sizes(keyed.select("cid", "block"), part_turns).join(kept, "cid").select("cid", "block", "parts_ahead", "n_turns", "n_collapsed")
    rows = keyed.join(places, ["cid", "block"]).withColumn("nth", _nth())
    role, text = (F.replace(F.col(c), F.lit("<|"), F.lit("< |")) for c in ("role", "text"))
    body = F.concat(F.lit(TURN_OPEN), role, F.lit("\n"), text, F.lit(TURN_CLOSE))
    part = F.col("parts_ahead") + F.floor((F.col("nth") - 1) / part_turns)
    each = rows.select("cid", "block", part.cast("int").alias("part"), "n_turns", "n_collapsed", F.struct("nth", body.alias("body")).alias("turn"))
    parts = each.groupBy("cid", "block", "part", "n_turns", "n_collapsed").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return parts.select(F.nullif("cid", F.lit(_NULL_ID)).alias("conv_id"), "part", "n_turns", "n_collapsed", F.array_join(F.col("turns.body"), "").alias("rendered"))


def format_conversations(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """The maximal conversations, rendered."""
    return render(turns, maximal(turns), part_turns)


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_conversations(common.read_table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos,
         coalesce(floor(turn / 256), -1e18) AS block, (row_number() OVER (PARTITION BY conv_id, floor(turn / 256) ORDER BY turn, digest) - 1) // 256 AS sub
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) AS digest FROM conversations)
),
convs AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS ts, count(*) AS n FROM turns GROUP BY conv_id),
maximal AS (
  SELECT min(conv_id) AS conv_id, ts, n, count(*) - 1 AS n_collapsed FROM convs c
  WHERE NOT EXISTS (SELECT 1 FROM convs o WHERE o.n > c.n AND o.ts[1] = c.ts[1] AND o.ts[1:c.n] = c.ts)
  GROUP BY ts, n
),
parted AS (SELECT *, (dense_rank() OVER (PARTITION BY conv_id ORDER BY block, sub) - 1)::INT AS part FROM turns)
SELECT m.conv_id, t.part, m.n AS n_turns, m.n_collapsed,
       string_agg('<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM maximal m JOIN parted t ON t.conv_id IS NOT DISTINCT FROM m.conv_id
GROUP BY m.conv_id, t.part, m.n, m.n_collapsed
"""
