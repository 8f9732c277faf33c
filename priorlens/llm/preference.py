"""Chat formatting: preference pairs with a shared prompt and masked completions, in DataFrame functions only.

The longest common prefix of the chosen and the rejected conversation's turns (equal role and equal text) is rendered
once as the prompt; what follows is rendered as the chosen and the rejected completion, as segments with a loss mask:
the text and end mark of assistant turns are learned (1), role headers and the turns of others are context (0).

Turns without a conversation id belong to no conversation. Null roles and texts count as empty; the order of turns is
(turn, role, text), null turns first, so repeated rows of a turn stay and have a fixed order. A conversation that is a
prefix of its partner has an empty completion; equal conversations have two, and ``identical`` is true. An empty table
gives no rows. A conversation is one row of the result, so its own turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, pick
from .mixing import bucket_count, digest_order, digest_share

HEADER, END = "<|%s|>\n", "\n<|end|>\n"


def conversations(turns: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id and its turns in order, as an array of (role, text)."""
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    rows = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def swapped_replies(turns: DataFrame, seed: int = 41, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """pair_id, chosen, rejected, for turns that no one has judged: a conversation up to its last reply is the chosen side;
    the rejected side leaves it at one of its replies, picked by a seeded digest, and has there the last reply of another
    conversation: the next one, in the order of digests, that has a reply (after the last comes the first). A conversation
    without a reply is no pair; where it is the only one that has any, the rejected side ends before the reply.

    Conversations are put together once; what finds the other reply moves ids and last replies only."""
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    replies = rows.where("role = 'assistant'").withColumn("text", F.coalesce("text", F.lit(""))).groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), F.struct("turn", "text")).alias("_reply"))
    ids = rows.where("role = 'assistant'").select("conv_id").distinct().withColumn("_h", digest_order(seed, F.col("conv_id")))
    n = ids.count()
    buckets = bucket_count(n)
    placed = global_rank(ids, None, ["_h", "conv_id"], F.floor(digest_share(F.col("_h")) * buckets), buckets)
    nexts = placed.select(F.pmod(F.col("before") - 1, F.lit(max(n, 1))).alias("before"), F.col("conv_id").alias("_other"))
    other = placed.join(nexts, "before").where("conv_id <> _other").select("conv_id", "_other")
    other = other.join(replies.withColumnRenamed("conv_id", "_other"), "_other").select("conv_id", "_reply")
    convs = conversations(rows).withColumn("_at", F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())).where(F.size("_at") > 0)
    k = F.least(F.floor(digest_share(digest_order(seed, F.lit("at"), F.col("conv_id"))) * F.size("_at")), F.size("_at") - 1)
    convs = convs.withColumn("_k", F.element_at("_at", (k + 1).cast("int")).cast("int"))
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    reply = F.coalesce(F.when(F.col("_reply").isNotNull(), F.array("_reply")), none)
    return convs.join(other, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.slice("turns", 1, F.element_at("_at", -1).cast("int")).alias("chosen"), F.concat(F.slice("turns", 1, F.col("_k") - 1), reply).alias("rejected"))


def mask(segments):
    """A completion's mask as text: ``loss:characters`` of each segment, in order."""
    return F.concat_ws(",", F.transform(segments, lambda s: F.concat_ws(":", s["loss"].cast("string"), F.length(s["text"]).cast("string"))))


def render(turns):
    """One string for an array of turns."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.format_string(HEADER, t["role"]), t["text"], F.lit(END))))


def masked(turns):
    """Segments (text, loss) of a completion."""
    def parts(t):
        learned = (t["role"] == "assistant").cast("int")
        return F.array(F.struct(F.format_string(HEADER, t["role"]).alias("text"), F.lit(0).alias("loss")), F.struct(F.concat(t["text"], F.lit(END)).alias("text"), learned.alias("loss")))

    return F.flatten(F.transform(turns, parts))


def preference_format(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen and rejected (arrays of (role, text), null counts as none). Returns pair_id, prefix_turns,
    prompt, chosen, rejected (strings), chosen_segments, rejected_segments (text, loss), identical."""
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    both = pairs.select("pair_id", F.coalesce("chosen", none).alias("_c"), F.coalesce("rejected", none).alias("_r"))
    # the first place where the turns differ; a turn that only one side has differs from none
    differs = F.array_position(F.zip_with("_c", "_r", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
    both = both.withColumn("prefix_turns", F.when(differs > 0, differs - 1).otherwise(F.size("_c")).cast("int"))
    rest = lambda c: F.slice(c, F.col("prefix_turns") + 1, F.greatest(F.size(c) - F.col("prefix_turns"), F.lit(0)))
    both = both.withColumn("_cr", rest("_c")).withColumn("_rr", rest("_r"))
    return both.select(
        "pair_id", "prefix_turns",
        render(F.slice("_c", 1, F.col("prefix_turns"))).alias("prompt"),
        render("_cr").alias("chosen"), render("_rr").alias("rejected"),
        masked(F.col("_cr")).alias("chosen_segments"), masked(F.col("_rr")).alias("rejected_segments"),
        ((F.size("_cr") == 0) & (F.size("_rr") == 0)).alias("identical"),
    )
