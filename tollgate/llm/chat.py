"""Chat formatting from event logs, with DataFrame functions only.

An event has conv_id, seq, kind, msg_id, role and text.  Per conversation, sorted by sequence:
``message`` starts a message, ``delta`` appends to it (no msg_id: to the last one named), ``edit``
replaces its text, ``regenerate`` discards its text and every message that began between it and the
event; deltas after the last edit or regenerate are appended again.  The final messages are then rendered,
every control string inside a text broken by a backslash after its first character, and backslashes doubled, so that
reading the output back gives the texts again.

Defined cases: null text or role counts as empty; an empty log gives no rows; equal sequence numbers are ordered by
msg_id, kind, role and text; null sequence numbers (null turns) come first; rows of a null conv_id are one conversation, whose conv_id
comes out null; a conversation, of texts of any length, is rendered whole; rows repeated whole are events of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm.common import table

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Strings that may steer a model; a backslash goes after the first character.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the messages that stand at the end of each log; ``at`` orders them."""
    conv = Window.partitionBy("conv_id")
    in_order = conv.orderBy("at")
    ev = events.select("conv_id", "seq", "kind", "msg_id", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    ev = ev.withColumn("at", F.row_number().over(conv.orderBy("seq", "msg_id", "kind", "role", "text")))
    ev = ev.withColumn("msg_id", F.last("msg_id", ignorenulls=True).over(in_order))
    of_message = Window.partitionBy("conv_id", "msg_id")
    ev = ev.withColumns({
        "began": F.min("at").over(of_message),
        "reset": F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(of_message),
    })
    # the earliest message that a later event regenerates: what began after it and before that event is gone
    later = in_order.rowsBetween(1, Window.unboundedFollowing)
    ev = ev.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("began"))).over(later))
    piece = F.when(F.col("at") >= F.coalesce("reset", F.lit(0)), F.struct("at", "text"))
    kept = ev.groupBy("conv_id", "msg_id", "began").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"),
        F.min_by("role", F.when((F.col("role") != "") | (F.col("at") == F.col("began")), F.struct(F.col("role") == "", "at"))).alias("role"),
        F.max(F.when((F.col("at") == F.col("began")) & (F.col("cut") < F.col("began")), True)).alias("gone"))
    return kept.where(F.col("gone").isNull()).select(
        "conv_id", F.col("began").alias("at"), "role", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): loss_mask has, for each assistant text, its turn, its place in that turn
    (``at``) and in ``formatted`` (``start``) and its ``length``, in code points and as escaped there."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    turns = messages.select("conv_id", "at", "role", head.alias("head"), body.alias("body")).withColumns({
        "turn": F.concat("head", "body", F.lit(CLOSE))})
    before = Window.partitionBy("conv_id").orderBy("at")
    turns = turns.withColumns({
        "start": F.sum(F.length("turn")).over(before) - F.length("turn") + F.length("head"),
        "n": F.row_number().over(before)})
    mask = F.when(F.col("role") == "assistant", F.struct(
        "n", (F.length("head") - F.lit(len(OPEN))).alias("at"), F.col("start").cast("long").alias("start"),
        F.length("body").alias("length")))
    return turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "turn"))).alias("turns"),
        F.sort_array(F.collect_list(mask)).alias("loss_mask"),
    ).select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read from ``formatted`` and ``loss_mask`` alone."""
    # parts[0] is the empty string before the first mark; a turn is role, SEP, text, CLOSE
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    out = formatted.select("conv_id", "formatted", "loss_mask", parts.alias("parts"))
    close = len(CLOSE)

    def turn(p):
        role = F.substring_index(p, SEP, 1)
        text = p.substr(F.length(role) + F.lit(len(SEP) + 1), F.length(p) - F.length(role) - F.lit(len(SEP) + close))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.col("parts")[m["n"]].substr(m["at"] + 1, m["length"]))), "")
    out = out.withColumn("loss", loss)
    said = F.array_join(F.transform(F.slice("parts", F.lit(2), F.size("parts")), turn), "")
    return out.select(
        "conv_id", (F.size("parts") - 1).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log of whole messages; every row is a message of its own."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), at.alias("msg_id"), "role", "text")


def format_chats(events: DataFrame) -> DataFrame:
    return render(final_messages(events))


PROBE = r"</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_chats(events_of_turns(turns)))


_ESCAPED = "replace(text, '\\', '\\\\')"
for _c in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
s AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(OPEN + SEP + CLOSE)} + length({_ESCAPED.replace('text', 'role')}) + length({_ESCAPED}))::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM s
"""
