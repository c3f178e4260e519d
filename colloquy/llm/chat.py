"""Chat formatting from an event log.

Conversations are folded from events, rendered with a template whose control
strings cannot be forged by a text, and can be read back from the output.
DataFrame code only.

Events ``(conv_id, seq, turn, kind, role, text)``: ``message`` and ``edit``
set a turn's text, ``delta`` appends to it, ``regenerate`` empties the turn
and takes back every later turn written before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", " :\n", "\n</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Every backslash, ``<``, ``#`` and ``:`` gets a backslash before it, so
    no control string of the template can occur in a text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "([\\\\<#:])", "\\\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\([\\\\<#:])", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of an event log.

    Events apply in the order of ``seq``; equal ``seq`` by kind, role and
    text, so repeated runs agree. A turn's role is that of its last event
    with one. Turns whose events were all taken back have no row; a turn of
    deltas only is their concatenation; NULL texts count as empty. Only the
    regenerations of a conversation meet in one row, not its texts.
    """
    e = events.select("conv_id", "seq", "turn", F.lower("kind").alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    back = (e.where("kind = 'regenerate'").groupBy("conv_id")
            .agg(F.collect_set(F.struct("turn", "seq")).alias("back")).withColumnRenamed("conv_id", "_c"))
    alive = (e.join(back, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
             .where(~F.coalesce(F.exists("back", lambda b: (F.col("turn") > b["turn"]) & (F.col("seq") < b["seq"])), F.lit(False)))
             .select("conv_id", "turn", F.struct("seq", "kind", "role", "text").alias("e")))
    turns = alive.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("log"))
    start = F.aggregate("log", F.struct(F.lit(0).alias("i"), F.lit(1).alias("at")), lambda acc, x: F.struct(
        (acc["i"] + 1).alias("i"), F.when(x["kind"] != "delta", acc["i"] + 1).otherwise(acc["at"]).alias("at")))["at"]
    tail = turns.withColumn("at", start).withColumn("tail", F.slice("log", F.col("at"), F.size("log")))
    role = F.element_at(F.filter("log", lambda x: x["role"].isNotNull()), F.lit(-1))["role"]
    return (tail.select("conv_id", "turn", F.when(F.size(F.filter("log", lambda x: x["role"].isNotNull())) > 0, role).alias("role"),
                    F.array_join(F.transform("tail", lambda x: x["text"]), "").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """Formatted conversations: ``conv_id, formatted, n_turns``. Turns are
    rendered one by one and joined in order of turn; ties in a turn go by
    role and text. NULL roles and texts are empty."""
    piece = F.concat(F.lit(OPEN), escape(F.col("role").cast("string")), F.lit(MID), escape(F.col("text").cast("string")), F.lit(CLOSE))
    rows = messages.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("r"), piece.alias("piece")).alias("m"))
    return (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
            .select("conv_id", F.array_join(F.transform("ms", lambda m: m["piece"]), "").alias("formatted"),
                    F.size("ms").cast("long").alias("n_turns")))


def read_back(formatted: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Turns of formatted conversations: ``conv_id, formatted, turns`` with
    ``role, text, loss`` per turn, unescaped; ``loss`` marks the spans that a
    loss is computed on."""
    parts = F.filter(F.split("formatted", "\n</turn>\n"), lambda p: p != "")
    role = lambda p: unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MID, 1))

    def turn(p: Column) -> Column:
        cut = F.call_function("instr", p, F.lit(MID))
        return F.struct(role(p).alias("role"), unescape(F.substr(p, cut + len(MID))).alias("text"),
                        (role(p) == loss_role).alias("loss"))

    return formatted.select("*", F.transform(parts, turn).alias("turns"))


def loss_spans(formatted: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``conv_id, start, length``: where in ``formatted`` (code points, from
    0) each span under the loss mask lies."""
    from pyspark.sql import Window

    parts = formatted.select("conv_id", F.posexplode(F.filter(F.split("formatted", "\n</turn>\n"), lambda p: p != "")).alias("pos", "p"))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.call_function("instr", F.col("p"), F.lit(MID)) + len(MID) - 1
    at = F.coalesce(F.sum(F.length("p") + len(CLOSE)).over(before), F.lit(0))
    role = unescape(F.substring_index(F.substr(F.col("p"), F.lit(len(OPEN) + 1)), MID, 1))
    return (parts.select("conv_id", "p", at.alias("at"), cut.alias("cut")).where(role == loss_role)
            .select("conv_id", (F.col("at") + F.col("cut")).cast("long").alias("start"),
                    (F.length("p") - F.col("cut")).cast("long").alias("length")))


def digest(formatted: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """What the output says, read back from it: turn and loss digests."""
    back = read_back(formatted, loss_role)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
