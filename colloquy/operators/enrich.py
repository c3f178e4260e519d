"""Enrichment operators (ingestion side): accounts, call types, action items,
speaker roles, competitor and product mentions.

Dictionaries are small fixed vocabularies, so each compiles into Column
expressions (a CASE chain or one whole-word test per term) evaluated inside
the scan's codegen stage: no join, no shuffle. Only de-duplication of
mentions shuffles, after map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as DICT
from ..dictionaries import DEFAULT, Dictionaries
from ..functions import classify as C
from ..functions import text as X
from .containment import containing


# ----------------------------------------------------------------- accounts
def with_accounts(meetings: DataFrame, title: str = "title", emails: str | None = "all_emails",
                  d: Dictionaries = DEFAULT, out: str = "account") -> DataFrame:
    """ENR4-ENR6: account by title dictionary, else by mail domain, else
    'Unknown Customer'."""
    emails_col = F.col(emails) if emails else F.array().cast("array<string>")
    return meetings.withColumn(out, C.resolve_account(F.col(title), emails_col, d))


def dictionary_first_match(df: DataFrame, text_col: str, dictionary: DataFrame, key_cols: list[str],
                           term_col: str = "term", rank_col: str = "rank", out: str = "match") -> DataFrame:
    """First dictionary term (lowest rank) contained in ``text_col`` for each
    key, for dictionaries kept as DataFrames (JOI12).

    A large dictionary is looked up by anchors (see ``containment``), so no
    text is tested against every term; ``min_by`` keeps list-order priority.
    Rows without a hit get NULL.
    """
    ready = dictionary.select(F.lower(F.col(term_col)).alias("_term"), F.col(term_col).alias("_label"),
                              F.col(rank_col).alias("_rank"))
    texts = df.select(*key_cols, F.lower(F.col(text_col)).alias("_text"))
    hits = (containing(texts, ["_text"], ready, "_term", lambda c: F.col(c).contains(F.col("_term")))
            .groupBy(*key_cols).agg(F.min_by("_label", "_rank").alias(out)))
    return df.join(hits, on=key_cols, how="left")


def dictionary_mentions(turns: DataFrame, dictionary: DataFrame, text_col: str = "sentence",
                        keep: tuple[str, ...] = ("meeting_id", "speaker_name")) -> DataFrame:
    """ENR15 / ENR16 for a dictionary kept as a DataFrame (term, entity_name,
    entity_type): the distinct entities whose term is a whole word of the
    lower-cased text, with the ``keep`` columns of the turn. Terms made of
    word characters alone are equal to a word of the text and meet it in a
    join; only the others are looked for within texts."""
    terms = dictionary.select(F.lower("term").alias("_term"), "entity_name", "entity_type").distinct()
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("_term"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit(f"(?<![{X.WORD_CHARS}])"), quoted, F.lit(f"(?![{X.WORD_CHARS}])"))
    texts = turns.select(*keep, F.lower(F.col(text_col)).alias("_text"))
    word = F.col("_term").rlike(f"\\A[{X.WORD_CHARS}]+\\z")
    # dealt evenly, since a task holds the entities of all its turns
    said = texts.hint("rebalance").select(*keep, F.explode(F.array_distinct(F.split("_text", f"[^{X.WORD_CHARS}]+"))).alias("_word"))
    words = said.join(terms.filter(word), F.col("_word") == F.col("_term"))
    others = containing(texts, ["_text"], terms.filter(~word), "_term",
                        lambda c: F.col(c).contains(F.col("_term")) & F.regexp_like(F.col(c), pattern))
    found = [df.select(*keep, "entity_name", "entity_type") for df in (words, others)]
    return found[0].unionByName(found[1]).distinct()


# ------------------------------------------------------------- action items
def action_items(items: DataFrame, meeting_col: str = "meeting_id", pos_col: str = "pos",
                 item_col: str = "item", d: Dictionaries = DEFAULT, keep_pos: bool = False) -> DataFrame:
    """ENR7-ENR10: one action-item row per raw item string.

    id ``{meeting}_ai_{pos}``, owner/task split at the first colon, deadline
    label from the ordered patterns, status 'Open'; with ``keep_pos`` also the
    position, ``pos``.
    """
    owner, task = C.split_owner_task(F.col(item_col))
    pos = [F.col(pos_col).alias("pos")] if keep_pos else []
    base = items.select(
        *pos,
        F.concat(F.col(meeting_col).cast("string"), F.lit("_ai_"), F.col(pos_col).cast("string")).alias("id"),
        F.col(meeting_col).alias("meeting_id"),
        task.alias("task"), owner.alias("owner"))
    return base.select("id", "meeting_id", "task", "owner",
                       C.deadline_label(F.col("task"), d).alias("deadline"),
                       F.lit(DICT.DEFAULT_STATUS).alias("status"), *["pos"] * keep_pos)


# ------------------------------------------------------------ speaker roles
def speaker_roles(turns: DataFrame, meetings: DataFrame, speaker_col: str = "speaker_name",
                  d: Dictionaries = DEFAULT) -> DataFrame:
    """ENR14: attach ``speaker_role`` to every turn.

    ``meetings`` must carry meeting_id, all_emails, host, call_type; one row
    of it comes to each turn by one equi-join (a very long meeting is split by
    AQE) and the rule is a column of the joined row. Turns without a meeting
    id or a speaker have no role.
    """
    known = meetings.select("meeting_id", F.col("all_emails").alias("_emails"), F.col("host").alias("_host"),
                            F.col("call_type").alias("_call_type"))
    speaker = F.col(speaker_col)
    role = C.speaker_role(speaker, F.col("_emails"), F.col("_host"), F.col("_call_type"), d)
    return (turns.join(known, "meeting_id", "left")
            .select(*turns.columns, F.when(F.col("meeting_id").isNotNull() & speaker.isNotNull(), role).alias("speaker_role")))


# ----------------------------------------------------------------- mentions
def _entries(d: Dictionaries) -> list[tuple[str, str, list[str]]]:
    """(entity name, entity type, whole-word aliases) for every dictionary
    entry; a product matches its short name or its full name."""
    out = [(c, "Competitor", [c.lower()]) for c in d.competitors]
    for p in d.products:
        short = p.replace(d.product_prefix, "").lower() if d.product_prefix else p.lower()
        aliases = [short] if short == p.lower() else [short, p.lower()]
        out.append((p, "Product", aliases))
    return out


def turn_mentions(turns: DataFrame, text_col: str = "sentence", speaker_col: str | None = "speaker_name",
                  d: Dictionaries = DEFAULT) -> DataFrame:
    """ENR15/ENR16: (meeting_id, speaker, entity_name, entity_type) for every
    turn that names a competitor or product as a whole word of its
    lower-cased text; distinct rows."""
    low = F.lower(F.col(text_col))
    hits = []
    for name, kind, aliases in _entries(d):
        cond = F.lit(False)
        for a in aliases:
            cond = cond | X.contains_word(low, a)
        hits.append(F.when(cond, F.struct(F.lit(name).alias("entity_name"), F.lit(kind).alias("entity_type"))))
    keep = ["meeting_id"] + ([speaker_col] if speaker_col else [])
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return (turns.select(*keep, F.explode(found).alias("_hit"))
            .select(*keep, "_hit.entity_name", "_hit.entity_type")
            .distinct())


def entities(mentions: DataFrame) -> DataFrame:
    """ENR17: distinct entities per meeting by type (SET4)."""
    return mentions.select("meeting_id", "entity_name", "entity_type").distinct()
