"""Exact dedup against a minimal perfect hash over historical digests.

The distinct digests of the texts collected so far are dealt into shards by
hash. Each shard gets a minimal perfect hash of its own (cascaded bit arrays:
a digest alone in its position of a level is placed there, the others go on to
the next level; the slot is the rank of its bit). A slot holds the full digest
and the locator of the winner, the row that stays. New rows look their digest
up; the 32 bytes in the slot decide, so a digest outside the history is never
taken for a member. Members repeat the historical winner, nonmembers are
grouped among themselves.

Before any shuffle by digest or shard, the rows of one input partition with
the same digest become one lookup, and answers go back to the rows by
(partition, digest): a text that a third of all rows share costs one row per
input partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

BLANKS = "[\\x20\\x09-\\x0D]+"
# digests a shard holds on average: about 1 MB of slots
SHARD_KEYS = 1 << 14
# positions of a level for each digest that reaches it
SPACE = 2
WORDS = 4  # 64-bit words of a SHA-256 digest
ELSEWHERE = -1  # row number of a winner that is in no row of the table at hand

INDEX = ("shard long, shards long, sizes array<long>, levels array<binary>, "
         "digests binary, no_ids binary, ids binary, rows binary")
SLOTS = "digest binary, no_id boolean, id long, row long"
ANSWERS = ("chunk long, digest binary, member boolean, no_id boolean, id long, row long, n long")


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A hash of whole digests, another one for each level."""
    h = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k in range(WORDS):
        h ^= words[:, k]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def digest_words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, WORDS)


def build_hash(words: np.ndarray) -> tuple[list[int], list[bytes], np.ndarray]:
    """``sizes, levels, slots`` of distinct digests: the bit arrays and the
    slot, 0 to n - 1, of each digest."""
    sizes, levels = [], []
    slots, left, placed = np.empty(len(words), np.int64), np.arange(len(words)), 0
    while len(left):
        size = SPACE * len(left)
        at = (_mixed(words[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = placed + np.cumsum(bits)[at[alone]] - 1
        placed += int(bits.sum())
        left = left[~alone]
        sizes.append(size)
        levels.append(np.packbits(bits).tobytes())
    return sizes, levels, slots


def find_slots(words: np.ndarray, sizes, levels) -> np.ndarray:
    """Slot of each digest; a nonmember gets any slot, or -1."""
    slots, left, placed = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, (size, packed) in enumerate(zip(sizes, levels)):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(size)).astype(bool)
        at = (_mixed(words[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = placed + np.cumsum(bits)[at[hit]] - 1
        placed += int(bits.sum())
        left = left[~hit]
    return slots


def numbered_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, chunk, no_id, id, digest`` of every row, written once: the
    number of a row and its input partition stay the same for all readers.
    NULL text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return keep(docs.select(
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("chunk"),
        F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"),
        F.unhex(F.sha2(F.regexp_replace(text, BLANKS, " "), 256)).alias("digest")))


def _winner() -> Column:
    """Least locator: smallest id, NULL ids last, then the first row."""
    return F.min(F.struct("no_id", "id", "row")).alias("w")


def build_history(rows: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The index over the distinct digests of ``rows(digest, no_id, id, row)``,
    one row per shard (schema ``INDEX``); the winner of a digest has the
    smallest id. No rows give an index of one empty shard."""
    shards = max(1, -(-rows.count() // shard_keys))
    winners = (rows.groupBy("digest").agg(_winner()).select("digest", "w.*")
               .withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))))

    def shard(key, g: pd.DataFrame) -> pd.DataFrame:
        sizes, levels, slots = build_hash(digest_words(g["digest"]))
        g = g.iloc[np.argsort(slots)]
        return pd.DataFrame([(key[0], shards, sizes, levels, b"".join(g["digest"]), g["no_id"].to_numpy(np.bool_).tobytes(),
                              g["id"].to_numpy("<i8").tobytes(), g["row"].to_numpy("<i8").tobytes())],
                            columns=[c.split()[0] for c in INDEX.split(", ")])

    built = winners.groupBy("shard").applyInPandas(shard, INDEX)
    empty = rows.sparkSession.createDataFrame([(0, shards, [], [], b"", b"", b"", b"")] if shards == 1 else [], INDEX)
    # an empty first shard keeps the number of shards of an empty history
    return keep(built.unionByName(empty))


def _slots(index: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: the hash, the slots' digests and their locators."""
    r = index.loc[index["digests"].map(len).idxmax()]
    return ([r["sizes"], r["levels"]], np.frombuffer(r["digests"], "<u8").reshape(-1, WORDS),
            np.frombuffer(r["no_ids"], np.bool_), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<i8"))


def slots(index: DataFrame) -> DataFrame:
    """The slots as rows ``digest, no_id, id, row``; with those of new winners
    they build the next history. The winners are rows of another table then."""
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(len(part)):
                _, digests, no_ids, ids, _ = _slots(part.iloc[k:k + 1])
                yield pd.DataFrame({"digest": [d.tobytes() for d in digests], "no_id": no_ids, "id": ids, "row": ELSEWHERE})

    return index.mapInPandas(read, SLOTS)


def _look_up(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    asked = asked.drop(columns="shard").assign(member=False)
    if len(asked) and len(index):
        (sizes, levels), digests, no_ids, ids, rows = _slots(index)
        words = digest_words(asked["digest"])
        at = find_slots(words, sizes, levels)
        member = at >= 0
        member[member] = (digests[at[member]] == words[member]).all(axis=1)
        at = at[member]
        total = np.bincount(at, weights=asked["n"].to_numpy()[member], minlength=len(ids)).astype(np.int64)
        for name, of in (("no_id", no_ids), ("id", ids), ("row", rows), ("n", total)):
            column = asked[name].to_numpy(copy=True)
            column[member] = of[at]
            asked[name] = column
        asked["member"] = member
    return asked[[c.split()[0] for c in ANSWERS.split(", ")]]


def look_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``chunk, digest, member, no_id, id, row, n``: for the digests of each
    chunk of ``rows`` the winner and the number of rows with this digest."""
    shards = index.agg(F.max("shards")).first()[0]
    asked = (rows.groupBy("chunk", "digest").agg(_winner(), F.count("*").alias("n"))
             .select("chunk", "digest", "w.*", "n", F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")))
    found = keep(asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, ANSWERS))
    new = found.where("not member")
    groups = (new.groupBy("digest").agg(_winner(), F.sum("n").alias("n"))
              .select("digest", F.lit(False).alias("member"), "w.*", "n"))
    return found.where("member").unionByName(new.select("chunk", "digest").join(groups, "digest"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, keep_id, group_size, kept,
    text_sha256, in_history``.

    Texts are equal when they are identical after each run of blanks became
    one space. With ``history`` (an index of earlier tables) its members are
    dropped in favour of the historical winner, whatever the ids, and
    ``group_size`` counts the rows of ``docs``. Without, the rows up to the
    middle of the id range count as collected first: their digests are the
    history all rows are looked up in, and as later ids are larger, the
    smallest id of each text stays.

    NULL text counts as empty. NULL ids count as the largest and join no
    history. Of repeated rows (same id and text) one is kept. An empty table
    gives no rows. Other columns, whatever their names, are not read.
    """
    rows = numbered_digests(docs, id_col, text_col)
    if history is None:
        low, high = rows.where("not no_id").agg(F.min("id"), F.max("id")).first()
        middle = 0 if low is None else low + (high - low) // 2
        history = build_history(rows.where(~F.col("no_id") & (F.col("id") <= middle)))
    else:
        history = history.withColumn("rows", F.unhex(F.repeat(F.lit("FF"), F.length("rows"))))  # every row number ELSEWHERE
    won = look_up(rows, history).select(
        "chunk", "digest", "member", F.when(~F.col("no_id"), F.col("id")).alias("keep_id"), F.col("row").alias("winner"), "n")
    return rows.join(won, ["chunk", "digest"]).select(
        F.when(~F.col("no_id"), F.col("id")).alias(id_col), "keep_id", F.col("n").alias("group_size"),
        (F.col("row") == F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"))
