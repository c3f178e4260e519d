"""Stored tables that change while they are read (SNK1, MUT1, SNK5).

A store is a folder of written table folders and of manifests. A manifest
names, table by table, the folders that make it up; the one with the highest
number is the present state. Writers put their folders in place first and
then rename one manifest in, which fails if another writer was faster. A reader takes
one manifest, so it never meets a missing table or a mix of two states, and
what it reads stays until ``vacuum``.

Keyed tables are written in buckets of their key, so a merge writes only the
buckets in which its keys fall; the others keep their files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed first; read the new state and try again."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, os.path.join(root, MANIFESTS))
    if not fs.exists(path):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, root: str) -> dict:
    """The present state: ``{"number", "tables": {name: {"schema", "buckets",
    "key", "folders": {bucket or "": folder}}}}``."""
    numbers = _numbers(spark, root)
    if not numbers:
        return {"number": 0, "tables": {}}
    text = spark.read.option("wholetext", True).text(os.path.join(root, MANIFESTS, f"{numbers[-1]}.json")).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, root: str, number: int, tables: dict) -> None:
    fs, path = _fs(spark, os.path.join(root, MANIFESTS, f"{number}.json"))
    _, draft = _fs(spark, os.path.join(root, MANIFESTS, f"_{uuid.uuid4()}"))
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"number": number, "tables": tables}).encode()))
    out.close()
    if fs.exists(path) or not fs.rename(draft, path):
        fs.delete(draft, False)
        raise Conflict(f"{root}: state {number} was committed by another writer")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, folder: str, key: str | None, buckets: int) -> dict[str, str]:
    if key is None:
        df.write.parquet(folder)
        return {"": folder}
    rows = df.withColumn(BUCKET, _bucket(key, buckets))
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
    return {str(r[0]): os.path.join(folder, f"{BUCKET}={r[0]}") for r in rows.select(BUCKET).distinct().collect()}


def refresh(tables: dict[str, DataFrame], root: str, keys: dict[str, tuple[str, int]] | None = None) -> None:
    """SNK1: all ``tables`` anew, seen by readers at once; tables not named
    stay. ``keys`` gives (key column, buckets) of those that are merged into."""
    spark = next(iter(tables.values())).sparkSession
    state = manifest(spark, root)
    number = state["number"] + 1
    made = {}
    for name, df in tables.items():
        key, buckets = (keys or {}).get(name, (None, 0))
        folder = os.path.join(root, "data", f"{name}-{number}-{uuid.uuid4()}")
        made[name] = {"schema": json.loads(df.schema.json()), "key": key, "buckets": buckets,
                      "folders": _write(df, folder, key, buckets)}
    _commit(spark, root, number, state["tables"] | made)


def _read(spark: SparkSession, entry: dict, only: Sequence[str] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(entry["schema"])
    folders = [f for b, f in entry["folders"].items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """SRC3: the tables of the present state."""
    return {name: _read(spark, entry) for name, entry in manifest(spark, root)["tables"].items()}


def merge(spark: SparkSession, root: str, table: str, changes: DataFrame,
          apply: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Apply ``changes`` (with the table's key column) to a stored table:
    ``apply(rows, changes) -> (new rows, rejects)`` sees the buckets the
    changes fall in, and only those are written again. Returns the rejects,
    which are stored with the new state."""
    state = manifest(spark, root)
    entry, number = state["tables"][table], state["number"] + 1
    at = _bucket(entry["key"], entry["buckets"])
    touched = [str(r[0]) for r in changes.select(at).distinct().collect()]  # at most the number of buckets
    rows, rejects = apply(_read(spark, entry, touched), changes)
    folder = os.path.join(root, "data", f"{table}-{number}-{uuid.uuid4()}")
    new = _write(rows, folder, entry["key"], entry["buckets"])
    kept = {b: f for b, f in entry["folders"].items() if b not in touched}
    refused = os.path.join(root, "data", f"{table}-rejects-{number}-{uuid.uuid4()}")
    rejects.write.parquet(refused)
    _commit(spark, root, number, state["tables"] | {table: entry | {"folders": kept | new}})
    return spark.read.schema(rejects.schema).parquet(refused)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete what only earlier states name; readers of those must be done.
    Returns the number of folders deleted."""
    state = manifest(spark, root)
    used = [f for entry in state["tables"].values() for f in entry["folders"].values()]
    fs, data = _fs(spark, os.path.join(root, "data"))
    names = [st.getPath().getName() for st in fs.listStatus(data)] if fs.exists(data) else []
    gone = 0
    for name in names:
        folder = os.path.join(root, "data", name)
        parts = {f for f in used if f == folder or f.startswith(folder + "/")}
        if not parts:
            fs.delete(_fs(spark, folder)[1], True)
            gone += 1
            continue
        if folder in parts:
            continue
        for st in fs.listStatus(_fs(spark, folder)[1]):
            sub = st.getPath().getName()
            if sub.startswith(f"{BUCKET}=") and os.path.join(folder, sub) not in parts:
                fs.delete(st.getPath(), True)
                gone += 1
    for number in _numbers(spark, root)[:-1]:
        fs.delete(_fs(spark, os.path.join(root, MANIFESTS, f"{number}.json"))[1], False)
    return gone
