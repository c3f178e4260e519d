"""Meeting bundles: one folder per meeting holding six JSON documents
(SRC1, SRC2, SRC4-SRC6).

Documents up to ``WHOLE_BYTES`` are whole-text rows (folder and name taken
from the file path), parsed once with ``try_parse_json`` into VARIANT; the few
it does not take, such as those with ``NaN``, are read again as ``json.load``
reads them. Larger documents are read in splits at closing braces, put in
order per document and pulled apart element by element, so no task ever holds
one whole. All of it is compacted into Parquet staging tables; every later
step reads those instead of millions of small files. The completeness and
decode gates are one aggregation per folder over the file rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import REQUIRED_FILES
from . import json_pull

FOLDER_RX = r"([^/]+)/[^/]+$"
FILE_RX = r"([^/]+)$"
# larger documents are pulled apart (a VARIANT may hold 128 MB)
WHOLE_BYTES = 16 << 20
# the arrays of large documents that become rows, and those nothing reads
STREAMED = {"transcript.json": ("data",), "summary.json": ("actionItems", "topics", "keyMoments")}
DROPPED = {"speakers.json": ("",), "events.json": ("",)}
PULLED = "folder string, file string, kind string, key string, nth long, pos long, value string"


@dataclass
class Bundles:
    """``files``: (folder, file, decoded, doc VARIANT) of every document;
    ``parts``: (folder, file, key, pos, value VARIANT) of the elements of
    large documents, whose ``doc`` lacks those arrays; ``folders``: (folder)
    of all folders, where known."""

    files: DataFrame
    parts: DataFrame | None = None
    folders: DataFrame | None = None


def _paths(root: str | list[str]) -> str | list[str]:
    return os.path.join(root, "*", "*.json") if isinstance(root, str) else root


def _named(raw: DataFrame, *columns: Column) -> DataFrame:
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(path, FOLDER_RX, 1).alias("folder"),
                      F.regexp_extract(path, FILE_RX, 1).alias("file"), *columns)


def read_bundle_files(spark: SparkSession, root: str | list[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SRC1: (folder, file, text) of the documents ``<root>/<folder>/<file>.json``
    (or of a list of files) up to ``whole_bytes``."""
    try:
        raw = spark.read.option("wholetext", True).text(_paths(root))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or not isinstance(root, str):
            raise
        return spark.createDataFrame([], "folder string, file string, text string")  # only empty folders
    return _named(raw.filter(F.col("_metadata.file_size") <= whole_bytes), F.col("value").alias("text"))


def _read_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["value"] = [json_pull.plain(t) for t in batch["text"]]
        yield batch[["folder", "file", "value"]]


def _one_document(rows) -> Iterator[str]:
    """The text of a document from its fragments: each but the last ended
    with a brace; whether the last did is told by the file's size."""
    last, total, size = None, 0, 0
    for _, _, size, value in rows:
        if last is not None:
            yield last + "}"
            total += 1
        last, total = value, total + len(value.encode())
    if last is None or total not in (size, size - 1):
        raise ValueError("bytes that are no UTF-8")
    yield last + "}" * (size - total)


def _pulled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PULLED.split(", ")]
    rows = (r for b in batches for r in zip(b["folder"], b["file"], b["size"], b["value"]))
    out, length = [], 0
    for (folder, file), own in groupby(rows, lambda r: r[:2]):
        for row in json_pull.document(_one_document(own), STREAMED.get(file, ()), DROPPED.get(file, ())):
            out.append((folder, file, *row))
            length += len(row[4] or "")
            if length > 1 << 22 or len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names).astype(object)
                out, length = [], 0
    if out:
        yield pd.DataFrame(out, columns=names).astype(object)


def pull_large_files(spark: SparkSession, root: str | list[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SRC1, SRC5 of documents beyond ``whole_bytes``: rows of schema
    ``PULLED`` (see ``json_pull.document``). Splits of one file are read by
    many tasks; its fragments then pass one task in order, one at a time."""
    try:
        raw = spark.read.option("lineSep", "}").text(_paths(root)).filter(F.col("_metadata.file_size") > whole_bytes)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or not isinstance(root, str):
            raise
        return spark.createDataFrame([], PULLED)
    pieces = _named(raw, F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"), "value").filter(F.col("file").isin(*REQUIRED_FILES))
    return (pieces.repartition("folder", "file").sortWithinPartitions("folder", "file", "block", "seq")
            .select("folder", "file", "size", "value").mapInPandas(_pulled, PULLED))


def bundle_folders(spark: SparkSession, root: str) -> DataFrame:
    """SRC4: the folders directly under ``root``, those without any file
    included, from one listing of ``root`` itself."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [(st.getPath().getName(),) for st in fs.listStatus(path) if st.isDirectory()]
    return spark.createDataFrame(names, "folder string")


def parse_files(rows: DataFrame, staging_path: str) -> DataFrame:
    """SRC5: (folder, file, decoded, doc) of whole documents (folder, file,
    text), written to two staging tables partitioned by file name, so reading
    one kind of document prunes to its partition, and the gates read two small
    columns. What ``try_parse_json`` does not take is read again, leniently."""
    spark = rows.sparkSession
    doc = F.try_parse_json("text")
    first, second = os.path.join(staging_path, "parsed"), os.path.join(staging_path, "read_again")
    (rows.filter(F.col("file").isin(*REQUIRED_FILES)).select("folder", "file", doc.alias("doc"), "text")
     .select("folder", "file", "doc", F.when(F.col("doc").isNull(), F.col("text")).alias("text"))
     .write.mode("overwrite").partitionBy("file").parquet(first))
    schema = "folder string, doc variant, text string, file string"
    parsed = spark.read.schema(schema).parquet(first)
    (parsed.filter(F.col("doc").isNull()).select("folder", "file", F.coalesce("text", F.lit("")).alias("text"))
     .mapInPandas(_read_again, "folder string, file string, value string")
     .select("folder", "file", F.try_parse_json("value").alias("doc")).write.mode("overwrite").partitionBy("file").parquet(second))
    again = spark.read.schema("folder string, doc variant, file string").parquet(second)
    flagged = lambda df, ok: df.select("folder", "file", ok.alias("decoded"), "doc")
    return flagged(parsed.filter(F.col("doc").isNotNull()), F.lit(True)).unionByName(flagged(again, F.col("doc").isNotNull()))


def stage_bundles(spark: SparkSession, root: str | list[str], staging_path: str, whole_bytes: int = WHOLE_BYTES) -> Bundles:
    """All bundle documents under ``root`` (or of a list of files) in staging
    tables, the only pass over the files; this also cuts lineage."""
    whole = parse_files(read_bundle_files(spark, root, whole_bytes), staging_path)
    path = os.path.join(staging_path, "pulled")
    pull_large_files(spark, root, whole_bytes).write.mode("overwrite").parquet(path)
    pulled = spark.read.schema(PULLED).parquet(path)
    large = pulled.filter("kind = 'doc'").select("folder", "file", F.col("value").isNotNull().alias("decoded"),
                                                 F.try_parse_json("value").alias("doc"))
    gone = pulled.filter("kind = 'superseded'").select("folder", "file", "key", "nth")
    parts = (pulled.filter("kind = 'element'").join(gone, ["folder", "file", "key", "nth"], "left_anti")
             .select("folder", "file", "key", F.col("pos").cast("int").alias("pos"), F.try_parse_json("value").alias("value")))
    return Bundles(whole.unionByName(large), parts, bundle_folders(spark, root) if isinstance(root, str) else None)


def exploded(bundles: Bundles, file: str, key: str) -> DataFrame:
    """(folder, pos, value): the elements of an array of one kind of document."""
    rows = (bundles.files.filter(F.col("file") == file)
            .select("folder", F.posexplode(elements(F.col("doc"), f"$.{key}")).alias("pos", "value")))
    if bundles.parts is None:
        return rows
    return rows.unionByName(bundles.parts.filter((F.col("file") == file) & (F.col("key") == key)).select("folder", "pos", "value"))


def gate(files: DataFrame, required=REQUIRED_FILES, folders: DataFrame | None = None) -> DataFrame:
    """SRC4 + SRC5: per folder, the reject reason or NULL.

    Missing files are reported for the first absent name in ``required``
    order; otherwise any undecodable required file rejects the whole folder
    (including files the enrichment never uses). A folder without any
    document is known from ``folders`` only.
    """
    req = F.array(*[F.lit(r) for r in required])
    per_folder = (files.filter(F.col("file").isin(*required)).groupBy("folder")
                  .agg(F.collect_set("file").alias("_present"), F.bool_or(~F.col("decoded")).alias("_undecodable")))
    if folders is not None:
        per_folder = (folders.select("folder").distinct().join(per_folder, "folder", "full")
                      .withColumn("_present", F.coalesce("_present", F.array().cast("array<string>"))))
    first_missing = F.get(F.array_except(req, F.col("_present")), 0)
    reason = (F.when(first_missing.isNotNull(), F.lit("missing"))
              .when(F.col("_undecodable"), F.lit("undecodable")))
    detail = (F.when(first_missing.isNotNull(), F.concat(F.lit("Missing file "), first_missing, F.lit(" in "), F.col("folder")))
              .when(F.col("_undecodable"), F.concat(F.lit("JSON Decode Error in "), F.col("folder"))))
    return per_folder.select("folder", reason.alias("reason"), detail.alias("detail"))


def rejects(status: DataFrame) -> DataFrame:
    """SRC6: the rejected folders with reason and message."""
    return status.filter(F.col("reason").isNotNull())


def first_rejects(status: DataFrame, n: int = 5) -> DataFrame:
    """SRC6: the first ``n`` reject messages (by folder) for display."""
    return rejects(status).orderBy("folder").limit(n).select("folder", "detail")


def report(status: DataFrame) -> DataFrame:
    """SRC6: processed and rejected folder counts in one row."""
    return status.agg(F.count_if(F.col("reason").isNull()).alias("processed"),
                      F.count_if(F.col("reason").isNotNull()).alias("rejected"))


def accepted(bundles: Bundles, status: DataFrame) -> Bundles:
    ok = status.filter(F.col("reason").isNull()).select("folder")
    of = lambda df: None if df is None else df.join(ok, "folder", "left_semi")
    return Bundles(of(bundles.files), of(bundles.parts))


# ----------------------------------------------------------- field access
def present(doc: Column, path: str) -> Column:
    """True when the key at ``path`` exists (a JSON null counts as present)."""
    return F.variant_get(doc, path, "variant").isNotNull()


def field(doc: Column, path: str, dtype: str | T.DataType, default: Column | None = None) -> Column:
    """Value at ``path`` cast to ``dtype`` (NULL when it does not convert);
    ``default`` replaces an absent key only, as ``dict.get(key, default)``."""
    dt = dtype if isinstance(dtype, str) else dtype.simpleString()
    value = F.try_variant_get(doc, path, dt)
    if default is None:
        return value
    return F.when(present(doc, path), value).otherwise(default)


def elements(doc: Column, path: str) -> Column:
    """Array at ``path`` as array<variant>; absent or NULL gives []."""
    return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))


def speaker_meta_values(doc: Column) -> Column:
    """SRC2: the values of a root object with dynamic keys."""
    return F.coalesce(F.map_values(F.try_variant_get(doc, "$", "map<string,string>")),
                      F.array().cast("array<string>"))
