"""Incremental ingestion of meeting bundles with Structured Streaming.

New JSON files under ``<root>/<folder>/`` arrive as a file stream that carries
their paths only. Each micro-batch (``foreachBatch``):

 1. reads its files as the batch job does, so large documents are pulled
    apart here too, and unions them with the *pending* files -- files of folders
    that were not yet complete (or not decodable) after the previous batch.
    Completeness across batches is this small state table, so a batch reads
    pending + new files, never the whole history;
 2. gates the folders in that union;
 3. leaves out folders already ingested (status table), so a meeting is
    loaded once, and writes the still-incomplete folders' files as the next
    pending state (``_staging/pending/epoch=<id>``);
 4. builds the eight tables for the accepted folders with the same
    ``plans.ingest.build_tables`` the batch job uses and writes them under
    ``<table>/epoch=<id>`` with overwrite, so a retried epoch replaces its
    own output (idempotent);
 5. records the gate status of the touched folders for that epoch.

``read_tables`` presents the per-epoch output as the eight tables: nodes
keep the last epoch's version (later loads win, as in the batch job), edges,
topics and entities are de-duplicated.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..dictionaries import DEFAULT, Dictionaries
from ..operators import sinks as SK
from ..plans.ingest import build_tables
from ..sources import bundles as BN

STAGING = "_staging/new_files"
PENDING = "_staging/pending"
STATUS = "_ingest_status"


# files of a micro-batch; their paths pass through the driver
FILES_PER_BATCH = 10_000


def _file_stream(spark: SparkSession, root: str) -> DataFrame:
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", FILES_PER_BATCH).load(os.path.join(root, "*"))
            .select("path"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def _latest_epoch_dir(spark: SparkSession, root: str, before: int) -> str | None:
    """Path of the newest ``epoch=<n>`` folder under ``root`` with n < before
    (a metadata listing of the state folders, one per batch)."""
    if not _exists(spark, root):
        return None
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    epochs = [int(st.getPath().getName().split("=", 1)[1]) for st in p.getFileSystem(conf).listStatus(p)
              if st.getPath().getName().startswith("epoch=")]
    older = [e for e in epochs if e < before]
    return os.path.join(root, f"epoch={max(older)}") if older else None


def process_batch(spark: SparkSession, batch: DataFrame, epoch: int, out_dir: str,
                  d: Dictionaries = DEFAULT) -> None:
    pending_root = os.path.join(out_dir, PENDING)
    status_path = os.path.join(out_dir, STATUS)
    paths = [r["path"] for r in batch.collect()]
    if not paths:
        return
    new = BN.stage_bundles(spark, paths, os.path.join(out_dir, STAGING, f"epoch={epoch}"))
    files, parts = new.files.withColumn("seen", F.lit(epoch)), new.parts.withColumn("seen", F.lit(epoch))
    previous = _latest_epoch_dir(spark, pending_root, epoch)
    if previous:
        files = files.unionByName(spark.read.parquet(os.path.join(previous, "files")))
        parts = parts.unionByName(spark.read.parquet(os.path.join(previous, "parts")))
    # the latest copy of each file (a re-sent file replaces the older one);
    # a partition holds the copies of one file, bounded by the re-sends
    latest = Window.partitionBy("folder", "file").orderBy(F.col("seen").desc())
    files = files.withColumn("_k", F.row_number().over(latest)).filter(F.col("_k") == 1).drop("_k")
    parts = parts.join(files.select("folder", "file", "seen"), ["folder", "file", "seen"], "left_semi")
    status = BN.gate(files)
    if _exists(spark, status_path):
        # an epoch that is run again must not see what its first run accepted
        done = (spark.read.parquet(status_path).filter(F.col("reason").isNull() & (F.col("epoch") < epoch))
                .select("folder"))
        status = status.join(done, "folder", "left_anti")
    work = os.path.join(out_dir, "_work", f"status-epoch={epoch}")
    status.write.mode("overwrite").parquet(work)
    status = spark.read.parquet(work)
    accepted = BN.accepted(BN.Bundles(files.drop("seen"), parts.drop("seen")), status)
    tables = build_tables(spark, accepted, d, work_dir=os.path.join(out_dir, "_work", f"epoch={epoch}"))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(out_dir, name, f"epoch={epoch}"))
    waiting = status.filter(F.col("reason").isNotNull()).select("folder")
    for name, df in (("files", files), ("parts", parts)):
        df.join(waiting, "folder", "left_semi").write.mode("overwrite").parquet(
            os.path.join(pending_root, f"epoch={epoch}", name))
    # last: a crash before this leaves the epoch as if it had not run
    status.write.mode("overwrite").parquet(os.path.join(status_path, f"epoch={epoch}"))


def start(spark: SparkSession, bundle_root: str, out_dir: str, checkpoint_location: str,
          d: Dictionaries = DEFAULT, available_now: bool = True):
    """Start the incremental ingestion; with ``available_now`` it processes
    everything present and stops (scheduled batch), otherwise it keeps
    watching the folder."""
    writer = (_file_stream(spark, bundle_root).writeStream
              .foreachBatch(lambda batch, epoch: process_batch(spark, batch, epoch, out_dir, d))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_tables(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The eight tables over all epochs written so far."""
    out = {}
    for name, (schema, keys) in S.TABLES.items():
        path = os.path.join(out_dir, name)
        if not _exists(spark, path):
            out[name] = spark.createDataFrame([], schema)
            continue
        df = spark.read.parquet(path)
        if name == "graph_nodes":
            out[name] = SK.upsert_last(df, "id", ["epoch"], ["label", "type"])
        elif name in ("graph_edges", "topics", "entities"):
            out[name] = SK.insert_ignore(df.drop("epoch"), list(keys))
        else:
            out[name] = df.drop("epoch")
    return out


def read_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest gate status per folder."""
    st = spark.read.parquet(os.path.join(out_dir, STATUS))
    w = Window.partitionBy("folder").orderBy(F.col("epoch").desc())
    return st.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")
