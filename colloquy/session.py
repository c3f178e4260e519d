"""Spark session construction and lineage cutting.

On a cluster the session comes from the platform and already names a shared
checkpoint folder in ``spark.checkpoint.dir``; this module only fills in
settings that are unset, so the same code runs in tests on ``local[*]``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings this library relies on. Session time zone UTC keeps timestamp
# parsing and date truncation identical on every executor.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # of a repeated JSON key the last one counts, as in json.load
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# Static settings applied when this module builds the session.
BUILD_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "colloquy",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Get or create a session with the library's required settings.

    ``master`` and ``shuffle_partitions`` are only applied when given, so a
    cluster-provided session keeps its own values.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in BUILD_CONF.items():
        builder = builder.config(key, value)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_required_conf(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings the operators assume (idempotent)."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` (or the SparkContext's folder). Only when
    neither is set on a local master, as in tests, a private folder is
    created and registered; a cluster without the setting is an error, since
    a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
        conf_dir = tempfile.mkdtemp(prefix="colloquy-ckpt-")  # local runs and tests only
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder.

    Reliable checkpoints survive executor loss (local checkpoints do not), so
    long ingestion lineages are cut here.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.
    Like ``cut_lineage``, but joins with it go by the size of its files."""
    folder = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table_path(root: str, name: str) -> str:
    return os.path.join(root, f"{name}.parquet")


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large run: shuffle partitions sized so each holds about
    ``target_partition_bytes`` of the input (AQE coalesces what turns out
    smaller and splits skewed partitions), scans split at the same size.
    Apply with ``spark.conf.set`` before building the queries."""
    partitions = max(cores * 3, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }
