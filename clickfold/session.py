"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

SESSION_CONF = {
    # All event times are UTC wall-clock values.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Merge shuffle partitions up to this size, also where that leaves cores idle:
    # what is written after a shuffle should be few large files.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}

# A streaming query switches adaptive execution off for its session. Inside a batch the
# data is an ordinary table, and sizing its files and splitting hot partitions needs it.
FILES_CONF = {key: value for key, value in SESSION_CONF.items() if ".adaptive." in key}

# A batch sorts its rows by id, and a sorted row takes about sixteen times its shuffled size:
# its tasks get less than files would want, which compaction merges later.
BATCH_CONF = {
    **FILES_CONF,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
}

# Partitions can be merged but, under a sort by key, not split at run time. What they hold at
# most is therefore set by their number before merging: so much of Parquet, so many messages.
PARTITIONS_BEFORE_MERGE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
BYTES_PER_PARTITION = 4 * 1024**2
MESSAGES_PER_PARTITION = 200_000

# Needed by the stateful de-duplication only: key state lives on executor disks
# and reaches the checkpoint as a change log rather than as full snapshots.
STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(
    app_name: str = "clickfold", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def session_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Apply settings for a block; a streaming query copies them when it starts."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def batch_conf(spark: SparkSession, stored_bytes: int = 0, messages: int = 0) -> dict[str, str]:
    """Settings for a batch over that much; never fewer partitions than set around it."""
    least = spark.conf.get(PARTITIONS_BEFORE_MERGE, None) or spark.conf.get(
        "spark.sql.shuffle.partitions"
    )
    wanted = max(stored_bytes // BYTES_PER_PARTITION, messages // MESSAGES_PER_PARTITION)
    return {**BATCH_CONF, PARTITIONS_BEFORE_MERGE: str(max(int(least), wanted))}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a local
    master, where driver and executors share a disk, may fall back to a temp folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="clickfold-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
