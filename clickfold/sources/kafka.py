"""Event messages from Kafka, or from files with the same columns."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from clickfold.schemas import KAFKA_SCHEMA, TOPICS


def kafka_options(
    servers: str,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Options for one subscription to all topics.

    ``starting_offsets`` (``earliest``, ``latest`` or offsets as JSON) holds for a stream
    without a checkpoint; see :func:`resume_offsets`.
    ``max_offsets_per_trigger`` bounds a micro-batch after an outage;
    ``min_partitions`` splits large topic partitions into more tasks.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(TOPICS),
        "startingOffsets": starting_offsets,
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def resume_offsets(
    given: str | None, stored: Mapping[str, Mapping[str, int]], has_checkpoint: bool
) -> str:
    """Where a landing stream starts: after the stored messages where its checkpoint was
    lost. ``latest`` would then skip what was sent meanwhile, and is refused. A topic
    nothing was stored of starts at its beginning (-2); Kafka wants all partitions named, and
    refuses the start where others are silent: name those in ``given``."""
    if has_checkpoint or not stored:
        return given or "latest"
    if given == "latest":
        raise ValueError("messages are stored but the checkpoint is gone: latest would skip some")
    if given:
        return given
    return json.dumps({t: dict(stored[t]) if t in stored else {"0": -2} for t in TOPICS})


def read_event_stream(
    spark: SparkSession, options: Mapping[str, str], path: str | None = None
) -> DataFrame:
    """A stream of (key, value, topic, partition, offset).

    With ``path`` the messages are Parquet files, read with the file source; the
    options are then the file source's.
    """
    if path is None:
        stream = spark.readStream.format("kafka").options(**options).load()
    else:
        stream = spark.readStream.schema(KAFKA_SCHEMA).options(**options).parquet(path)
    return stream.select(*KAFKA_SCHEMA.names)


def write_topics(messages: DataFrame, servers: str) -> None:
    """Send routed messages; the sink picks the topic from the ``topic`` column."""
    messages.select("topic", "key", "value").write.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("kafka.acks", "all").save()
