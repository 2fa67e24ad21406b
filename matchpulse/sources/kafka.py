"""Kafka options, stream readers and stream writers; files stand in for topics in tests."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from matchpulse.sources.staging import shared_folder

LOG_SCHEMA = "key string, value string, timestamp timestamp, partition int, offset bigint"


@dataclass(frozen=True)
class Security:
    """Connection security; without a mechanism the connection is plain."""

    protocol: str = "PLAINTEXT"
    mechanism: str | None = None
    username: str | None = None
    password: str | None = field(default=None, repr=False)

    @classmethod
    def from_env(cls) -> Security:
        """Secrets come from the environment only."""
        return cls(
            protocol=os.environ.get("KAFKA_SECURITY_PROTOCOL", "PLAINTEXT"),
            mechanism=os.environ.get("KAFKA_SASL_MECHANISM"),
            username=os.environ.get("KAFKA_SASL_USERNAME"),
            password=os.environ.get("KAFKA_SASL_PASSWORD"),
        )


@dataclass(frozen=True)
class Topic:
    servers: str
    name: str
    starting_offsets: str = "latest"
    group_id: str | None = None
    max_offsets_per_trigger: int | None = None
    security: Security = Security()


def kafka_security_options(security: Security) -> dict[str, str]:
    """The same options serve readers and writers."""
    if not security.mechanism:
        return {}
    login = "org.apache.kafka.common.security.scram.ScramLoginModule"
    return {
        "kafka.security.protocol": security.protocol,
        "kafka.sasl.mechanism": security.mechanism,
        "kafka.sasl.jaas.config": f'{login} required username="{security.username}" password="{security.password}";',
    }


def reader_options(topic: Topic) -> dict[str, str]:
    """Options of a stream. From the earliest offset on the first micro-batch would be the whole log, so
    that start asks for a limit."""
    if topic.starting_offsets != "latest" and not topic.max_offsets_per_trigger:
        raise ValueError("set max_offsets_per_trigger when the stream does not start at the latest offsets")
    options = {
        "kafka.bootstrap.servers": topic.servers,
        "subscribe": topic.name,
        "startingOffsets": topic.starting_offsets,
        "failOnDataLoss": "false",
        **kafka_security_options(topic.security),
    }
    if topic.group_id:
        options["kafka.group.id"] = topic.group_id
    if topic.max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(topic.max_offsets_per_trigger)
    return options


def writer_options(topic: Topic) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": topic.servers,
        "topic": topic.name,
        **kafka_security_options(topic.security),
    }


def read_topic(spark: SparkSession, topic: Topic) -> DataFrame:
    """Telemetry, request, response or prediction messages as a stream."""
    return spark.readStream.format("kafka").options(**reader_options(topic)).load()


@dataclass(frozen=True)
class Stretch:
    """A part of a log: times in [start, end) and, per partition, offsets in [first, last); what is not given is not bounded.

    With ``offsets`` only the partitions named there are in the stretch of a file log; a topic wants every partition
    named, and takes None as the beginning or end of one.
    """

    start: datetime | None = None
    end: datetime | None = None
    offsets: dict[int, tuple[int | None, int | None]] | None = None


def _millis(at: datetime) -> str:
    if at.tzinfo is None:
        raise ValueError("times of a stretch need a time zone")
    return str(int(at.timestamp() * 1000))


def stretch_options(topic: Topic, stretch: Stretch) -> dict[str, str]:
    """Where a replay of a topic begins and ends, as the reader's options: offsets per partition or times, not both."""
    if stretch.offsets is not None:
        if stretch.start or stretch.end:
            raise ValueError("a topic is replayed by offsets or by times")
        edge = lambda i, none: json.dumps({topic.name: {str(p): none if o[i] is None else o[i] for p, o in sorted(stretch.offsets.items())}})
        return {"startingOffsets": edge(0, -2), "endingOffsets": edge(1, -1)}
    options = {}
    if stretch.start:
        # a partition without messages since then has nothing to replay
        options |= {"startingTimestamp": _millis(stretch.start), "startingOffsetsByTimestampStrategy": "latest"}
    if stretch.end:
        options["endingTimestamp"] = _millis(stretch.end)
    return options


def replay_options(topic: Topic, stretch: Stretch | None = None) -> dict[str, str]:
    options = reader_options(replace(topic, starting_offsets="latest", max_offsets_per_trigger=None))
    options = {**options, "startingOffsets": "earliest", "failOnDataLoss": "true"}
    return {**options, **stretch_options(topic, stretch)} if stretch else options


def replay_topic(spark: SparkSession, topic: Topic, stretch: Stretch | None = None) -> DataFrame:
    """The retained log of a topic, or a stretch of it, as a bounded table; lost offsets are an error."""
    return spark.read.format("kafka").options(**replay_options(topic, stretch)).load()


def archive(log: DataFrame, path: str) -> None:
    """Append messages to a file log that is laid out for replays: a folder per day, ordered by time and position inside its files."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds("timestamp") / 86_400).cast("int")).alias("day")  # in UTC
    rows = log.select(*[x.split()[0] for x in LOG_SCHEMA.split(", ")], day)
    # ranges of time spread a busy day over files and keep the statistics of each narrow
    rows.repartitionByRange("day", "timestamp").sortWithinPartitions("day", "timestamp", "partition", "offset").write.partitionBy("day").mode(
        "append"
    ).parquet(path)


def replay_archive(spark: SparkSession, path: str, stretch: Stretch = Stretch()) -> DataFrame:
    """A stretch of an archive: folders outside its days are not listed in the scan, row groups outside its times and offsets are skipped."""
    rows = spark.read.schema(f"{LOG_SCHEMA}, day date").parquet(path)
    at = F.col("timestamp")
    if stretch.start is not None:
        start = F.timestamp_millis(F.lit(int(_millis(stretch.start))))
        rows = rows.filter((F.col("day") >= F.lit(stretch.start.astimezone(timezone.utc).date())) & (at >= start))
    if stretch.end is not None:
        end = F.timestamp_millis(F.lit(int(_millis(stretch.end))))
        rows = rows.filter((F.col("day") <= F.lit(stretch.end.astimezone(timezone.utc).date())) & (at < end))
    if stretch.offsets is not None:
        inside = F.lit(False)
        for partition, (first, last) in sorted(stretch.offsets.items()):
            own = F.col("partition") == partition
            own = own if first is None else own & (F.col("offset") >= first)
            inside = inside | (own if last is None else own & (F.col("offset") < last))
        rows = rows.filter(inside)
    return rows.drop("day")


def read_files(spark: SparkSession, path: str, file_format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of message files with the log's columns (parquet or JSON lines)."""
    reader = spark.readStream.format(file_format).schema(LOG_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def replay_files(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.format(file_format).schema(LOG_SCHEMA).load(path)


def checkpoint_location(spark: SparkSession, name: str, root: str | None = None, resume: bool = False) -> str:
    """A new folder per start, so state begins empty; ``resume`` names the same folder every time."""
    base = f"{(root or shared_folder(spark)).rstrip('/')}/{name}"
    return base if resume else f"{base}-{uuid.uuid4()}"


def writer(
    df: DataFrame,
    name: str,
    mode: str = "kafka",
    topic: Topic | None = None,
    path: str | None = None,
    trigger_ms: int = 1000,
    available_now: bool = False,
    checkpoint_root: str | None = None,
    resume: bool = False,
    output_mode: str = "append",
) -> DataStreamWriter:
    """Configured stream writer; call ``start()`` on it.

    ``kafka`` takes key and value columns, ``console`` prints untruncated rows, any file format
    writes below ``path``.
    """
    out = df.writeStream.queryName(name).outputMode(output_mode)
    out = out.option("checkpointLocation", checkpoint_location(df.sparkSession, name, checkpoint_root, resume))
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime=f"{trigger_ms} milliseconds")
    if mode == "console":
        return out.format("console").option("truncate", False)
    if mode == "kafka":
        return out.format("kafka").options(**writer_options(topic))
    return out.format(mode).option("path", path)
