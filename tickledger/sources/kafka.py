"""Options for reading and writing topics with Spark's Kafka connector.

The connector is a separate jar; only the options are built here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter


def read_options(servers: str, topic: str, offsets_per_batch: int | None = None) -> dict[str, str]:
    """From the first record; a gap in the topic is an error, not a silent skip."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if offsets_per_batch is not None:
        options["maxOffsetsPerTrigger"] = str(offsets_per_batch)
    return options


def write_options(servers: str, topic: str, checkpoint: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}


def topic_reader(spark: SparkSession, servers: str, topic: str) -> DataStreamReader:
    """Raw records: `key` and `value` are bytes."""
    return spark.readStream.format("kafka").options(**read_options(servers, topic))


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic from its beginning to its present end, as a batch."""
    options = read_options(servers, topic)
    return spark.read.format("kafka").options(**options).option("endingOffsets", "latest").load()


def topic_writer(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Messages are (key, value) text or bytes."""
    return messages.writeStream.format("kafka").options(**write_options(servers, topic, checkpoint))
