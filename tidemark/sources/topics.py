"""Message topics: option builders and the pure parts of reading and publishing.

The Kafka connector is a separate Spark package; the builders return the options for it. Parsing and
keying are plain DataFrame functions, used with file streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.urls import surt_authority

PARTITIONS = 16
# times keep their microseconds in messages
TIME_FORMATS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
}


def read_options(
    brokers: str, topic: str, from_start: bool = True, max_offsets: int | None = None, fail_on_data_loss: bool = True
) -> dict[str, str]:
    """Options of a topic reader; ``from_start`` seeks to the beginning on the first run.

    Offsets that retention has removed fail the query, unless the caller accepts their loss.
    """
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": "earliest" if from_start else "latest",
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def write_options(brokers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "topic": topic, "kafka.compression.type": "snappy"}


def read_topic(spark: SparkSession, options: dict[str, str], schema: T.StructType) -> DataFrame:
    """The parsed messages of a topic as a stream."""
    return parse_messages(spark.readStream.format("kafka").options(**options).load(), schema)


def parse_messages(raw: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON messages as columns; text that does not parse is kept in ``_corrupt``."""
    text = F.col(value).cast("string")
    parsed = F.from_json(text, schema, TIME_FORMATS)
    rest = [c for c in raw.columns if c != value]
    return (
        raw.withColumn("_m", parsed)
        .withColumn("_corrupt", F.when(F.col("_m").isNull() | _all_null("_m", schema), text))
        .select(*rest, "_m.*", "_corrupt")
    )


def _all_null(struct: str, schema: T.StructType) -> Column:
    test = F.lit(True)
    for field in schema.fields:
        test = test & F.col(struct)[field.name].isNull()
    return test


def messages(df: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """``key`` and JSON ``value`` ready for a topic writer."""
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*columns), TIME_FORMATS).alias("value"))


def authority_messages(df: DataFrame, url: str, columns: list[str]) -> DataFrame:
    """Messages keyed by SURT authority, so that one site's messages stay in one partition."""
    return messages(df, surt_authority(url), columns)


def partition_by_authority(df: DataFrame, url: str, partitions: int = PARTITIONS) -> DataFrame:
    """Rows placed as a topic with that many partitions would place them: one partition per authority."""
    return df.withColumn("message_key", surt_authority(url)).repartition(partitions, "message_key")


def partition_number(key: Column, partitions: int = PARTITIONS) -> Column:
    """Partition of a key: the first 32 bits of its md5, modulo the number of partitions. A null key counts as an empty one."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return (F.conv(head, 16, 10).cast("long") % partitions).cast("int")


def placed_messages(df: DataFrame, url: str, columns: list[str], partitions: int = PARTITIONS) -> DataFrame:
    """``key``, ``value`` and the ``partition`` that a topic writer puts the message in; nothing is shuffled.

    The number is a function of the authority alone, so runs and streams agree on it whatever their own partitions are.
    """
    return authority_messages(df, url, columns).withColumn("partition", partition_number(F.col("key"), partitions))
