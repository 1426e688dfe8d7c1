"""Result, traffic and resource logs, and message brokers, as tables with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = (
    "approach string, pattern string, iteration int, window_number int, window_start long, window_end long, result_value double, query_registered_at long, "
    "first_data_received_at long, last_required_chunk_received_at long, result_emitted_at long, expected_window_close long, coverage_complete boolean, "
    "is_partial_window boolean, is_comparable_window boolean"
)
TRAFFIC = (
    "timestamp long, scenario string, approach string, scale string, iteration string, topic string, message_type string, topic_bytes long, payload_bytes long, "
    "published_bytes long, subscriber_count int, estimated_delivery_bytes long, warmup boolean, target_publish_time long, actual_publish_time long, publish_lag_ms double"
)
RESOURCES = "run string, timestamp long, process_count int, total_cpu_pct double, tree_rss_bytes long, tree_cpu_seconds double"


def _split(lines: DataFrame, parsed) -> tuple[DataFrame, DataFrame]:
    rows = lines.select("value", parsed.alias("row"))
    bad = F.col("row").isNull() | F.col("row.bad_line").isNotNull()
    return rows.where(~bad).select("row.*").drop("bad_line"), rows.where(bad).select("value")


def read_csv_log(spark: SparkSession, path: str, schema: str = RESULTS) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV log (its header line is passed over), and the lines that don't fit the schema."""
    header = ",".join(part.split()[0] for part in schema.split(", "))
    lines = spark.read.text(path).where(F.regexp_replace("value", r"\s", "") != header)
    return _split(lines, F.from_csv("value", f"{schema}, bad_line string", {"columnNameOfCorruptRecord": "bad_line"}))


def read_json_log(spark: SparkSession, path: str, schema: str = TRAFFIC) -> tuple[DataFrame, DataFrame]:
    """Rows of a log of one JSON object a line, and the lines that are none."""
    return _split(spark.read.text(path), F.from_json("value", f"{schema}, bad_line string", {"columnNameOfCorruptRecord": "bad_line"}))


def to_topics(rows: DataFrame, topic: str = "topic", payload: str = "payload") -> DataFrame:
    """topic and value, as a message broker takes them."""
    return rows.select(F.col(topic).cast("string").alias("topic"), F.col(payload).cast("string").alias("value"))


def topic_sink(rows: DataFrame, servers: str, checkpoint: str, **trigger):
    """Publishes a stream of (topic, payload) to Kafka; needs Spark's Kafka package on the class path."""
    out = to_topics(rows).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def topic_stream(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """topic, value, arrived_at of a Kafka subscription; needs Spark's Kafka package on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "earliest").load()
    return rows.select("topic", F.col("value").cast("string").alias("value"), F.unix_millis("timestamp").alias("arrived_at"))
