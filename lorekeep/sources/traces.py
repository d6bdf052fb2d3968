"""The operation trace log: JSON lines of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.spans import elapsed_ms, value_text
from lorekeep.schema import SPAN

#: A log above this size is set aside before more is written.
ROTATE_BYTES = 10 * 1024 * 1024


def parse_spans(lines: DataFrame) -> DataFrame:
    """lines(value) -> name, elapsed_ms, timestamp_ns, attributes; lines that are no span fall away."""
    span = F.from_json("value", SPAN)
    rows = lines.withColumn("s", span).where("s.name is not null")
    attributes = F.map_from_entries(F.transform(F.coalesce("s.attributes", F.array()), lambda a: F.struct(a["key"], value_text(a["value"]))))
    start = F.coalesce(F.col("s.startTimeUnixNano").cast("long"), F.lit(0).cast("long"))
    return rows.select(
        *[c for c in lines.columns if c != "value"], F.col("s.name").alias("name"),
        elapsed_ms(start, F.coalesce(F.col("s.endTimeUnixNano").cast("long"), F.lit(0).cast("long"))).alias("elapsed_ms"),
        start.alias("timestamp_ns"), attributes.alias("attributes"),
    )


def tail(lines: DataFrame, n: int, order: str = "line") -> DataFrame:
    """The last n lines in their order."""
    return lines.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def recent_traces(lines: DataFrame, n: int, prefix: str | None = None, order: str = "line") -> DataFrame:
    """Spans among the last n lines whose name begins with prefix: the limit counts lines, before any filter."""
    found = parse_spans(tail(lines, n, order))
    return found.where(F.col("name").startswith(prefix)) if prefix else found


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line of one log file; a missing file is empty."""
    try:
        text = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string, line long")
    return text.withColumn("line", F.monotonically_increasing_id())


def write_spans(spans: DataFrame, path: str, prefix: str) -> None:
    """Appends the spans whose name begins with prefix."""
    spans.where(F.col("name").startswith(prefix)).write.mode("append").json(path)


def join_children(spans: DataFrame) -> DataFrame:
    """Root spans with the number and time of the spans of their trace."""
    root = spans.where("coalesce(parentSpanId, '') = ''").select("traceId", F.col("name").alias("root"))
    inner = spans.where("coalesce(parentSpanId, '') <> ''").groupBy("traceId").agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("elapsed_ms"))
    return root.join(inner, "traceId", "left")
