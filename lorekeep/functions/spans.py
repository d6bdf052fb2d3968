"""Functions on spans of the operation trace log (OTLP-like JSON lines)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.schema import SPAN_VALUE


def parse_value(json: Column) -> Column:
    return F.from_json(json, SPAN_VALUE)


def value_text(v: Column) -> Column:
    """A tagged value as text: string, integer (sent as a string), double or boolean; else null."""
    return F.coalesce(v["stringValue"], v["intValue"].cast("long").cast("string"), v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def tagged_value(text: Column | None = None, whole: Column | None = None, real: Column | None = None, flag: Column | None = None) -> Column:
    """The JSON of a tagged value."""
    null = F.lit(None)
    return F.to_json(
        F.struct(
            (null.cast("string") if text is None else text).alias("stringValue"),
            (null.cast("string") if whole is None else whole.cast("string")).alias("intValue"),
            (null.cast("double") if real is None else real).alias("doubleValue"),
            (null.cast("boolean") if flag is None else flag).alias("boolValue"),
        )
    )


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between nanosecond stamps, 0 where the end is first."""
    spent = F.greatest(end.cast("long") - start.cast("long"), F.lit(0).cast("long"))
    return ((spent - spent % 1_000_000) / 1_000_000).cast("long")
