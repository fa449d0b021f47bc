"""Run-log lines ``[iso-seconds] LEVEL: message`` and their display form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.config import LOG_DISPLAY_CHARS
from corpusweave.functions.text import py_strip

LEVELS = ("STEP", "SUCCESS", "WARN", "ERROR", "DETAIL")
LINE_RE = r"^\[([^\]]*)\] ([A-Z]+): (.*)$"


def format_lines(events: DataFrame, ts: str = "ts", level: str = "level", message: str = "message") -> DataFrame:
    """(value) text lines, one per event."""
    return events.select(F.format_string(
        "[%s] %s: %s", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.col(level), F.col(message)).alias("value"))


def append_log(events: DataFrame, path: str, **cols) -> None:
    """Append the formatted lines to a text log under ``path``."""
    format_lines(events, **cols).write.mode("append").text(path)


def read_log(spark, path: str) -> DataFrame:
    """Parse lines back into (ts, level, message); a line break inside a
    message yields continuation lines with null level."""
    t = spark.read.text(path)
    return t.select(F.to_timestamp(F.regexp_extract("value", LINE_RE, 1)).alias("ts"),
                    F.nullif(F.regexp_extract("value", LINE_RE, 2), F.lit("")).alias("level"),
                    F.regexp_extract("value", "(?s)" + LINE_RE, 3).alias("message"), "value")


def display(text: F.Column, max_chars: int = LOG_DISPLAY_CHARS, log_name: str = "pipeline.log") -> F.Column:
    """Terminal form: null/empty -> '(no output)'; stripped; longer than n ->
    the last n chars under a header with the hidden count."""
    s = py_strip(text)
    hidden = F.length(s) - max_chars
    head = F.format_string(f"... [%d earlier characters hidden — see {log_name} for full output] ...\n", hidden)
    return (F.when(text.isNull() | (text == ""), F.lit("(no output)"))
             .when(F.length(s) <= max_chars, s)
             .otherwise(F.concat(head, F.substring(s, -max_chars, max_chars))))
