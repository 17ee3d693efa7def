"""Resumable generation: rows already answered are not asked again, and a run that ends early goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, sinks


def resumed(inputs: DataFrame, stored_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """inputs (line_no, id, text, ...), stored lines of JSON -> (the valid beginning of what is stored, inputs that are still to do)."""
    kept = readers.valid_prefix(inputs.select("line_no", "id", "text"), readers.numbered_json(stored_lines, "id string, text string, prediction string, response string"))
    return kept, inputs.join(kept.select("line_no"), "line_no", "left_anti")


def stream_answers(spark: SparkSession, source: str, schema: str, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1):
    """Answer every file of prompts in a folder once, with what is there now, then stop; started again, only new files are read.

    Each batch is written under its own number, so a batch that is run again after a failure replaces its own output.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    write = lambda df, batch: sinks.append_batch(answer(df), out, batch)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(stored: DataFrame, expected: int) -> DataFrame:
    """One row: done, expected, share."""
    return stored.agg(F.count("*").alias("done")).withColumn("expected", F.lit(expected)).withColumn("share", F.try_divide("done", "expected"))
