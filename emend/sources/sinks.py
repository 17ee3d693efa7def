"""Writers. A stage's output that is already there is left alone unless it is to be overwritten."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_released
from .readers import BLANK_ID, BLANK_TEXT, exists


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "ignore"


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode(_mode(overwrite)).json(path)
    if not exists(rows.sparkSession, path):
        raise OSError(f"{path} was not written")


def write_table(rows: DataFrame, path: str, overwrite: bool = False, by: tuple[str, ...] = ()) -> None:
    rows.write.mode(_mode(overwrite)).partitionBy(*by).parquet(path)


def blank_split(spark, dataset: str) -> DataFrame:
    """The row that stands for a missing split in file formats that can't be empty."""
    return spark.createDataFrame([(BLANK_ID, dataset, BLANK_TEXT)], "id string, `from` string, text string")


#: Lines of one file; more go into further files, whose names follow their order.
LINES_A_FILE = 10_000_000


def write_lines(rows: DataFrame, path: str, column: str = "value", order: str = "line_no", append: bool = False, compression: str = "none", a_file: int | None = None) -> None:
    """One stripped line for each row, in order: the form in which external tools take sentences. Read it with readers.lines(joined=True).

    A compressed file is read by one task, so it should have few lines."""
    text = rows.select(order, F.regexp_replace(F.trim(column), r"[\r\n]+", " ").alias("value"))
    files = max(1, -(-rows.count() // (a_file or LINES_A_FILE)))
    with shuffles_released(rows.sparkSession):
        text.repartitionByRange(files, order).sortWithinPartitions(order).select("value").write.mode("append" if append else "overwrite").text(path, compression=compression)


def write_parallel(pairs: DataFrame, prefix: str) -> None:
    for column in ("src", "tgt"):
        write_lines(pairs, f"{prefix}.{column}", column)


def write_vectors(pairs: DataFrame, sites: DataFrame, folder: str, overwrite: bool = False) -> None:
    write_table(pairs, f"{folder}/pair_vectors", overwrite)
    write_table(sites, f"{folder}/site_vectors", overwrite)


def write_tsv(rows: DataFrame, path: str) -> None:
    """src, tgt if there is one, and predict, tab-separated."""
    own = [c for c in ("src", "tgt", "predict") if c in rows.columns]
    rows.select(F.concat_ws("\t", *own).alias("value")).write.mode("overwrite").text(path)


def checked_count(rows: DataFrame, expected: int | None) -> DataFrame:
    """Rows, after a check of their number where a submission has a fixed one."""
    if expected is not None and (n := rows.count()) != expected:
        raise AssertionError(f"expected {expected} rows, got {n}")
    return rows


def write_submission(rows: DataFrame, folder: str, name: str, column: str = "prediction", order: str = "line_no", expected: int | None = None) -> str:
    """Lines in order as one text file in a zip on the driver. Lines are streamed; the file is as long as the submission."""
    path = os.path.join(folder, f"{name}.zip")
    os.makedirs(folder, exist_ok=True)
    ordered = checked_count(rows, expected).orderBy(order).select(F.trim(column).alias("value"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{name}.txt", "w") as out:
        for row in ordered.toLocalIterator():
            out.write(f"{row['value']}\n".encode())
    return path


def write_predictions(cleaned: DataFrame, folder: str, overwrite: bool = False) -> None:
    """predictions (JSON), their lines, and the number of rows for each reason."""
    write_json(cleaned, f"{folder}/predictions", overwrite)
    if "line_no" in cleaned.columns:
        write_lines(cleaned, f"{folder}/output", "prediction")
    write_json(cleaned.groupBy(F.col("postprocess_reason").alias("reason")).count().coalesce(1), f"{folder}/output.stats", overwrite)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """One batch of a resumable run: written again, it takes the place of itself."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")
