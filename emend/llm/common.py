"""What the operators share: word rule, table access, durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, heap_released, run_dir, shuffles_released

#: Fixed value: a word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text) -> F.Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def durable(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder: lost executors cost no recomputation, and lineage ends here."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path)
    heap_released(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what durable() wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_durable_path", None):
            delete(path, df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration())


def repeated(df: DataFrame, times: str, nth: str, part: int = 10_000) -> DataFrame:
    """Each row as often as `times` says, numbered from 0 in `nth`; numbers are made in two steps, so that no array is long."""
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    out = df.withColumn("__of", upto(F.floor((F.col(times) - 1) / part)))
    out = out.withColumn("__nth", upto(F.least(F.lit(part - 1), F.col(times) - 1 - F.col("__of") * part)))
    return out.withColumn(nth, F.col("__of") * part + F.col("__nth")).drop("__of", "__nth", times)


#: Rows of one key that may meet in one task, and the most keys that have more: these go to all executors.
TOGETHER, MOST_HOT = 1_000, 50_000


def joined_by_key(many: DataFrame, one: DataFrame, key: str, rows: str) -> DataFrame:
    """many joined with one, a durable table with a row for each key and the number of its rows in many, which is left out.

    Keys with most rows are broadcast with their row of `one`, so that no task gets all rows of one; as the numbers add up to the rows of
    many, these are MOST_HOT keys at most.
    """
    total, most = one.agg(F.coalesce(F.sum(rows), F.lit(0)), F.coalesce(F.max(rows), F.lit(0))).first()
    upto = max(TOGETHER, total // MOST_HOT)
    if most <= upto:
        return many.join(one.drop(rows), key)
    few, rest = one.where(F.col(rows) > upto).drop(rows), one.where(F.col(rows) <= upto).drop(rows)
    return many.join(F.broadcast(few), key).unionByName(many.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches to Python end at `size` bytes, for the rest of the session, so that workers hold few texts at once, however long these are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
