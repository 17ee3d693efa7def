"""Numbers and running sums in one total order of a whole table, whatever its keys, without a task that sees the whole table.

Rows are dealt by ranges of the whole order, key after key, as sampled; rows with equal keys are cut by a salt. Each part is sorted and numbered on its
own and written, so that its numbers never change, and a small table says how much comes before each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: Rows of a part, about.
PER_BUCKET = 500_000
_LOW = (1 << 33) - 1


def _summed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of one sorted part with the sums up to and with each row."""
    before = [0] * len(names)
    for batch in batches:
        made = []
        for i, name in enumerate(names):
            sums = np.cumsum(batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)) + before[i]
            before[i] = sums[-1] if len(sums) else before[i]
            made.append(pa.array(sums, batch.column(name).type))
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f"{n}__upto" for n in names)])


def _in_parts(df: DataFrame, order: list, sums: list[str]) -> DataFrame | None:
    """The table in parts that follow each other, with __part, __at (place in the part, from 0) and for each name of sums its sum in the part so far; None for one part."""
    n = -(-df.count() // PER_BUCKET)
    if n <= 1:
        return None
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(n, *order, "__salt").sortWithinPartitions(*order, "__salt").drop("__salt").withColumn("__id", F.monotonically_increasing_id())
    if sums:
        kind = T.StructType([*ranged.schema.fields, *(T.StructField(f"{s}__upto", ranged.schema[s].dataType) for s in sums)])
        ranged = ranged.mapInArrow(lambda it: _summed(it, sums), kind)
    id_ = F.col("__id")
    return stored(ranged.withColumn("__part", F.shiftright(id_, 33)).withColumn("__at", id_.bitwiseAND(F.lit(_LOW))).drop("__id"), "ordered")


def _before(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """What comes before each part: a row for each PER_BUCKET rows of the table, laid end to end."""
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    each = parts.groupBy("__part").agg(*(v.alias(n) for n, v in sums.items()))
    return each.select("__part", *(F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in sums))


def running_sums(df: DataFrame, values: dict[str, Column], order: list) -> DataFrame:
    """df with, for each name, the sum of its value (bigint or double) up to and with each row. Rows that are equal in all of the order come in any one order."""
    made = {n: f"__value{i}" for i, n in enumerate(values)}
    own = df.withColumns({made[n]: F.coalesce(v, F.lit(0)) for n, v in values.items()})
    own = own.withColumns({c: F.col(c).cast("double" if own.schema[c].dataType.simpleString() in ("double", "float") else "bigint") for c in made.values()})
    parts = _in_parts(own, order, list(made.values()))
    if parts is None:  # PER_BUCKET rows at most
        window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return own.withColumns({n: F.sum(c).over(window) for n, c in made.items()}).drop(*made.values())
    joined = parts.join(F.broadcast(_before(parts, {f"{c}__before": F.sum(c) for c in made.values()})), "__part")
    out = joined.withColumns({n: F.col(f"{c}__before") + F.col(f"{c}__upto") for n, c in made.items()})
    return out.select(*df.columns, *(n for n in values if n not in df.columns))


def running(df: DataFrame, value: Column, order: list, name: str) -> DataFrame:
    """running_sums() of one value."""
    return running_sums(df, {name: value}, order)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the number of each row in the order, from 0."""
    parts = _in_parts(df, order, [])
    if parts is None:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    joined = parts.join(F.broadcast(_before(parts, {"__before": F.count("*")})), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
