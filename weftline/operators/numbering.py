"""Row numbers, running totals, shifts and ranks over whole tables, without a task that sees all rows.

A table is dealt in ranges of its order, sorted and stored once with each row's place in its partition; what
lies before a partition, or before a run of CHUNK rows, is added as one row per partition or run. Rows that
are numbered as they stand in their files are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.shared import stored

SEED = 42
#: Running totals are computed in runs of so many rows.
CHUNK = 1 << 17


def name_of(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def before(order: str, value: str) -> Column:
    """The sum of the values of the rows before."""
    return F.coalesce(F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def with_row_number(df: DataFrame, order_by: list[str | Column], column: str = "row_id") -> DataFrame:
    """Contiguous numbers from 1 in the order given, kept in the shared folder; ties are numbered in any order.

    Ties, which may be any part of the rows, are dealt by a seeded random number.
    """
    keys = [name_of(c) if isinstance(c, str) else c for c in order_by]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__tie", F.rand(SEED)).repartitionByRange(n, *keys, "__tie").sortWithinPartitions(*keys).drop("__tie")
    # The place in the partition is in the low 33 bits.
    placed = stored(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    offsets = counts.select("__part", before("__part", "__rows").alias("__before"))
    # One row per partition is broadcast.
    found = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return found.select(*(name_of(c) for c in df.columns), number.cast("long").alias(column))


def with_file_order(df: DataFrame, column: str = "row_id", *, per_file: bool = False, file_col: str | None = None) -> DataFrame:
    """Contiguous numbers from 1 as the rows stand in their files, files in the order of their paths.

    df is what a reader of files gives, with columns added or dropped but no rows. Each task stores its rows with
    the split that they come from; the numbers of rows before each split, one row per split, are added up and
    broadcast. per_file: each file's rows are numbered by themselves. file_col: adds the file's path.
    """
    marks = {"__file": F.col("_metadata.file_path"), "__split": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()}
    placed = stored(df.withColumns(marks))
    # A task reads its splits one after the other.
    splits = placed.groupBy("__file", "__split").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    order = Window.partitionBy("__file").orderBy("__split") if per_file else Window.orderBy("__file", "__split")
    rows_before = F.coalesce(F.sum("__rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("__file", "__split", (rows_before - F.col("__first") + 1).alias("__add"))
    found = placed.join(F.broadcast(offsets), ["__file", "__split"])
    file = [F.col("__file").alias(file_col)] if file_col else []
    return found.select(*(name_of(c) for c in df.columns), *file, (F.col("__at") + F.col("__add")).alias(column))


def with_running_total(df: DataFrame, value: Column, column: str, row_id: str = "row_id") -> DataFrame:
    """The sum of the values up to each row, in the order of the row numbers; nulls count as nothing.

    Whole numbers are added exactly; where a sum doesn't fit in 64 bits it is null.
    """
    whole = isinstance(df.select(value.alias("v")).schema["v"].dataType, T.IntegralType)
    value = value.cast("decimal(20,0)") if whole else value
    run = F.shiftright(name_of(row_id), CHUNK.bit_length() - 1)
    rows = df.withColumn("__value", value).withColumn("__run", run)
    sums = rows.groupBy("__run").agg(F.sum("__value").alias("__sum"))
    # One row per CHUNK rows.
    offsets = sums.select("__run", before("__run", "__sum").alias("__before"))
    within = Window.partitionBy("__run").orderBy(row_id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.coalesce(F.sum("__value").over(within), F.lit(0))
    found = rows.withColumn("__within", total).join(offsets, "__run")
    upto = F.col("__before") + F.col("__within")
    return found.select(*(name_of(c) for c in df.columns), (upto.try_cast("bigint") if whole else upto).alias(column))


def with_shift(df: DataFrame, value: Column, by: int, column: str, row_id: str = "row_id") -> DataFrame:
    """The value of the row `by` places before, or after if it is negative, by contiguous row numbers.

    Rows are dealt in runs of CHUNK; the border rows that the next run looks back at go there too, as copies that
    are dropped again, so that rows meet in one shuffle. Shifts by whole runs are a join by number.
    """
    if abs(by) >= CHUNK:
        others = df.select((name_of(row_id) + by).alias("__to"), value.alias(column))
        return df.join(others, name_of(row_id) == F.col("__to"), "left").drop("__to")
    run = F.shiftright(name_of(row_id), CHUNK.bit_length() - 1)
    needed = F.shiftright(name_of(row_id) + by, CHUNK.bit_length() - 1)  # the run of the row that looks here
    rows = df.select("*", run.alias("__own"), F.explode(F.array_distinct(F.array(run, needed))).alias("__run"))
    within = Window.partitionBy("__run").orderBy(row_id)
    return rows.withColumn(column, F.lag(value, by).over(within)).where("__own = __run").drop("__own", "__run")


def ranked_values(df: DataFrame, value: Column, column: str) -> DataFrame:
    """(__ranked, column): each value's rank among all rows, the mean of their places where rows are equal."""
    counts = df.select(value.alias("__ranked")).where(F.col("__ranked").isNotNull()).groupBy("__ranked").agg(F.count("*").alias("__n"))
    numbered = with_row_number(counts, ["__ranked"], "__number")
    total = with_running_total(numbered, F.col("__n"), "__upto", "__number")
    return total.select("__ranked", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(column))
