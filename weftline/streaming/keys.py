"""Keys and references of streams: repeated keys by state of each key, orphans by an outer join of two streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.numbering import name_of
from .checks import timed

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyCounter(StatefulProcessor):
    """Counts the rows of each key and tells it whenever it has come again; a pause of more than `keep_ms` starts anew."""

    def __init__(self, keys: list[str], keep_ms: int):
        self.keys, self.keep_ms = keys, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        n, last = self.seen.get() if self.seen.exists() else (0, 0)
        if n:
            self.handle.deleteTimer(last + self.keep_ms)
        told: list[int] = []
        for part in rows:
            for ms in sorted(part.iloc[:, -1].tolist()):  # the time: Spark loses the column's name here
                if n and ms - last > self.keep_ms:
                    n = 0
                n, last = n + 1, max(last, ms)
                if n == 2 or not told and n > 2:
                    told.append(n)
                elif n > 2:
                    told[-1] = n
        self.seen.update((n, last))
        self.handle.registerTimer(last + self.keep_ms)
        if told:
            yield pd.DataFrame({**{k: [v] * len(told) for k, v in zip(self.keys, key, strict=True)}, "n": told})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def key_violations(df: DataFrame, keys: list[str], time_col: str, keep: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, n): a row whenever a key has come again, with the number of its rows so far; keys with a null don't count.

    Without keep, keys are kept, no row is too late, and the counts are Spark's own, updated in each batch. keep,
    such as `1 hour`, forgets a key after so long a pause, and then rows later than `late` are ignored; a key takes
    two numbers of state then, and a call of Python in each batch that has it.
    """
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only one that keeps a counter's state
    if keep is None:
        return rows.groupBy(*(name_of(k) for k in keys)).agg(F.count("*").alias("n")).where("n > 1")
    rows = timed(rows, time_col, late)
    narrow = rows.select(*(name_of(k) for k in keys), name_of(time_col), F.coalesce(F.unix_millis(time_col), F.lit(0)).alias("__ms"))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType())])
    keep_ms = int(df.sparkSession.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00 UTC' + interval '{keep}')").head()[0])
    return narrow.groupBy(*(name_of(k) for k in keys)).transformWithStateInPandas(KeyCounter(keys, keep_ms), schema, "append", "EventTime")


def orphan_stream(child: DataFrame, column: str, child_time: str, parent: DataFrame, parent_column: str, parent_time: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The child rows for which no parent with their reference came at most `within` before them; null references don't count.

    A row is given once the watermark of both streams, `late` behind the slower one's newest row, has passed it;
    child or parent rows that come later than that are ignored. Both sides are kept for `within` and `late`.
    """
    rows = timed(child.where(name_of(column).isNotNull()), child_time, late)
    keys = timed(parent, parent_time, late).select(name_of(parent_column).alias("__key"), name_of(parent_time).alias("__time"))
    near = (F.col("__time") <= name_of(child_time)) & (F.col("__time") >= name_of(child_time) - F.expr(f"interval '{within}'"))
    found = rows.join(keys, (name_of(column) == F.col("__key")) & near, "leftOuter")
    return found.where("__key IS NULL").drop("__key", "__time")
