"""Window functions over keys of any size.

A plain window puts one key into one task. ``KeyedScan`` counts rows per key first; where a key is
too large it is cut into blocks at quantiles of its order column, each block runs as its own window
partition, and one summary row per block carries lag, lead and running values across the cuts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4_000_000
# A hot key holds more than 1/SHARES of the rows, so there are fewer than SHARES of them
# and fewer than 2 * SHARES cuts: that bounds what the driver sees and what is broadcast.
SHARES = 4096


def _cut_points(df: DataFrame, keys: list[str], order: str, block_rows: int) -> DataFrame | None:
    """Cuts per hot key as literal rows (fixed once, so a re-run task sees the same blocks), or None."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(block_rows, math.ceil((total or 0) / SHARES))
    if largest is None or largest <= limit:
        return None
    parts = math.ceil(largest / limit)
    probabilities = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    hot = sizes.filter(F.col("_n") > limit)
    stride = F.greatest(F.lit(1), F.floor(F.lit(parts) / F.ceil(F.col("_n") / F.lit(limit)))).cast("int")
    cuts = (
        df.join(hot, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(order, probabilities).alias("_cuts"))
        .join(hot, keys)
        .select(*keys, F.array_distinct(F.filter("_cuts", lambda _, i: (i + 1) % stride == 0)).alias("_cuts"))
    )
    schema = T.StructType([*[df.schema[k] for k in keys], cuts.schema["_cuts"]])
    return df.sparkSession.createDataFrame(cuts.collect(), schema)


class KeyedScan:
    """Running and shifted values per key, ordered by one numeric column that is unique within the key.

    Each method adds a column and returns the scan; ``df`` holds the result.
    Keys and scanned values must not be null.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: str, block_rows: int = BLOCK_ROWS):
        self.keys, self.order = list(keys), order
        cuts = _cut_points(df, self.keys, order, block_rows)
        self.cut = cuts is not None
        if self.cut:
            passed = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col(order)))
            df = df.join(F.broadcast(cuts), self.keys, "left").withColumn("_block", passed).drop("_cuts")
        self._frame = df

    @property
    def df(self) -> DataFrame:
        return self._frame.drop("_block")

    @property
    def _part(self) -> list[str]:
        return [*self.keys, "_block"] if self.cut else self.keys

    def _window(self):
        return Window.partitionBy(*self._part).orderBy(self.order)

    def _carry(self, per_block: Column, across) -> None:
        """Join ``_carry``: ``across`` applied to the block summaries of the key."""
        blocks = self._frame.groupBy(*self._part).agg(per_block.alias("_value"))
        by_block = Window.partitionBy(*self.keys).orderBy("_block")
        carried = blocks.withColumn("_carry", across(F.col("_value"), by_block)).drop("_value")
        self._frame = self._frame.join(carried, self._part)

    def _shift(self, name: str, value: Column, back: bool) -> KeyedScan:
        pick, move = (F.max_by, F.lag) if back else (F.min_by, F.lead)
        frame = self._frame.withColumn(name, value)
        self._frame = frame
        if self.cut:
            self._carry(pick(F.col(name), F.col(self.order)), lambda v, w: move(v).over(w))
        near = move(F.col(name)).over(self._window())
        shifted = F.coalesce(near, F.col("_carry")) if self.cut else near
        self._frame = self._frame.withColumn(name, shifted).drop("_carry")
        return self

    def previous(self, name: str, value: Column) -> KeyedScan:
        return self._shift(name, value, back=True)

    def following(self, name: str, value: Column) -> KeyedScan:
        return self._shift(name, value, back=False)

    def running(self, name: str, value: Column, how: str) -> KeyedScan:
        """Running ``sum`` or ``max`` up to and including the row."""
        fold = {"sum": F.sum, "max": F.max}[how]
        self._frame = self._frame.withColumn(name, value)
        if self.cut:
            before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
            self._carry(fold(name), lambda v, w: fold(v).over(before(w)))
        near = fold(F.col(name)).over(self._window().rowsBetween(Window.unboundedPreceding, 0))
        if self.cut:
            carry = F.col("_carry")
            near = near + F.coalesce(carry, F.lit(0)) if how == "sum" else F.greatest(near, carry)
        self._frame = self._frame.withColumn(name, near).drop("_carry")
        return self

    def add(self, name: str, value: Column) -> KeyedScan:
        self._frame = self._frame.withColumn(name, value)
        return self

    def keep(self, condition: Column) -> KeyedScan:
        """Drop rows; the blocks stay as cut."""
        self._frame = self._frame.filter(condition)
        return self

    def row_number(self, name: str) -> KeyedScan:
        return self.running(name, F.lit(1).cast("bigint"), "sum")
