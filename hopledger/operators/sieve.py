"""Large tables sifted by a set of keys before a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed size: words of 64 bits in the table that marks keys, whatever the number of keys, and how many of them make a row of it.
WORDS, PER_ROW = 1 << 20, 16


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the place of their keys in the table: ``_line``, ``_slot`` and ``_bit``."""
    spot = rows.withColumn("_spot", F.xxhash64(*keys))
    return spot.withColumns({
        "_line": F.shiftrightunsigned("_spot", 64 - (WORDS // PER_ROW - 1).bit_length()),
        "_slot": F.shiftright("_spot", 6).bitwiseAND(F.lit(PER_ROW - 1)).cast("int"), "_bit": F.expr("shiftleft(1L, cast(_spot & 63 as int))"),
    }).drop("_spot")


def bits(wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The table: ``_line`` and its words. Several words make a row, as the driver, through which it goes, holds far more for a row than a word."""
    words = [F.bit_or(F.when(F.col("_slot") == i, F.col("_bit"))).alias(f"_w{i}") for i in range(PER_ROW)]
    return _placed(wanted.select(*keys), keys).groupBy("_line").agg(*words)


def marked(rows: DataFrame, wanted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: true for all whose ``keys`` are in ``wanted``, and for few others.

    Keys are hashed to bits of a table of at most ``WORDS`` words, which every task gets, so rows that a join would drop need no shuffle.
    The join decides: a crowded table only lets more rows through.
    """
    words = [f"_w{i}" for i in range(PER_ROW)]
    met = _placed(rows, keys).join(F.broadcast(bits(wanted, keys)), "_line", "left")
    found = F.get(F.array(*words), "_slot").bitwiseAND(F.col("_bit")) != 0
    return met.withColumn(name, F.coalesce(found, F.lit(False))).drop("_line", "_slot", "_bit", *words)
