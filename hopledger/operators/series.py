"""Time-series algebra on an evaluation grid.

Ticks are multiples of the step, in microseconds since the epoch (``t``). A sample belongs to the
ticks of ``[ts, ts + range)``, which is the same as a tick seeing ``(t - range, t]``.

Series are cut into time blocks. A sample goes to the block of every tick it belongs to (two at
most when a block is longer than the range), blocks are the only thing shuffled, and ticks are
generated and aggregated inside the task that holds the block. A series of any length is spread over
its blocks, and the range-to-step blow-up never reaches the network.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopledger.functions.times import epoch_micros

MICROS = 1_000_000
SERIES = ["instance", "if_index", "if_name", "iface"]


@dataclass(frozen=True)
class Grid:
    """Evaluation ticks and ranges in seconds; bounds are inclusive and optional."""

    step: int = 15
    range: int = 300
    lookback: int = 300
    start: int | None = None
    end: int | None = None
    blocks: int = 12

    @property
    def block_us(self) -> int:
        """A block: a multiple of the step, several times the longest range."""
        longest = max(self.range, self.lookback, self.step)
        return -(-longest // self.step) * self.step * self.blocks * MICROS

    def ticks(self, spark: SparkSession) -> DataFrame:
        if self.start is None or self.end is None:
            raise ValueError("a list of ticks needs both ends of the grid")
        first = -(-self.start // self.step)
        last = self.end // self.step
        return spark.range(first, last + 1).select((F.col("id") * self.step * MICROS).alias("t"))

    def clip(self, df: DataFrame) -> DataFrame:
        if self.start is not None:
            df = df.filter(F.col("t") >= self.start * MICROS)
        if self.end is not None:
            df = df.filter(F.col("t") <= self.end * MICROS)
        return df


def floor_to(value: Column, unit: int) -> Column:
    return value - F.pmod(value, F.lit(unit))


def ceil_to(value: Column, unit: int) -> Column:
    return value + F.pmod(-value, F.lit(unit))


def with_series_labels(samples: DataFrame) -> DataFrame:
    """Missing labels become empty strings, so label joins are plain equalities."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("instance", "if_name", "iface") if c in samples.columns}
    return samples.withColumns(text)


def keep_metrics(samples: DataFrame, pattern: str) -> DataFrame:
    """Samples whose whole metric name matches."""
    return samples.filter(F.col("metric").rlike(f"^(?:{pattern})$"))


def keep_scoped(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """The named counters, and alerts only where they carry an interface name."""
    return samples.filter(
        F.col("metric").isin(*metrics) | ((F.col("metric") == "ALERTS") & (F.col("if_name") != ""))
    )


def into_blocks(samples: DataFrame, keys: list[str], near: list[str], grid: Grid, span: Column) -> DataFrame:
    """Samples by (``near``, block), once per (series, instant).

    ``span`` is the range in seconds of a row, a literal or a column. ``near`` are the columns to
    keep together, a subset of ``keys``. Copies of a sample keep the highest value. Grid bounds cut
    the scan, and adds ``us``, ``first`` and ``last``: the instant and its ticks within the block.
    """
    step, block = grid.step * MICROS, grid.block_us
    rows = samples
    if grid.start is not None:
        reach = grid.start - max(grid.range, grid.lookback)
        rows = rows.filter(F.col("ts") > F.timestamp_seconds(F.lit(reach)))
    if grid.end is not None:
        rows = rows.filter(F.col("ts") <= F.timestamp_seconds(F.lit(grid.end)))
    rows = rows.withColumns({"us": epoch_micros(F.col("ts")), "_span": span.cast("bigint") * MICROS})
    rows = rows.withColumns({
        "first": ceil_to(F.col("us"), step),
        "last": floor_to(F.col("us") + F.col("_span") - 1, step),
    }).filter(F.col("first") <= F.col("last"))
    block_of = lambda tick: F.expr(f"({tick} - pmod({tick}, {block})) div {block}")
    rows = rows.withColumn("blk", F.explode(F.sequence(block_of("first"), block_of("last"))))
    rows = rows.repartition(*near, "blk").groupBy(*keys, "blk", "us", "first", "last").agg(
        F.max("value").alias("value")
    )
    begin = F.col("blk") * block
    return rows.withColumns({
        "first": F.greatest("first", begin),
        "last": F.least(F.col("last"), begin + block - step),
    })


def instant_vector(samples: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """V1: the last sample of each series within the look-back of each tick.

    A sample holds until the next one or until it is too old, so each output row is made once and
    nothing is aggregated per tick.
    """
    step = grid.step * MICROS
    rows = into_blocks(samples, keys, keys, grid, F.lit(grid.lookback))
    later = F.lead("us").over(Window.partitionBy(*keys, "blk").orderBy("us"))
    rows = rows.withColumn("last", F.least(F.col("last"), F.coalesce(floor_to(later - 1, step), F.col("last"))))
    held = rows.filter(F.col("first") <= F.col("last"))
    return grid.clip(held.select(
        *keys, F.explode(F.sequence("first", "last", F.lit(step))).alias("t"), F.col("us").alias("sample_us"), "value"
    ))


def range_vector(samples: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """V3: the samples of each series in each tick's range, as an array in time order.

    An array holds no more than the samples of one series in one range.
    """
    rows = into_blocks(samples, keys, keys, grid, F.lit(grid.range))
    ticks = rows.withColumn("t", F.explode(F.sequence("first", "last", F.lit(grid.step * MICROS))))
    points = F.array_sort(F.collect_list(F.struct("us", "value")))
    return grid.clip(ticks.groupBy(*keys, "blk", "t").agg(points.alias("points")).drop("blk"))


def range_facts(samples: DataFrame, keys: list[str], near: list[str], grid: Grid, span: Column) -> DataFrame:
    """Per series and tick: first and last sample, count and the drops of resets.

    A range slides over the samples, so its facts change only where a sample enters or leaves. Samples are numbered and their drops
    added up once per block; what lies in a range then follows from its first and its last sample, as differences of the two. There are two
    changes per sample and one row per tick, however many ticks a sample belongs to, all in the task of the block.
    """
    rows = into_blocks(samples, keys, near, grid, span)
    step = grid.step * MICROS
    by_time = Window.partitionBy(*keys, "blk").orderBy("us")
    rows = rows.withColumns({"_prev": F.lag("value").over(by_time), "_i": F.row_number().over(by_time)})
    drops = F.sum(F.when(F.col("value") < F.col("_prev"), F.col("_prev")).otherwise(0.0)).over(by_time)
    rows = rows.withColumn("_at", F.struct("us", "value", "_i", drops.alias("drops")))
    rows = rows.withColumn("_after", F.lead("_at").over(by_time))
    none = F.lit(None).cast(rows.schema["_at"].dataType)
    changes = rows.select(*keys, "blk", F.inline(F.array(
        F.struct(F.col("first").alias("t"), F.col("_at").alias("_in"), F.when(F.col("_i") == 1, F.col("_at")).otherwise(none).alias("_low"), F.lit(False).alias("_end")),
        F.struct((F.col("last") + step).alias("t"), none.alias("_in"), F.col("_after").alias("_low"), F.col("_after").isNull().alias("_end")),
    )))
    # Structs compare by time first: the last that enters, and the next after the last that leaves.
    at_tick = changes.groupBy(*keys, "blk", "t").agg(F.max("_in").alias("_in"), F.max("_low").alias("_low"), F.bool_or("_end").alias("_end"))
    by_tick = Window.partitionBy(*keys, "blk").orderBy("t")
    held = at_tick.withColumns({
        "_high": F.last("_in", ignorenulls=True).over(by_tick), "_low": F.last("_low", ignorenulls=True).over(by_tick),
        "_until": F.lead("t").over(by_tick) - step})
    held = held.filter(~F.col("_end") & F.col("_until").isNotNull() & (F.col("_high._i") >= F.col("_low._i")))
    ticks = held.withColumn("t", F.explode(F.sequence("t", "_until", F.lit(step))))
    return grid.clip(ticks.select(
        *keys, "blk", "t", F.col("_low.us").alias("first_us"), F.col("_high.us").alias("last_us"),
        F.col("_low.value").alias("first_value"), F.col("_high.value").alias("last_value"),
        (F.col("_high._i") - F.col("_low._i") + 1).cast("long").alias("n"), (F.col("_high.drops") - F.col("_low.drops")).alias("reset"),
    ))


def with_rate(facts: DataFrame, range_s: int) -> DataFrame:
    """Adds ``rate``, the per-second increase extrapolated to the ends of the range; null below two samples.

    An end further away than 1.1 mean gaps counts as half a gap, and a counter is not extended
    below zero. In steps, because one expression would be copied into each of its uses.
    """
    seconds = lambda us: us.cast("double") / MICROS
    steps = facts.withColumns({
        "_increase": F.col("last_value") - F.col("first_value") + F.col("reset"),
        "_interval": seconds(F.col("last_us") - F.col("first_us")),
        "_to_start": seconds(F.col("first_us") - F.col("t") + range_s * MICROS),
        "_to_end": seconds(F.col("t") - F.col("last_us")),
    }).withColumn("_gap", F.try_divide("_interval", F.col("n") - 1)).withColumn("_reach", F.col("_gap") * 1.1)
    inside = lambda c: F.when(F.col(c) >= F.col("_reach"), F.col("_gap") / 2).otherwise(F.col(c))
    rising = (F.col("_increase") > 0) & (F.col("first_value") >= 0)
    to_zero = F.when(rising, F.col("_interval") * F.try_divide("first_value", "_increase"))
    steps = steps.withColumns({"_start": F.least(inside("_to_start"), to_zero), "_end": inside("_to_end")})
    stretched = F.try_divide(F.col("_interval") + F.col("_start") + F.col("_end"), F.col("_interval"))
    rate = F.when(F.col("n") >= 2, F.col("_increase") * stretched / range_s)
    return steps.withColumn("rate", rate).drop(
        "_increase", "_interval", "_to_start", "_to_end", "_gap", "_reach", "_start", "_end"
    )


def counter_rate(samples: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """V4: counter rate per series and tick; at least two samples, resets corrected."""
    facts = range_facts(samples, keys, keys, grid, F.lit(grid.range)).filter("n >= 2")
    return with_rate(facts, grid.range).select(*keys, "t", F.col("rate").alias("value"))


def unique_side(one: DataFrame, keys: list[str]) -> DataFrame:
    """The side of a many-to-one match that must be unique: rows with their number per (keys, t)."""
    return one.groupBy(*keys, "t").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("copies"))


def fan_out(one: DataFrame, mapping: DataFrame, keys: list[str], checked: bool = False) -> DataFrame:
    """V8: each value onto every mapping row of its interface; unmatched rows of either side drop.

    A key with more than one value at a tick is left out (``fan_out_conflicts`` lists it).
    ``checked`` says the values are unique already. The join is left to adaptive planning, which
    knows the mapping's real size: broadcast when small, else sorted with hot keys split.
    """
    single = one if checked else unique_side(one, keys).filter("copies = 1").drop("copies")
    return single.select(*keys, "t", "value").join(mapping, keys)


def fan_out_conflicts(one: DataFrame, keys: list[str]) -> DataFrame:
    """V8: keys and ticks whose value is not unique."""
    return unique_side(one, keys).filter("copies > 1").drop("value")


def ratio(top: DataFrame, bottom: DataFrame, labels: list[str]) -> DataFrame:
    """V9: one-to-one division on all labels; no row where a side is missing or the bottom is zero."""
    left, right = top.withColumnRenamed("value", "_top"), bottom.withColumnRenamed("value", "_bottom")
    quotient = F.try_divide("_top", "_bottom")
    return left.join(right, [*labels, "t"]).select(*labels, "t", quotient.alias("value")).filter("value is not null")


def select_labels(df: DataFrame, **labels: str) -> DataFrame:
    """V2: rows whose labels equal the given values."""
    for name, value in labels.items():
        df = df.filter(F.col(name) == value)
    return df


def compare(df: DataFrame, op: str, bound: float) -> DataFrame:
    """V5: keep the rows, and the values, that satisfy the comparison; NaN satisfies none but ``!=``."""
    value = F.col("value")
    kept = {">": value > bound, "<": value < bound, "==": value == bound, "!=": value != bound,
            ">=": value >= bound, "<=": value <= bound}
    return df.filter(kept[op] if op == "!=" else kept[op] & ~F.isnan(value))


def equals_flag(df: DataFrame, to: float) -> DataFrame:
    """V6: one where equal, zero elsewhere."""
    return df.withColumn("value", (F.col("value") == to).cast("double"))


def scaled(df: DataFrame, factor: float) -> DataFrame:
    """V7: a product with a number."""
    return df.withColumn("value", F.col("value") * factor)


def aggregate_by(df: DataFrame, how: str, by: list[str]) -> DataFrame:
    """``max``, ``min`` or ``sum`` by labels and tick; combined before the shuffle.

    A NaN is the greatest or least value only where there is no number beside it; in a sum it stays.
    """
    number = F.when(~F.isnan("value"), F.col("value"))
    fold = {"max": F.coalesce(F.max(number), F.max("value")), "min": F.coalesce(F.min(number), F.min("value")),
            "sum": F.sum("value")}[how]
    return df.groupBy(*by, "t").agg(fold.alias("value"))


def rollup_by_app(df: DataFrame) -> DataFrame:
    """V10a."""
    return aggregate_by(df, "sum", ["app"])


def count_by(df: DataFrame, by: list[str]) -> DataFrame:
    """V10c."""
    return df.groupBy(*by, "t").agg(F.count(F.lit(1)).cast("double").alias("value"))


def sum_or_either(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left plus right where both are, else the one there is."""
    return aggregate_by(left.unionByName(right), "sum", by)


def unless(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side without a partner."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def absent(present: DataFrame, ticks: DataFrame) -> DataFrame:
    """V14 without labels: the ticks where nothing is present."""
    return ticks.join(present.select("t").distinct(), "t", "left_anti").withColumn("value", F.lit(1.0))


def presence(samples: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """(keys, first, last): runs of ticks at which a sample of the key lies within the look-back.

    Runs are formed in the block of their ticks, so a key with very many samples is spread over its blocks; two runs
    may touch at a block's edge. There are no more of them than ticks, however many samples there are.
    """
    step = grid.step * MICROS
    rows = into_blocks(samples, keys, keys, grid, F.lit(grid.lookback))
    by_time = Window.partitionBy(*keys, "blk").orderBy("us")
    # Every sample lasts equally long, so the sample before reaches furthest.
    begins = F.coalesce(F.col("first") > F.lag("last").over(by_time) + step, F.lit(False)).cast("int")
    numbered = rows.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(by_time))
    return numbered.groupBy(*keys, "blk", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(*keys, "first", "last")


def absent_series(samples: DataFrame, keys: list[str], grid: Grid, expected: DataFrame | None = None) -> DataFrame:
    """V14 per key: (keys, t, value 1) for each tick of the grid at which an expected key has no sample within the look-back.

    ``expected(keys)`` lists the keys to watch, by default all that ever sent a sample; without keys the whole feed is watched, also an
    empty one. A gap lies between the end of a run and the next run, so no grid of keys and ticks is formed: ticks are made of gaps.
    """
    if grid.start is None or grid.end is None:
        raise ValueError("absence needs both ends of the grid")
    step = grid.step * MICROS
    begin, end = -(-grid.start // grid.step) * step, grid.end // grid.step * step
    watched = samples.select(*keys).distinct() if expected is None else expected.select(*keys).distinct()
    runs = presence(samples, keys, grid).filter(F.col("last") >= begin).withColumn("first", F.greatest("first", F.lit(begin)))
    if keys:
        runs = runs.join(watched, keys, "left_semi")
    else:
        watched = samples.sparkSession.range(1).select()
    # An empty run before the grid stands for the key itself: also a key without samples then has its gap.
    before = watched.select(*keys, F.lit(begin - step).alias("first"), F.lit(begin - step).alias("last"))
    by_time = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("first")
    gaps = runs.unionByName(before).select(
        *keys, (F.col("last") + step).alias("_from"), (F.coalesce(F.lead("first").over(by_time), F.lit(end + step)) - step).alias("_to"))
    gaps = gaps.select(*keys, F.greatest("_from", F.lit(begin)).alias("_from"), F.least("_to", F.lit(end)).alias("_to")).filter("_from <= _to")
    return gaps.select(*keys, F.explode(F.sequence("_from", "_to", F.lit(step))).alias("t"), F.lit(1.0).alias("value"))


def age_of_newest(samples: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """Seconds since the newest sample of a key up to each tick, over all history; no row before its first sample.

    Samples become one row per key and tick at most (combined before the shuffle), and each holds until the next. Within a block of
    ticks that is the next row; over blocks it is found on one row per key and block, so a busy key is spread over its blocks.
    Without keys it is the age of the whole feed.
    """
    if grid.start is None or grid.end is None:
        raise ValueError("ages need both ends of the grid")
    step, block = grid.step * MICROS, grid.block_us
    begin, end = -(-grid.start // grid.step) * step, grid.end // grid.step * step
    us = epoch_micros(F.col("ts"))
    rows = samples.select(*keys, us.alias("us"), F.greatest(F.lit(begin), ceil_to(us, step)).alias("t")).filter(F.col("t") <= end)
    rows = rows.withColumn("blk", F.expr(f"(t - pmod(t, {block})) div {block}"))
    newest = rows.groupBy(*keys, "blk", "t").agg(F.max("us").alias("us"))
    edge = (F.col("blk") + 1) * block
    inner = newest.withColumn("_next", F.coalesce(F.lead("t").over(Window.partitionBy(*keys, "blk").orderBy("t")), edge))
    ends = rows.groupBy(*keys, "blk").agg(F.max("us").alias("us"), F.min("t").alias("_first"))
    later = F.lead("_first").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("blk"))
    outer = ends.select(*keys, "us", edge.alias("t"), F.coalesce(later, F.lit(end + step)).alias("_next"))
    held = inner.select(*keys, "us", "t", "_next").unionByName(outer).withColumn("_next", F.least(F.col("_next"), F.lit(end + step)))
    ticks = held.filter(F.col("t") < F.col("_next")).withColumn("t", F.explode(F.sequence("t", F.col("_next") - step, F.lit(step))))
    return ticks.select(*keys, "t", ((F.col("t") - F.col("us")) / MICROS).alias("value"))


def group_by_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    """V16."""
    return df.select(*labels).distinct()
