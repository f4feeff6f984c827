"""Ordered and whole-group work that holds when one key has a third of all rows.

A window or a collect over a key puts all of the key's rows in one task. The helpers here cut each key
into slices that are known from the row itself (a time slice, a value range), work inside the slice, and
then stitch the slices with one small row per slice. Results are exact; nothing is sampled or capped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelake.functions.windows import window_micros
from wirelake.schema import micros

_MANTISSA = 12  # a percentile bucket spans at most 1/4096 of its value


def with_time_slice(df: DataFrame, width: str, name: str = "_slice", time: str = "_us") -> DataFrame:
    """Add `_us` (epoch microseconds) and the number of the time slice the row lies in."""
    if time == "_us" and "_us" not in df.columns:
        df = df.withColumn("_us", micros(df))
    return df.withColumn(name, F.floor(F.col(time) / F.lit(window_micros(width))))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                  width: str) -> DataFrame:
    """Add struct `_prev` = `values` of the row before, per key in `order` (`order[0]` is `_us`).

    First window: inside (key, time slice). Second window: only the first and last row of each slice meet
    on the bare key, all others keep their slice in the partitioning, so no task gets a hot key whole.
    """
    df = with_time_slice(df, width)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    row = F.struct(*values)
    df = (
        df.withColumn("_in", F.lag(row).over(inside))
        .withColumn("_first", F.col("_in").isNull())
        .withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
        .withColumn("_edge", F.col("_first") | F.col("_last"))
        .withColumn("_part", F.when(~F.col("_edge"), F.col("_slice")))
    )
    across = Window.partitionBy(*keys, "_edge", "_part").orderBy(*order, "_last")
    return (
        df.withColumn("_prev", F.when(F.col("_first"), F.lag(row).over(across)).otherwise(F.col("_in")))
        .drop("_in", "_first", "_last", "_edge", "_part", "_slice")
    )


def interval_stats(df: DataFrame, keys: Sequence[str], width: str = "1s", wide: str = "1h") -> DataFrame:
    """Per key: packets, intervals, min / max / mean / std (ddof 1, seconds) of the gaps between packets.

    Packets are counted per (key, microsecond) first; equal times make gaps of zero. Gaps inside a (key, slice) are
    reduced to count, mean and squared deviation where they lie. Slices of `width` are merged within `wide` ones and these
    over the key, with the pooled-variance formula, which loses no precision on constant gaps.
    """
    keys = list(keys)
    times = with_time_slice(df.where(F.col("timestamp").isNotNull()), width).groupBy(*keys, "_slice", "_us").agg(
        F.count(F.lit(1)).alias("_times"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_us")
    gap = (F.col("_us") - F.lag("_us").over(inside)) / F.lit(1e6)
    zeros, gaps = F.sum(F.col("_times") - 1), F.count("_gap")
    mean = F.coalesce(F.avg("_gap"), F.lit(0.0))
    parts = (
        times.select(*keys, "_slice", "_us", "_times", gap.alias("_gap"))
        .groupBy(*keys, "_slice")
        .agg(F.sum("_times").alias("_packets"), (gaps + zeros).alias("_n"),
             F.coalesce(F.try_divide(mean * gaps, gaps + zeros), F.lit(0.0)).alias("_mean"),
             (F.coalesce(F.var_pop("_gap") * gaps, F.lit(0.0))
              + F.coalesce(F.try_divide(gaps * zeros * mean * mean, gaps + zeros), F.lit(0.0))).alias("_m2"),
             F.min(F.when(F.col("_times") > 1, F.lit(0.0)).otherwise(F.col("_gap"))).alias("_lo"),
             F.max(F.coalesce("_gap", F.when(F.col("_times") > 1, F.lit(0.0)))).alias("_hi"),
             F.min("_us").alias("_start"), F.max("_us").alias("_end"))
    )
    if not keys:
        parts = parts.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    ratio = max(1, window_micros(wide) // window_micros(width))
    merged = _merged_parts(parts.withColumn("_wide", F.floor(F.col("_slice") / ratio)), [*by, "_wide"], "_slice")
    whole = _merged_parts(merged.withColumnRenamed("_wide", "_slice"), by, "_slice")
    result = whole.select(
        *by, F.col("_packets").alias("packets"), F.col("_n").alias("n_intervals"), F.col("_lo").alias("min"), F.col("_hi").alias("max"),
        F.when(F.col("_n") > 0, F.col("_mean")).alias("avg"), F.sqrt(F.try_divide("_m2", F.col("_n") - 1)).alias("std"))
    return result if keys else result.drop("_all")


def _merged_parts(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Parts of a sequence (see `interval_stats`) put together by the keys `by`; gaps between neighbours are added."""
    ordered, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    parts = (
        parts.withColumn("_edge", (F.col("_start") - F.lag("_end").over(ordered)) / F.lit(1e6))
        .withColumn("_e", F.col("_edge").isNotNull().cast("int"))
        .withColumn("_edge0", F.coalesce("_edge", F.lit(0.0)))
        .withColumn("_total", F.sum(F.col("_n") + F.col("_e")).over(whole))
        .withColumn("_avg", F.coalesce(F.try_divide(
            (F.max("_end").over(whole) - F.min("_start").over(whole)) / F.lit(1e6), F.col("_total")), F.lit(0.0)))
    )
    spread = (F.col("_m2") + F.col("_n") * F.pow(F.col("_mean") - F.col("_avg"), 2)
              + F.col("_e") * F.pow(F.col("_edge0") - F.col("_avg"), 2))
    return parts.groupBy(*by).agg(
        F.sum("_packets").alias("_packets"), F.max("_total").alias("_n"), F.max("_avg").alias("_mean"), F.sum(spread).alias("_m2"),
        F.min(F.least("_lo", "_edge")).alias("_lo"), F.max(F.greatest("_hi", "_edge")).alias("_hi"),
        F.min("_start").alias("_start"), F.max("_end").alias("_end"))


def _bucket(value: Column) -> Column:
    """A number that grows with the value and takes few values: exact below 4096, then 12 bits per octave."""
    size = F.abs(value)
    shift = F.greatest(F.length(F.bin(size)) - 1 - _MANTISSA, F.lit(0))
    level = shift.cast("bigint") * (1 << _MANTISSA) + F.call_function("shiftright", size, shift.cast("int"))
    return F.when(value < 0, -level).otherwise(level)


def _fraction_bucket(value: Column) -> Column:
    """The same for doubles: 512 buckets per octave, NaN above all."""
    size = F.abs(value)
    level = F.floor(F.ln(size) * (512 / math.log(2))) + (1 << 20)
    top = F.lit(1 << 40)
    level = F.when(size == 0, F.lit(0)).when(size == float("inf"), top).otherwise(level).cast("bigint")
    return F.when(F.isnan(value), top + 1).when(value < 0, -level).otherwise(level)


def value_stats(df: DataFrame, value: Column, quantiles: dict[str, float],
                groups: Sequence[str] = (), scale: float = 1.0, fractions: bool = False) -> DataFrame:
    """count, min, max, avg and exact interpolated quantiles of a BIGINT expression (a double one, if `fractions`) per group.

    For few groups of any size (often one: the whole table). Values are counted first, the counts are
    rolled up to a bounded number of buckets, and only the buckets that hold a wanted rank are opened, so
    no task sees all values. `scale` divides every result (microseconds -> seconds). No rows, no result.
    """
    groups = list(groups)
    by = groups or ["_all"]
    df = df.select(*groups, value.cast("double" if fractions else "bigint").alias("_v"))
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    counts = (
        df.where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", _fraction_bucket(F.col("_v")) if fractions else _bucket(F.col("_v")))
    )
    ordered = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    buckets = (
        counts.groupBy(*by, "_b")
        .agg(F.sum("_n").alias("_bn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
             F.sum(F.col("_v") * F.col("_n") if fractions else
                   F.col("_v").cast("decimal(25,0)") * F.col("_n").cast("decimal(13,0)")).alias("_bs"))
        .withColumn("_cum", F.sum("_bn").over(ordered))
        .withColumn("_total", F.sum("_bn").over(whole))
        .withColumn("_min", F.min("_lo").over(whole))
        .withColumn("_max", F.max("_hi").over(whole))
        .withColumn("_sum", F.sum("_bs").over(whole))
    )
    wanted = []
    for i, q in enumerate(quantiles.values()):
        place = F.lit(float(q)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                                   rank.cast("bigint").alias("rank"), (place - F.floor(place)).alias("frac")))
    targets = (
        buckets.select(*by, "_b", "_bn", "_cum", "_total", "_min", "_max", "_sum",
                       F.explode(F.array(*wanted)).alias("_t"))
        .where((F.col("_t.rank") < F.col("_cum")) & (F.col("_t.rank") >= F.col("_cum") - F.col("_bn")))
        .select(*by, "_b", "_total", "_min", "_max", "_sum", "_t.i", "_t.side", "_t.frac",
                (F.col("_t.rank") - (F.col("_cum") - F.col("_bn"))).alias("_at"))
    )
    # At most two rows per quantile and group: the broadcast is bounded by the call, not by the data.
    opened = counts.join(F.broadcast(targets), [*by, "_b"])
    inside = Window.partitionBy(*by, "i", "side").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        opened.withColumn("_c", F.sum("_n").over(inside))
        .where((F.col("_at") < F.col("_c")) & (F.col("_at") >= F.col("_c") - F.col("_n")))
    )
    side = lambda i, s: F.max(F.when((F.col("i") == i) & (F.col("side") == s), F.col("_v")))
    frac = lambda i: F.max(F.when(F.col("i") == i, F.col("frac")))
    scaled = lambda c: c.cast("double") / F.lit(float(scale))
    result = picked.groupBy(*by).agg(
        F.max("_total").alias("count"), scaled(F.max("_min")).alias("min"), scaled(F.max("_max")).alias("max"),
        (F.max("_sum").cast("double") / F.max("_total") / F.lit(float(scale))).alias("avg"),
        *[scaled(F.when(side(i, "lo") == side(i, "hi"), side(i, "lo")).otherwise(
            side(i, "lo") + (side(i, "hi") - side(i, "lo")) * frac(i))).alias(name)
          for i, name in enumerate(quantiles)],
    )
    return result if groups else result.drop("_all")


def sequential_share(df: DataFrame, keys: Sequence[str], value: Column, sums: dict[str, Column] | None = None) -> DataFrame:
    """Per key: n distinct values and the share of +1 steps between neighbours in value order.

    With `sums`, the rows must already be distinct per (key, value) and the named sums over them come along; a
    null value then counts in the sums only. Values are cut into ranges of 65,536; each range is scanned alone and
    gives one row, and the ranges are then checked for touching at their borders.
    """
    keys, sums = list(keys), sums or {}
    rows = df.select(*keys, value.cast("bigint").alias("_v"), *[c.alias(f"_sum_{n}") for n, c in sums.items()])
    if not sums:
        rows = rows.where(F.col("_v").isNotNull()).distinct()
    rows = rows.withColumn("_range", F.shiftright("_v", 16))
    inside = Window.partitionBy(*keys, "_range").orderBy("_v")
    ranges = (
        rows.withColumn("_step", (F.col("_v") - F.lag("_v").over(inside) == 1).cast("int"))
        .groupBy(*keys, "_range")
        .agg(F.count("_v").alias("_n"), F.sum("_step").alias("_steps"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
             *[F.sum(f"_sum_{n}").alias(n) for n in sums])
    )
    across = Window.partitionBy(*keys).orderBy("_range")
    touching = (F.col("_lo") - F.lag("_hi").over(across) == 1).cast("int")
    steps = F.coalesce(F.sum("_steps"), F.lit(0)) + F.coalesce(F.sum("_touch"), F.lit(0))
    share = F.when(F.sum("_n") > 1, steps / (F.sum("_n") - 1)).otherwise(F.lit(0.0))
    return ranges.withColumn("_touch", touching).groupBy(*keys).agg(
        F.sum("_n").alias("n"), share.alias("sequential_share"), *[F.sum(n).alias(n) for n in sums])


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str = "position",
                  total: str = "_total") -> DataFrame:
    """Add `position` (from 1, in `order`, which begins with `_us`) and `total`: rows of the key.

    Rows are ranked inside (key, millisecond). Counts by millisecond are summed up inside each minute, and counts by
    minute over the key, so a task holds one millisecond of a key, the milliseconds of a minute, or its minutes.
    """
    cut = [*keys, "_minute", "_ms"]
    rows = df.withColumns({"_ms": F.floor(F.col("_us") / F.lit(1000)), "_minute": F.floor(F.col("_us") / F.lit(60_000_000))})
    before = lambda by, at: F.coalesce(
        F.sum("_n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
    minutes = counts.groupBy(*keys, "_minute").agg(F.sum("_n").alias("_n")).select(
        *keys, "_minute", before(keys, "_minute").alias("_earlier"), F.sum("_n").over(Window.partitionBy(*keys)).alias(total))
    same = lambda a, b, columns: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    places = counts.withColumn("_before", before([*keys, "_minute"], "_ms")).alias("c") \
        .join(minutes.alias("m"), same("c", "m", [*keys, "_minute"])) \
        .select(*[f"c.{c}" for c in cut], (F.col("_before") + F.col("_earlier")).alias("_before"), total)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cut).orderBy(*order)))
    return ranked.alias("r").join(places.alias("p"), same("r", "p", cut)) \
        .select("r.*", total, (F.col("_before") + F.col("_rank")).alias(position)).drop("_ms", "_minute", "_rank")


def match_first(df: DataFrame, keys: Sequence[str], request: Sequence[str], reply: Sequence[str],
                horizon: str, width: str = "1m") -> DataFrame:
    """For each request its first reply with the same key at or after it, within `horizon`, else null.

    Input has BOOLEAN `_is_reply` and BIGINT `_us`; null key parts equal each other. Result: the keys, `_us`,
    the `request` columns and struct `_reply(_us, *reply)`. One shuffle and one running window, newest row
    first, instead of a join: a key with many requests and replies never forms pairs. The key is cut into
    time slices; a reply early in a slice is also given to the slice before, whose requests may wait for it.
    """
    reach, span = window_micros(horizon), window_micros(width)
    span = max(span, reach)
    own = F.floor(F.col("_us") / F.lit(span))
    early = F.col("_is_reply") & (F.col("_us") - own * span <= reach)
    rows = df.select(*keys, "_us", "_is_reply", *dict.fromkeys([*request, *reply]),
                     F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))).alias("_slice"))
    newest = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(F.desc("_us"), F.desc("_is_reply"), *[F.desc(c) for c in reply])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answer = F.last(F.when(F.col("_is_reply"), F.struct("_us", *reply)), ignorenulls=True).over(newest)
    return (
        rows.withColumn("_reply", answer).where(~F.col("_is_reply"))
        .withColumn("_reply", F.when(F.col("_reply._us") - F.col("_us") <= reach, F.col("_reply")))
        .select(*keys, "_us", *[c for c in request if c not in keys], "_reply")
    )


@dataclass(frozen=True)
class Entries:
    """Packets as entries for sums and several exact distinct counts: `rows` are to be grouped by keys and `by` with
    `partial`, and that by the keys with `total`."""

    rows: DataFrame
    by: list[str]
    partial: list[Column]
    total: list[Column]


def distinct_entries(df: DataFrame, keys: Sequence[str], sums: dict[str, tuple[str, Column]], distincts: dict[str, str]) -> Entries:
    """Each row becomes one entry per counted column that is set; the first carries the sums."""
    kinds = dict(df.dtypes)
    types = sorted({kinds[c] for c in distincts.values()})
    entries = []
    for i, column in enumerate(distincts.values()):
        parts = [F.lit(i).alias("k"), *[
            (F.col(column) if kinds[column] == t else F.lit(None).cast(t)).alias(f"v{j}") for j, t in enumerate(types)]]
        entry = F.struct(*parts)
        entries.append(entry if i == 0 else F.when(F.col(column).isNotNull(), entry))
    first = F.col("_k") == 0
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    rows = (
        df.select(*keys, *[value.alias(f"_{name}") for name, (_, value) in sums.items()],
                  F.explode(F.array(*entries)).alias("_x"))
        .where(F.col("_x").isNotNull())  # not array_compact: a lambda would leave whole-stage codegen
        .select(*keys, *[f"_{name}" for name in sums], F.col("_x.k").alias("_k"),
                *[F.col(f"_x.v{j}").alias(f"_v{j}") for j in range(len(types))])
    )
    partial = [combine[how](F.when(first, F.col(f"_{name}"))).alias(name) for name, (how, _) in sums.items()]
    counted = [F.count_if((F.col("_k") == i) & F.col(f"_v{types.index(kinds[c])}").isNotNull()).alias(name)
               for i, (name, c) in enumerate(distincts.items())]
    return Entries(rows, ["_k", *[f"_v{j}" for j in range(len(types))]], partial,
                   [*[combine[how](name).alias(name) for name, (how, _) in sums.items()], *counted])


def sums_and_distincts(df: DataFrame, keys: Sequence[str], sums: dict[str, tuple[str, Column]],
                       distincts: dict[str, str]) -> DataFrame:
    """Per key: sums / minima / maxima of row values and exact distinct counts of several columns (nulls not counted).

    Entries (see `distinct_entries`) are combined on (key, column, value) on the map side, so a hot key is spread over
    its values, and then counted per key: two exchanges and about two rows per input row, where several
    COUNT(DISTINCT) would expand every row once per column and shuffle three times.
    """
    made = distinct_entries(df, keys, sums, distincts)
    return made.rows.groupBy(*keys, *made.by).agg(*made.partial).groupBy(*keys).agg(*made.total)


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated exactly once per row: filters on it are not copied below it."""
    return df.withColumn(name, F.explode(F.array(value)))
