"""Per-row helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelake.functions.lookups import TCP_FLAG_NAMES

# Accepted timestamp texts are 'Y-m-d H:M:S', the same with fractions, both with 'T' between
# day and time, 'Y-m-dTH:M:SZ', and 'Y-m-d'.
_TIMESTAMP_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?|T\d{1,2}:\d{1,2}:\d{1,2}Z)?$"


def has_flag(flags: Column, letter: str) -> Column:
    """Whether a TCP flag letter is set; null flags give null."""
    return flags.contains(letter)


def parse_tcp_flags(flags: Column) -> Column:
    """Struct of eight booleans FIN..CWR. Case does not matter; null gives all false."""
    upper = F.upper(F.coalesce(flags, F.lit("")))
    return F.struct(*[upper.contains(letter).alias(name) for letter, name in TCP_FLAG_NAMES.items()])


def string_entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of a string; 0 for an empty one."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    characters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    bits = F.aggregate(characters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(size == 0, F.lit(0.0)).otherwise(bits)


def column_entropy(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """Entropy (bits) of the values of a column per group.

    H = log2(N) - sum(n log2 n) / N over the value counts: two partial aggregations, no pass for N.
    """
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return counts.groupBy(*groups).agg(
        F.greatest(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, F.lit(0.0)).alias("entropy"))


def format_bytes(count: Column) -> Column:
    """1536000 -> '1.46 MB'; negative -> '0 B'. Hundredths are rounded half to even, in exact integer steps."""
    count = count.cast("bigint")
    text = F.when(count < 0, F.lit("0 B")).when(count < 1024, F.concat(count.cast("string"), F.lit(".00 B")))
    for power, unit in enumerate(["KB", "MB", "GB", "TB", "PB"], start=1):
        size = 1024 ** power
        hundreds = count.bitwiseAND(size - 1) * 100
        down, rest = F.shiftright(hundreds, 10 * power), hundreds.bitwiseAND(size - 1)
        up = (rest > size // 2) | ((rest == size // 2) & (down % 2 == 1))
        total = F.shiftright(count, 10 * power) * 100 + down + up.cast("int")
        shown = F.concat(F.floor(total / 100).cast("string"), F.lit("."),
                         F.lpad((total % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        text = text.when(count < size * 1024, shown) if unit != "PB" else text.when(count.isNotNull(), shown)
    return text


def _two_places(x: Column) -> Column:
    """A non-negative double with two decimals, rounded from its exact binary value, ties to even.

    Java rounds the shortest decimal form instead. The two differ only where that form ends in a 5 at the third
    place; there the sign of the (exactly computed) error of x * 1000 decides.
    """
    k = F.round(x * 1000.0)
    looks_tied = (k / 1000.0 == x) & (k % 10 == 5)
    c = x * 134_217_729.0
    high = c - (c - x)
    error = ((high * 1000.0 - x * 1000.0) + (x - high) * 1000.0) + (x * 1000.0 - k)
    down = F.floor(k / 10)
    up = (error > 0) | ((error == 0) & (down % 2 == 1))
    tied = (down + up.cast("int")) / 100.0
    return F.format_string("%.2f", F.when(looks_tied, tied).otherwise(x))


def format_duration(seconds: Column) -> Column:
    """45.5 -> '45.50s', 3665 -> '1h 1m 5.00s'; negative -> '0s'."""
    s = seconds.cast("double")
    days, hours = F.floor(s / 86400), F.floor(s % 86400 / 3600)
    minutes, rest = F.floor(s % 3600 / 60), s % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    last = F.concat(_two_places(rest), F.lit("s"))
    parts = F.concat_ws(" ", part(days, "d"), part(hours, "h"), part(minutes, "m"), F.when(rest > 0, last))
    return F.when(s < 0, F.lit("0s")).when(s < 60, F.concat(_two_places(s), F.lit("s"))).when(s >= 60, parts)


def micros_to_timestamp(us: Column) -> Column:
    """Epoch microseconds to the UTC wall clock as TIMESTAMP_NTZ, whatever the session time zone."""
    day = F.lit(86_400_000_000)
    days = F.floor(us / day).cast("int")
    rest = us - days.cast("bigint") * day
    return (F.date_add(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz")
            + F.make_dt_interval(secs=(rest.cast("decimal(20,6)") / F.lit(1_000_000)).cast("decimal(18,6)")))


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds (any number) to the UTC wall clock as TIMESTAMP_NTZ."""
    return micros_to_timestamp(F.round(seconds.cast("double") * 1e6).cast("bigint"))


def parse_timestamp(value: Column, kind: str = "string") -> Column:
    """Timestamp text or epoch number to TIMESTAMP_NTZ; text of another form gives null.

    `kind` is the column's type family, known at plan time: 'string', 'number' or 'timestamp'.
    """
    if kind == "number":
        return epoch_to_timestamp(value)
    if kind == "timestamp":
        return value.cast("timestamp_ntz")
    plain = F.regexp_replace(F.regexp_replace(value, "Z$", ""), "T", " ")
    return F.when(value.rlike(_TIMESTAMP_TEXT), plain.try_cast("timestamp_ntz"))


def create_flow_id(src: Column, dst: Column, sport: Column, dport: Column, protocol: Column) -> Column:
    """'src:sport->dst:dport:PROTO', a null port shown as '*'."""
    port = lambda p: F.coalesce(p.cast("string"), F.lit("*"))
    return F.concat(src, F.lit(":"), port(sport), F.lit("->"), dst, F.lit(":"), port(dport), F.lit(":"), protocol)


def calculate_packet_rate(count: Column, seconds: Column) -> Column:
    """Packets per second; 0 for a duration that is not positive."""
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def safe_cast_to_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_cast_to_str(value: Column, default: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """part / whole as DOUBLE, `default` where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(default))
