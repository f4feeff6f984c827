"""How catalog entries are declared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wirelake.catalog.packet_sql import oracle
from wirelake.sources.events_view import packets_from_folder


# Private IPv4 addresses, the two public ones in 192.0.0.0/24 left out.
_PRIVATE_RANGES = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rows: str | None = None  # the query over `p` alone, for use inside another oracle


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema])


def packets(build: Callable[[DataFrame], DataFrame], sql: str | None) -> Entry:
    """An entry whose query takes the packet view."""
    return Entry(lambda spark, folder: rounded(build(packets_from_folder(spark, folder))),
                 oracle(sql) if sql else None, sql)


def tables(build: Callable[[SparkSession, str], DataFrame], sql: str | None) -> Entry:
    """An entry whose query takes the session and the folder of the given tables."""
    return Entry(lambda spark, folder: rounded(build(spark, folder)), sql)


def sql_private(ip: str) -> str:
    """DuckDB test for a private IPv4 address, by first and last address of each private range, written out."""
    def number(text: str) -> int:
        return sum(int(x) << (24 - 8 * i) for i, x in enumerate(text.split(".")))

    part = [f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {1 << (24 - 8 * i)}" for i in range(4)]
    own = "(" + " + ".join(part) + ")"
    return "(" + " OR ".join(f"{own} BETWEEN {number(a)} AND {number(b)}" for a, b in _PRIVATE_RANGES) + ")"


def changed(build: Callable[[DataFrame], DataFrame], columns: dict[str, str], sql: str) -> Entry:
    """An entry over the packet view with some columns replaced by expressions that both engines read; `sql` is over `q`."""
    def run(p: DataFrame) -> DataFrame:
        return build(p.select(*[F.expr(columns[c]).cast(p.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in p.columns],
                              *[F.expr(e).alias(c) for c, e in columns.items() if c not in p.columns]))

    def over(have: list[str]) -> str:
        replaced = ", ".join(f"{e} AS {c}" for c, e in columns.items() if c in have)
        added = "".join(f", {e} AS {c}" for c, e in columns.items() if c not in have)
        return f"SELECT * {f'REPLACE ({replaced})' if replaced else ''}{added} FROM p"

    from wirelake.schema import PACKET_SCHEMA

    view = over([c for c in columns if c in PACKET_SCHEMA.names and not c.startswith("IPv6")])
    body = sql.strip()
    body = f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}"
    return packets(run, f"WITH q AS ({view}){body}")


def bucket(width: str, column: str = "timestamp") -> str:
    return f"time_bucket(INTERVAL '{width}', {column}, TIMESTAMP '1970-01-01 00:00:00')"


def seconds(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start})) / 1e6"
