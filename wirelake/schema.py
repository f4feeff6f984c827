"""The packet table: one row per packet, one nullable column per decoded field.

`PACKET_SCHEMA` is fixed, so a file written before a layer was known still reads: absent columns are
null. Fields of layers that have no column of their own are kept in `extras`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wirelake.errors import MissingColumnError

LAYER_FIELDS = {
    "Ethernet": "dst_mac string, src_mac string, type int",
    "IP": "version int, ihl int, tos int, len bigint, id int, flags string, frag int, ttl int, proto int, "
          "chksum int, src string, dst string, options string",
    "IPv6": "src string, dst string, nh int, plen int, hlim int",
    "TCP": "sport int, dport int, seq bigint, ack bigint, dataofs int, reserved int, flags string, "
           "window int, chksum int, urgptr int, options string",
    "UDP": "sport int, dport int, len int, chksum int",
    "ICMP": "type int, code int, chksum int, id int, seq int, data binary",
    "ARP": "hw_type int, proto_type int, hw_len int, proto_len int, opcode int, sender_mac string, "
           "sender_ip string, target_mac string, target_ip string",
    "STP": "protocol_id int, version int, bpdutype int, flags binary, root_bridge_id string, "
           "sender_bridge_id string, root_path_cost bigint, port_id int, message_age double, "
           "max_age double, hello_time double, forward_delay double",
    "DNS": "id int, qr int, rcode int, qname string, qtype int",
}


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
          "binary": T.BinaryType()}


def _packet_schema() -> T.StructType:
    schema = T.StructType().add("timestamp", T.TimestampNTZType()).add("raw_size", T.LongType())
    for layer, fields in LAYER_FIELDS.items():
        for name, kind in (field.split() for field in fields.split(",")):
            schema = schema.add(f"{layer}_{name}", _TYPES[kind])
    return schema.add("extras", T.MapType(T.StringType(), T.StringType()))


PACKET_SCHEMA = _packet_schema()
NESTED_SCHEMA = (
    T.StructType().add("timestamp", T.DoubleType())
    .add("layers", T.ArrayType(T.StructType().add("layer_name", T.StringType())
                               .add("fields", T.MapType(T.StringType(), T.StringType()))))
    .add("raw_size", T.LongType())
)

PORT_COLUMNS = ("UDP_dport", "UDP_sport", "TCP_dport", "TCP_sport")
CONNECTION_KEY = ("IP_src", "IP_dst", "TCP_sport", "TCP_dport")


def require(df: DataFrame, *names: str) -> None:
    """Check, at plan time, that the columns exist."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumnError(missing, df.columns)


def optional(df: DataFrame, name: str, ddl_type: str) -> Column:
    """The column, or a typed null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(ddl_type)


def integral(df: DataFrame, name: str) -> Column:
    """The column as a number. Integer columns stay bare, so filters on them reach the parquet scan."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name)
    return F.col(name).try_cast("bigint")


def length_column(df: DataFrame) -> Column:
    """IP_len as BIGINT."""
    require(df, "IP_len")
    return integral(df, "IP_len").cast("bigint")


def micros(df: DataFrame, name: str = "timestamp") -> Column:
    """Microseconds since the epoch, whatever the session time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = f"cast(cast(`{name}` - timestamp_ntz'1970-01-01' as interval second) as decimal(20,6))"
        return F.expr(f"cast({seconds} * 1000000 as bigint)")
    return F.unix_micros(name)


def seconds_between(start: str, end: str) -> Column:
    """Exact seconds from column `start` to column `end` as DOUBLE."""
    return F.expr(f"cast(cast(cast(`{end}` - `{start}` as interval second) as decimal(20,6)) as double)")


def whole_seconds_between(start: str, end: str) -> Column:
    """Seconds from `start` to `end`, truncated toward zero, as BIGINT."""
    return F.expr(f"cast(cast(cast(`{end}` - `{start}` as interval second) as decimal(20,6)) as bigint)")
