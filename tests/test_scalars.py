import ipaddress
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wirelake.errors import InvalidTimeWindowError
from wirelake.functions import addresses, lookups, scalars
from wirelake.functions.windows import interval_text, parse_time_window


def values(spark, rows, ddl, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], ddl).select(expression.alias("o")).collect()]


def test_private_matches_python(spark):
    rng = random.Random(5)
    ips = ["", "x", "1.2.3", "01.2.3.4", "256.1.1.1", "::", "::1", "1::", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "fe80::1%eth0",
           "2001:1::1", "2001:20::5", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1::2::3", ":1", "1:", ":::",
           "12345::", "::300.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::8", "192.0.0.9", "192.0.0.8", "100.64.0.1"]
    for text in addresses.PRIVATE_V4 + addresses.PUBLIC_HOLES_V4 + addresses.PRIVATE_V6 + addresses.PUBLIC_HOLES_V6:
        net = ipaddress.ip_network(text)
        kind = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        for step in (-1, 0, net.num_addresses - 1, net.num_addresses):
            number = int(net.network_address) + step
            if 0 <= number < 2 ** net.max_prefixlen:
                ips.append(str(kind(number)))
    for _ in range(300):
        ips.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        ips.append(":".join(rng.choice(["0", f"{rng.getrandbits(rng.choice([4, 8, 16])):x}"]) for _ in range(8)))

    def expected(ip):
        try:
            return ipaddress.ip_address(ip).is_private
        except ValueError:
            return None

    got = values(spark, ips, "ip string", addresses.is_private_ip(F.col("ip")))
    assert got == [expected(ip) for ip in ips]
    public = values(spark, ips, "ip string", addresses.is_public_ip(F.col("ip")))
    assert public == [expected(ip) is False for ip in ips]


def test_subnet(spark):
    ips = ["10.1.2.3", "10.2.0.1", "2001:db8::1", "junk", None]
    assert values(spark, ips, "ip string", addresses.in_subnet(F.col("ip"), "10.1.0.0/16")) == [True, False, False, None, None]
    assert values(spark, ips, "ip string", addresses.in_subnet(F.col("ip"), "2001:db8::/32")) == [False, False, True, None, None]


def test_flags(spark):
    rows = values(spark, ["SA", "fpu", "", None, "xZ"], "f string", scalars.parse_tcp_flags(F.col("f")))
    assert [[k for k, v in r.asDict().items() if v] for r in rows] == [["SYN", "ACK"], ["FIN", "PSH", "URG"], [], [], []]


def test_format_bytes_is_pythons(spark):
    def python(n):
        if n < 0:
            return "0 B"
        size, unit = float(n), 0
        while size >= 1024 and unit < 5:
            size, unit = size / 1024, unit + 1
        return f"{size:.2f} {['B', 'KB', 'MB', 'GB', 'TB', 'PB'][unit]}"

    rng = random.Random(1)
    numbers = [-1, 0, 1, 1023, 1024, 1536000, 144000, 1024 ** 2 - 1, 1024 ** 5, 1024 ** 6] + [
        rng.getrandbits(rng.randint(1, 53)) for _ in range(500)] + [128 * k + 64 for k in range(1024, 1100)]
    assert values(spark, numbers, "n bigint", scalars.format_bytes(F.col("n"))) == [python(n) for n in numbers]


def test_format_duration_is_pythons(spark):
    def python(s):
        if s < 0:
            return "0s"
        if s < 60:
            return f"{s:.2f}s"
        parts = []
        for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
            if s >= size:
                parts.append(f"{int(s // size)}{unit}")
                s %= size
        if s > 0:
            parts.append(f"{s:.2f}s")
        return " ".join(parts)

    rng = random.Random(2)
    numbers = [-1.0, 0.0, 45.5, 59.999, 60.0, 3665.0, 90061.005, 2.675, 1.005, 0.125, 0.375, 86400.0] + [
        rng.randrange(0, 200_000_000) / 1000 for _ in range(500)] + [k / 1000 for k in range(5, 3000, 10)]
    assert values(spark, numbers, "s double", scalars.format_duration(F.col("s"))) == [python(s) for s in numbers]


def test_entropy(spark):
    assert values(spark, ["aaaa", "abcd", "", None], "s string", scalars.string_entropy(F.col("s"))) == [0.0, 2.0, 0.0, None]
    frame = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 1), ("y", 1)], "g string, v int")
    assert {r.g: r.entropy for r in scalars.column_entropy(frame, "v", "g").collect()} == {"x": 2.0, "y": 0.0}


def test_timestamps(spark):
    texts = ["2021-01-01 00:00:01", "2021-01-01 00:00:01.25", "2021-01-01T00:00:01", "2021-01-01T00:00:01Z", "2021-01-01",
             "01/02/2021", None]
    one = datetime(2021, 1, 1, 0, 0, 1)
    assert values(spark, texts, "t string", scalars.parse_timestamp(F.col("t"))) == [
        one, one.replace(microsecond=250000), one, one, datetime(2021, 1, 1), None, None]
    assert values(spark, [1609459201.25, -0.5], "t double", scalars.parse_timestamp(F.col("t"), "number")) == [
        one.replace(microsecond=250000), datetime(1969, 12, 31, 23, 59, 59, 500000)]


def test_timestamps_do_not_depend_on_session_zone(spark):
    from wirelake.schema import micros

    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:  # 02:30 does not exist that day in Berlin
        frame = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30),)], "timestamp timestamp_ntz")
        us = frame.select(micros(frame).alias("us"))
        row = us.select("us", scalars.micros_to_timestamp(F.col("us")).alias("t")).first()
        assert (row.us, row.t) == (1711852200000000, datetime(2024, 3, 31, 2, 30))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_small_helpers(spark):
    assert values(spark, [80, 8080, 50000, 70000, -1, None], "p int", lookups.classify_port(F.col("p"))) == [
        "well-known", "registered", "ephemeral", "invalid", "invalid", None]
    assert values(spark, [6, 17, 89, 200, None], "p int", lookups.protocol_name(F.col("p"))) == [
        "TCP", "UDP", "OSPF", "Protocol-200", None]
    assert values(spark, [0.0, -1.0, 10.0], "s double", scalars.calculate_packet_rate(F.lit(1000), F.col("s"))) == [0.0, 0.0, 100.0]
    assert values(spark, ["5", "x", None], "s string", scalars.safe_cast_to_int(F.col("s"), 7)) == [5, 7, 7]
    flow = scalars.create_flow_id(F.lit("a"), F.lit("b"), F.col("p"), F.lit(53), F.lit("UDP"))
    assert values(spark, [1, None], "p int", flow) == ["a:1->b:53:UDP", "a:*->b:53:UDP"]


def test_time_windows():
    assert parse_time_window("1.5H").total_seconds() == 5400
    assert interval_text("100ms") == "100000 microseconds"
    for bad in ("", "5", "m5", "5 m", "5w", "-5m"):
        with pytest.raises(InvalidTimeWindowError):
            parse_time_window(bad)
