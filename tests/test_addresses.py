"""Private addresses against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from wirelake.functions.addresses import PRIVATE_V4, PRIVATE_V6, PUBLIC_HOLES_V4, PUBLIC_HOLES_V6, is_private_ip

BAD = [None, "", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.-4", "+1.2.3.4", " 1.2.3.4", "1.2.3.4 ", "1..3.4", "a.b.c.d", ":::", "1:2:3", "g::1",
       "1:2:3:4:5:6:7:8:9", "::1::", "12345::", "1.2.3.4:80", "::ffff:1.2.3", "1e1.2.3.4", "1.2.3.0x4"]
V6 = ["::", "::1", "fe80::1%eth0", "2001:DB8::A", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:3::", "2001:4:112::5", "2001:20::", "2001:3f:ffff::", "2001:40::",
      "2002::1", "fbff:ffff::", "fc00::", "fdff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "fe7f::", "fec0::", "100::", "100:0:0:1::", "64:ff9b:1::", "64:ff9b:2::",
      "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "1:2:3:4:5:6:7.8.9.10", "::1.2.3.4"]


def texts():
    rnd = random.Random(2)
    edges = []
    for name in (*PRIVATE_V4, *PUBLIC_HOLES_V4):
        net = ipaddress.ip_network(name)
        edges += [int(net.network_address) - 1, int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1]
    for name in (*PRIVATE_V6, *PUBLIC_HOLES_V6):
        net = ipaddress.ip_network(name)
        edges += [int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1]
    made = [str(ipaddress.ip_address(n)) for n in edges if 0 <= n < 1 << 32] + [str(ipaddress.IPv6Address(n)) for n in edges if 1 << 32 < n < 1 << 128]
    made += [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(100)]
    return made + V6


def test_private_addresses(spark):
    nets = [[ipaddress.ip_network(n) for n in names] for names in ((*PRIVATE_V4, *PRIVATE_V6), (*PUBLIC_HOLES_V4, *PUBLIC_HOLES_V6))]

    def private(text):
        ip = ipaddress.ip_address(text.split("%")[0])
        ip = getattr(ip, "ipv4_mapped", None) or ip
        inside, hole = (any(ip.version == n.version and ip in n for n in names) for names in nets)
        return inside and not hole

    df = spark.createDataFrame([(t,) for t in texts() + BAD], "ip string")
    for r in df.withColumn("own", is_private_ip(F.col("ip"))).collect():
        assert r["own"] == (None if r["ip"] in BAD else private(r["ip"])), r["ip"]
