"""Packet rows derived from the `events` table.

The given tables hold no packets, so each event stands for a small exchange of packets of one kind.
Works on a batch or a streaming events DataFrame: it is one scan and one explode, with no join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F



# Packets per event and kind; the k-th packet follows the first by k steps.
_EXCHANGES = """
concat(
  transform(sequence(0, cast(CASE WHEN kind = 'tcp' THEN 3 + e % 3 WHEN kind = 'udp' THEN 1 + e % 2
                                  WHEN e % 7 = 0 THEN 1 ELSE 2 END AS INT) - 1),
            k -> named_struct('kind', kind, 'k', k, 'step', 1)),
  CASE WHEN e % 100 = 0
       THEN transform(sequence(0, CASE WHEN e % 200 = 0 THEN 59 ELSE 29 END),
                      k -> named_struct('kind', 'scan', 'k', k, 'step', 1))
       ELSE array() END,
  CASE WHEN e % 500 = 1
       THEN transform(sequence(0, 9), k -> named_struct('kind', 'beacon', 'k', k, 'step', 60))
       ELSE array() END)
"""

_COLUMNS = {
    "IP_src": "CASE WHEN kind = 'arp' THEN NULL WHEN rev = 1 THEN srv ELSE cli END",
    "IP_dst": "CASE WHEN kind = 'arp' THEN NULL WHEN rev = 1 THEN cli ELSE srv END",
    "IP_proto": "cast(CASE WHEN kind IN ('tcp','scan','beacon') THEN 6 WHEN kind IN ('udp','dns') THEN 17 "
                "WHEN kind = 'icmp' THEN 1 END AS INT)",
    "IP_len": "cast(CASE WHEN kind = 'arp' THEN NULL WHEN kind = 'dns' AND rev = 1 AND e % 20 = 6 THEN 1400 "
              "WHEN kind = 'scan' THEN 60 ELSE 52 + v % 100 END AS BIGINT)",
    "IP_flags": "CASE WHEN kind = 'arp' THEN NULL WHEN e % 40 = 3 THEN 'MF' ELSE 'DF' END",
    "IP_frag": "cast(CASE WHEN kind = 'arp' THEN NULL WHEN e % 40 = 4 THEN 185 ELSE 0 END AS INT)",
    "IP_tos": "cast(CASE WHEN kind = 'arp' THEN NULL WHEN e % 9 = 0 THEN 184 WHEN e % 9 = 1 THEN 3 ELSE 0 END AS INT)",
    "TCP_sport": "cast(CASE WHEN kind IN ('tcp','scan','beacon') "
                 "THEN CASE WHEN rev = 1 THEN e % 1000 ELSE 20000 + e % 40000 END END AS INT)",
    "TCP_dport": "cast(CASE WHEN kind = 'scan' THEN 1000 + k WHEN kind = 'beacon' THEN 443 WHEN kind = 'tcp' "
                 "THEN CASE WHEN rev = 1 THEN 20000 + e % 40000 ELSE e % 1000 END END AS INT)",
    "TCP_flags": "CASE WHEN kind = 'scan' THEN CASE WHEN k % 30 = 29 THEN 'FPU' WHEN k % 30 = 28 THEN '' ELSE 'S' END "
                 "WHEN kind = 'beacon' THEN 'PA' WHEN kind = 'tcp' THEN CASE k WHEN 0 THEN 'S' "
                 "WHEN 1 THEN CASE WHEN e % 4 = 0 THEN 'RA' ELSE 'SA' END WHEN 2 THEN 'A' WHEN 3 THEN 'PA' "
                 "ELSE 'FA' END END",
    "TCP_seq": "cast(CASE WHEN kind IN ('tcp','scan','beacon') "
               "THEN e * 1000 + CASE WHEN e % 11 = 0 THEN 0 ELSE k END END AS BIGINT)",
    "TCP_window": "cast(CASE WHEN kind IN ('tcp','scan','beacon') THEN 1024 + (v * 37) % 64000 END AS INT)",
    "UDP_sport": "cast(CASE WHEN kind = 'udp' THEN CASE WHEN rev = 1 THEN 123 ELSE 30000 + e % 9000 END "
                 "WHEN kind = 'dns' THEN CASE WHEN rev = 1 THEN 53 ELSE 30000 + e % 9000 END END AS INT)",
    "UDP_dport": "cast(CASE WHEN kind = 'udp' THEN CASE WHEN rev = 1 THEN 30000 + e % 9000 ELSE 123 END "
                 "WHEN kind = 'dns' THEN CASE WHEN rev = 1 THEN 30000 + e % 9000 ELSE 53 END END AS INT)",
    "DNS_id": "cast(CASE WHEN kind = 'dns' THEN e % 65536 END AS INT)",
    "DNS_qr": "cast(CASE WHEN kind = 'dns' THEN rev END AS INT)",
    "DNS_rcode": "cast(CASE WHEN kind = 'dns' AND rev = 1 THEN CASE WHEN e % 5 = 1 THEN 3 WHEN e % 17 = 0 THEN 2 "
                 "ELSE 0 END END AS INT)",
    "DNS_qname": "CASE WHEN kind = 'dns' THEN CASE WHEN e % 30 = 6 "
                 "THEN concat(repeat(cast(e * 7919 AS STRING), 16), '.t.example.net') "
                 "ELSE concat('host', cast(e % 50 AS STRING), '.example.com') END END",
    "DNS_qtype": "cast(CASE WHEN kind = 'dns' THEN CASE e % 4 WHEN 0 THEN 1 WHEN 1 THEN 28 WHEN 2 THEN 16 "
                 "ELSE 15 END END AS INT)",
    "ICMP_type": "cast(CASE WHEN kind = 'icmp' THEN CASE WHEN rev = 1 THEN 0 WHEN e % 3 = 2 THEN 3 ELSE 8 END END AS INT)",
    "ICMP_id": "cast(CASE WHEN kind = 'icmp' THEN e % 65536 END AS INT)",
    "ARP_opcode": "cast(CASE WHEN kind = 'arp' THEN 1 + k END AS INT)",
    "ARP_sender_ip": "CASE WHEN kind = 'arp' THEN CASE WHEN k = 0 THEN cli ELSE srv END END",
    "ARP_sender_mac": "CASE WHEN kind = 'arp' THEN concat('02:00:00:00:00:', "
                      "cast(10 + e % CASE WHEN k = 0 THEN 7 ELSE 3 END AS STRING)) END",
    "ARP_target_ip": "CASE WHEN kind = 'arp' THEN CASE WHEN e % 6 = 3 THEN CASE WHEN k = 0 THEN cli ELSE srv END "
                     "WHEN k = 0 THEN srv ELSE cli END END",
    "raw_size": "cast(60 + v % 100 AS BIGINT)",
}


def packets_from_events(events: DataFrame) -> DataFrame:
    """The packet view over an events DataFrame (event_id, ts, user_id, value)."""
    base = events.select(
        F.col("event_id").alias("e"),
        F.col("ts").alias("event_ts"),
        F.floor("value").cast("bigint").alias("v"),
        F.expr("CASE WHEN event_id % 10 < 5 THEN 'tcp' WHEN event_id % 10 = 5 THEN 'udp' "
               "WHEN event_id % 10 < 8 THEN 'dns' WHEN event_id % 10 = 8 THEN 'icmp' ELSE 'arp' END").alias("kind"),
        F.expr("concat('10.0.', cast(user_id % 4 AS STRING), '.', cast(user_id % 200 + 1 AS STRING))").alias("client"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN concat('8.8.8.', cast(event_id % 5 + 1 AS STRING)) "
               "ELSE concat('192.168.1.', cast(event_id % 20 + 1 AS STRING)) END").alias("server"),
    )
    packets = base.select("e", "event_ts", "v", "client", "server", F.explode(F.expr(_EXCHANGES)).alias("x")).select(
        "e", "v",
        F.expr("event_ts + make_dt_interval(0, 0, 0, x.k * x.step)").alias("timestamp"),
        F.col("x.kind").alias("kind"), F.col("x.k").alias("k"),
        F.expr("CASE x.kind WHEN 'scan' THEN '10.0.9.9' WHEN 'beacon' THEN '10.0.8.8' ELSE client END").alias("cli"),
        F.expr("CASE x.kind WHEN 'scan' THEN '192.168.1.5' WHEN 'beacon' THEN '93.184.216.34' "
               "ELSE server END").alias("srv"),
        F.expr("CASE WHEN x.kind IN ('tcp','udp','dns','icmp') AND x.k = 1 THEN 1 ELSE 0 END").alias("rev"),
    )
    return packets.select("timestamp", *[F.expr(sql).alias(name) for name, sql in _COLUMNS.items()])


def packets_from_folder(spark: SparkSession, folder: str) -> DataFrame:
    return packets_from_events(spark.read.parquet(f"{folder}/events.parquet"))
