"""Queries and oracles of sources, sinks, filters, summaries and scalar functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelake.catalog.entry import bucket, packets, seconds, sql_private, tables
from wirelake.catalog.packet_sql import oracle
from wirelake.functions import addresses, lookups, scalars
from wirelake.operators import filters, sketches, summary
from wirelake.session import scratch_path
from wirelake.sources import nested, parquet
from wirelake.sources.events_view import packets_from_folder

_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
           "conversations").split()
_COLUMNS = ("timestamp IP_src IP_dst IP_proto IP_len IP_flags IP_frag IP_tos TCP_sport TCP_dport TCP_flags TCP_seq "
            "TCP_window UDP_sport UDP_dport DNS_id DNS_qr DNS_rcode DNS_qname DNS_qtype ICMP_type ICMP_id ARP_opcode "
            "ARP_sender_ip ARP_sender_mac ARP_target_ip raw_size").split()
_TEXT_COLUMNS = ["timestamp", "IP_src", "IP_dst", "IP_flags", "TCP_flags", "DNS_qname", "ARP_sender_mac", "raw_size"]
_HASHED = ", ".join(_TEXT_COLUMNS)


def _filled(df: DataFrame) -> DataFrame:
    """Null integers as -1, so that integer columns compare as integers in both engines."""
    kinds = {"int", "bigint"}
    return df.select(*[F.coalesce(F.col(n), F.lit(-1).cast(t)).alias(n) if t in kinds else F.col(n) for n, t in df.dtypes])


_INTS = {"IP_proto", "IP_len", "IP_frag", "IP_tos", "TCP_sport", "TCP_dport", "TCP_seq", "TCP_window", "UDP_sport",
         "UDP_dport", "DNS_id", "DNS_qr", "DNS_rcode", "DNS_qtype", "ICMP_type", "ICMP_id", "ARP_opcode", "raw_size"}


def _filled_sql(columns=_COLUMNS, source: str = "p", tail: str = "") -> str:
    shown = ", ".join(f"coalesce({c}, -1) AS {c}" if c in _INTS else c for c in columns)
    return f"SELECT {shown} FROM {source} {tail}"


def _saved(spark: SparkSession, folder: str) -> DataFrame:
    """The table written under a name with the time of writing, and found again by the path given back."""
    path = parquet.save_to_parquet(packets_from_folder(spark, folder), scratch_path(spark, "saved"), "capture")
    if not re.fullmatch(r".*/capture_\d+\.parquet", path):
        raise AssertionError(path)
    return parquet.load_landed(spark, path).groupBy("IP_src").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("raw_size").alias("bytes"), F.max("timestamp").alias("last_seen"))


def _round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "packets")
    parquet.save_packets(packets_from_folder(spark, folder), path, "zstd")
    return _filled(parquet.load_landed(spark, path).select(*_COLUMNS))


def _appended(spark: SparkSession, folder: str) -> DataFrame:
    """TCP packets saved first; the others, with fewer columns, appended."""
    rows, path = packets_from_folder(spark, folder), scratch_path(spark, "packets")
    parquet.save_packets(rows.where("IP_proto = 6"), path)
    others = rows.where("IP_proto IS NULL OR IP_proto <> 6").select("timestamp", "IP_src", "IP_dst", "IP_proto", "raw_size")
    parquet.append_packets(others, path)
    return _filled(parquet.load_packets(spark, path).groupBy("IP_proto").agg(
        F.count(F.lit(1)).alias("packets"), F.count("TCP_dport").alias("with_port"), F.sum("raw_size").alias("bytes")))


def _concatenated(p: DataFrame) -> DataFrame:
    tcp, rest = p.where("IP_proto = 6"), p.where("IP_proto IS NULL OR IP_proto <> 6").select("timestamp", "raw_size")
    both = parquet.concat_packets(tcp, rest)
    return both.groupBy("TCP_flags").agg(F.count(F.lit(1)).alias("packets"), F.sum("raw_size").alias("bytes"))


def _file_info(spark: SparkSession, folder: str) -> DataFrame:
    info = parquet.get_file_info(spark, f"{folder}/events.parquet")
    return info.select("name", "files", "columns", (F.col("size_bytes") > 0).alias("has_size"))


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    found = [(t, parquet.validate_parquet(spark, f"{folder}/{t}.parquet")) for t in (*_TABLES, "absent")]
    return spark.createDataFrame(found, "name string, valid boolean")


def _exported(spark: SparkSession, folder: str) -> DataFrame:
    rows, path = packets_from_folder(spark, folder), scratch_path(spark, "summary")
    parts = []
    for kind in ("json", "csv", "parquet"):
        summary.export_summary_report(rows, kind, f"{path}/{kind}")
        reader = spark.read.schema("category string, metric string, value string")
        back = (reader.option("header", True) if kind == "csv" else reader).format(kind).load(f"{path}/{kind}")
        parts.append(back.withColumn("format", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


_SUMMARY_SQL = f"""
WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE IP_proto = 6) AS tcp,
  count(*) FILTER (WHERE IP_proto = 17) AS udp, count(*) FILTER (WHERE UDP_sport = 53 OR UDP_dport = 53
  OR TCP_sport = 53 OR TCP_dport = 53) AS dns, count(*) FILTER (WHERE ARP_opcode IS NOT NULL) AS arp,
  count(*) FILTER (WHERE IP_proto = 1) AS icmp, count(*) AS ip FROM p),
k AS (SELECT unnest([('total', total), ('tcp', tcp), ('udp', udp), ('dns', dns), ('arp', arp), ('icmp', icmp),
      ('ip', ip)]) AS x FROM c),
s AS (SELECT 'packet_counts' AS category, x[1] AS metric, CAST(x[2] AS VARCHAR) AS value FROM k
UNION ALL SELECT 'analyzers_available', x[1], CAST(x[2] > 0 AS VARCHAR) FROM k WHERE x[1] <> 'total'
UNION ALL SELECT 'analyzers_available', unnest(['flow', 'anomaly']), 'true'
UNION ALL SELECT 'date_range', 'start', CAST(min(timestamp) AS VARCHAR) FROM p
UNION ALL SELECT 'date_range', 'end', CAST(max(timestamp) AS VARCHAR) FROM p
UNION ALL SELECT 'general', 'unique_hosts', CAST(count(DISTINCT h) AS VARCHAR)
  FROM (SELECT IP_src AS h FROM p UNION ALL SELECT IP_dst FROM p)
UNION ALL SELECT 'protocols', coalesce(CAST(IP_proto AS VARCHAR), 'None'), CAST(count(*) AS VARCHAR) FROM p GROUP BY IP_proto)
"""


def _without_duration(df: DataFrame) -> DataFrame:
    """The text form of a double differs between engines; its value is compared by `date_range`."""
    return df.where("NOT (category = 'date_range' AND metric = 'duration')")


def _nested(p: DataFrame) -> DataFrame:
    return nested.nest_packets(p)


def _json_round_trip(p: DataFrame) -> DataFrame:
    from wirelake.schema import NESTED_SCHEMA

    texts = nested.to_json(_nested(p)).where("value not like '%\"total_packets\"%'")
    back = texts.select(F.from_json("value", NESTED_SCHEMA).alias("x")).select("x.*")
    return _filled(nested.flatten_packets(back).select(*_COLUMNS))


def _json_total(p: DataFrame) -> DataFrame:
    texts = nested.to_json(_nested(p)).where("value like '%\"total_packets\"%'")
    return texts.select(F.get_json_object("value", "$.total_packets").cast("bigint").alias("total_packets"))


def _odd_layers(p: DataFrame) -> DataFrame:
    """Every packet with layers that have no fields, come twice, or whose unknown fields come to one name."""
    fields = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in kv])
    layer = lambda name, f: F.struct(F.lit(name).alias("layer_name"), f.alias("fields"))
    none = F.lit(None).cast("map<string,string>")
    layers = F.array(
        layer("TCP", fields("sport", F.col("raw_size"), "x_y", F.lit("known"))), layer("TCP", none),
        layer("TCP_x", fields("y", F.lit("unknown"))), layer("X", fields("a", F.col("IP_len"))), layer("Y", none))
    odd = nested.flatten_packets(p.select(F.lit(0.0).alias("timestamp"), layers.alias("layers"), "raw_size"))
    return odd.groupBy("raw_size", "TCP_sport", *[F.col("extras")[k].alias(k) for k in ("TCP_x_y", "X_a")]).agg(F.count(F.lit(1)).alias("packets"))


_LAYER_TESTS = {"IP": "IP_src IS NOT NULL", "TCP": "TCP_sport IS NOT NULL", "UDP": "UDP_sport IS NOT NULL",
                "DNS": "DNS_id IS NOT NULL", "ICMP": "ICMP_type IS NOT NULL", "ARP": "ARP_opcode IS NOT NULL"}

SOURCES = {
    "packet_view": packets(_filled, _filled_sql()),
    "table_round_trip": tables(_round_trip, oracle(_filled_sql())),
    "table_save_to_parquet": tables(_saved, oracle(
        "SELECT IP_src, count(*) AS packets, CAST(sum(raw_size) AS BIGINT) AS bytes, max(timestamp) AS last_seen FROM p GROUP BY 1")),
    "table_append": tables(_appended, oracle(
        "SELECT coalesce(IP_proto, -1) AS IP_proto, count(*) AS packets, count(TCP_dport) AS with_port, "
        "CAST(sum(raw_size) AS BIGINT) AS bytes FROM p GROUP BY 1")),
    "table_concat": packets(
        _concatenated, "SELECT TCP_flags, count(*) AS packets, CAST(sum(raw_size) AS BIGINT) AS bytes FROM p GROUP BY 1"),
    "table_schema": tables(
        lambda spark, folder: parquet.get_schema(spark, f"{folder}/events.parquet"),
        "SELECT column_name AS \"column\", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
        "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE data_type END AS type "
        "FROM duckdb_columns() WHERE table_name = 'events'"),
    "table_file_info": tables(
        _file_info, "SELECT 'events.parquet' AS name, CAST(1 AS BIGINT) AS files, CAST(count(*) AS INTEGER) AS columns, "
        "true AS has_size FROM duckdb_columns() WHERE table_name = 'events'"),
    "table_validate": tables(
        _validated, "SELECT unnest([" + ", ".join(f"'{t}'" for t in _TABLES) + "]) AS name, true AS valid "
        "UNION ALL SELECT 'absent', false"),
    "summary_export": tables(
        lambda spark, folder: _without_duration(_exported(spark, folder)), oracle(
            f"{_SUMMARY_SQL} SELECT s.*, format FROM s, (SELECT unnest(['json', 'csv', 'parquet']) AS format)")),
    "nested_flatten": packets(
        lambda p: _filled(nested.flatten_packets(_nested(p)).select(*_COLUMNS)), _filled_sql()),
    "nested_json_export": packets(_json_round_trip, _filled_sql()),
    "nested_json_total": packets(_json_total, "SELECT count(*) AS total_packets FROM p"),
    "nested_odd_layers": packets(
        _odd_layers, "SELECT raw_size, CAST(raw_size AS INTEGER) AS \"TCP_sport\", 'known' AS \"TCP_x_y\", "
        "CAST(IP_len AS VARCHAR) AS \"X_a\", count(*) AS packets FROM p GROUP BY ALL"),
    "nested_layer_stats": packets(
        lambda p: nested.show_stats(_nested(p)), " UNION ALL ".join(
            f"SELECT '{name}' AS layer_name, count(*) FILTER (WHERE {test}) AS packets, "
            f"round(count(*) FILTER (WHERE {test}) * 100.0 / count(*), 6) AS percentage FROM p"
            for name, test in _LAYER_TESTS.items())),
    "nested_has_layer": packets(
        lambda p: _nested(p).groupBy(*[nested.has_layer(x).alias(f"has_{x}") for x in ("TCP", "DNS", "STP")]).agg(
            F.count(F.lit(1)).alias("packets")),
        "SELECT TCP_sport IS NOT NULL AS \"has_TCP\", DNS_id IS NOT NULL AS \"has_DNS\", false AS \"has_STP\", "
        "count(*) AS packets FROM p GROUP BY ALL"),
    "nested_get_layer": packets(
        lambda p: _nested(p).select(nested.get_layer("DNS").alias("dns")).where("dns IS NOT NULL").select(
            F.col("dns.layer_name").alias("layer_name"), F.col("dns.fields")["qname"].alias("qname"),
            F.col("dns.fields")["id"].alias("id")),
        "SELECT 'DNS' AS layer_name, DNS_qname AS qname, CAST(DNS_id AS VARCHAR) AS id FROM p WHERE DNS_id IS NOT NULL"),
}

_HOST = "192.168.1.5"
_OWN = f"(IP_src = '{_HOST}' OR IP_dst = '{_HOST}')"
_ORDER = ", ".join(f"{c} {{0}} NULLS LAST" for c in _COLUMNS)
_DNS = "UDP_sport = 53 OR UDP_dport = 53 OR TCP_sport = 53 OR TCP_dport = 53"


def _sampled(p: DataFrame) -> DataFrame:
    """Properties of a sample: its rows, its different ones, and those that the table holds."""
    columns = ["timestamp", "IP_src", "IP_dst", "TCP_sport", "TCP_dport", "UDP_sport", "TCP_seq", "DNS_id", "ARP_sender_ip", "raw_size"]
    marks = p.select(F.xxhash64(*columns).alias("mark")).withColumn("row", F.monotonically_increasing_id())
    picked = filters.sample(marks, 100, seed=7)
    known = marks.select(F.col("mark").alias("own")).distinct()
    return picked.join(known, picked["mark"] == known["own"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("n_different"), F.count("own").alias("n_known"))


_FRACTIONS = {"half": "raw_size * 0.5D", "huge": "raw_size * 3.0D * 1e13D", "tiny": "raw_size / 1073741824.0D", "signed": "(raw_size - 100) * 0.125D"}


def _described_fractions(p: DataFrame) -> DataFrame:
    """Fractions of every size, shown in units in which both engines round alike."""
    rows = filters.describe(p.select(*[F.expr(e).alias(c) for c, e in _FRACTIONS.items()]))
    unit = F.when(F.col("column") == "huge", 1e13).when(F.col("column") == "tiny", 1 / 1073741824.0).otherwise(1.0)
    return rows.select(*[(F.col(c) / unit).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def _sketched(p: DataFrame) -> DataFrame:
    """Weekly reports from stored daily sketches beside the exact figures, and whether they are as near as stated."""
    path = scratch_path(p.sparkSession, "sketches")
    for part in (p.where("timestamp < timestamp_ntz'2024-01-12'"), p.where("timestamp >= timestamp_ntz'2024-01-11'")):
        sketches.store_sketches(part, path)  # a day that comes again is replaced
    found = sketches.report(p.sparkSession.read.parquet(path), "week", (0.5,))
    week = F.to_date(F.date_trunc("week", "timestamp")).alias("period")
    exact = p.groupBy(week).agg(
        F.count_distinct(F.when(F.col("IP_src").isNotNull(), F.concat_ws(">", "IP_src", "IP_dst"))).alias("exact_pairs"),
        F.count_distinct(F.coalesce("TCP_dport", "UDP_dport")).alias("exact_ports"))
    sizes = p.groupBy(week, "IP_len").count()
    ranks = sizes.join(found.select("period", "size_p50"), "period").where("IP_len is not null").groupBy("period").agg(
        (F.sum(F.when(F.col("IP_len") < F.col("size_p50"), F.col("count")).otherwise(0)) / F.sum("count")).alias("below"),
        (F.sum(F.when(F.col("IP_len") <= F.col("size_p50"), F.col("count")).otherwise(0)) / F.sum("count")).alias("upto"))
    near = lambda c: (F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.05 * F.col(f"exact_{c}")).alias(f"{c}_near")
    return found.join(exact, "period").join(ranks, "period").select(
        "period", "packets", "bytes", "first_seen", "last_seen", "exact_pairs", "exact_ports", near("pairs"), near("ports"),
        ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))


def _described(p: DataFrame) -> DataFrame:
    """All columns; seconds of the timestamp to a thousandth, as both engines add up large numbers."""
    rows = filters.describe(p, *_COLUMNS)
    return rows.select(*[F.when(F.col("column") == "timestamp", F.round(c, 3)).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c)
                         for c, t in rows.dtypes])


def _describe_sql(column: str, value: str, unit: str = "", digits: int = 6) -> str:
    q = lambda f: f"round({f} {unit}, {digits})"
    return (f"SELECT '{column}' AS \"column\", count({value}) AS count, count(*) - count({value}) AS null_count, "
            f"{q(f'stddev_samp({value})')} AS std, {q(f'avg({value})')} AS mean, {q(f'CAST(min({value}) AS DOUBLE)')} AS min, "
            f"{q(f'quantile_cont({value}, 0.25)')} AS p25, {q(f'quantile_cont({value}, 0.5)')} AS p50, "
            f"{q(f'quantile_cont({value}, 0.75)')} AS p75, {q(f'CAST(max({value}) AS DOUBLE)')} AS max, "
            "CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text FROM p")


FILTERS = {
    "filter_by_protocol": packets(
        lambda p: _filled(filters.get_by_protocol(p, "TCP")), _filled_sql([c for c in _COLUMNS if "TCP" in c])),
    "filter_by_ip": packets(
        lambda p: _filled(filters.find_ip_information(p, _HOST)), _filled_sql(tail=f"WHERE {_OWN}")),
    "filter_timestamps": packets(filters.get_timestamps, "SELECT timestamp FROM p"),
    "filter_timestamps_by_ip": packets(
        lambda p: filters.get_timestamps_by_ip(p, _HOST), f"SELECT timestamp FROM p WHERE {_OWN}"),
    "view_tcp": packets(lambda p: _filled(filters.tcp_packets(p)), _filled_sql(tail="WHERE IP_proto = 6")),
    "view_udp": packets(lambda p: _filled(filters.udp_packets(p)), _filled_sql(tail="WHERE IP_proto = 17")),
    "view_dns": packets(lambda p: _filled(filters.dns_packets(p)), _filled_sql(tail=f"WHERE {_DNS}")),
    "view_icmp": packets(lambda p: _filled(filters.icmp_packets(p)), _filled_sql(tail="WHERE IP_proto = 1")),
    "view_arp": packets(lambda p: _filled(filters.arp_packets(p)), _filled_sql(tail="WHERE ARP_opcode IS NOT NULL")),
    "unified_addresses": packets(
        lambda p: filters.unified_ips(p).groupBy(F.col("_source_ip").alias("source_ip"),
                                                 F.col("_destination_ip").alias("destination_ip")).count(),
        "SELECT IP_src AS source_ip, IP_dst AS destination_ip, count(*) AS count FROM p GROUP BY 1, 2"),
    "rows_head": packets(
        lambda p: _filled(filters.head(p, 25)), _filled_sql(source=f"(SELECT * FROM p ORDER BY {_ORDER.format('ASC')} LIMIT 25)")),
    "rows_tail": packets(
        lambda p: _filled(filters.tail(p, 25)), _filled_sql(source=f"(SELECT * FROM p ORDER BY {_ORDER.format('DESC')} LIMIT 25)")),
    "rows_sample": packets(
        _sampled, "SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_different, least(100, count(*)) AS n_known "
        "FROM (SELECT row_number() OVER () AS r FROM p)"),
    "rows_describe": packets(_described, " UNION ALL ".join(
        [_describe_sql(c, c) for c in _COLUMNS if c in _INTS] + [_describe_sql("timestamp", "epoch_us(timestamp)", "/ 1e6", 3)] + [
            f"SELECT '{c}', count({c}), count(*) - count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, min({c}), max({c}) FROM p"
            for c in _COLUMNS if c not in _INTS and c != "timestamp"])),
}


SKETCHES = {"sketch_weekly_report": packets(_sketched, """
SELECT CAST(date_trunc('week', timestamp) AS DATE) AS period, count(*) AS packets, CAST(coalesce(sum(IP_len), 0) AS BIGINT) AS bytes,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  count(DISTINCT CASE WHEN IP_src IS NOT NULL THEN concat(IP_src, '>', IP_dst) END) AS exact_pairs,
  count(DISTINCT coalesce(TCP_dport, UDP_dport)) AS exact_ports, true AS pairs_near, true AS ports_near, true AS median_near
FROM p GROUP BY 1""")}
_PLAIN = {"half": "raw_size * 0.5::DOUBLE", "huge": "raw_size * 3.0::DOUBLE * 1e13::DOUBLE", "tiny": "raw_size / 1073741824.0::DOUBLE",
          "signed": "(raw_size - 100) * 0.125::DOUBLE"}
_UNITS = {"huge": "/ 1e13", "tiny": "* 1073741824.0::DOUBLE"}
FILTERS["rows_describe_fractions"] = packets(_described_fractions, " UNION ALL ".join(
    _describe_sql(c, f"({e})", _UNITS.get(c, "")) for c, e in _PLAIN.items()))


def _behavior(host: str, peer: str, name: str, size: str, peers: str, window: str) -> str:
    flags = ", ".join(f"count(*) FILTER (WHERE contains(TCP_flags, '{x}')) AS {n}_count"
                      for n, x in (("syn", "S"), ("rst", "R"), ("fin", "F"), ("psh", "P")))
    protos = ", ".join(f"count(*) FILTER (WHERE IP_proto = {n}) AS {x}_packet_count"
                       for x, n in (("tcp", 6), ("udp", 17), ("icmp", 1)))
    return f"""
SELECT {bucket(window)} AS window_start, {host} AS {name}, count(*) AS packet_count, CAST(sum(IP_len) AS BIGINT) AS {size},
  count(DISTINCT {peer}) AS {peers}, count(DISTINCT TCP_dport) AS unique_tcp_dst_port_count,
  count(DISTINCT UDP_dport) AS unique_udp_dst_port_count, {protos}, {flags},
  count(*) FILTER (WHERE IP_flags = 'MF') AS ip_fragment_count,
  count(*) FILTER (WHERE IP_flags = 'DF') AS ip_dont_fragment_count
FROM p WHERE {host} IS NOT NULL GROUP BY 1, 2"""


_SENT = _behavior("IP_src", "IP_dst", "source_ip", "total_bytes_sent", "unique_dst_ip_count", "1 hour")
_RANGE = f"SELECT min(timestamp) AS start, max(timestamp) AS \"end\", round({seconds('min(timestamp)', 'max(timestamp)')}, 6) AS duration FROM p"

SUMMARIES = {
    "packet_count": packets(summary.get_packet_count, "SELECT count(*) AS packet_count FROM p"),
    "date_range": packets(summary.get_date_range, _RANGE),
    "date_range_udp": packets(
        lambda p: summary.get_date_range(filters.udp_packets(p)), f"{_RANGE} WHERE IP_proto = 17"),
    "analyzers_available": packets(
        summary.get_analyzers_available,
        "SELECT bool_or(IP_proto = 6) AS tcp, bool_or(IP_proto = 17) AS udp, "
        f"bool_or({_DNS}) AS dns, bool_or(ARP_opcode IS NOT NULL) AS arp, bool_or(IP_proto = 1) AS icmp, "
        "true AS ip, true AS flow, true AS anomaly FROM p"),
    "summary": packets(lambda p: _without_duration(summary.generate_summary(p)), f"{_SUMMARY_SQL} SELECT * FROM s"),
    "behavior_by_source_hour": packets(lambda p: summary.behavioral_summary(p, "1h", "source_ip"), _SENT),
    "behavior_by_source_minute": packets(
        lambda p: summary.behavioral_summary(p, "1m", "source_ip"),
        _behavior("IP_src", "IP_dst", "source_ip", "total_bytes_sent", "unique_dst_ip_count", "1 minute")),
    "behavior_by_destination_day": packets(
        lambda p: summary.behavioral_summary(p, "1d", "destination_ip"),
        _behavior("IP_dst", "IP_src", "destination_ip", "total_bytes_received", "unique_src_ip_count", "1 day")),
}

_BYTES = "CASE {1} ELSE format('{{:.2f}} PB', {0} / 1024.0 ** 5) END"
_STEPS = " ".join(f"WHEN v < 1024.0 ** {i + 1} THEN format('{{:.2f}} {u}', v / 1024.0 ** {i})"
                  for i, u in enumerate(("B", "KB", "MB", "GB", "TB")))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _flag_struct(p: DataFrame) -> DataFrame:
    return p.where("TCP_flags IS NOT NULL").select("TCP_flags", scalars.parse_tcp_flags(F.lower("TCP_flags")).alias("f")).select(
        "TCP_flags", *[F.col(f"f.{n}").alias(n) for n in lookups.TCP_FLAG_NAMES.values()]).groupBy(
        "TCP_flags", *lookups.TCP_FLAG_NAMES.values()).count()


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


_PARTS = ("CASE WHEN s < 60 THEN format('{:.2f}s', s) ELSE concat_ws(' ', "
          "CASE WHEN s >= 86400 THEN concat(CAST(floor(s / 86400) AS BIGINT), 'd') END, "
          "CASE WHEN s % 86400 >= 3600 THEN concat(CAST(floor(s % 86400 / 3600) AS BIGINT), 'h') END, "
          "CASE WHEN s % 3600 >= 60 THEN concat(CAST(floor(s % 3600 / 60) AS BIGINT), 'm') END, "
          "CASE WHEN s % 60 > 0 THEN format('{:.2f}s', s % 60) END) END")

SCALARS = {
    "fn_tcp_flags": packets(
        _flag_struct, "SELECT TCP_flags, " + ", ".join(
            f"contains(TCP_flags, '{x}') AS \"{n}\"" for x, n in lookups.TCP_FLAG_NAMES.items())
        + ", count(*) AS count FROM p WHERE TCP_flags IS NOT NULL GROUP BY ALL"),
    "fn_private_public": packets(
        lambda p: p.where("IP_dst IS NOT NULL").select(
            "IP_dst", addresses.is_private_ip(F.col("IP_dst")).alias("is_private"),
            addresses.is_public_ip(F.col("IP_dst")).alias("is_public")).distinct(),
        f"SELECT DISTINCT IP_dst, {sql_private('IP_dst')} AS is_private, NOT {sql_private('IP_dst')} AS is_public "
        "FROM p WHERE IP_dst IS NOT NULL"),
    "fn_text_entropy": tables(
        lambda spark, folder: _events(spark, folder).select("event_id", scalars.string_entropy(F.col("props")).alias("entropy")),
        "SELECT event_id, round(list_aggregate(string_split(props, ''), 'entropy'), 6) AS entropy FROM events"),
    "fn_column_entropy": packets(
        lambda p: scalars.column_entropy(p.where("IP_src IS NOT NULL"), "IP_dst", "IP_src"),
        "SELECT IP_src, round(entropy(IP_dst), 6) AS entropy FROM p WHERE IP_src IS NOT NULL GROUP BY 1"),
    "fn_format_bytes": tables(
        lambda spark, folder: _documents(spark, folder).select(
            "doc_id", scalars.format_bytes(F.col("n_chars") * F.col("n_chars") * 1000).alias("size")),
        "WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) * n_chars * 1000 AS v FROM documents) "
        f"SELECT doc_id, {_BYTES.format('v', _STEPS)} AS size FROM d"),
    "fn_format_duration": tables(
        lambda spark, folder: _documents(spark, folder).select(
            "doc_id", scalars.format_duration(F.col("n_chars") * 2.5).alias("duration")),
        f"WITH d AS (SELECT doc_id, n_chars * CAST(2.5 AS DOUBLE) AS s FROM documents) SELECT doc_id, {_PARTS} AS duration FROM d"),
    "fn_parse_timestamp": tables(
        lambda spark, folder: _events(spark, folder).select(
            "event_id", scalars.parse_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("from_text"),
            scalars.parse_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("from_iso"),
            scalars.parse_timestamp(F.date_format("ts", "yyyy-MM-dd")).alias("from_day"),
            scalars.parse_timestamp(F.col("event_id") * 1000.5, "number").alias("from_epoch")),
        "SELECT event_id, date_trunc('second', ts) AS from_text, date_trunc('second', ts) AS from_iso, "
        "CAST(date_trunc('day', ts) AS TIMESTAMP) AS from_day, "
        "make_timestamp(CAST(event_id * 1000500000 AS BIGINT)) AS from_epoch FROM events"),
    "fn_flow_id": packets(
        lambda p: p.where("IP_proto IS NOT NULL").select(scalars.create_flow_id(
            F.col("IP_src"), F.col("IP_dst"), F.coalesce("TCP_sport", "UDP_sport"), F.coalesce("TCP_dport", "UDP_dport"),
            lookups.protocol_name(F.col("IP_proto"))).alias("flow_id")).groupBy("flow_id").count(),
        "SELECT concat(IP_src, ':', coalesce(CAST(coalesce(TCP_sport, UDP_sport) AS VARCHAR), '*'), '->', IP_dst, ':', "
        "coalesce(CAST(coalesce(TCP_dport, UDP_dport) AS VARCHAR), '*'), ':', CASE IP_proto WHEN 6 THEN 'TCP' "
        "WHEN 17 THEN 'UDP' ELSE 'ICMP' END) AS flow_id, count(*) AS count FROM p WHERE IP_proto IS NOT NULL GROUP BY 1"),
    "fn_packet_rate": tables(
        lambda spark, folder: _events(spark, folder).select(
            "event_id", scalars.calculate_packet_rate(F.col("event_id"), F.col("value") - 5).alias("rate")),
        "SELECT event_id, CASE WHEN value > 5 THEN round(event_id / (value - 5), 6) ELSE 0.0 END AS rate FROM events"),
    "fn_classify_port": packets(
        lambda p: p.select(lookups.classify_port(F.coalesce("TCP_dport", "UDP_dport")).alias("port_class")).groupBy("port_class").count(),
        "SELECT CASE WHEN coalesce(TCP_dport, UDP_dport) < 1024 THEN 'well-known' WHEN coalesce(TCP_dport, UDP_dport) < 49152 "
        "THEN 'registered' WHEN coalesce(TCP_dport, UDP_dport) < 65536 THEN 'ephemeral' END AS port_class, count(*) AS count "
        "FROM p GROUP BY 1"),
    "fn_protocol_name": tables(
        lambda spark, folder: _events(spark, folder).select(
            "event_id", lookups.protocol_name((F.col("event_id") % 140).cast("int")).alias("name")),
        "SELECT event_id, CASE event_id % 140 WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' "
        "WHEN 41 THEN 'IPv6' WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH' WHEN 58 THEN 'ICMPv6' "
        "WHEN 89 THEN 'OSPF' WHEN 132 THEN 'SCTP' ELSE concat('Protocol-', event_id % 140) END AS name FROM events"),
    "fn_safe_casts": packets(
        lambda p: p.select(scalars.safe_cast_to_int(F.col("DNS_qname"), -7).alias("name_as_int"),
                           scalars.safe_cast_to_int(F.col("TCP_dport").cast("string"), -1).alias("port"),
                           scalars.safe_cast_to_str(F.col("IP_proto"), "none").alias("proto")).groupBy(
            "name_as_int", "port", "proto").count(),
        "SELECT CAST(coalesce(try_cast(DNS_qname AS BIGINT), -7) AS BIGINT) AS name_as_int, "
        "CAST(coalesce(TCP_dport, -1) AS BIGINT) AS port, coalesce(CAST(IP_proto AS VARCHAR), 'none') AS proto, "
        "count(*) AS count FROM p GROUP BY 1, 2, 3"),
    "fn_time_windows": packets(
        lambda p: _windows(p), "SELECT " + ", ".join(
            f"{bucket(w)} AS \"{n}\"" for n, w in (("w_500ms", "500 milliseconds"), ("w_90s", "90 seconds"),
                                                  ("w_7m", "7 minutes"), ("w_36h", "36 hours"))) + ", count(*) AS count "
        "FROM p GROUP BY ALL"),
}


def _windows(p: DataFrame) -> DataFrame:
    from wirelake.functions.windows import tumbling

    texts = {"w_500ms": "500ms", "w_90s": "1.5m", "w_7m": "7m", "w_36h": "1.5D"}
    for name, text in texts.items():
        p = p.withColumn(name, tumbling(text).start)
    return p.groupBy(*texts).count()


ENTRIES = SOURCES | FILTERS | SUMMARIES | SCALARS | SKETCHES
