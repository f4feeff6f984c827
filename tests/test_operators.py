"""Hand-computed results on literal frames."""

from datetime import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wirelake import errors
from wirelake.operators import anomaly, arp, dns, filters, flow, icmp, ip, summary, tcp, udp


def test_tcp_counts(tcp_frame):
    assert tcp.get_connection_success_ratio(tcp_frame).first()[0] == 0.5
    counts = [f(tcp_frame).first()[0] for f in (tcp.get_syn_count, tcp.get_rst_count, tcp.get_fin_count, tcp.get_ack_count,
                                                tcp.get_psh_count)]
    assert counts == [4, 1, 1, 4, 0]
    row = tcp.get_handshake_analysis(tcp_frame).first()
    assert tuple(row) == (3, 1, 1, 1, 2)
    shares = {r.flag: (r["count"], r.percentage) for r in tcp.get_flag_distribution(tcp_frame).collect()}
    assert shares["SYN"] == (4, 50.0) and shares["CWR"] == (0, 0.0) and len(shares) == 8


def test_tcp_connections(tcp_frame):
    rows = tcp.detect_incomplete_connections(tcp_frame).collect()
    assert [(r.IP_src, r.syn_count, r.fin_count) for r in rows] == [("192.168.1.101", 2, 0), ("1.1.1.1", 1, 0)]
    assert tuple(tcp.get_connection_duration_stats(tcp_frame).first()) == (10.0, 10.0, 10.0, 10.0)  # 10.9 s, whole
    assert [r.duration_s for r in tcp.identify_long_lived_connections(tcp_frame, "10s").collect()] == [10.9]
    assert [r.duration_s for r in tcp.identify_short_lived_connections(tcp_frame, "2s").collect()] == [0.0, 0.0]
    assert [(r.TCP_seq, r.seq_count) for r in tcp.detect_retransmissions(tcp_frame).collect()] == [(5, 2)]
    rows = tcp.get_throughput_by_connection(tcp_frame).collect()
    assert [(r.total_bytes, round(r.bytes_per_sec, 6)) for r in rows] == [(160, round(160 / 3, 6)), (164, round(164 / 10.9, 6))]
    rows = {r.TCP_sport: r for r in tcp.flag_text(tcp.analyze_flag_sequences(tcp_frame)).collect()}
    assert (rows[50000].flag_sequence, rows[50000].packet_count, rows[50001].flag_sequence) == ("S A FA", 3, "S S")
    row = tcp.get_window_size_stats(tcp_frame).first()
    assert (row["min"], row["max"], row["median"]) == (0, 500, 300.0)
    assert tcp.get_window_size_stats(tcp_frame.where("TCP_window is null")).count() == 0
    assert tcp.get_connection_duration_stats(tcp_frame.where("TCP_flags = 'S'")).count() == 0


def test_tcp_ports(tcp_frame):
    rows = [(r.TCP_dport, r.service_name, r["count"], r.percentage) for r in tcp.get_most_used_ports(tcp_frame, 2).collect()]
    assert rows == [(80, "HTTP", 3, 37.5), (443, "HTTPS", 3, 37.5)]
    row = tcp.get_ephemeral_vs_wellknown_ratio(tcp_frame).first()
    assert (row.well_known, row.registered, row.ephemeral, row.total) == (6, 0, 2, 8)
    assert tcp.detect_non_standard_ports(tcp_frame, 0).count() == 2


def test_scan_severity_and_profiles(spark):
    rows = [(at(i), "10.0.0.50", f"1.1.1.{h}", 6, 1, p) for h, n in ((1, 60), (2, 40), (3, 21), (4, 20)) for i, p in enumerate(range(n))]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, TCP_sport int, TCP_dport int")
    found = {r.target_ip: (r.unique_ports, r.severity) for r in tcp.detect_port_scanning(frame, ports_contacted=False).collect()}
    assert found == {"1.1.1.1": (60, "critical"), "1.1.1.2": (40, "high"), "1.1.1.3": (21, "medium")}
    assert tcp.custom_scan_config(9, "1m").sensitivity == "very_high" and tcp.custom_scan_config(30, "1m").sensitivity == "low"
    assert tcp.detect_port_scanning(frame, "honeypot", ports_contacted=False).count() == 4
    assert anomaly.detect_port_scanning(frame, threshold=59, time_window="5m").count() == 60  # a row per port
    assert anomaly.detect_port_scanning(frame, time_window="5m").count() == 0  # custom default: 100 ports


def _udp(spark, rows):
    return spark.createDataFrame([(at(t), s, d, 17, n, sp, dp) for t, s, d, n, sp, dp in rows],
                                 "timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, IP_len int, UDP_sport int, UDP_dport int")


def test_udp(spark):
    frame = _udp(spark, [(0, "a", "r", 60, 5000, 123), (1.9, "r", "a", 900, 123, 5000), (2, "b", "r", 60, 6000, 53),
                         (3, "c", "c", 60, 7, 7), (4, "d", "r", None, None, 53)])
    rows = udp.detect_unidirectional_traffic(frame).collect()
    assert [(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.packet_count, r.total_bytes) for r in rows] == [("b", "r", 6000, 53, 1, 60)]
    rows = udp.detect_udp_amplification(frame).collect()
    assert [(r.victim_ip, r.reflector_ip, r.service_port, r.amplification_ratio) for r in rows] == [("a", "r", 123, 15.0)]
    flows = {r.flow_id: r for r in udp.get_udp_flow_stats(frame).collect()}
    assert flows["d:0->r:53:UDP"].total_bytes == 0
    ports = [(r.port, r["count"], r.unique_sources, r.port_name, r.port_class) for r in udp.get_most_used_ports(frame, 1).collect()]
    assert ports == [(53, 2, 2, "DNS", "well-known")]
    assert udp.detect_udp_flood(frame, 2, "1m").count() == 0 and udp.detect_udp_flood(frame, 1, "1m").count() == 5
    row = udp.calculate_packet_rate(frame, "1m").first()
    assert (row.packet_count, row.byte_count, row.packets_per_second) == (5, 1080, 5 / 60)
    assert [r.src_ip for r in udp.identify_udp_scan(frame, 1).collect()] == ["a", "b", "c", "d", "r"]


def test_ip_hosts(spark):
    rows = [(at(0), "10.0.0.1", "8.8.8.8", 6, 100), (at(1), "10.0.0.1", "8.8.8.8", 6, 100), (at(2), "8.8.8.8", "10.0.0.1", 6, 50),
            (at(3), "10.0.0.2", "10.0.0.1", 17, 10), (at(4), None, None, None, None)]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, IP_len int")
    top = ip.get_most_active_ips(frame, 1).first()
    assert (top.ip_address, top.packets_sent, top.packets_received, top.total_bytes) == ("10.0.0.1", 2, 2, 260)
    assert [r.ip_address for r in ip.get_sender_only_ips(frame).collect()] == ["10.0.0.2"]
    assert ip.get_receiver_only_ips(frame).count() == 0
    assert [(r.ip_address, r.send_ratio) for r in ip.get_asymmetric_ips(frame, 0.9).collect()] == [("10.0.0.2", 1.0)]
    assert {r.direction: r.packets for r in ip.get_internal_vs_external_ratio(frame).collect()} == {"outbound": 2, "inbound": 1, "internal": 1}
    assert (ip.get_border_traffic(frame).count(), ip.get_lateral_traffic(frame).count()) == (3, 1)
    assert [(r.ip_address, r.unique_peers) for r in ip.detect_hub_ips(frame, 2).collect()] == [("10.0.0.1", 2)]
    row = anomaly.detect_data_exfiltration(frame, 100).first()
    assert (row.src_ip, row.outbound_bytes, row.unique_destinations) == ("10.0.0.1", 200, 1)
    sent, received = (sum(r[c] for r in ip._host_totals(frame).collect()) for c in ("packets_sent", "packets_received"))
    assert sent == received == 4


def test_ipv6_addresses_are_used_per_row(spark):
    frame = spark.createDataFrame([("1.1.1.1", None, "2.2.2.2", None, 10), (None, "fe80::1", None, "2001:db8::2", 20)],
                                  "IP_src string, IPv6_src string, IP_dst string, IPv6_dst string, IP_len int")
    rows = {r.source_ip: r.destination_ip for r in ip.get_communication_matrix(frame).collect()}
    assert rows == {"1.1.1.1": "2.2.2.2", "fe80::1": "2001:db8::2"}


def test_icmp_attacks_without_fixture(spark):
    schema = ("timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, IP_len int, IP_flags string, IP_frag int, "
              "IP_id int, IP_ihl int, ICMP_type int, ICMP_data binary")
    rows = [(at(0), "v", "10.0.0.255", 1, 28, "DF", 0, 1, 5, 8, None), (at(1), "x", "v", 1, 28, "DF", 0, 2, 5, 0, None),
            (at(2), "y", "v", 1, 28, "DF", 0, 3, 5, 0, None), (at(3), "e", "v", 1, 1500, "MF", 0, 9, 5, 8, None),
            (at(3), "e", "v", 1, 1500, "", 8189, 9, 5, 8, None), (at(4), "t", "u", 1, 60, "DF", 0, 4, 5, 8, bytearray(200))]
    frame = spark.createDataFrame(rows, schema)
    row = icmp.detect_smurf_attack(frame).first()
    assert (row.src_ip, row.broadcast_ip, row.requests, row.replies) == ("v", "10.0.0.255", 1, 2)
    row = icmp.detect_ping_of_death(frame).first()
    assert (row.src_ip, row.fragments, row.reassembled_size) == ("e", 2, 8189 * 8 + 1480)
    assert {(r.src_ip, r.max_payload) for r in icmp.detect_icmp_tunneling(frame).collect()} == {("e", 1472), ("t", 200)}


def test_land_attack(spark):
    frame = spark.createDataFrame([(at(0), "a", "a", 5, 5), (at(1), "a", "a", 5, 6), (at(2), "a", "b", 5, 5)],
                                  "timestamp timestamp_ntz, IP_src string, IP_dst string, TCP_sport int, TCP_dport int")
    assert sorted(r.same_port for r in anomaly.detect_land_attack(frame).collect()) == [False, True]


def test_arp(spark):
    rows = [(at(0), 1, "1.1.1.1", "aa", "00:00:00:00:00:00", "1.1.1.2"), (at(1), 2, "1.1.1.2", "bb", "aa", "1.1.1.1"),
            (at(2), 2, "1.1.1.1", "cc", "ff:ff:ff:ff:ff:ff", "1.1.1.1"), (at(3), 1, "1.1.1.1", "cc", None, "1.1.1.3")]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, ARP_opcode int, ARP_sender_ip string, ARP_sender_mac string, "
                                        "ARP_target_mac string, ARP_target_ip string")
    assert {(r.ip_address, r.mac_address): r.observations for r in arp.get_arp_table(frame).collect()} == {
        ("1.1.1.1", "aa"): 2, ("1.1.1.2", "bb"): 1, ("1.1.1.1", "cc"): 2}
    changes = arp.detect_arp_spoofing(frame).collect()
    assert [(r.old_mac, r.new_mac, r.changed_at, r.is_gratuitous) for r in changes] == [("aa", "cc", at(2), True)]
    assert sorted(r.mac_address for r in arp.get_duplicate_ips(frame).collect()) == ["aa", "cc"] and arp.get_duplicate_macs(frame).count() == 0
    row = arp.detect_arp_scanning(frame, 2).first()
    assert (row.sender_ip, row.requests, row.unique_targets, row.sequential_share) == ("1.1.1.1", 2, 2, 1.0)
    assert arp.detect_gratuitous_arp_flood(frame, 1).count() == 0


def test_flow_directions(spark):
    rows = [(at(0), "b", "a", 6, 10, 2, 1), (at(1), "a", "b", 6, 20, 1, 2), (at(2), "c", "d", 6, 5, 1, 1)]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, IP_len int, TCP_sport int, TCP_dport int")
    got = {r.ip_a: tuple(r)[5:] for r in flow.get_bidirectional_flow_stats(frame).collect()}
    assert got == {"b": (1, 1, 10, 20, False), "c": (1, 0, 5, 0, True)}
    assert flow.get_flow_by_id(frame, "a:1->b:2:TCP").count() == 1


def test_bursts_and_hours(spark):
    rows = [(at(60 * m), "a", "b", 1) for m in range(30)] + [(at(60 * 40), "a", "b", 1)] * 50
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, IP_src string, IP_dst string, IP_len int")
    assert [r.packets for r in anomaly.detect_traffic_bursts(frame).collect()] == [50]
    assert anomaly.detect_off_hours_activity(frame, (9, 17)).count() == 0  # 12:00 to 12:40
    assert anomaly.detect_off_hours_activity(frame, (time(12, 30), time(17))).first().packets == 30


def test_behavior_features_follow_columns(spark, tcp_frame):
    got = summary.behavioral_summary(tcp_frame.drop("TCP_flags"), "1m")
    assert "syn_count" not in got.columns and "unique_udp_dst_port_count" not in got.columns
    row = {r.source_ip: r for r in summary.behavioral_summary(tcp_frame, "1m").collect()}["192.168.1.101"]
    assert (row.packet_count, row.total_bytes_sent, row.unique_dst_ip_count, row.unique_tcp_dst_port_count, row.syn_count,
            row.udp_packet_count) == (4, 250, 1, 1, 2, 1)


def test_views_without_their_columns(spark):
    frame = spark.createDataFrame([("a",)], "IP_src string")
    assert [f(frame).count() for f in (filters.icmp_packets, filters.arp_packets, filters.dns_packets)] == [0, 0, 0]
    with pytest.raises(errors.MissingColumnError):
        filters.tcp_packets(frame)
    with pytest.raises(errors.EmptyTableError):
        filters.check_rows(filters.arp_packets(frame), "ARP")
    row = summary.get_analyzers_available(frame).first()
    assert not row.tcp and not row.arp and row.ip
    assert tuple(summary.get_date_range(frame).first()) == (None, None, None)


def test_ipv6_protocols_on_request(spark):
    frame = spark.createDataFrame([(6, None), (None, 6), (None, 58)], "IP_proto int, IPv6_nh int")
    assert (filters.tcp_packets(frame).count(), filters.tcp_packets(frame, True).count()) == (1, 2)
    assert filters.icmp_packets(frame, True).count() == 1


def test_bad_arguments(tcp_frame):
    bad = errors.InvalidThresholdError
    for call in (lambda: udp.get_most_used_ports(tcp_frame, 0), lambda: udp.detect_udp_flood(tcp_frame, -1),
                 lambda: udp.detect_udp_amplification(tcp_frame, 1.0), lambda: ip.get_asymmetric_ips(tcp_frame, 1.5),
                 lambda: anomaly.detect_syn_flood(tcp_frame, 0), lambda: tcp.detect_port_scanning(tcp_frame, threshold=0)):
        with pytest.raises((bad, errors.MissingColumnError)):
            call()
    for call in (lambda: filters.get_by_protocol(tcp_frame, "FTP"), lambda: ip.get_most_active_ips(tcp_frame, 5, "size"),
                 lambda: summary.behavioral_summary(tcp_frame, "1m", "port"), lambda: tcp.detect_port_scanning(tcp_frame, "loud"),
                 lambda: flow.calculate_inter_arrival_times(tcp_frame, "port"), lambda: flow.get_flow_by_id(tcp_frame, "x"),
                 lambda: summary.export_summary_report(tcp_frame, "xml", "/tmp/x"),
                 lambda: anomaly.detect_off_hours_activity(tcp_frame, ("nine", 17))):
        with pytest.raises(errors.InvalidValueError):
            call()
    with pytest.raises(errors.InvalidTimeWindowError):
        tcp.identify_long_lived_connections(tcp_frame, "5 minutes")
    with pytest.raises(errors.MissingColumnError):
        dns.get_top_queries(tcp_frame.drop("timestamp"))
    assert filters.sample(tcp_frame, 3, seed=1).count() == 3 and filters.sample(tcp_frame, 99).count() == 9
    assert filters.find_ip_information(tcp_frame.drop("IP_src", "IP_dst"), "x").count() == 0
    assert filters.get_by_protocol(tcp_frame.withColumn("IPv6_src", F.lit("x")), "IP").columns[-1] == "IPv6_src"


def test_sketches_of_days_merge(spark, tmp_path):
    from wirelake.operators import sketches

    frame = spark.range(20_000).selectExpr(
        "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 10 as int), 0, 0, id % 1000) as timestamp", "concat('10.0.', id % 40, '.', id % 50) as IP_src",
        "if(id % 7 = 0, null, concat('11.0.0.', id % 90)) as IP_dst", "cast(id % 2000 as int) as TCP_dport", "id % 1500 as IP_len")
    path = str(tmp_path / "days")
    for part in ("id", "timestamp < timestamp_ntz'2024-01-05'"):  # the second time only some days are written again
        sketches.store_sketches(frame if part == "id" else frame.where(part), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 10
    row = sketches.report(stored, "month", (0.5, 0.9)).head()
    hosts = frame.selectExpr("explode(array(IP_src, IP_dst)) as h").where("h is not null").distinct().count()
    pairs = frame.where("IP_dst is not null").select("IP_src", "IP_dst").distinct().count()
    assert row.packets == 20_000 and row.bytes == frame.agg({"IP_len": "sum"}).head()[0]
    assert all(abs(got - want) <= 0.05 * want for got, want in ((row.hosts, hosts), (row.pairs, pairs), (row.ports, 2000)))
    assert abs(row["size_p50"] - 750) <= 30 and abs(row["size_p90"] - 1350) <= 30
    assert sketches.report(stored, "day").count() == 10 and sketches.report(stored.limit(0)).count() == 0
