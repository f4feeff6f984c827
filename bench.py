"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

The packet view is landed once as parquet (timed as `land_packets`); every other query reads that table, the way
the published single-node figures were taken from a parquet file. Results go to the noop sink, so all rows are
computed. Each query runs twice and the second run counts, since the first one compiles its code.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wirelake.operators import anomaly, arp, dns, flow, icmp, ip, summary, tcp, udp  # noqa: E402
from wirelake.plans import workflows  # noqa: E402
from wirelake.plans.findings import Report  # noqa: E402
from wirelake.session import local_session  # noqa: E402
from wirelake.sources import parquet  # noqa: E402
from wirelake.sources.events_view import packets_from_folder  # noqa: E402

QUERIES = {
    "tcp_handshake": tcp.get_handshake_analysis,
    "tcp_flag_distribution": tcp.get_flag_distribution,
    "tcp_incomplete": tcp.detect_incomplete_connections,
    "tcp_durations": tcp.get_connection_duration_stats,
    "tcp_port_scans": tcp.detect_port_scanning,
    "tcp_flag_sequences": tcp.analyze_flag_sequences,
    "tcp_throughput": tcp.get_throughput_by_connection,
    "udp_unidirectional": udp.detect_unidirectional_traffic,
    "udp_amplification": udp.detect_udp_amplification,
    "ip_most_active": ip.get_most_active_ips,
    "ip_hubs": lambda p: ip.detect_hub_ips(p, 20),
    "ip_border_traffic": ip.get_border_traffic,
    "dns_response_times": dns.get_response_time_stats,
    "dns_failed": dns.get_failed_queries,
    "dns_tunneling": dns.detect_dns_tunneling,
    "dns_dga": dns.identify_dga_domains,
    "icmp_tunneling": icmp.detect_icmp_tunneling,
    "arp_spoofing": arp.detect_arp_spoofing,
    "flow_sessions": lambda p: flow.create_flows(p, "protocol"),
    "flow_beacons": flow.detect_beacon_behavior,
    "flow_inter_arrival": flow.calculate_inter_arrival_times,
    "flow_periodic": flow.detect_periodic_patterns,
    "syn_flood": lambda p: anomaly.detect_syn_flood(p, 2),
    "data_exfiltration": lambda p: anomaly.detect_data_exfiltration(p, 2000),
    "behavior_by_hour": lambda p: summary.behavioral_summary(p, "1h"),
    "summary": summary.generate_summary,
    "daily_audit": lambda p: workflows.daily_audit(p),
}


def run(df) -> float:
    """Seconds to compute all rows of a query; a report gathers its facts and builds its checks when it runs."""
    began = time.perf_counter()
    df = df.run() if isinstance(df, Report) else df
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    path = tempfile.mkdtemp(prefix="wirelake-bench-") + "/packets"
    source = packets_from_folder(spark, folder)
    run(source.limit(1000))
    began = time.perf_counter()
    parquet.save_packets(source, path)
    times = {"land_packets": time.perf_counter() - began}
    packets = parquet.load_packets(spark, path)
    n = packets.count()
    wanted = sys.argv[1:]
    for name, build in QUERIES.items():
        if wanted and name not in wanted:
            continue
        run(build(packets))
        times[name] = run(build(packets))
    total = sum(times.values())
    print(json.dumps({
        "metric": "total seconds of all headline queries", "value": round(total, 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()}, "sf": os.path.basename(folder.rstrip("/")),
        "packets": n, "packets_per_second": {k: round(n / v) for k, v in times.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
