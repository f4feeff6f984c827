"""DNS statistics and detectors over packets with port 53 at either end.

Queries have DNS_qr 0, responses 1; a packet without the field (a bare TCP handshake, say) is neither. A response answers a query with the same transaction id, client,
server and client port; the first one within `horizon` counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelake.errors import positive
from wirelake.functions.lookups import DNS_QUERY_TYPES, lookup
from wirelake.functions.scalars import ratio, string_entropy
from wirelake.operators.filters import destination_ip, dns_packets, source_ip
from wirelake.operators.slices import compute_once, match_first, value_stats
from wirelake.schema import length_column, micros, optional, require

_MATCH_KEY = ("DNS_id", "client_ip", "server_ip", "client_port")


def _dns(packets: DataFrame) -> DataFrame:
    """DNS packets as (timestamp, src_ip, dst_ip, sport, dport, length, DNS_*)."""
    require(packets, "timestamp")
    port = lambda end: F.coalesce(optional(packets, f"UDP_{end}", "int"), optional(packets, f"TCP_{end}", "int"))
    return dns_packets(packets).select(
        "timestamp", source_ip(packets).alias("src_ip"), destination_ip(packets).alias("dst_ip"),
        port("sport").alias("sport"), port("dport").alias("dport"),
        (length_column(packets) if "IP_len" in packets.columns else F.lit(None).cast("bigint")).alias("length"),
        optional(packets, "DNS_id", "int").alias("DNS_id"), optional(packets, "DNS_qr", "int").alias("DNS_qr"),
        optional(packets, "DNS_rcode", "int").alias("DNS_rcode"),
        optional(packets, "DNS_qname", "string").alias("DNS_qname"),
        optional(packets, "DNS_qtype", "int").alias("DNS_qtype"))


def _queries(packets: DataFrame) -> DataFrame:
    return _dns(packets).where(F.col("DNS_qr") == 0)


def _matched(packets: DataFrame, horizon: str) -> DataFrame:
    """One row per query, with struct `_reply` of its first response or null."""
    dns = _dns(packets).where(F.col("DNS_qr").isin(0, 1)).withColumn("_is_reply", F.col("DNS_qr") == 1)
    side = lambda request, reply: F.when(F.col("_is_reply"), F.col(reply)).otherwise(F.col(request))
    rows = dns.select(
        "timestamp", "_is_reply", "DNS_id", "DNS_qname", "DNS_rcode", "length", micros(dns).alias("_us"),
        side("src_ip", "dst_ip").alias("client_ip"), side("dst_ip", "src_ip").alias("server_ip"),
        side("sport", "dport").alias("client_port"))
    return match_first(rows, _MATCH_KEY, ["timestamp", "DNS_qname", "length"], ["DNS_rcode", "length"], horizon)


def get_top_queries(packets: DataFrame, n: int = 20) -> DataFrame:
    positive("n", n)
    return get_queried_domains_list(packets).limit(n)


def get_queried_domains_list(packets: DataFrame) -> DataFrame:
    """Distinct query names by number of queries."""
    return (
        _queries(packets).where(F.col("DNS_qname").isNotNull()).groupBy("DNS_qname")
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "DNS_qname")
    )


def get_query_response_ratio(packets: DataFrame) -> DataFrame:
    """Queries, responses, and responses per query."""
    counts = _dns(packets).agg(F.count_if(F.col("DNS_qr") == 0).alias("queries"),
                               F.count_if(F.col("DNS_qr") == 1).alias("responses"))
    return counts.withColumn("ratio", ratio(F.col("responses"), F.col("queries")))


def get_response_time_stats(packets: DataFrame, horizon: str = "5s") -> DataFrame:
    """Time from query to first response in ms: matched pairs, min, max, avg, median, p95, p99."""
    waits = F.col("_reply._us") - F.col("_us")
    stats = value_stats(_matched(packets, horizon), waits,
                        {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, scale=1000.0)
    return stats.select(F.col("count").alias("matched"), F.col("min").alias("min_ms"), F.col("max").alias("max_ms"),
                        F.col("avg").alias("avg_ms"), "median_ms", "p95_ms", "p99_ms")


def get_top_querying_ips(packets: DataFrame, n: int = 10) -> DataFrame:
    positive("n", n)
    return (
        _queries(packets).where(F.col("src_ip").isNotNull()).groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "src_ip").limit(n)
    )


def get_failed_queries(packets: DataFrame, horizon: str = "5s") -> DataFrame:
    """Queries without a response, or answered NXDOMAIN or SERVFAIL."""
    reason = (F.when(F.col("_reply").isNull(), "NO_RESPONSE").when(F.col("_reply.DNS_rcode") == 3, "NXDOMAIN")
              .when(F.col("_reply.DNS_rcode") == 2, "SERVFAIL"))
    return (
        _matched(packets, horizon).withColumn("reason", reason).where(F.col("reason").isNotNull())
        .select("timestamp", "client_ip", "server_ip", "DNS_id", "DNS_qname", "reason")
    )


def detect_dns_tunneling(packets: DataFrame, length_threshold: int = 100, min_entropy: float | None = None) -> DataFrame:
    """Queries with a name longer than the threshold (or, when `min_entropy` is given, at least that random)."""
    positive("length_threshold", length_threshold)
    size = F.length("DNS_qname")
    flagged = size > length_threshold
    queries = _queries(packets)
    if min_entropy is None:
        queries = queries.where(flagged)
    queries = compute_once(queries, "_entropy", string_entropy(F.col("DNS_qname")))
    if min_entropy is not None:
        queries = queries.where(flagged | (F.col("_entropy") >= min_entropy))
    return queries.select(
        "timestamp", F.col("src_ip").alias("IP_src"), F.col("dst_ip").alias("IP_dst"), "DNS_qname",
        size.alias("query_length"), F.col("_entropy").alias("entropy"),
        F.coalesce(F.col("DNS_qtype") == 16, F.lit(False)).alias("is_txt"))


def detect_dns_amplification(packets: DataFrame, min_ratio: float = 10.0, horizon: str = "5s") -> DataFrame:
    """Answered queries whose response is more than `min_ratio` times as large."""
    require(packets, "IP_len")
    return (
        _matched(packets, horizon).where(F.col("_reply").isNotNull())
        .select("timestamp", "client_ip", "server_ip", "DNS_qname", F.col("length").alias("request_bytes"),
                F.col("_reply.length").alias("response_bytes"))
        .withColumn("amplification_ratio", F.try_divide("response_bytes", "request_bytes"))
        .where(F.col("amplification_ratio") > min_ratio)
    )


def detect_excessive_nxdomain(packets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Clients whose share of NXDOMAIN responses is above the threshold."""
    return (
        _dns(packets).where(F.col("DNS_qr") == 1).groupBy(F.col("dst_ip").alias("client_ip"))
        .agg(F.count(F.lit(1)).alias("responses"), F.count_if(F.col("DNS_rcode") == 3).alias("nxdomain"))
        .withColumn("nxdomain_ratio", ratio(F.col("nxdomain"), F.col("responses")))
        .where(F.col("nxdomain_ratio") > threshold).orderBy(F.desc("nxdomain_ratio"), "client_ip")
    )


def identify_dga_domains(packets: DataFrame, min_entropy: float = 3.5, min_label: int = 12,
                         failing_rate: float = 0.5, failing_entropy: float = 3.0) -> DataFrame:
    """Names that look generated: a long random label, or a fairly random one that mostly fails to resolve.

    Figures are of the longest label (the first such), computed once per distinct name.
    """
    names = (
        _dns(packets).where(F.col("DNS_qname").isNotNull()).groupBy(F.col("DNS_qname").alias("domain"))
        .agg(F.count_if(F.col("DNS_qr") == 0).alias("queries"),
             F.count_if(F.col("DNS_qr") == 1).alias("_responses"),
             F.count_if((F.col("DNS_qr") == 1) & (F.col("DNS_rcode") == 3)).alias("_nx"))
    )
    longest = F.aggregate(F.split("domain", r"\."), F.lit(""),
                          lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    names = compute_once(compute_once(names, "_label", longest), "entropy", string_entropy(F.col("_label")))
    size = F.length("_label")
    digits = size - F.length(F.translate("_label", "0123456789", ""))
    return (
        names.select("domain", size.alias("label_length"), "entropy", ratio(digits, size).alias("digit_ratio"), "queries",
                     ratio(F.col("_nx"), F.col("_responses")).alias("nxdomain_rate"))
        .where(((F.col("entropy") >= min_entropy) & (F.col("label_length") >= min_label))
               | ((F.col("nxdomain_rate") > failing_rate) & (F.col("entropy") >= failing_entropy)))
        .orderBy(F.desc("entropy"), "domain")
    )


def get_query_type_distribution(packets: DataFrame) -> DataFrame:
    """Queries per type, with its name."""
    return (
        _queries(packets).where(F.col("DNS_qtype").isNotNull()).groupBy("DNS_qtype")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("DNS_qtype", lookup(F.col("DNS_qtype"), DNS_QUERY_TYPES,
                                    F.concat(F.lit("TYPE"), F.col("DNS_qtype").cast("string"))).alias("type_name"), "count")
        .orderBy(F.desc("count"), "DNS_qtype")
    )
