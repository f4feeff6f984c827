"""Names of ports, codes and classes, and their lookup as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Service names shown for TCP ports.
TCP_SERVICES = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "TELNET", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3",
    143: "IMAP", 443: "HTTPS", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 8080: "HTTP-ALT",
}

# Service names shown for UDP ports.
UDP_SERVICES = {
    53: "DNS", 67: "DHCP-SERVER", 68: "DHCP-CLIENT", 69: "TFTP", 123: "NTP", 137: "NETBIOS-NS",
    138: "NETBIOS-DGM", 161: "SNMP", 162: "SNMP-TRAP", 500: "ISAKMP", 514: "SYSLOG", 520: "RIP",
    1900: "SSDP", 4500: "IPSec-NAT-T", 5353: "MDNS",
}

# UDP services that can amplify (DNS, NTP, SNMP, SSDP, mDNS).
AMPLIFIER_PORTS = (53, 123, 161, 1900, 5353)

# TCP flag letters and names.
TCP_FLAG_NAMES = {
    "F": "FIN", "S": "SYN", "R": "RST", "P": "PSH", "A": "ACK", "U": "URG", "E": "ECE", "C": "CWR",
}

# IP protocol numbers.
PROTOCOL_NAMES = {
    1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6",
    89: "OSPF", 132: "SCTP",
}

# DSCP classes.
DSCP_CLASSES = {0: "BE", 8: "CS1", 10: "AF11", 46: "EF"}

# DNS query types.
DNS_QUERY_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY",
}

# DNS response codes.
DNS_RESPONSE_CODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}

# ICMP message types.
ICMP_MESSAGE_TYPES = {
    0: "Echo Reply", 3: "Destination Unreachable", 4: "Source Quench", 5: "Redirect", 8: "Echo Request",
    9: "Router Advertisement", 10: "Router Solicitation", 11: "Time Exceeded", 12: "Parameter Problem",
    13: "Timestamp Request", 14: "Timestamp Reply", 15: "Information Request", 16: "Information Reply",
    17: "Address Mask Request", 18: "Address Mask Reply",
}


def lookup(key: Column, names: dict, default: Column | str) -> Column:
    """Name of `key` in a small fixed map, else `default`."""
    table = F.create_map(*[F.lit(x) for x in chain(*names.items())])
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(table, key.cast("int")), default)


def protocol_name(number: Column) -> Column:
    """'TCP' for 6 and so on; 'Protocol-n' for numbers without a name; null stays null."""
    return F.when(number.isNotNull(),
                  lookup(number, PROTOCOL_NAMES, F.concat(F.lit("Protocol-"), number.cast("string"))))


def classify_port(port: Column) -> Column:
    """well-known, registered, ephemeral or invalid; null stays null."""
    return (
        F.when(port.isNull(), F.lit(None).cast("string"))
        .when((port >= 0) & (port < 1024), "well-known")
        .when((port >= 1024) & (port < 49152), "registered")
        .when((port >= 49152) & (port < 65536), "ephemeral")
        .otherwise("invalid")
    )
