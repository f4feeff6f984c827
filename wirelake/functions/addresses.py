"""IP address tests as Column expressions (no Python runs per row).

IPv4 text becomes a BIGINT. IPv6 text becomes 32 hex digits, which compare like the number they spell.
Text that is not an address gives null.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

# Networks counted as private, and the public holes inside them.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_HOLES_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
)
PUBLIC_HOLES_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)

_OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_ZEROS_FFFF = "0" * 20 + "ffff"  # start of an IPv4-mapped IPv6 address


def _digits_pattern(cidr: str) -> str:
    """Pattern of the leading hex digits of all addresses of a network."""
    net = ipaddress.ip_network(cidr)
    digits = f"{int(net.network_address):0{net.max_prefixlen // 4}x}"
    whole, rest = divmod(net.prefixlen, 4)
    if not rest:
        return digits[:whole]
    first = int(digits[whole], 16)
    return digits[:whole] + "[" + "".join(f"{d:x}" for d in range(first, first + (1 << (4 - rest)))) + "]"


def _dotted_pattern(cidr: str) -> str:
    """Pattern of the leading octets of all addresses of an IPv4 network, as dotted text."""
    net = ipaddress.ip_network(cidr)
    low, high = net.network_address.packed, net.broadcast_address.packed
    octets = ["(?:" + "|".join(str(n) for n in range(a, b + 1)) + ")" if (a, b) != (0, 255) else None
              for a, b in zip(low, high)]
    fixed = [o for o in octets if o is not None]
    return r"\.".join(fixed) + (r"\." if len(fixed) < 4 else "$")


def _one_of(patterns, holes) -> str:
    return "^(?!" + "|".join(holes) + ")(?:" + "|".join(patterns) + ")"


_PRIVATE_DOTTED = _one_of(map(_dotted_pattern, PRIVATE_V4), map(_dotted_pattern, PUBLIC_HOLES_V4))
_PRIVATE_MAPPED = _one_of(map(_digits_pattern, PRIVATE_V4), map(_digits_pattern, PUBLIC_HOLES_V4)).lstrip("^")
_PRIVATE_DIGITS = _one_of([*map(_digits_pattern, PRIVATE_V6), _ZEROS_FFFF + _PRIVATE_MAPPED],
                          map(_digits_pattern, PUBLIC_HOLES_V6))


def ipv4_long(ip: Column) -> Column:
    """Dotted IPv4 text as BIGINT, else null."""
    part = F.split(ip, r"\.")
    number = sum((part[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(ip.rlike(_V4), number)


# Eight groups; or '::' once, standing for at least one group, and no single colon at an end.
_EIGHT = r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"
_SHORT = (r"(?=.*::)(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)(?!(?:[^0-9a-f]*[0-9a-f]+(?![0-9a-f])){8})"
          r"(?:[0-9a-f]{1,4}(?![0-9a-f])|:)+")


def _bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text as 32 lower-case hex digits, else null. A zone suffix (%eth0) is ignored."""
    def dotted_tail(text):
        tail = ipv4_long(F.substring_index(text, ":", -1))
        groups = F.lower(F.regexp_replace(F.lpad(F.hex(tail), 8, "0"), "^(.{4})", "$1:"))
        return F.when(text.contains("."), F.concat(F.regexp_replace(text, r"[\d.]+$", ""), groups)).otherwise(text)

    def digits(text):
        missing = 8 - F.regexp_count(text, F.lit("[0-9a-f]+"))
        filled = F.replace(text, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), missing)))
        for zeros in (1, 2, 3):
            filled = F.regexp_replace(filled, f"(?<![0-9a-f])([0-9a-f]{{{4 - zeros}}})(?![0-9a-f])", "0" * zeros + "$1")
        return F.when(text.rlike(f"^(?:{_EIGHT}|{_SHORT})$"), F.replace(filled, F.lit(":"), F.lit("")))

    plain = F.lower(F.regexp_replace(ip, "%.+$", ""))
    return F.when(ip.contains(":"), _bind(_bind(plain, dotted_tail), digits))


def is_private_ip(ip: Column) -> Column:
    """True / false for an address, null for anything else. IPv4-mapped IPv6 follows its IPv4 address.

    Each family is one pattern match on the address text or digits.
    """
    return F.when(ip.rlike(_V4), ip.rlike(_PRIVATE_DOTTED)).otherwise(ipv6_hex(ip).rlike(_PRIVATE_DIGITS))


def is_public_ip(ip: Column) -> Column:
    """Not private; false for text that is not an address."""
    return F.coalesce(~is_private_ip(ip), F.lit(False))


def in_subnet(ip: Column, cidr: str) -> Column:
    """Whether the address lies in `cidr`; null for text that is not an address."""
    net = ipaddress.ip_network(cidr, strict=False)
    is_v4 = ip.rlike(_V4)
    if net.version == 4:
        inside = ip.rlike("^" + _dotted_pattern(str(net))) if net.prefixlen else F.lit(True)
        return F.when(is_v4, inside).when(ipv6_hex(ip).isNotNull(), F.lit(False))
    return F.when(is_v4, F.lit(False)).otherwise(ipv6_hex(ip).rlike("^" + _digits_pattern(str(net))))
