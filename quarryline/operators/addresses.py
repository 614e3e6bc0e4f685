"""Which addresses and hosts may be fetched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Networks that are never safe; IPv4 networks that are safe only where private ones are allowed (private, loopback,
# link-local, multicast, reserved), and the addresses inside them that are public.
NEVER = ["169.254.169.254/32", "100.100.100.200/32", "0.0.0.0/8"]
PRIVATE = [
    "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
PUBLIC = ["192.0.0.9/32", "192.0.0.10/32"]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number, else null. Octets have no leading zeros."""
    octets = F.split(ip, r"\.")
    number = sum((F.get(octets, F.lit(i)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(ip.rlike(IPV4), number)


def _inside(number: Column, nets: list[str]) -> Column:
    test = F.lit(False)
    for net in nets:
        base, bits = net.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        test = test | number.between(low, low + (1 << (32 - int(bits))) - 1)
    return test


@F.pandas_udf(IntegerType())
def _ipv6_class(ip: pd.Series) -> pd.Series:
    """0 for an IPv6 address that is public, 1 for others, null for what is no such address."""
    import ipaddress

    def kind(x):
        try:
            a = ipaddress.IPv6Address(x)
        except ValueError:
            return None
        return int(a.is_loopback or a.is_private or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified)

    return ip.map(kind, na_action="ignore").astype("Int32")


def ip_safe(ip: Column, allow_private: Column) -> Column:
    """Whether an address may be fetched; what is no address may not. Only IPv6 addresses reach Python."""
    n = ip_number(ip)
    four = ~_inside(n, NEVER) & (allow_private | ~_inside(n, PRIVATE) | _inside(n, PUBLIC))
    six = _ipv6_class(F.when(F.instr(ip, ":") > 0, ip))
    return F.when(n.isNotNull(), four).otherwise(F.coalesce((six == 0) | (six.isNotNull() & allow_private), F.lit(False)))


def host_safe(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """host, allow_private, safe of hosts (host, allow_private): an address as it is; a name if it resolved (dns: host, ip) and each of its addresses is safe."""
    literal = F.when(F.col("host").rlike(IPV4) | (F.instr("host", ":") > 0), F.col("host"))
    asked = hosts.distinct().join(dns.select("host", F.col("ip").alias("found")).distinct(), "host", "left")
    asked = asked.select("host", "allow_private", F.coalesce(literal, F.col("found")).alias("ip"))
    each = asked.withColumn("ok", ip_safe(F.col("ip"), F.col("allow_private")))
    return each.groupBy("host", "allow_private").agg(F.bool_and("ok").alias("safe"))
