"""Addresses as binary of 4 or 16 bytes: text forms, CIDR ranges, flow keys and Community IDs.

Spark compares binary bytewise unsigned, so order of addresses and ranges of networks need no decoding.
"""

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import ICMP_ANSWERS, ICMPV6_ANSWERS, lookup

TCP, UDP, SCTP, ICMP, ICMPV6 = 6, 17, 132, 1, 58


def from_number(number: Column) -> Column:
    """IPv4 as binary from its 32-bit number."""
    return F.unhex(F.lpad(F.hex(number), 8, "0"))


def to_text(address: Column) -> Column:
    """Dotted quad, or eight groups of hexadecimal digits."""
    byte = lambda i: F.conv(F.hex(F.substring(address, i, 1)), 16, 10)
    groups = [F.lower(F.hex(F.substring(address, i, 2))) for i in range(1, 17, 2)]
    return F.when(F.octet_length(address) == 4, F.concat_ws(".", *[byte(i) for i in range(1, 5)])).otherwise(F.concat_ws(":", *groups))


def parse(text: str) -> bytes:
    return ipaddress.ip_address(text).packed


def network(text: str) -> tuple[bytes, bytes] | None:
    """First and last address of a CIDR block or of one address; None if it is neither."""
    try:
        net = ipaddress.ip_network(text.strip(), strict=False)
    except ValueError:
        return None
    return net.network_address.packed, net.broadcast_address.packed


def in_networks(address: Column, texts: list[str]) -> Column:
    """Whether an address lies in any of the networks of its own version; items that are none are skipped."""
    found = F.lit(False)
    for bounds in filter(None, map(network, texts)):
        low, high = (F.lit(bytearray(b)) for b in bounds)
        found = found | ((F.octet_length(address) == len(bounds[0])) & address.between(low, high))
    return found


def key_ports(protocol: Column, source: Column, target: Column, icmp_type: Column | None = None, icmp_code: Column | None = None) -> tuple[Column, Column]:
    """The ports that a flow's identity takes.

    TCP, UDP and SCTP have theirs. An ICMP type stands with the type that answers it, or with its code if
    none does, so that it isn't the same the other way round. All else has zeros.
    """
    zero, icmp = F.lit(0), protocol.isin(ICMP, ICMPV6)
    type_, code = (icmp_type, icmp_code) if icmp_type is not None else (source, target)
    answer = F.when(protocol == ICMP, lookup(type_, ICMP_ANSWERS)).when(protocol == ICMPV6, lookup(type_, ICMPV6_ANSWERS))
    plain = protocol.isin(TCP, UDP, SCTP)
    first = F.when(plain, source).when(icmp, type_).otherwise(zero).cast("int")
    second = F.when(plain, target).when(icmp, F.coalesce(answer, code)).otherwise(zero).cast("int")
    return first, second


def community_id(source_ip: Column, target_ip: Column, source_port: Column, target_port: Column, protocol: Column, seed: int = 0) -> Column:
    """Community ID v1 from the key ports."""
    swap = (source_ip > target_ip) | ((source_ip == target_ip) & (source_port > target_port))
    two = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    head = F.unhex(F.lpad(F.hex(protocol), 2, "0"))
    parts = [F.lit(bytearray(seed.to_bytes(2, "big"))), pick(source_ip, target_ip), pick(target_ip, source_ip), head, F.lit(bytearray(1)), two(pick(source_port, target_port)), two(pick(target_port, source_port))]
    return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.concat(*parts)))))


def with_key(packets: DataFrame) -> DataFrame:
    """Adds the normalised flow key (a_ip, a_port, b_ip, b_port) and a_to_b: whether the packet runs that way."""
    icmp = (F.col("icmp_type"), F.col("icmp_code")) if "icmp_type" in packets.columns else (None, None)
    first, second = key_ports(F.col("proto"), F.col("src_port"), F.col("dst_port"), *icmp)
    packets = packets.withColumns({"key_src_port": first, "key_dst_port": second})
    swap = (F.col("src_ip") > F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("key_src_port") > F.col("key_dst_port")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    keys = {"a_ip": pick("src_ip", "dst_ip"), "a_port": pick("key_src_port", "key_dst_port"), "b_ip": pick("dst_ip", "src_ip"), "b_port": pick("key_dst_port", "key_src_port"), "a_to_b": ~swap}
    return packets.withColumns(keys).drop("key_src_port", "key_dst_port")


KEY = ["a_ip", "a_port", "b_ip", "b_port", "proto"]


def key_id(seed: int = 0) -> Column:
    """Community ID of the normalised key."""
    return community_id(F.col("a_ip"), F.col("b_ip"), F.col("a_port"), F.col("b_port"), F.col("proto"), seed)
