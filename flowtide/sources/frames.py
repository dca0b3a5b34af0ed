"""Frames made of packet columns, for captures that were stored decoded."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hex(number: Column, n_bytes: int) -> Column:
    return F.lpad(F.hex(number.cast("long")), 2 * n_bytes, "0")


def ipv4_frames(packets: DataFrame) -> DataFrame:
    """Adds frame: Ethernet, IPv4 and TCP or UDP headers of each packet, and one byte of payload if it has any."""
    c = F.col
    tcp = F.concat(_hex(c("src_port"), 2), _hex(c("dst_port"), 2), F.lit("00" * 8), F.lit("50"), _hex(c("tcp_flags"), 1), F.lit("00" * 6))
    udp = F.concat(_hex(c("src_port"), 2), _hex(c("dst_port"), 2), F.lit("00" * 4))
    ip = F.concat(F.lit("45"), _hex(c("dscp") * 4 + c("ecn"), 1), F.lit("00" * 6), _hex(c("ttl"), 1), _hex(c("proto"), 1), F.lit("0000"), F.hex("src_ip"), F.hex("dst_ip"))
    ethernet = F.concat(F.lit("02000000000A0200000000"), _hex(c("ifindex"), 1), F.lit("0800"))
    text = F.concat(ethernet, ip, F.when(c("proto") == 6, tcp).otherwise(udp))
    return packets.withColumn("frame", F.unhex(text))
