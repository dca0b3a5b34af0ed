"""What hosts tell besides packets: open ports, processes' connections, capture errors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import CAPTURE_ERRORS, LEVELS, lookup

#: Fixed value: the state in which a TCP socket listens, as the kernel's socket tables write it.
LISTEN = "0A"


def listening_ports(lines: DataFrame) -> DataFrame:
    """(host, proto, port) of socket-table lines (host, table: tcp, tcp6, udp or udp6; value).

    TCP sockets must listen; UDP ones must be bound to a port other than 0. Header lines and broken lines go.
    """
    parts = F.split(F.trim("value"), r"\s+")
    port = F.conv(F.substring_index(F.try_element_at(parts, F.lit(2)), ":", -1), 16, 10).cast("int")
    rows = lines.select("host", F.when(F.col("table").startswith("tcp"), 6).otherwise(17).alias("proto"), port.alias("port"), F.upper(F.try_element_at(parts, F.lit(4))).alias("state"), F.try_element_at(parts, F.lit(1)).rlike(r"^\d+:$").alias("row"))
    good = F.col("row") & F.when(F.col("proto") == 6, F.col("state") == LISTEN).otherwise(F.col("port") > 0)
    return rows.filter(good & F.col("port").isNotNull()).select("host", "proto", "port").distinct()


def process_events(raw: DataFrame) -> DataFrame:
    """Outbound connections that succeeded and accepted inbound ones, with comm cut at its first NUL."""
    done = (F.col("event") == "accept") | ((F.col("event") == "connect") & (F.col("result") == 0))
    return raw.filter(done).withColumn("comm", F.substring_index("comm", "\u0000", 1)).drop("result")


def capture_errors(raw: DataFrame) -> DataFrame:
    """Capture errors by text, level, interface and direction."""
    named = raw.select(F.coalesce(lookup(F.col("error_code"), CAPTURE_ERRORS), F.lit("unknown")).alias("error"), lookup(F.col("level"), LEVELS).alias("level"), "ifindex", "direction")
    return named.groupBy("error", "level", "ifindex", "direction").agg(F.count("*").alias("n"))
