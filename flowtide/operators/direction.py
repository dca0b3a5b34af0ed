"""Which side of a flow is the client: rules in order, as one expression over flow rows.

CLIENT means that the observing host's end is the client in the sense of its hook direction; the flow's
source is the side that sent the first packet.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tcp
from ..functions.addresses import ICMP, ICMPV6, TCP, UDP

CLIENT, SERVER, INTERNAL = "CLIENT", "SERVER", "INTERNAL"
EPHEMERAL_FROM = 32768

# ICMP types that ask and types that answer.
ASKS = {ICMP: (8, 13, 17), ICMPV6: (128, 130)}
ANSWERS = {ICMP: (0, 14, 18), ICMPV6: (129, 131)}


def _either(client: Column, server: Column) -> Column:
    return F.when(client, CLIENT).when(server, SERVER)


def by_listening(egress: Column, target_listens: Column, source_listens: Column) -> Column:
    return F.when(target_listens, F.when(egress, CLIENT).otherwise(SERVER)).when(source_listens, F.when(egress, SERVER).otherwise(CLIENT))


def by_handshake(egress: Column, flags: Column) -> Column:
    syn = tcp.has(flags, tcp.SYN) & ~tcp.has(flags, tcp.ACK)
    both, ack = tcp.has(flags, tcp.SYN | tcp.ACK), flags == tcp.ACK
    return _either((egress & syn) | (~egress & both) | (egress & ack), (~egress & syn) | (egress & both) | (~egress & ack))


def by_ports(source: Column, target: Column) -> Column:
    high_source, high_target = source >= EPHEMERAL_FROM, target >= EPHEMERAL_FROM
    one = high_source != high_target
    return F.when(one, _either(high_source, high_target)).when(high_source & high_target, _either(source > target, target > source))


def by_icmp(egress: Column, proto: Column, icmp_type: Column) -> Column:
    of = lambda types: F.coalesce(*[F.when(proto == p, icmp_type.isin(*t)) for p, t in types.items()])
    return _either((egress & of(ASKS)) | (~egress & of(ANSWERS)), (~egress & of(ASKS)) | (egress & of(ANSWERS)))


def with_listening(flows: DataFrame, listening: DataFrame) -> DataFrame:
    """Adds dst_listens and src_listens from (host, proto, port): a small dimension of hosts' open ports."""
    for side in ("dst", "src"):
        ports = listening.select("host", "proto", F.col("port").alias(f"{side}_port"), F.lit(True).alias(f"{side}_listens")).distinct()
        flows = flows.join(ports, ["host", "proto", f"{side}_port"], "left").fillna(False, [f"{side}_listens"])
    return flows


def with_kind(flows: DataFrame, first_flags: str = "fwd_first_flags", icmp_type: str | None = None) -> DataFrame:
    """Adds kind (CLIENT, SERVER or INTERNAL) and flow_direction (forward, reverse or unknown)."""
    egress, proto = F.col("direction") == "egress", F.col("proto")
    rules = [by_listening(egress, F.col("dst_listens"), F.col("src_listens")), F.when(proto == TCP, by_handshake(egress, F.col(first_flags))), F.when(proto.isin(TCP, UDP), by_ports(F.col("src_port"), F.col("dst_port")))]
    if icmp_type:
        rules.append(by_icmp(egress, proto, F.col(icmp_type)))
    kind = F.coalesce(*rules, F.lit(INTERNAL))
    return flows.withColumn("kind", kind).withColumn("flow_direction", flow_direction(F.col("kind")))


def flow_direction(kind: Column) -> Column:
    return F.when(kind == CLIENT, "forward").when(kind == SERVER, "reverse").otherwise("unknown")


def split_latency(kind: Column, value: Column) -> dict[str, Column]:
    """A latency or jitter as seen by a server (its service time) or by a client (the round trip)."""
    return {"service": F.when(kind == SERVER, value), "round_trip": F.when(kind == CLIENT, value)}
