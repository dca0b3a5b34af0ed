"""Packet tables.

Operators take packets with these columns (further ones pass by): ts_ns long, src_ip and dst_ip binary,
src_port, dst_port, proto int, len long, tcp_flags int, direction string, and what a query needs of host,
ifindex, ttl, dscp, ecn, has_payload, icmp_type, icmp_code; and columns that order packets of one ts_ns.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import from_number

#: Wall time of ts_ns 0.
BOOT_NS = 1_700_000_000_000_000_000


@dataclass(frozen=True)
class PacketTable:
    """SQL that derives packets with numeric addresses from given tables, and the columns that order them."""

    tables: tuple[str, ...]
    sql: str
    order: list[str] = field(default_factory=list)
    #: The same order for operators, as ts_ns and one long from 0 to under 10**18 that orders packets of one ts_ns.
    ranked: list[str] = field(default_factory=list)

    def cte(self) -> str:
        """For SQL beside Spark's: common table expressions that end in one named packets."""
        return self.sql.format(**{t: t for t in self.tables})

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        packets = spark.sql(f"WITH {self.sql} SELECT * FROM packets", **frames)
        return packets.withColumns({"src_ip": from_number(F.col("src_ip")), "dst_ip": from_number(F.col("dst_ip"))})


_ENDS = """
  CASE WHEN from_client THEN client_ip ELSE server_ip END AS src_ip,
  CASE WHEN from_client THEN server_ip ELSE client_ip END AS dst_ip,
  CAST(CASE WHEN from_client THEN client_port ELSE server_port END AS INT) AS src_port,
  CAST(CASE WHEN from_client THEN server_port ELSE client_port END AS INT) AS dst_port
"""

#: One packet a line of an order, one conversation an order: many short conversations.
LINES = PacketTable(
    ("lineitem", "orders"),
    """raw AS (
  SELECT l_orderkey AS conn,
    l_orderkey*1000000000 + l_linenumber*50000000 + (l_partkey%50)*100000 AS ts_ns,
    CAST(l_linenumber AS BIGINT)*100000000000000000 + (l_partkey%100000000)*1000000000 + (l_suppkey%10000000)*100 + CAST(floor(l_quantity) AS BIGINT) AS seq,
    l_linenumber AS ln, l_partkey AS tie1, l_suppkey AS tie2, l_quantity AS tie3, l_extendedprice AS tie4,
    l_discount AS tie5, l_tax AS tie6, l_returnflag AS tie7, l_linestatus AS tie8, l_shipdate AS tie9,
    l_linenumber IN (1,3,4,6) AS from_client,
    10*16777216 + 1*65536 + o_custkey AS client_ip,
    10*16777216 + 2*65536 + l_orderkey%10 AS server_ip,
    32768 + l_orderkey%28000 AS client_port,
    CASE l_orderkey%5 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 8080 ELSE 9090 END AS server_port,
    CASE WHEN l_orderkey%5=2 THEN 17 ELSE 6 END AS proto,
    CAST(60 + CAST(l_quantity AS INT)*20 AS BIGINT) AS len,
    CASE WHEN l_orderkey%5=2 THEN 0 WHEN l_linenumber=1 THEN 2 WHEN l_linenumber=2 THEN 18
      WHEN l_linenumber=3 THEN 16 WHEN l_linenumber IN (4,5) THEN 24
      WHEN l_linenumber=6 THEN 17 WHEN l_returnflag='R' THEN 4 ELSE 17 END AS tcp_flags,
    CAST(l_orderkey%4 AS INT) AS host, CAST(1 + l_orderkey%3 AS INT) AS ifindex,
    l_orderkey%2=0 AS observer_is_client, CAST(64 - l_linenumber AS INT) AS ttl,
    CASE l_orderkey%4 WHEN 0 THEN 0 WHEN 1 THEN 46 WHEN 2 THEN 10 ELSE 3 END AS dscp,
    CAST(l_linenumber%4 AS INT) AS ecn, l_linenumber IN (4,5) AS has_payload, o_custkey AS custkey
  FROM {lineitem} JOIN {orders} ON o_orderkey=l_orderkey
), packets AS (
  SELECT conn, ts_ns, seq, ln, tie1, tie2, tie3, tie4, tie5, tie6, tie7, tie8, tie9, proto, len, tcp_flags, host, ifindex, ttl, dscp, ecn,
    has_payload, custkey, CASE WHEN from_client = observer_is_client THEN 'egress' ELSE 'ingress' END AS direction,
    """ + _ENDS + """ FROM raw
)""",
    ["ts_ns", "ln", *(f"tie{i}" for i in range(1, 10))],
    ["ts_ns", "seq"],
)

#: One packet an event, fifty conversations that two hosts each see a part of: long flows with gaps. ICMP has its type as source port.
EVENTS = PacketTable(
    ("events",),
    """raw AS (
  SELECT event_id AS packet_id, event_id*250000000 AS ts_ns, user_id%50 AS conn, event_id%2=0 AS from_client,
    CAST(60 + CAST(floor(value) AS INT) AS BIGINT) AS len,
    10*16777216 + 1*65536 + user_id%50 AS client_ip, 10*16777216 + 2*65536 + user_id%50%8 AS server_ip,
    40000 + user_id%50 AS client_port,
    CASE user_id%50%4 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 ELSE 8080 END AS server_port,
    CASE WHEN user_id%50%10=9 THEN 1 WHEN user_id%50%4=2 THEN 17 ELSE 6 END AS proto,
    CAST(1 + user_id%50%3 AS INT) AS ifindex, CAST(event_id%7%2 AS INT) AS host, event_type, value
  FROM {events}
), shaped AS (
  SELECT packet_id, ts_ns, conn, from_client, len, proto, ifindex, host, client_ip, server_ip,
    CASE WHEN proto <> 6 THEN 0 WHEN event_type='signup' THEN CASE WHEN from_client THEN 2 ELSE 18 END
      WHEN event_type IN ('click','purchase') THEN 24
      WHEN event_type='error' AND value>480 THEN 4 WHEN event_type='error' AND value>400 THEN 17 ELSE 16 END AS tcp_flags,
    CASE WHEN proto=1 THEN 8 ELSE client_port END AS client_port,
    CASE WHEN proto=1 THEN 0 ELSE server_port END AS server_port
  FROM raw
), packets AS (
  SELECT packet_id, ts_ns, conn, len, proto, ifindex, host, tcp_flags, tcp_flags = 24 AS has_payload,
    CASE WHEN from_client THEN 'egress' ELSE 'ingress' END AS direction,
    """ + _ENDS + """ FROM shaped
)""",
    ["ts_ns", "packet_id"],
    ["ts_ns", "packet_id"],
)


def flow_snapshots_sql(step_ns: int = 5_000_000_000) -> str:
    """CTEs that end in snapshots: cumulative counters of EVENTS conversations at every step with traffic before it."""
    return EVENTS.sql + f""", steps AS (
  SELECT conn, ts_ns - ts_ns % {step_ns} + {step_ns} AS poll_ns, sum(CASE WHEN from_egress THEN 1 ELSE 0 END) AS fwd, sum(CASE WHEN NOT from_egress THEN 1 ELSE 0 END) AS rev,
    sum(CASE WHEN from_egress THEN len ELSE 0 END) AS fwd_len, sum(CASE WHEN NOT from_egress THEN len ELSE 0 END) AS rev_len
  FROM (SELECT *, direction = 'egress' AS from_egress FROM packets) p GROUP BY 1, 2
), snapshots AS (
  SELECT conn, poll_ns, sum(fwd) OVER w AS fwd_packets, sum(rev) OVER w AS rev_packets, sum(fwd_len) OVER w AS fwd_bytes, sum(rev_len) OVER w AS rev_bytes
  FROM steps WINDOW w AS (PARTITION BY conn ORDER BY poll_ns ROWS UNBOUNDED PRECEDING)
)"""


def with_wall_clock(packets: DataFrame, boots: DataFrame) -> DataFrame:
    """Adds wall_ns from hosts' boot times (host, boot_ns); one row a host, joined by Spark's choice."""
    return packets.join(boots.select("host", "boot_ns"), "host", "left").withColumn("wall_ns", F.col("ts_ns") + F.col("boot_ns")).drop("boot_ns")
