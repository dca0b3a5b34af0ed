"""Registered queries over packets: flows, timing, sessions, records, filters, direction, names, metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.addresses import KEY, key_id, to_text, with_key
from ..operators import direction, filters, flows, metrics
from ..sources import host
from ..sources.packets import EVENTS, LINES, flow_snapshots_sql, with_wall_clock
from . import sqltext as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def readable(df: DataFrame) -> DataFrame:
    """Addresses as text."""
    return df.withColumns({c: to_text(F.col(c)) for c in ("src_ip", "dst_ip") if c in df.columns})


FLOW_COLUMNS = ["community_id", "host", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "first_ns", "last_ns", "tcp_flags", "fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes", "fwd_flags", "rev_flags", "fwd_first_flags", "rev_first_flags"]
TEXT_IPS = f"{S.dotted('src_ip')} AS src_ip, {S.dotted('dst_ip')} AS dst_ip"


def line_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.flow_aggregate(LINES.read(spark, sf_dir), LINES.ranked)


@query(f"WITH {S.FLOWS} SELECT * EXCLUDE (src_ip, dst_ip, direction, ifindex, custkey, conn), {TEXT_IPS} FROM flows")
def flow_aggregate(spark, sf_dir):
    return readable(line_flows(spark, sf_dir)).select(FLOW_COLUMNS)


@query(f"WITH {S.LINES_KEYED} SELECT {S.community()} AS community_id, host, ts_ns, len, direction, ifindex FROM keyed QUALIFY row_number() OVER (PARTITION BY host, a_ip, a_port, b_ip, b_port, proto ORDER BY {S.LINES_ORDER}) = 1")
def new_flows(spark, sf_dir):
    return flows.new_flows(LINES.read(spark, sf_dir), LINES.ranked).select("community_id", "host", "ts_ns", "len", "direction", "ifindex")


@query(f"WITH {S.EVENTS_KEYED} SELECT conn, {S.community()} AS community_id, count(*) AS packets FROM keyed GROUP BY ALL")
def community_ids(spark, sf_dir):
    return with_key(EVENTS.read(spark, sf_dir)).withColumn("community_id", key_id()).groupBy("conn", "community_id").agg(F.count("*").alias("packets"))


@query(
    f"""WITH {S.LINES_KEYED}, waits AS (
  SELECT *, CASE WHEN has_payload AND lag(a_to_b) OVER w <> a_to_b THEN ts_ns - lag(ts_ns) OVER w END AS wait
  FROM keyed WHERE proto = 6 WINDOW w AS (PARTITION BY host, a_ip, a_port, b_ip, b_port, has_payload ORDER BY {S.LINES_ORDER})
), t AS (
  SELECT {S.community()} AS community_id, host, max(ts_ns) FILTER ((tcp_flags & 18) = 2) AS syn, max(ts_ns) FILTER ((tcp_flags & 18) = 18) AS syn_ack,
    CAST(coalesce(sum(wait), 0) AS BIGINT) AS latency_sum_ns, count(wait) AS transactions
  FROM waits GROUP BY a_ip, b_ip, a_port, b_port, proto, host
) SELECT community_id, host, CASE WHEN syn IS NOT NULL AND syn_ack IS NOT NULL THEN greatest(syn_ack - syn, 0) END AS handshake_ns, latency_sum_ns, transactions, CASE WHEN transactions > 0 THEN latency_sum_ns // transactions END AS latency_mean_ns FROM t"""
)
def tcp_timing(spark, sf_dir):
    return flows.tcp_timing(LINES.read(spark, sf_dir), LINES.ranked)


def folded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.packet_fold(EVENTS.read(spark, sf_dir), EVENTS.ranked, keep=("packet_id", "ifindex"))


@query(f"WITH {S.FOLD} SELECT packet_id, session, start_ns, seen, state, jitter_ns, wait_sum_ns, waits FROM fold")
def packet_states(spark, sf_dir):
    return flows.numbered(folded_events(spark, sf_dir)).select("packet_id", "session", "start_ns", "seen", "state", "jitter_ns", "wait_sum_ns", "waits")


@query(
    f"""WITH {S.RECORDS}, s AS (
  SELECT host, community_id, proto, src_ip, src_port, dst_ip, dst_port, session, start_ns, max(record_end_ns) AS end_ns, bit_or(tcp_flags) AS tcp_flags,
    CAST(sum(fwd_packets_delta) AS BIGINT) AS fwd_packets, CAST(sum(rev_packets_delta) AS BIGINT) AS rev_packets, CAST(sum(fwd_bytes_delta) AS BIGINT) AS fwd_bytes, CAST(sum(rev_bytes_delta) AS BIGINT) AS rev_bytes,
    arg_max(state, interval) AS state, arg_max(jitter_ns, interval) AS jitter_ns, arg_max(wait_sum_ns, interval) AS wait_sum_ns, arg_max(waits, interval) AS waits, arg_max(end_reason, interval) AS end_reason
  FROM records GROUP BY ALL
) SELECT * EXCLUDE (src_ip, dst_ip) REPLACE ({names.sql_case("state", names.STATES)} AS state), {TEXT_IPS} FROM s"""
)
def flow_sessions(spark, sf_dir):
    return readable(flows.sessions(folded_events(spark, sf_dir)))


@query(f"WITH {S.RECORDS} SELECT * EXCLUDE (src_ip, dst_ip, ifindex) REPLACE ({names.sql_case('state', names.STATES)} AS state), {TEXT_IPS} FROM records")
def interval_records(spark, sf_dir):
    return readable(flows.interval_records(folded_events(spark, sf_dir)))


_SNAPSHOTS = flow_snapshots_sql()
_COUNTERS = ["fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes"]


@query(
    f"""WITH {_SNAPSHOTS.format(events="events")}, d AS (SELECT conn, poll_ns, {", ".join(f"CAST({c} AS BIGINT) AS {c}, CAST(greatest({c} - coalesce(lag({c}) OVER w, 0), 0) AS BIGINT) AS {c}_delta" for c in _COUNTERS)} FROM snapshots WINDOW w AS (PARTITION BY conn ORDER BY poll_ns))
SELECT * FROM d WHERE fwd_packets_delta > 0 OR rev_packets_delta > 0"""
)
def snapshot_deltas(spark, sf_dir):
    snapshots = spark.sql(f"WITH {_SNAPSHOTS} SELECT * FROM snapshots", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return flows.snapshot_deltas(snapshots, ["conn"], "poll_ns", _COUNTERS)


@query(
    f"""WITH {LINES.cte()} SELECT coalesce({names.sql_case("proto", names.PROTOCOLS)}, CAST(proto AS VARCHAR)) AS transport, coalesce({names.sql_case("dscp", names.DSCP)}, 'df') AS dscp_span,
  coalesce({names.sql_case("dscp", names.DSCP)}, CAST(dscp AS VARCHAR)) AS dscp_filter, {names.sql_case("ecn", names.ECN)} AS ecn,
  concat_ws(',', {", ".join(f"CASE WHEN (tcp_flags & {1 << i}) <> 0 THEN '{n}' END" for i, n in enumerate(names.FLAGS))}) AS flags, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes
FROM packets GROUP BY ALL"""
)
def decoded_fields(spark, sf_dir):
    p = LINES.read(spark, sf_dir)
    c = F.col
    named = p.select(names.protocol_name(c("proto")).alias("transport"), names.dscp_name(c("dscp")).alias("dscp_span"), names.dscp_name(c("dscp"), False).alias("dscp_filter"), names.ecn_name(c("ecn")).alias("ecn"), F.array_join(names.flag_tags(c("tcp_flags")), ",").alias("flags"), "len")
    return named.groupBy("transport", "dscp_span", "dscp_filter", "ecn", "flags").agg(F.count("*").alias("packets"), F.sum("len").alias("bytes"))


@query(f"WITH {EVENTS.cte()} SELECT {names.sql_case('src_port', names.ICMP_TYPES)} AS icmp_type, {names.sql_case('(len % 44) * 256 + len % 17', names.ICMP_CODES)} AS icmp_code, direction, count(*) AS packets FROM packets WHERE proto = 1 GROUP BY ALL")
def icmp_names(spark, sf_dir):
    p = EVENTS.read(spark, sf_dir).filter("proto = 1")
    code = names.icmp_code_name(F.col("len") % 44, F.col("len") % 17, F.lit(4))  # lengths stand in for types and codes
    return p.groupBy(names.icmp_type_name(F.col("src_port"), F.lit(4)).alias("icmp_type"), code.alias("icmp_code"), "direction").agg(F.count("*").alias("packets"))


_LISTENING = "SELECT * FROM (VALUES (0, 6, 443), (1, 6, 443), (2, 6, 443), (3, 6, 443), (1, 6, 8080), (2, 17, 53)) AS t(host, proto, port)"


def observed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the hook direction and interface of the creating packet."""
    packets = LINES.read(spark, sf_dir).withColumn("egress", F.col("direction") == "egress")  # text would need a sort
    return flows.flow_aggregate(packets, LINES.ranked, first=("egress", "ifindex")).withColumn("direction", F.when(F.col("egress"), "egress").otherwise("ingress"))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direction.with_kind(direction.with_listening(observed_flows(spark, sf_dir), spark.sql(_LISTENING)))


KINDS = (
    S.FLOWS
    + f""", listening AS ({_LISTENING}), kinds AS (
  SELECT f.*, coalesce(
    CASE WHEN d.port IS NOT NULL THEN CASE WHEN direction = 'egress' THEN 'CLIENT' ELSE 'SERVER' END WHEN s.port IS NOT NULL THEN CASE WHEN direction = 'egress' THEN 'SERVER' ELSE 'CLIENT' END END,
    CASE WHEN f.proto = 6 THEN CASE WHEN (fwd_first_flags & 18) = 2 OR fwd_first_flags = 16 THEN CASE WHEN direction = 'egress' THEN 'CLIENT' ELSE 'SERVER' END WHEN (fwd_first_flags & 18) = 18 THEN CASE WHEN direction = 'egress' THEN 'SERVER' ELSE 'CLIENT' END END END,
    CASE WHEN src_port >= 32768 AND dst_port < 32768 THEN 'CLIENT' WHEN src_port < 32768 AND dst_port >= 32768 THEN 'SERVER' WHEN src_port >= 32768 AND src_port > dst_port THEN 'CLIENT' WHEN src_port >= 32768 AND src_port < dst_port THEN 'SERVER' END,
    'INTERNAL') AS kind
  FROM flows f LEFT JOIN listening d ON d.host = f.host AND d.proto = f.proto AND d.port = f.dst_port LEFT JOIN listening s ON s.host = f.host AND s.proto = f.proto AND s.port = f.src_port
)"""
)


@query(f"WITH {KINDS} SELECT community_id, host, direction, src_port, dst_port, kind, CASE kind WHEN 'CLIENT' THEN 'forward' WHEN 'SERVER' THEN 'reverse' ELSE 'unknown' END AS flow_direction FROM kinds")
def flow_kinds(spark, sf_dir):
    return kinds(spark, sf_dir).select("community_id", "host", "direction", "src_port", "dst_port", "kind", "flow_direction")


@query(
    f"""WITH {S.FLOWS}, sides AS (SELECT ifindex, direction, fwd_packets AS packets, fwd_bytes AS bytes FROM flows UNION ALL SELECT ifindex, CASE direction WHEN 'egress' THEN 'ingress' ELSE 'egress' END, rev_packets, rev_bytes FROM flows)
SELECT ifindex, direction, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM sides WHERE packets > 0 GROUP BY ALL"""
)
def traffic_counters(spark, sf_dir):
    return metrics.traffic_counters(observed_flows(spark, sf_dir))


@query(f"WITH {S.RECORDS} SELECT proto, count(*) FILTER (record_start_ns = start_ns) AS created, count(*) AS recorded, count(*) FILTER (end_reason <> 'active timeout') AS closed FROM records GROUP BY ALL")
def lifecycle_counters(spark, sf_dir):
    return metrics.lifecycle(flows.interval_records(folded_events(spark, sf_dir)), "proto")


@query(
    f"""WITH {S.RECORDS}, kept AS (SELECT * FROM records WHERE ifindex <> 3), lost AS (SELECT DISTINCT a_ip, a_port, b_ip, b_port, proto, host, ifindex FROM fold WHERE ifindex = 3),
made AS (SELECT ifindex, count(*) FILTER (record_start_ns = start_ns) AS created, count(*) AS recorded, count(*) FILTER (end_reason = 'idle timeout') AS idled, 0 AS dropped FROM kept GROUP BY ifindex
  UNION ALL SELECT ifindex, 0, 0, 0, count(*) FROM lost GROUP BY ifindex)
SELECT ifindex, status, n FROM (UNPIVOT made ON created, recorded, idled, dropped INTO NAME status VALUE n)"""
)
def lifecycle_by_interface(spark, sf_dir):
    """What became of flows, by interface and status; a filter drops those of interface 3."""
    packets, rule = EVENTS.read(spark, sf_dir), {"network_interface_index": filters.Rule(["1-2"])}
    records = flows.interval_records(flows.packet_fold(filters.filter_flows(packets, rule), EVENTS.ranked, keep=("ifindex",)), ("ifindex",))
    records = records.withColumn("ifindex", F.coalesce("fwd_ifindex", "rev_ifindex"))
    dropped = flows.new_flows(packets.filter(~filters.condition(rule)), EVENTS.ranked)
    return metrics.lifecycle_statuses(records, dropped, "ifindex")


@query(
    f"""WITH {S.FLOWS} SELECT proto, CAST(sum(fwd_packets + rev_packets) AS BIGINT) AS sum, count(*) AS n FROM flows GROUP BY proto"""
)
def flow_size_sums(spark, sf_dir):
    """Sum and number of what flow_size_histogram counts."""
    return metrics.histogram_sums(line_flows(spark, sf_dir).withColumn("packets", F.col("fwd_packets") + F.col("rev_packets")), "packets", ["proto"])


@query(
    f"""WITH {S.RECORDS}, s AS (SELECT start_ns, max(record_end_ns) AS end_ns FROM records GROUP BY host, community_id, session, start_ns), c AS (SELECT start_ns AS moment, 1 AS change FROM s UNION ALL SELECT end_ns, -1 FROM s),
t AS (SELECT moment - moment % 60000000000 AS step_ns, sum(change) AS change FROM c GROUP BY ALL) SELECT step_ns, CAST(sum(change) OVER (ORDER BY step_ns) AS BIGINT) AS active FROM t"""
)
def active_flows(spark, sf_dir):
    return metrics.active_flows(flows.sessions(folded_events(spark, sf_dir)), 60 * flows.SECOND)


_SIZES = (1.0, 2.0, 4.0, 6.0, 8.0)


@query(
    f"""WITH {S.FLOWS}, b AS (SELECT * FROM (VALUES {", ".join(f"({b})" for b in _SIZES)}, (NULL)) AS t(le))
SELECT proto, CAST(le AS DOUBLE) AS le, count(*) FILTER (le IS NULL OR fwd_packets + rev_packets <= le) AS n FROM flows, b GROUP BY ALL"""
)
def flow_size_histogram(spark, sf_dir):
    return metrics.histogram(line_flows(spark, sf_dir).withColumn("packets", F.col("fwd_packets") + F.col("rev_packets")), "packets", ["proto"], _SIZES)


@query(f"WITH {KINDS} SELECT kind, proto, count(*) AS n FROM kinds GROUP BY ALL")
def flows_by_kind(spark, sf_dir):
    return metrics.count_by(kinds(spark, sf_dir), "kind", "proto")


@query(
    f"""WITH {S.LINES_KEYED}, f AS (SELECT {S.community()} AS community_id, ifindex, host, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS packets FROM keyed GROUP BY a_ip, b_ip, a_port, b_port, proto, ifindex, host),
g AS (SELECT *, max(end_ns) OVER (PARTITION BY community_id ORDER BY start_ns, end_ns, ifindex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
w AS (SELECT *, sum(CASE WHEN start_ns > reach THEN 1 ELSE 0 END) OVER (PARTITION BY community_id ORDER BY start_ns, end_ns, ifindex) AS wnd FROM g)
SELECT community_id, ifindex, host, start_ns, end_ns, packets FROM w QUALIFY row_number() OVER (PARTITION BY community_id, wnd ORDER BY packets DESC, ifindex, start_ns) = 1"""
)
def one_observer(spark, sf_dir):
    keyed = with_key(LINES.read(spark, sf_dir)).withColumn("community_id", key_id())
    seen = keyed.groupBy("community_id", "ifindex", "host").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.count("*").alias("packets"))
    return flows.one_observer(seen, "start_ns", "end_ns", "packets", "ifindex").drop("window")


@query(f"WITH {S.LINES_KEYED}, c AS (SELECT {S.community()} AS community_id, host FROM keyed GROUP BY ALL) SELECT community_id, count(*) AS n_hosts, min(host) AS first_host, max(host) AS last_host FROM c GROUP BY ALL")
def cross_observers(spark, sf_dir):
    """How many hosts saw each conversation."""
    seen = with_key(LINES.read(spark, sf_dir)).select(*KEY, "host").distinct().withColumn("community_id", key_id())
    return seen.groupBy("community_id").agg(F.count("*").alias("n_hosts"), F.min("host").alias("first_host"), F.max("host").alias("last_host"))


@query(f"WITH {S.FLOWS} SELECT community_id, host, fwd_bytes + rev_bytes AS bytes FROM flows WHERE fwd_bytes + rev_bytes > 3000")
def flows_over_bytes(spark, sf_dir):
    total = F.col("fwd_bytes") + F.col("rev_bytes")
    return line_flows(spark, sf_dir).filter(total > 3000).select("community_id", "host", total.alias("bytes"))


@query(f"WITH {S.FLOWS} SELECT community_id, host, last_ns FROM flows WHERE (tcp_flags & 4) <> 0")
def reset_flows(spark, sf_dir):
    tags = names.flag_tags(F.col("tcp_flags"))
    return line_flows(spark, sf_dir).filter(F.array_contains(tags, "rst")).select("community_id", "host", "last_ns")


_BOOTS = "SELECT CAST(i AS INT) AS host, 1700000000000000000 + i * 1000 AS boot_ns FROM (VALUES (0), (1), (2), (3)) AS t(i)"


@query(f"WITH {LINES.cte()}, boots AS ({_BOOTS}) SELECT host, direction, min(ts_ns + boot_ns) AS first_wall_ns, max(ts_ns + boot_ns) AS last_wall_ns FROM packets JOIN boots USING (host) GROUP BY ALL")
def wall_clock(spark, sf_dir):
    """When each host first and last saw packets, by wall clock."""
    timed = with_wall_clock(LINES.read(spark, sf_dir), spark.sql(_BOOTS))
    return timed.groupBy("host", "direction").agg(F.min("wall_ns").alias("first_wall_ns"), F.max("wall_ns").alias("last_wall_ns"))


@query(
    f"""WITH {S.RECORDS}, k AS (SELECT *, CASE WHEN proto = 6 AND src_port >= 32768 AND dst_port < 32768 THEN 'CLIENT' WHEN proto = 6 AND src_port < 32768 AND dst_port >= 32768 THEN 'SERVER' ELSE 'INTERNAL' END AS kind FROM records)
SELECT kind, CAST(sum(CASE WHEN kind = 'SERVER' THEN wait_sum_ns END) AS BIGINT) AS service, CAST(sum(CASE WHEN kind = 'CLIENT' THEN wait_sum_ns END) AS BIGINT) AS round_trip, count(*) AS records FROM k GROUP BY ALL"""
)
def latency_by_kind(spark, sf_dir):
    """Waits of transactions as service time where the source serves, and as round trips where it asks."""
    records = flows.interval_records(folded_events(spark, sf_dir))
    kind = F.when(F.col("proto") == 6, F.coalesce(direction.by_ports(F.col("src_port"), F.col("dst_port")), F.lit(direction.INTERNAL))).otherwise(direction.INTERNAL)
    split = direction.split_latency(F.col("kind"), F.col("wait_sum_ns"))
    return records.withColumn("kind", kind).groupBy("kind").agg(*[F.sum(c).alias(k) for k, c in split.items()], F.count("*").alias("records"))


@query(
    f"""WITH {S.RECORDS} SELECT host, community_id, session, interval, arg_min(len, rn) FILTER (a_to_b = first_ab) AS fwd_len, arg_min(len, rn) FILTER (a_to_b <> first_ab) AS rev_len,
  arg_min(packet_id, rn) FILTER (a_to_b = first_ab) AS fwd_packet_id, arg_min(packet_id, rn) FILTER (a_to_b <> first_ab) AS rev_packet_id FROM numbered GROUP BY ALL"""
)
def interval_metadata(spark, sf_dir):
    """What the first packet of each record interval carried, each way."""
    records = flows.interval_records(folded_events(spark, sf_dir), metadata=("len", "packet_id"))
    return records.select("host", "community_id", "session", "interval", "fwd_len", "rev_len", "fwd_packet_id", "rev_packet_id")


# The ICMP types that packets of the next query have, by their number.
_TYPES = (8, 13, 17, 0, 14, 18, 3)


@query(
    f"""WITH {S.EVENTS_KEYED}, f AS (SELECT {S.community()} AS community_id, host, direction, packet_id % 7 AS t FROM keyed WHERE proto = 1 QUALIFY row_number() OVER (PARTITION BY host, a_ip, a_port, b_ip, b_port ORDER BY ts_ns, packet_id) = 1)
SELECT community_id, host, CASE WHEN t = 6 THEN 'INTERNAL' WHEN (t < 3) = (direction = 'egress') THEN 'CLIENT' ELSE 'SERVER' END AS kind FROM f"""
)
def icmp_kinds(spark, sf_dir):
    """Sides of ICMP flows by whether the first packet asks or answers."""
    packets = EVENTS.read(spark, sf_dir).filter("proto = 1")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("packet_id") % 7 + 1).cast("int"))
    made = flows.flow_aggregate(packets.withColumns({"first_type": kind, "egress": F.col("direction") == "egress"}), EVENTS.ranked, first=("first_type", "egress"))
    made = made.withColumn("direction", F.when(F.col("egress"), "egress").otherwise("ingress"))
    return direction.with_kind(direction.with_listening(made, spark.sql(_LISTENING)), icmp_type="first_type").select("community_id", "host", "kind")


@query("SELECT DISTINCT CAST(s_suppkey % 5 AS INT) AS host, CASE WHEN s_suppkey % 4 < 2 THEN 6 ELSE 17 END AS proto, CAST(CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1000 + s_suppkey * 7 % 30000 END AS INT) AS port FROM supplier WHERE CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey % 3 <> 0 ELSE s_suppkey % 9 <> 0 END")
def open_ports(spark, sf_dir):
    """Open ports of hosts from their socket tables, as text."""
    s, key = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    table = F.element_at(F.array(*map(F.lit, ("tcp", "tcp6", "udp", "udp6"))), (key % 4 + 1).cast("int"))
    port = F.when(key % 9 == 0, 0).otherwise(1000 + key * 7 % 30000).cast("long")
    line = F.concat(F.lit("  "), key, F.lit(": 0100007F:"), F.lpad(F.hex(port), 4, "0"), F.lit(" 00000000:0000 "), F.when(key % 3 == 0, "01").otherwise("0A"), F.lit(" 00000000:00000000"))
    heads = s.select((key % 5).cast("int").alias("host"), table.alias("table"), F.lit("  sl  local_address rem_address   st").alias("value"))
    return host.listening_ports(heads.unionAll(s.select((key % 5).cast("int").alias("host"), table.alias("table"), line.alias("value"))))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'accept' ELSE 'connect' END AS event, 'svc' || user_id % 9 AS comm, count(*) AS n FROM events WHERE event_id % 3 = 0 OR event_id % 4 <> 1 GROUP BY ALL")
def process_connections(spark, sf_dir):
    """Connections that processes made or took, by name."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    event = F.when(F.col("event_id") % 3 == 0, "accept").otherwise("connect")
    result = F.when(F.col("event_id") % 4 == 1, -111).otherwise(0)
    raw = e.select(event.alias("event"), result.alias("result"), F.col("event_id").alias("pid"), F.concat(F.lit("svc"), F.col("user_id") % 9, F.lit("\0tail")).alias("comm"))
    return metrics.count_by(host.process_events(raw), "event", "comm")


@query(f"SELECT coalesce({names.sql_case('event_id % 7', names.CAPTURE_ERRORS)}, 'unknown') AS error, {names.sql_case('event_id % 3', names.LEVELS)} AS level, CAST(user_id % 3 AS INT) AS ifindex, CASE WHEN event_id % 2 = 0 THEN 'egress' ELSE 'ingress' END AS direction, count(*) AS n FROM events GROUP BY ALL")
def capture_error_counts(spark, sf_dir):
    e, key = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    raw = e.select((key % 7).cast("int").alias("error_code"), (key % 3).cast("int").alias("level"), (F.col("user_id") % 3).cast("int").alias("ifindex"), F.when(key % 2 == 0, "egress").otherwise("ingress").alias("direction"))
    return host.capture_errors(raw)
