"""Pieces of SQL for another engine, beside the DataFrame operators."""

from ..functions.names import ICMP_ANSWERS, sql_case
from ..functions.tcp import next_state_sql
from ..operators.flows import Timeouts
from ..sources.packets import EVENTS, LINES


def dotted(x: str) -> str:
    return f"CAST({x} >> 24 AS VARCHAR) || '.' || CAST(({x} >> 16) & 255 AS VARCHAR) || '.' || CAST(({x} >> 8) & 255 AS VARCHAR) || '.' || CAST({x} & 255 AS VARCHAR)"


def community(a_ip="a_ip", b_ip="b_ip", a_port="a_port", b_port="b_port", proto="proto") -> str:
    pad = lambda x, n: f"lpad(hex({x}), {n}, '0')"
    body = " || ".join(["'0000'", pad(a_ip, 8), pad(b_ip, 8), pad(proto, 2), "'00'", pad(a_port, 4), pad(b_port, 4)])
    return f"'1:' || base64(unhex(sha1(unhex({body}))))"


KEYED = """keyed AS (
  SELECT *, CASE WHEN swapped THEN dst_ip ELSE src_ip END AS a_ip, CASE WHEN swapped THEN src_ip ELSE dst_ip END AS b_ip,
    CASE WHEN swapped THEN dst_port ELSE src_port END AS a_port, CASE WHEN swapped THEN src_port ELSE dst_port END AS b_port, NOT swapped AS a_to_b
  FROM (SELECT *, src_ip > dst_ip OR (src_ip = dst_ip AND src_port > dst_port) AS swapped FROM packets) p
)"""
LINES_KEYED = LINES.cte() + ", " + KEYED
EVENTS_KEYED = EVENTS.cte() + ", " + KEYED
LINES_ORDER = ", ".join(LINES.order)

FLOWS = (
    LINES_KEYED
    + f""", firsts AS (
  SELECT *, first_value(a_to_b) OVER (PARTITION BY host, a_ip, a_port, b_ip, b_port, proto ORDER BY {LINES_ORDER}) AS first_ab,
    row_number() OVER (PARTITION BY host, a_ip, a_port, b_ip, b_port, proto ORDER BY {LINES_ORDER}) AS place,
    row_number() OVER (PARTITION BY host, a_ip, a_port, b_ip, b_port, proto, a_to_b ORDER BY {LINES_ORDER}) AS side_place
  FROM keyed
), flows AS (
  SELECT {community()} AS community_id, host, proto,
    CASE WHEN first_ab THEN a_ip ELSE b_ip END AS src_ip, CASE WHEN first_ab THEN a_port ELSE b_port END AS src_port,
    CASE WHEN first_ab THEN b_ip ELSE a_ip END AS dst_ip, CASE WHEN first_ab THEN b_port ELSE a_port END AS dst_port,
    min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, bit_or(tcp_flags) AS tcp_flags,
    count(*) FILTER (a_to_b = first_ab) AS fwd_packets, count(*) FILTER (a_to_b <> first_ab) AS rev_packets,
    CAST(coalesce(sum(len) FILTER (a_to_b = first_ab), 0) AS BIGINT) AS fwd_bytes, CAST(coalesce(sum(len) FILTER (a_to_b <> first_ab), 0) AS BIGINT) AS rev_bytes,
    coalesce(bit_or(tcp_flags) FILTER (a_to_b = first_ab), 0) AS fwd_flags, coalesce(bit_or(tcp_flags) FILTER (a_to_b <> first_ab), 0) AS rev_flags,
    max(tcp_flags) FILTER (a_to_b = first_ab AND side_place = 1) AS fwd_first_flags, max(tcp_flags) FILTER (a_to_b <> first_ab AND side_place = 1) AS rev_first_flags,
    max(direction) FILTER (place = 1) AS direction, max(ifindex) FILTER (place = 1) AS ifindex, max(custkey) AS custkey, max(conn) AS conn
  FROM firsts GROUP BY a_ip, a_port, b_ip, b_port, proto, host, first_ab
)"""
)

_T = Timeouts()
FOLD = (
    EVENTS_KEYED.replace("raw AS", "RECURSIVE raw AS", 1)
    + f""", ordered AS (
  SELECT *, direction = 'egress' AS egress, row_number() OVER (PARTITION BY host, a_ip, a_port, b_ip, b_port, proto ORDER BY ts_ns, packet_id) AS rn FROM keyed
), fold AS (
  SELECT rn, host, a_ip, a_port, b_ip, b_port, proto, packet_id, ts_ns, len, tcp_flags, egress, a_to_b, ifindex, 0 AS session, ts_ns AS start_ns, tcp_flags AS seen,
    CASE WHEN proto = 6 THEN {next_state_sql("0", "tcp_flags", "egress")} ELSE 0 END AS state,
    CAST(0 AS BIGINT) AS jitter_ns, CAST(0 AS BIGINT) AS wait_sum_ns, 0 AS waits, a_to_b AS first_ab,
    CASE WHEN has_payload AND proto = 6 THEN ts_ns END AS payload_ns, CASE WHEN has_payload AND proto = 6 THEN a_to_b END AS payload_ab
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT rn, host, a_ip, a_port, b_ip, b_port, proto, packet_id, ts_ns, len, tcp_flags, egress, a_to_b, ifindex, session, start_ns, seen | tcp_flags,
    CASE WHEN proto = 6 THEN {next_state_sql("state", "tcp_flags", "egress")} ELSE 0 END,
    CASE WHEN NOT turned THEN jitter_ns WHEN least(ts_ns - payload_ns, 4294967295) >= jitter_ns THEN jitter_ns + (least(ts_ns - payload_ns, 4294967295) - jitter_ns) // 16 ELSE jitter_ns - (jitter_ns - least(ts_ns - payload_ns, 4294967295)) // 16 END,
    wait_sum_ns + CASE WHEN turned THEN ts_ns - payload_ns ELSE 0 END, waits + CASE WHEN turned THEN 1 ELSE 0 END, first_ab,
    CASE WHEN has_payload AND proto = 6 THEN ts_ns ELSE payload_ns END, CASE WHEN has_payload AND proto = 6 THEN a_to_b ELSE payload_ab END
  FROM (
    SELECT *, coalesce(has_payload AND proto = 6 AND payload_ab <> a_to_b, false) AS turned
    FROM (
      SELECT n.rn, n.host, n.a_ip, n.a_port, n.b_ip, n.b_port, n.proto, n.packet_id, n.ts_ns, n.len, n.tcp_flags, n.egress, n.a_to_b, n.ifindex, n.has_payload,
        s.session + CASE WHEN fresh THEN 1 ELSE 0 END AS session, CASE WHEN fresh THEN n.ts_ns ELSE s.start_ns END AS start_ns, CASE WHEN fresh THEN 0 ELSE s.seen END AS seen,
        CASE WHEN fresh THEN 0 ELSE s.state END AS state, CASE WHEN fresh THEN 0 ELSE s.jitter_ns END AS jitter_ns, CASE WHEN fresh THEN 0 ELSE s.wait_sum_ns END AS wait_sum_ns,
        CASE WHEN fresh THEN 0 ELSE s.waits END AS waits, CASE WHEN fresh THEN n.a_to_b ELSE s.first_ab END AS first_ab,
        CASE WHEN fresh THEN NULL ELSE s.payload_ns END AS payload_ns, CASE WHEN fresh THEN NULL ELSE s.payload_ab END AS payload_ab
      FROM (SELECT o.*, o.ts_ns - f.ts_ns > {_T.idle_ns_sql("o.proto", "f.seen")} AS fresh FROM ordered o JOIN fold f ON o.rn = f.rn + 1 AND o.host = f.host AND o.a_ip = f.a_ip AND o.a_port = f.a_port AND o.b_ip = f.b_ip AND o.b_port = f.b_port AND o.proto = f.proto) n
      JOIN fold s ON n.rn = s.rn + 1 AND n.host = s.host AND n.a_ip = s.a_ip AND n.a_port = s.a_port AND n.b_ip = s.b_ip AND n.b_port = s.b_port AND n.proto = s.proto
    ) staged
  ) turned
)"""
)

RECORDS = (
    FOLD
    + f""", numbered AS (
  SELECT *, (ts_ns - start_ns) // {_T.record * 1_000_000_000} AS interval, {community()} AS community_id,
    CASE WHEN first_ab THEN a_ip ELSE b_ip END AS src_ip, CASE WHEN first_ab THEN a_port ELSE b_port END AS src_port,
    CASE WHEN first_ab THEN b_ip ELSE a_ip END AS dst_ip, CASE WHEN first_ab THEN b_port ELSE a_port END AS dst_port
  FROM fold
), cut AS (
  SELECT host, community_id, proto, src_ip, src_port, dst_ip, dst_port, session, start_ns, interval, min(ts_ns) AS record_start_ns, max(ts_ns) AS record_end_ns, bit_or(tcp_flags) AS flags,
    count(*) FILTER (a_to_b = first_ab) AS fwd_packets_delta, count(*) FILTER (a_to_b <> first_ab) AS rev_packets_delta,
    CAST(coalesce(sum(len) FILTER (a_to_b = first_ab), 0) AS BIGINT) AS fwd_bytes_delta, CAST(coalesce(sum(len) FILTER (a_to_b <> first_ab), 0) AS BIGINT) AS rev_bytes_delta,
    max(rn) AS last_rn, max(ifindex) AS ifindex
  FROM numbered GROUP BY ALL
), records AS (
  SELECT c.host, c.community_id, c.proto, c.src_ip, c.src_port, c.dst_ip, c.dst_port, c.session, c.start_ns, c.interval, c.record_start_ns, c.record_end_ns, c.ifindex,
    c.fwd_packets_delta, c.rev_packets_delta, c.fwd_bytes_delta, c.rev_bytes_delta,
    CAST(sum(c.fwd_packets_delta) OVER w AS BIGINT) AS fwd_packets_total, CAST(sum(c.rev_packets_delta) OVER w AS BIGINT) AS rev_packets_total,
    CAST(sum(c.fwd_bytes_delta) OVER w AS BIGINT) AS fwd_bytes_total, CAST(sum(c.rev_bytes_delta) OVER w AS BIGINT) AS rev_bytes_total,
    n.seen AS tcp_flags, n.state, n.jitter_ns, n.wait_sum_ns, n.waits,
    CASE WHEN lead(c.interval) OVER (PARTITION BY c.host, c.community_id, c.session ORDER BY c.interval) IS NOT NULL THEN 'active timeout' WHEN (n.seen & 5) <> 0 THEN 'end of Flow detected' ELSE 'idle timeout' END AS end_reason
  FROM cut c JOIN numbered n ON n.host = c.host AND n.community_id = c.community_id AND n.session = c.session AND n.rn = c.last_rn
  WINDOW w AS (PARTITION BY c.host, c.community_id, c.session ORDER BY c.interval)
)"""
)

ICMP_ANSWER = sql_case("icmp_type", ICMP_ANSWERS)
