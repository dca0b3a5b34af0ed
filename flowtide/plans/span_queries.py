"""Registered queries over frames, spans and host tables."""

from pyspark.sql import functions as F

from ..functions import names
from ..functions.addresses import to_text
from ..operators import flows, frames, metrics, spans
from ..sources.frames import ipv4_frames
from ..sources.packets import BOOT_NS, LINES
from . import sqltext as S
from .inventory_queries import DECORATED, decorated
from .packet_queries import folded_events, readable

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH {LINES.cte()} SELECT {S.dotted('src_ip')} AS src_ip, {S.dotted('dst_ip')} AS dst_ip, src_port, dst_port, proto, tcp_flags, dscp, ecn, ttl,
  '02:00:00:00:00:' || lpad(CAST(ifindex AS VARCHAR), 2, '0') AS src_mac, len > CASE WHEN proto = 6 THEN 54 ELSE 42 END AS has_payload, count(*) AS packets FROM packets GROUP BY ALL"""
)
def decoded_frames(spark, sf_dir):
    """Packets as frames and back."""
    raw = ipv4_frames(LINES.read(spark, sf_dir)).select("frame", "len")
    parsed = frames.parsed(frames.decode(raw))
    columns = ["src_ip", "dst_ip", "src_port", "dst_port", "proto", "tcp_flags", "dscp", "ecn", "ttl", "src_mac", "has_payload"]
    return readable(parsed).groupBy(*columns).agg(F.count("*").alias("packets"))


@query(f"WITH {LINES.cte()} SELECT CASE WHEN ln % 7 = 0 THEN CASE WHEN proto = 6 THEN 'malformed header' ELSE 'out of bounds' END WHEN ln % 7 = 1 THEN 'unsupported ether type' WHEN ln % 7 = 2 THEN 'unsupported protocol' END AS error, ifindex, direction, count(*) AS n FROM packets WHERE ln % 7 < 3 GROUP BY ALL")
def rejected_frames(spark, sf_dir):
    """Frames that are damaged in one of four ways, by what is wrong with them."""
    made = ipv4_frames(LINES.read(spark, sf_dir))
    f, way = F.col("frame"), F.col("ln") % 7
    part = lambda a, n: F.substring(f, F.lit(a), F.lit(n))
    broken = F.when((way == 0) & (F.col("proto") == 6), F.concat(part(1, 14), F.unhex(F.lit("43")), part(16, 200))).when(way == 0, part(1, 36)).when(way == 1, F.concat(part(1, 12), F.unhex(F.lit("0806")), part(15, 200))).when(way == 2, F.concat(part(1, 23), F.unhex(F.lit("59")), part(25, 200))).otherwise(f)
    rejects = frames.rejects(frames.decode(made.withColumn("frame", broken).select("frame", "len", "ifindex", "direction")))
    return metrics.count_by(rejects.withColumn("error", names.lookup(F.col("error"), names.CAPTURE_ERRORS)), "error", "ifindex", "direction")


_TUNNEL_SQL = f"{S.dotted('src_ip')} AS src_ip, {S.dotted('dst_ip')} AS dst_ip"


@query(f"WITH {LINES.cte()} SELECT {_TUNNEL_SQL}, src_port, dst_port, CASE ln % 3 WHEN 0 THEN 'vxlan' WHEN 1 THEN 'geneve' END AS tunnel_type, CASE WHEN ln % 3 < 2 THEN CAST(tie1 % 5000 AS INT) END AS tunnel_vni, CASE WHEN ln % 3 < 2 THEN '172.16.0.1' END AS outer_src_ip, count(*) AS packets FROM packets GROUP BY ALL")
def tunnelled_packets(spark, sf_dir):
    """Two in three packets inside a VXLAN or a Geneve tunnel (with options), taken out of it again."""
    made = ipv4_frames(LINES.read(spark, sf_dir))
    way, vni = F.col("ln") % 3, F.lpad(F.hex((F.col("tie1") % 5000).cast("long")), 6, "0")
    ip = "45000000000000004011" + "0000" + "AC100001" + "AC100002"
    head = lambda port: F.lit("02000000000A02000000000B0800" + ip + "C000" + port + "00000000")
    vxlan = F.unhex(F.concat(head("12B5"), F.lit("08000000"), vni, F.lit("00")))
    geneve = F.unhex(F.concat(head("17C1"), F.lit("02006558"), vni, F.lit("00"), F.lit("0102030405060708")))
    wrapped = F.when(way == 0, F.concat(vxlan, "frame")).when(way == 1, F.concat(geneve, "frame")).otherwise(F.col("frame"))
    out = frames.decapsulate(made.select(wrapped.alias("frame"), F.col("len")))
    columns = ["src_ip", "dst_ip", "src_port", "dst_port", "tunnel_type", "tunnel_vni", "outer_src_ip"]
    return readable(out).withColumn("outer_src_ip", F.when(F.col("outer_src_ip").isNotNull(), to_text(F.col("outer_src_ip")))).groupBy(*columns).agg(F.count("*").alias("packets"))


@query(f"WITH {LINES.cte()} SELECT proto, (proto IN (6, 17) AND (src_port IN (443, 8080, 51820) OR dst_port IN (443, 8080, 51820))) AS tunnel, count(*) AS packets FROM packets GROUP BY ALL")
def tunnel_test(spark, sf_dir):
    """The tunnel test with ports of a user's choice."""
    c = F.col
    return LINES.read(spark, sf_dir).groupBy("proto", frames.is_tunnel(c("proto"), c("src_port"), c("dst_port"), 443, 8080).alias("tunnel")).agg(F.count("*").alias("packets"))


_SPAN_FIELDS = {"flow.bytes.delta": "fwd_bytes_delta", "flow.reverse.bytes.delta": "rev_bytes_delta", "flow.connection.state": "state_text", "network.transport": "transport", "source.port": "src_port", "destination.port": "dst_port", "flow.end_reason": "end_reason"}
_TRANSPORT = names.sql_case("proto", names.PROTOCOLS)


@query(
    f"""WITH {S.RECORDS}, t AS (SELECT *, {_TRANSPORT} AS transport, CASE WHEN proto = 6 THEN {names.sql_case("state", names.STATES)} END AS state_text, min(record_end_ns) OVER (PARTITION BY community_id) AS first_ns FROM records)
SELECT 'flow_ipv4_' || transport AS name, record_start_ns + {BOOT_NS} AS start_ns, record_end_ns + {BOOT_NS} AS end_ns,
  substr(sha256(community_id || '|' || (((record_end_ns - first_ns) // 600000000000) * 600000000000 + first_ns)), 1, 32) AS trace_id,
  concat_ws(';', 'destination.port=' || dst_port, 'flow.bytes.delta=' || fwd_bytes_delta, CASE WHEN state_text IS NOT NULL THEN 'flow.connection.state=' || state_text END, 'flow.end_reason=' || end_reason, 'flow.reverse.bytes.delta=' || rev_bytes_delta, 'flow.tcp.flags.tags=' || concat_ws(',', {", ".join(f"CASE WHEN (tcp_flags & {1 << i}) <> 0 THEN '{n}' END" for i, n in enumerate(names.FLAGS))}), 'network.transport=' || transport, 'source.port=' || src_port) AS attributes FROM t"""
)
def flow_spans(spark, sf_dir):
    """Interval records as spans; the trace id lasts ten minutes here, so that it changes within the table."""
    records = flows.interval_records(folded_events(spark, sf_dir))
    named = records.withColumns({"transport": names.protocol_name(F.col("proto")), "state_text": F.when(F.col("proto") == 6, F.col("state")), "tags": names.flag_tags(F.col("tcp_flags"))})
    ided = spans.trace_ids(named, "record_end_ns", 600 * flows.SECOND)
    start, end = spans.in_order(F.col("record_start_ns") + BOOT_NS, F.col("record_end_ns") + BOOT_NS)
    made = ided.select(spans.span_name(F.lit("ipv4"), F.col("proto")).alias("name"), start.alias("start_ns"), end.alias("end_ns"), "trace_id", spans.attributes(_SPAN_FIELDS, lists={"flow.tcp.flags.tags": "tags"}).alias("map"))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("map")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return made.withColumn("attributes", flat).drop("map")


@query(f"WITH {DECORATED}, b AS (SELECT host, count(*) AS spans FROM decorated GROUP BY ALL) SELECT host, spans FROM b")
def otlp_batches(spark, sf_dir):
    """Spans of decorated flows in OTLP's shape, counted by the resource they carry."""
    made = decorated(spark, sf_dir).select("host", "community_id", "first_ns", "last_ns", "src_name", "dst_name")
    batches = spans.otlp(made, ["host"], "flows", 1024)
    one = batches.select(F.inline("resourceSpans")).select(F.col("resource.attributes")[0]["value"].cast("int").alias("host"), F.explode("scopeSpans").alias("s"))
    return one.groupBy("host").agg(F.sum(F.size("s.spans")).alias("spans"))


@query(
    f"""WITH {LINES.cte()}, s AS (SELECT ifindex, direction, max(ts_ns) AS last_active FROM packets GROUP BY ALL), t AS (SELECT max(ts_ns) AS now FROM packets), m AS (SELECT max(last_active) AS top FROM s)
SELECT ifindex, direction, last_active FROM s, t WHERE ifindex <> 3 OR last_active > now // 2"""
)
def live_series(spark, sf_dir):
    """Traffic series without those of interfaces that vanished (here: interface 3, half-way) and stayed silent."""
    packets = LINES.read(spark, sf_dir)
    series = packets.groupBy("ifindex", "direction").agg(F.max("ts_ns").alias("last_active"))
    times = packets.agg(F.max("ts_ns").alias("now"))
    gone = packets.filter("ifindex = 3").select("ifindex").distinct().withColumn("deleted_at", times.select(F.expr("now DIV 2")).scalar())
    return metrics.expire_series(series, gone, "ifindex", times.scalar(), 300)
