"""Identity, timing, states, direction and filters on literal packets."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from flowtide.functions import names, tcp
from flowtide.functions.addresses import KEY, community_id, in_networks, key_ports, network, to_text, with_key
from flowtide.operators import direction, filters, flows, frames, spans
from flowtide.operators.flows import SECOND, Timeouts

V6 = ("fe80:1:203:405:607:809:a0b:c0d", "fe80:1011:1213:1415:1617:1819:1a1b:1c1d")
V4 = ("1.2.3.4", "5.6.7.8")
VECTORS = [
    (*V4, 1122, 3344, 6, 0, "1:wCb3OG7yAFWelaUydu0D+125CLM="),
    (*V4[::-1], 3344, 1122, 6, 0, "1:wCb3OG7yAFWelaUydu0D+125CLM="),
    (*V4, 1122, 3344, 17, 0, "1:0Mu9InQx6z4ZiCZM/7HXi2WMhOg="),
    (*V4, 1122, 3344, 132, 0, "1:EKt4MsxuyaE6mL+hmrEkQ9csDD8="),
    (*V4, 8, 0, 1, 0, "1:crodRHL2FEsHjbv3UkRrfbs4bZ0="),
    (*V4[::-1], 0, 0, 1, 0, "1:crodRHL2FEsHjbv3UkRrfbs4bZ0="),
    (*V4, 11, 0, 1, 0, "1:f/YiSyWqczrTgfUCZlBUnvHRcPk="),
    (*V6, 128, 0, 58, 0, "1:0bf7hyMJUwt3fMED7z8LIfRpBeo="),
    (*V6[::-1], 129, 0, 58, 0, "1:0bf7hyMJUwt3fMED7z8LIfRpBeo="),
    (*V6, 155, 0, 58, 0, "1:EvBBWYT0zEU0Gg9GDmH7rd7Mxk0="),
    (*V6[::-1], 155, 0, 58, 0, "1:Zb019rYpqfcZisDbVT+l16mxt+Y="),
    (*V4, 0, 0, 46, 0, "1:hZHQjvhiT2t0BQWM3zNp/Kq7jHw="),
    (*V6, 0, 0, 46, 0, "1:oYO4dR7oS+6Hep4XUZjUlYLWEJo="),
    (*V4, 1122, 3344, 6, 1, "1:HhA1B+6CoLbiKPEs5nhNYN4XWfk="),
]


@pytest.mark.parametrize("seed", [0, 1])
def test_community_ids(spark, seed):
    rows = [(ipaddress.ip_address(a).packed, ipaddress.ip_address(b).packed, p, q, n, want) for a, b, p, q, n, s, want in VECTORS if s == seed]
    df = spark.createDataFrame([tuple(map(lambda x: bytearray(x) if isinstance(x, bytes) else x, r)) for r in rows], "a binary, b binary, p int, q int, proto int, want string")
    first, second = key_ports(F.col("proto"), F.col("p"), F.col("q"))
    got = df.select(community_id(F.col("a"), F.col("b"), first, second, F.col("proto"), seed).alias("id"), "want").collect()
    assert all(r.id == r.want for r in got)


def packet_frame(spark, rows):
    """(ts, from_a, flags, payload, len) of one conversation a -> b."""
    a, b = bytearray(ipaddress.ip_address("10.0.0.1").packed), bytearray(ipaddress.ip_address("10.0.0.2").packed)
    data = [(ts, a if fa else b, b if fa else a, 12345 if fa else 80, 80 if fa else 12345, 6, n, fl, "egress" if fa else "ingress", p, 0, 1) for ts, fa, fl, p, n in rows]
    return spark.createDataFrame(data, "ts_ns long, src_ip binary, dst_ip binary, src_port int, dst_port int, proto int, len long, tcp_flags int, direction string, has_payload boolean, host int, ifindex int")


def test_bidirectional(spark):
    rows = [(i, True, 16, False, 64) for i in range(10)] + [(20 + i, False, 16, False, 64) for i in range(8)]
    (f,) = flows.flow_aggregate(packet_frame(spark, rows), ["ts_ns"]).collect()
    assert (f.fwd_packets, f.fwd_bytes, f.rev_packets, f.rev_bytes) == (10, 640, 8, 512)
    assert bytes(f.src_ip) == b"\n\x00\x00\x01" and (f.src_port, f.dst_port) == (12345, 80)


def test_timing_and_jitter(spark):
    rows = [(1000, True, 2, False, 60), (1200, False, 18, False, 60), (2000, True, 24, True, 90), (2100, False, 24, True, 90), (3000, True, 24, True, 90), (3116, False, 24, True, 90)]
    packets = packet_frame(spark, rows)
    (t,) = flows.tcp_timing(packets, ["ts_ns"]).collect()
    assert (t.handshake_ns, t.latency_sum_ns, t.transactions) == (200, 1116, 3)
    folded = flows.session_fold(packets, ["ts_ns"]).orderBy("ts_ns").collect()
    assert [r.jitter_ns for r in folded] == [0, 0, 0, 6, 61, 64]


STATES = {n: k for k, n in names.STATES.items()}
S, A, FN, R = tcp.SYN, tcp.ACK, tcp.FIN, tcp.RST
WALKS = [
    ([(S, 1), (S | A, 0), (A, 1)], ["syn_sent", "established", "established"]),
    ([(S, 0), (S | A, 1), (A, 0)], ["syn_received", "syn_received", "established"]),
    ([(A, 1), (FN | A, 1), (A, 0), (FN | A, 0)], ["established", "fin_wait_1", "fin_wait_2", "time_wait"]),
    ([(A, 0), (FN | A, 0), (FN | A, 1), (A, 0)], ["established", "close_wait", "last_ack", "closed"]),
    ([(A, 1), (FN, 1), (FN, 0), (A, 0)], ["established", "fin_wait_1", "closing", "time_wait"]),
    ([(A, 1), (FN, 1), (FN | A, 0)], ["established", "fin_wait_1", "time_wait"]),
    ([(A, 1), (R, 0)], ["established", "closed"]),
    ([(FN, 0)], ["close_wait"]),
    ([(8, 1)], ["closed"]),
]


def test_states(spark):
    for walk, want in WALKS:
        state, seen = 0, []
        for flags, egress in walk:
            state = tcp.next_state_number(state, flags, bool(egress))
            seen.append(names.STATES[state])
        assert seen == want
    grid = [(s, f, e) for s in STATES.values() for f in range(32) for e in (True, False)]
    df = spark.createDataFrame(grid, "s int, f int, e boolean")
    got = df.select("s", "f", "e", tcp.next_state(F.col("s"), F.col("f"), F.col("e")).alias("n")).collect()
    assert all(r.n == tcp.next_state_number(r.s, r.f, r.e) for r in got)


def test_sessions_and_records(spark):
    s = SECOND
    rows = [(0, True, 2, False, 60), (15 * s, False, 18, False, 60), (30 * s, True, 17, False, 60), (34 * s, False, 16, False, 60), (40 * s, True, 16, False, 60)]
    folded = flows.session_fold(packet_frame(spark, rows), ["ts_ns"]).orderBy("ts_ns").collect()
    assert [r.session for r in folded] == [0, 0, 0, 0, 1]  # after FIN, 5 s without packets end the session
    busy = [(i * 10 * s, i % 2 == 0, 16, False, 100) for i in range(13)]
    records = flows.interval_records(flows.session_fold(packet_frame(spark, busy), ["ts_ns"])).orderBy("interval").collect()
    assert [(r.interval, r.fwd_packets_delta + r.rev_packets_delta, r.fwd_packets_total + r.rev_packets_total, r.end_reason) for r in records] == [(0, 6, 6, "active timeout"), (1, 6, 12, "active timeout"), (2, 1, 13, "idle timeout")]
    assert Timeouts().record == 60


def test_hosts_are_apart(spark):
    """Two hosts that see the same packets have twice the sessions, each as one host alone."""
    s = SECOND
    rows = [(i * 7 * s, i % 3 != 0, (16, 24, 18, 17, 24)[i % 5], i % 5 in (1, 4), 60 + i) for i in range(60)]
    one = packet_frame(spark, rows)
    two = one.unionByName(one.withColumn("host", F.lit(1)))
    plain = lambda df: [r.asDict() | {"host": 0} for r in df.orderBy("host", "start_ns").collect()]
    alone, both = plain(flows.sessions(flows.session_fold(one, ["ts_ns"]))), plain(flows.sessions(flows.session_fold(two, ["ts_ns"])))
    assert len(alone) > 3 and both == alone + alone
    alone, both = (flows.interval_records(flows.session_fold(p, ["ts_ns"])).drop("host") for p in (one, two))
    assert sorted(map(str, both.collect())) == sorted(map(str, alone.collect() * 2))


def test_fold_over_batches_and_runs(spark, monkeypatch):
    """The fold depends neither on where batches end nor on whether a flow's runs are dealt apart."""
    s = SECOND
    rows = [((i * 37 % 11 + i * 3 + i // 50 * 90) * s, i % 3 != 0, (16, 24, 18, 17, 24, 4, 8)[i % 7], i % 7 in (1, 4), 60) for i in range(400)]
    found, columns = [], ["ts_ns", "session", "start_ns", "seen", "state", "jitter_ns", "wait_sum_ns", "waits", "first_a_to_b"]
    packets, key = packet_frame(spark, rows), ["host", *KEY]
    assert flows.with_runs(with_key(packets), key, Timeouts()).select("run").distinct().count() == 8
    for size in (10_000, 1, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(str, flows.session_fold(packets, ["ts_ns"]).select(columns).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(flows, "with_runs", lambda keyed, key, timeouts: keyed.withColumn("run", F.lit(0)))
    found.append(sorted(map(str, flows.session_fold(packets, ["ts_ns"]).select(columns).collect())))
    assert all(f == found[0] for f in found) and len(found[0]) == 400


def test_snapshots(spark):
    df = spark.createDataFrame([(1, 5, 10, 640), (1, 10, 25, 1600), (1, 15, 25, 1600), (1, 20, 5, 100), (1, 25, 9, 300)], "flow int, at int, packets long, bytes long")
    got = flows.snapshot_deltas(df, ["flow"], "at", ["packets", "bytes"]).orderBy("at").collect()
    assert [(r.at, r.packets_delta, r.bytes_delta) for r in got] == [(5, 10, 640), (10, 15, 960), (25, 4, 200)]


KINDS = [  # proto, first flags, source port, target port, icmp type, hook direction, want
    (6, 2, 50000, 80, None, "egress", "CLIENT"),
    (6, 2, 50000, 80, None, "ingress", "SERVER"),
    (6, 18, 80, 50000, None, "ingress", "CLIENT"),
    (6, 18, 80, 50000, None, "egress", "SERVER"),
    (6, 16, 50000, 80, None, "egress", "CLIENT"),
    (6, 16, 50000, 80, None, "ingress", "SERVER"),
    (6, 24, 50000, 80, None, "ingress", "CLIENT"),
    (17, 0, 53, 40000, None, "egress", "SERVER"),
    (17, 0, 40000, 50000, None, "egress", "SERVER"),
    (17, 0, 50000, 40000, None, "egress", "CLIENT"),
    (17, 0, 40000, 40000, None, "egress", "INTERNAL"),
    (17, 0, 80, 53, None, "egress", "INTERNAL"),
    (1, 0, 0, 0, 8, "egress", "CLIENT"),
    (1, 0, 0, 0, 0, "ingress", "CLIENT"),
    (1, 0, 0, 0, 8, "ingress", "SERVER"),
    (1, 0, 0, 0, 14, "egress", "SERVER"),
    (1, 0, 0, 0, 3, "egress", "INTERNAL"),
    (58, 0, 0, 0, 128, "egress", "CLIENT"),
    (58, 0, 0, 0, 131, "egress", "SERVER"),
    (47, 0, 0, 0, None, "egress", "INTERNAL"),
]


def test_direction(spark):
    rows = [(i, *r[:6], 0) for i, r in enumerate(KINDS)]
    df = spark.createDataFrame(rows, "i int, proto int, fwd_first_flags int, src_port int, dst_port int, icmp_type int, direction string, host int")
    none = spark.createDataFrame([], "host int, proto int, port int")
    got = direction.with_kind(direction.with_listening(df, none), icmp_type="icmp_type").orderBy("i").collect()
    assert [r.kind for r in got] == [r[6] for r in KINDS]
    listening = spark.createDataFrame([(0, 17, 53)], "host int, proto int, port int")
    told = {r.i: r.kind for r in direction.with_kind(direction.with_listening(df, listening), icmp_type="icmp_type").collect()}
    assert told[7] == "SERVER" and told[11] == "CLIENT"


def test_networks_and_numbers(spark):
    assert network("10.0.0.0/8") and network("::1") and network("nonsense") is None
    df = spark.createDataFrame([(bytearray(ipaddress.ip_address(a).packed), a, p) for a, p in (("10.1.2.3", 80), ("11.0.0.1", 443), ("fe80::1", 8500), ("200.1.1.1", 22))], "ip binary, text string, port int")
    keep = lambda c: sorted(r.text for r in df.filter(c).collect())
    assert keep(in_networks(F.col("ip"), ["10.0.0.0/8", "200.1.1.1", "fe80::/10", "x/y"])) == ["10.1.2.3", "200.1.1.1", "fe80::1"]
    assert keep(filters.numbers(F.col("port"), ["80", "8000-9000", "9-1", "z"])) == ["10.1.2.3", "fe80::1"]
    rule = filters.Rule(["1-65535"], ["22"])
    assert keep(rule.keep(lambda items: filters.numbers(F.col("port"), items))) == ["10.1.2.3", "11.0.0.1", "fe80::1"]
    assert {r.t for r in df.select(to_text(F.col("ip")).alias("t")).collect()} >= {"10.1.2.3", "200.1.1.1"}


def test_globs(spark):
    cases = {("t[bc]p", "tcp"): True, ("t[!c]p", "tcp"): False, ("eth[0-9]", "eth3"): True, ("eth?", "eth10"): False, ("ETH*", "eth10"): True, ("{tcp,udp}", "udp"): True, ("a.c", "abc"): False, ("[", "["): True}
    for (pattern, text), want in cases.items():
        assert spark.range(1).select(filters.globs(F.lit(text), [pattern])).first()[0] is want, pattern


def test_flag_rule(spark):
    rule = {"flow_tcp_flags_tags": filters.Rule(["syn", "ack"], ["rst"])}
    df = spark.createDataFrame([(18, 6), (16, 6), (4, 6), (6, 6), (0, 17), (8, 6)], "tcp_flags int, proto int")
    assert [r.tcp_flags for r in filters.filter_flows(df, rule).orderBy("tcp_flags").collect()] == [0, 16, 18]
    unknown = spark.createDataFrame([(6, None, bytearray(4)), (6, 5, bytearray(4))], "proto int, ttl int, src_ip binary")
    assert filters.filter_flows(unknown, {"flow_ip_ttl": filters.Rule(["9"])}).count() == 1  # null can't be judged: kept


def test_frames(spark):
    eth = bytes(6) + bytes.fromhex("0a0000000001")
    v4 = lambda proto, ihl=5: bytes([0x40 | ihl, 0xB8, 0, 0, 0, 0, 0, 0, 63, proto, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8]) + bytes(4 * max(0, ihl - 5))
    tcp_ = bytes.fromhex("04620d10" + "00" * 8 + "5012" + "00" * 6)
    v6 = bytes.fromhex("6ab12345" + "0014" + "0640") + bytes(range(32))
    made = {
        "tcp": (eth + b"\x08\x00" + v4(6) + tcp_, None),
        "options": (eth + b"\x08\x00" + v4(6, 7) + tcp_, None),
        "v6": (eth + b"\x86\xdd" + v6 + tcp_, None),
        "icmp": (eth + b"\x08\x00" + v4(1) + b"\x08\x00\x00\x00", None),
        "short": (eth, 2),
        "arp": (eth + b"\x08\x06" + bytes(40), 3),
        "ihl": (eth + b"\x08\x00" + v4(6, 4) + tcp_, 1),
        "version": (eth + b"\x08\x00" + b"\x65" + v4(6)[1:] + tcp_, 1),
        "proto": (eth + b"\x08\x00" + v4(89) + tcp_, 4),
        "cut": (eth + b"\x08\x00" + v4(6) + tcp_[:10], 2),
    }
    df = spark.createDataFrame([(k, bytearray(f), len(f) + (5 if k == "tcp" else 0)) for k, (f, _) in made.items()] + [("null", None, None)], "name string, frame binary, len long")
    got = {r.name: r for r in frames.decode(df).collect()}
    assert {k: r.error for k, r in got.items()} == {k: e for k, (_, e) in made.items()} | {"null": 2}
    t, o, s = got["tcp"], got["options"], got["v6"]
    assert (t.src_port, t.dst_port, t.tcp_flags, t.dscp, t.ecn, t.ttl, t.has_payload, t.src_mac) == (1122, 3344, 18, 46, 0, 63, True, "0a:00:00:00:00:01")
    assert (o.src_port, o.l4_offset, o.has_payload) == (1122, 42, False)
    assert (s.flow_label, s.dscp, s.ecn, s.ttl, bytes(s.src_ip)) == (0x12345, 0xAB >> 2, 3, 0x40, bytes(range(16)))
    assert (got["icmp"].icmp_type, got["icmp"].src_port) == (8, 0)


def test_spans(spark):
    name = lambda kind, proto: spark.range(1).select(spans.span_name(F.lit(kind), F.lit(proto))).first()[0]
    assert [name("ipv4", 6), name("ipv6", 58), name("arp", 0), name("ipv6", 17), name("ipv4", 200)] == ["flow_ipv4_tcp", "flow_ipv6_icmpv6", "flow_arp", "flow_ipv6_udp", "flow_ipv4_200"]
    df = spark.createDataFrame([(1, None, {"a": "x"}, ["p", "q"])], "b int, n string, m map<string,string>, l array<string>")
    got = df.select(spans.attributes({"flow.b": "b", "flow.n": "n"}, {"pod.label": "m"}, {"policies": "l"}).alias("a")).first().a
    assert got == {"flow.b": "1", "pod.label.a": "x", "policies": "p,q"}
    day = spans.DAY_NS
    records = spark.createDataFrame([("x", 5), ("x", day), ("x", day + 5), ("y", 5)], "community_id string, at long")
    ids = [r.trace_id for r in spans.trace_ids(records, "at").orderBy("community_id", "at").collect()]
    assert ids[0] == ids[1] != ids[2] and len(set(ids)) == 3 and all(len(i) == 32 for i in ids)
    batches = spans.otlp(spark.range(10).coalesce(1).withColumn("host", F.lit(1)), ["host"], "scope", 4)
    sizes = sorted(len(r.resourceSpans[0].scopeSpans[0].spans) for r in batches.collect())
    assert sizes == [2, 4, 4]
