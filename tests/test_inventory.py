"""Inventory, attribution, selectors, policies and host tables on literal objects; all queries against their SQL."""

import ipaddress
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from flowtide.operators import enrich, filters, metrics, selectors
from flowtide.plans import registry
from flowtide.sources import host, inventory

SF = "/root/testdata/sf0.001"


def packed(text):
    return bytearray(ipaddress.ip_address(text).packed)


def test_json_objects(spark):
    dump = [
        {"kind": "Pod", "metadata": {"name": "p", "namespace": "n", "uid": "u1", "labels": {"app": "web"}, "ownerReferences": [{"kind": "ReplicaSet", "name": "rs"}]}, "status": {"podIPs": [{"ip": "10.0.0.1"}, {"ip": "fd00::1"}]}},
        {"kind": "Pod", "metadata": {"name": "h", "namespace": "n"}, "spec": {"hostNetwork": True}, "status": {"hostIPs": [{"ip": "10.9.0.1"}]}},
        {"kind": "Service", "metadata": {"name": "s", "namespace": "n"}, "spec": {"clusterIPs": ["None", "10.2.0.1"], "externalIPs": ["1.1.1.1"], "application": {"podSelector": {"matchLabels": {"app": "custom"}}}}},
        {"kind": "Node", "metadata": {"name": "node", "deletionTimestamp": "now"}, "status": {"addresses": [{"type": "InternalIP", "address": "10.9.0.1"}, {"type": "Hostname", "address": "x"}]}},
    ]
    lines = spark.createDataFrame([(json.dumps(d),) for d in dump], "value string")
    got = {r.name: r for r in inventory.from_json(lines).collect()}
    assert got["p"].ips == ["10.0.0.1", "fd00::1"] and got["p"].labels == {"app": "web"} and got["p"].owner_refs[0].name == "rs"
    assert got["h"].ips == ["10.9.0.1"] and got["s"].ips == ["10.2.0.1", "1.1.1.1"] and got["node"].ips == ["10.9.0.1"]
    assert got["node"].deleting and not got["p"].deleting
    custom = inventory.selector_at(inventory.from_json(lines), "spec.application.podSelector.matchLabels").filter("name = 's'").first()
    assert custom.match_labels == {"app": "custom"}


def test_validity(spark):
    changes = spark.createDataFrame([("u", "apply", 1, ["a"]), ("u", "apply", 5, ["a"]), ("u", "apply", 7, ["b"]), ("u", "delete", 9, None)], "uid string, event string, ts_ns long, ips array<string>")
    got = inventory.validity(changes).orderBy("ts_ns").collect()
    assert [(r.valid_from, r.valid_to, r.ips_changed) for r in got] == [(1, 5, True), (5, 7, False), (7, 9, True)]


def test_ip_conflict(spark):
    ip = packed("10.104.7.192")
    rows = [("Pod", "n", "regular", False), ("Pod", "n", "hostpod", True), ("Node", "", "node", False)]
    objects = spark.createDataFrame([(k, ns, n, h, [ip]) for k, ns, n, h in rows], "kind string, namespace string, name string, host_network boolean, ips array<binary>")
    flow = spark.createDataFrame([(ip, packed("9.9.9.9"), 5)], "src_ip binary, dst_ip binary, at long")
    (got,) = enrich.decorate(flow, enrich.ip_index(objects), "at").collect()
    assert (got.src_name, got.dst_name, got.decorator_status) == ("hostpod", None, "partial")
    (got,) = enrich.decorate(flow, enrich.ip_index(objects.filter("name <> 'hostpod'")), "at").collect()
    assert got.src_name == "node"
    (got,) = enrich.decorate(flow, enrich.ip_index(objects.filter("name = 'regular'")), "at").collect()
    assert got.src_name == "regular"


def test_ports_break_ties(spark):
    """Among pods of one address the one with the flow's port goes first; kinds keep their order."""
    ip = packed("10.0.0.9")
    rows = [("Pod", "a", [("TCP", 80)]), ("Pod", "b", [("UDP", 443), ("TCP", 443)]), ("Service", "s", [("TCP", 9090)])]
    objects = spark.createDataFrame([(k, "n", n, [ip], p) for k, n, p in rows], "kind string, namespace string, name string, ips array<binary>, ports array<struct<protocol: string, port: int>>")
    flow = spark.createDataFrame([(ip, packed("9.9.9.9"), 5, proto, port, 1) for proto, port in ((6, 443), (17, 443), (6, 80), (6, 9090))], "src_ip binary, dst_ip binary, at long, proto int, src_port int, dst_port int")
    got = {(r.proto, r.src_port): r.src_name for r in enrich.decorate(flow, enrich.ip_index(objects), "at").collect()}
    assert got == {(6, 443): "b", (17, 443): "b", (6, 80): "a", (6, 9090): "a"}


def test_relist(spark):
    changes = spark.createDataFrame([("u", "apply", 1, ["a"]), ("v", "apply", 2, ["b"]), (None, "init", 5, None), ("v", "apply", 6, ["b"]), (None, "init_done", 8, None), ("u", "apply", 20, ["a"])], "uid string, event string, ts_ns long, ips array<string>")
    got = sorted((r.uid, r.valid_from, r.valid_to) for r in inventory.validity(changes).collect())
    assert got == [("u", 1, 8), ("u", 20, inventory.FOREVER), ("v", 2, 6), ("v", 6, inventory.FOREVER)]


def test_several_owners(spark):
    """From JSON objects with several owners a level, some of them shared; the nearest 32 stay."""
    ref = lambda k, n: {"kind": k, "name": n}
    meta = lambda k, n, *refs: {"kind": k, "metadata": {"name": n, "namespace": "n", "ownerReferences": list(refs)}}
    dump = [meta("Pod", "p", ref("ReplicaSet", "r"), ref("Job", "j")), meta("ReplicaSet", "r", ref("Deployment", "d")), meta("Job", "j", ref("CronJob", "c"), ref("Deployment", "d")), meta("Pod", "many", *[ref("X", f"x{i}") for i in range(40)])]
    objects = inventory.from_json(spark.createDataFrame([(json.dumps(d),) for d in dump], "value string"))
    got = enrich.owner_chain(objects.filter("kind = 'Pod'"), objects)
    assert sorted((r.depth, r.kind, r.name) for r in got.filter("pod = 'p'").collect()) == [(1, "Job", "j"), (1, "ReplicaSet", "r"), (2, "CronJob", "c"), (2, "Deployment", "d")]
    assert got.filter("pod = 'many'").count() == 32


def test_owner_chain(spark):
    pods = spark.createDataFrame([("n", "p", "ReplicaSet", "rs"), ("n", "lone", None, None)], "namespace string, name string, owner_kind string, owner_name string")
    objects = spark.createDataFrame([("n", "ReplicaSet", "rs", "Deployment", "d"), ("n", "Deployment", "d", None, None), ("m", "ReplicaSet", "rs", "Deployment", "other")], "namespace string, kind string, name string, owner_kind string, owner_name string")
    chain = lambda **k: [(r.depth, r.kind, r.name) for r in enrich.owner_chain(pods, objects, **k).orderBy("depth").collect()]
    assert chain() == [(1, "ReplicaSet", "rs"), (2, "Deployment", "d")]
    assert chain(include=["deployment"]) == [(2, "Deployment", "d")]
    assert chain(include=["deployment"], exclude=["Deployment"]) == []
    assert chain(depth=1) == [(1, "ReplicaSet", "rs")]


SELECTORS = [
    ({"app": "web"}, None, True),
    ({"app": "api"}, None, False),
    (None, [("tier", "In", ["a", "b"])], True),
    (None, [("tier", "NotIn", ["a"])], False),
    (None, [("absent", "NotIn", ["a"])], True),
    (None, [("tier", "Exists", [])], True),
    (None, [("absent", "Exists", [])], False),
    (None, [("absent", "DoesNotExist", [])], True),
    (None, [("tier", "Near", ["a"])], False),
    ({"app": "web"}, [("tier", "In", ["z"])], False),
    (None, None, True),
]


def test_selectors(spark):
    rows = [(i, {"app": "web", "tier": "a"}, (labels, tests), want) for i, (labels, tests, want) in enumerate(SELECTORS)]
    df = spark.createDataFrame(rows, f"i int, labels map<string,string>, selector {selectors.SELECTOR}, want boolean")
    assert all(r.got == r.want for r in df.select(selectors.matches(F.col("labels"), F.col("selector")).alias("got"), "want").collect())


def test_whitelist_and_merge(spark):
    objects = spark.createDataFrame([("Pod", "n", {"a": "1"}), ("Pod", "m", {"a": "1"}), ("Service", "n", {}), ("Node", "", {})], "kind string, namespace string, labels map<string,string>")
    rules = [{"kind": "pod", "namespaces": ["n"], "match_labels": {"a": "1"}}, {"kind": "Service"}]
    assert sorted(r.kind for r in selectors.whitelisted(objects, rules).collect()) == ["Pod", "Service"]
    tests = [{"kind": "Pod", "match_expressions": [{"key": "a", "operator": "In", "values": ["1"]}]}]
    assert selectors.whitelisted(objects, tests).count() == 2
    kinds = lambda *k: spark.createDataFrame([(x, w) for x, w in k], "kind string, whose string")
    merged = selectors.merged_rules(kinds(("Pod", "default"), ("Node", "default")), kinds(("pod", "own"), ("pod", "own")))
    assert sorted((r.kind, r.whose) for r in merged.collect()) == [("Node", "default"), ("pod", "own"), ("pod", "own")]


def policy_case(spark, rule, port=443, proto=6, dst_ip="10.0.0.2"):
    pods = spark.createDataFrame([("n", "web", {"app": "web"}, [("main", "img", 443, "https")]), ("m", "db", {"app": "db"}, [("main", "img", 443, "https")])], "namespace string, name string, labels map<string,string>, containers array<struct<name: string, image: string, port: int, port_name: string>>")
    spaces = spark.createDataFrame([("n", {"env": "prod"}), ("m", {"env": "dev"})], "name string, labels map<string,string>")
    peer = "struct<low: binary, high: binary, excepted: array<struct<low: binary, high: binary>>, pod_selector: {0}, namespace_selector: {0}>".format(selectors.SELECTOR)
    schema = f"namespace string, name string, pod_selector {selectors.SELECTOR}, rules array<struct<way: string, peers: array<{peer}>, ports: array<struct<protocol: string, port: int, end_port: int, port_name: string>>>>"
    policies = spark.createDataFrame([("n", "np", (None, None), [rule])], schema)
    flow = spark.createDataFrame([(proto, packed("10.0.0.1"), packed(dst_ip), port, "Pod", "n", "web", "Pod", "m", "db")], "proto int, src_ip binary, dst_ip binary, dst_port int, src_kind string, src_namespace string, src_name string, dst_kind string, dst_namespace string, dst_name string")
    return enrich.permitting_policies(flow, pods, spaces, policies, []).first().egress_policies == ["n/np"]


def test_policies(spark):
    block = (packed("10.0.0.0"), packed("10.0.0.255"), None, None, None)
    holed = (packed("10.0.0.0"), packed("10.0.0.255"), [(packed("10.0.0.2"), packed("10.0.0.2"))], None, None)
    pod = (None, None, None, ({"app": "db"}, None), None)
    space = (None, None, None, None, ({"env": "dev"}, None))
    both = (None, None, None, ({"app": "db"}, None), ({"env": "dev"}, None))
    case = lambda peers, ports=(), way="egress", **k: policy_case(spark, (way, list(peers), list(ports)), **k)
    assert case([]) and case([block]) and not case([holed]) and not case([block], dst_ip="11.0.0.1")
    assert not case([pod]) and case([space]) and case([both])  # a pod selector alone looks in its own namespace
    assert not case([], way="ingress")
    assert case([], [(None, 443, None, None)]) and not case([], [(None, 80, None, None)]) and case([], [(None, 400, 500, None)])
    assert case([], [("TCP", None, None, "https")]) and not case([], [("UDP", None, None, None)]) and case([], [("UDP", None, None, None)], proto=17)


def test_host_tables(spark):
    lines = [
        (1, "tcp", "  sl  local_address rem_address   st tx_queue"),
        (1, "tcp", "   0: 0100007F:1F90 00000000:0000 0A 00000000:00000000 00:00000000"),
        (1, "tcp", "   1: 0100007F:0050 0200007F:1234 01 00000000:00000000 00:00000000"),
        (1, "tcp6", "   0: 00000000000000000000000000000000:1F90 00000000000000000000000000000000:0000 0A 0"),
        (1, "udp", "   0: 00000000:0035 00000000:0000 07 0"),
        (1, "udp", "   1: 00000000:0000 00000000:0000 07 0"),
        (2, "tcp", "broken"),
    ]
    got = host.listening_ports(spark.createDataFrame(lines, "host int, table string, value string")).collect()
    assert sorted((r.host, r.proto, r.port) for r in got) == [(1, 6, 8080), (1, 17, 53)]
    events = spark.createDataFrame([("connect", 0, 1, "curl\0\0x"), ("connect", -111, 2, "no"), ("accept", None, 3, "srv")], "event string, result int, pid int, comm string")
    assert sorted((r.pid, r.comm) for r in host.process_events(events).collect()) == [(1, "curl"), (3, "srv")]
    errors = spark.createDataFrame([(1, 1, 5, "egress"), (1, 1, 5, "egress"), (9, 2, 5, "ingress")], "error_code int, level int, ifindex int, direction string")
    assert sorted((r.error, r.level, r.n) for r in host.capture_errors(errors).collect()) == [("malformed header", "error", 2), ("unknown", "warn", 1)]


def test_small_operators(spark):
    names = spark.createDataFrame([("eth0",), ("eth0",), ("docker0",), ("veth1",)], "interface_name string")
    assert sorted(r[0] for r in filters.interfaces_matching(names, ["eth*", "v" * 300, "docker?"]).collect()) == ["docker0", "eth0"]
    assert metrics.bounds_or([1, 1], (1.0, 2.0)) == [1.0, 2.0] and metrics.bounds_or([1, 5], (9.0,)) == [1.0, 5.0]
    used = enrich.utilisation(spark.range(85), 100).first()
    assert (used.used, used.percent, used.alert) == (85, 85.0, True)
    pods = spark.createDataFrame([("n", "p", [("a", None, 80), ("b", "img", 80), ("c", "img2", 80)])], "namespace string, name string, containers array<struct<name: string, image: string, port: int>>")
    flow = spark.createDataFrame([("Pod", "n", "p", 80), ("Pod", "n", "q", 80)], "dst_kind string, dst_namespace string, dst_name string, dst_port int")
    assert {r.dst_name: r.dst_container for r in enrich.container_at(pods, flow, "dst").collect()} == {"p": "b", "q": None}


def normal(v):
    return bytes(v).hex() if isinstance(v, bytes | bytearray) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    rel = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in columns]
    want = sorted((tuple(normal(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr) == want
