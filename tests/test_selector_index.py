"""The inverted index of selectors, JSON inventory and policies by case, against tests of every pair."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from flowtide.operators import enrich, selectors
from flowtide.plans import registry
from flowtide.sources import inventory

from .test_inventory import SELECTORS, packed


def fits(labels, pairs, tests):
    def one(key, op, values):
        has = key in labels
        return {"In": has and labels[key] in values, "NotIn": not (has and labels[key] in values), "Exists": has, "DoesNotExist": not has}.get(op, False)

    return all(labels.get(k) == v for k, v in (pairs or {}).items()) and all(one(*t) for t in tests or [])


def random_selector(r):
    pairs = {k: r.choice("xyz") for k in r.sample("abc", r.randrange(3))} or None
    tests = [(r.choice("abcd"), r.choice(["In", "NotIn", "Exists", "DoesNotExist", "Near"] if r.random() < 0.2 else ["In", "NotIn", "Exists", "DoesNotExist"]), r.sample("xyz", r.randrange(3))) for _ in range(r.randrange(3))] or None
    return pairs, tests


@pytest.mark.parametrize("seed", [1, 2])
def test_index_of_selectors(spark, seed):
    r = random.Random(seed)
    pods = [(r.choice(["n", "m"]), f"p{i}", {k: r.choice("xyz") for k in r.sample("abc", r.randrange(4))} or None) for i in range(60)]
    chosen = [(r.choice(["n", "m"]), f"s{i}", random_selector(r)) for i in range(70)] + [("n", f"t{i}", s[:2]) for i, s in enumerate(SELECTORS)]
    df = spark.createDataFrame(chosen, f"namespace string, name string, pod_selector {selectors.SELECTOR}")
    got = selectors.candidates(spark.createDataFrame(pods, "namespace string, name string, labels map<string,string>"), df)
    assert sorted((x.namespace, x.pod, x.policy) for x in got.collect()) == sorted((n, p, s) for n, p, labels in pods for m, s, (pairs, tests) in chosen if n == m and fits(labels or {}, pairs, tests))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("inline", [64, 0])
def test_json_to_policies(spark, monkeypatch, inline):
    """From JSON text of a cluster to the policies that permit a flow; blocks and ports in the row or by joins."""
    monkeypatch.setattr(enrich, "MOST_INLINE", inline)
    meta = lambda name, **k: {"name": name, "namespace": "n", **k}
    rule = lambda side, peers, ports=None: {side: peers, **({"ports": ports} if ports else {})}
    policy = lambda name, **spec: {"kind": "NetworkPolicy", "metadata": meta(name), "spec": {"podSelector": {}, **spec}}
    dump = [
        {"kind": "Pod", "metadata": meta("a", labels={"app": "web"}), "spec": {"containers": [{"name": "c", "image": "i", "ports": [{"containerPort": 80, "name": "http"}, {"containerPort": 81}]}, {"name": "bare"}]}, "status": {"podIPs": [{"ip": "10.0.0.1"}, {"ip": "fd00::1"}, {"ip": "nonsense"}]}},
        {"kind": "Pod", "metadata": meta("b", labels={"app": "db"}), "status": {"podIP": "10.0.0.2"}},
        {"kind": "EndpointSlice", "metadata": meta("slice"), "endpoints": [{"addresses": ["10.0.0.3"]}], "ports": [{"port": 443, "protocol": "TCP"}]},
        policy("block", ingress=[rule("from", [{"ipBlock": {"cidr": "10.0.0.0/24", "except": ["10.0.0.4/31"]}}], [{"port": "http"}])]),
        policy("excepted", ingress=[rule("from", [{"ipBlock": {"cidr": "10.0.0.0/8", "except": ["10.0.0.2"]}}])]),
        policy("six", ingress=[rule("from", [{"ipBlock": {"cidr": "fd00::/16"}}], [{"port": 80, "endPort": 90}])]),
        policy("nobody", ingress=[rule("from", [{"ipBlock": {"cidr": "nonsense"}}])]),
        policy("labels", ingress=[rule("from", [{"podSelector": {"matchExpressions": [{"key": "app", "operator": "In", "values": ["db"]}]}}], [{"protocol": "UDP", "port": 80}, {"port": 80}])]),
        policy("all", ingress=[{}]),
        policy("out", egress=[rule("to", [{"podSelector": {"matchLabels": {"app": "web"}}}])]),
        policy("other", podSelector={"matchLabels": {"app": "db"}}, ingress=[{}]),
    ]
    objects = inventory.objects(spark.createDataFrame([(json.dumps(d),) for d in dump] + [("not json",)], "value string"))
    pod = objects.filter("name = 'a'").first()
    assert [bytes(x) for x in pod.ips] == [ipaddress.ip_address(t).packed for t in ("10.0.0.1", "fd00::1")]
    assert [(c.name, c.port, c.port_name) for c in pod.containers] == [("c", 80, "http"), ("c", 81, None), ("bare", None, None)] and [p.port for p in pod.ports] == [80, 81]
    flows = [(packed("10.0.0.2"), packed("10.0.0.1"), 6, 5000, 80, 1), (packed("10.0.0.4"), packed("10.0.0.1"), 6, 5000, 80, 2), (packed("fd00::9"), packed("fd00::1"), 6, 5000, 85, 3), (packed("10.0.0.2"), packed("10.0.0.3"), 17, 1, 2, 4)]
    df = spark.createDataFrame(flows, "src_ip binary, dst_ip binary, proto int, src_port int, dst_port int, at long")
    found = enrich.decorate(df, enrich.ip_index(objects), "at")
    spaces = spark.createDataFrame([("Namespace", "n", {"env": "prod"})], "kind string, name string, labels map<string,string>")
    got = {r.at: r for r in enrich.permitting_policies(found, objects.filter("kind = 'Pod'"), spaces, inventory.network_policies(objects), []).collect()}
    names = lambda x: [n.removeprefix("n/") for n in x]
    assert (got[1].src_name, got[1].dst_name, got[1].decorator_status) == ("b", "a", "ok")
    assert names(got[1].ingress_policies) == ["all", "block", "labels"] and names(got[1].egress_policies) == ["out"]
    assert names(got[2].ingress_policies) == ["all", "excepted"] and got[2].src_name is None
    assert names(got[3].ingress_policies) == ["all", "six"] and got[3].dst_name == "a"
    assert (got[4].dst_kind, got[4].dst_name, names(got[4].ingress_policies)) == ("EndpointSlice", "slice", [])



def test_pairs_spread(spark, monkeypatch):
    """One label set and one selector in one file make all pairs, and many tasks make them; rows without a name stay."""
    monkeypatch.setattr(selectors, "PACK", 16, raising=False)
    pods = spark.range(300).coalesce(1).selectExpr("'n' AS namespace", "concat('p', nullif(id, 7)) AS name", "map('app', 'web') AS labels")
    named = spark.range(200).coalesce(1).selectExpr("'n' AS namespace", "'Service' AS kind", "concat('s', nullif(id, 7)) AS name", "map('app', 'web') AS match_labels")
    policies = named.selectExpr("namespace", "name", f"CAST(NULL AS {selectors.SELECTOR}) AS pod_selector")
    for got, columns in ((selectors.candidates(pods, policies), ["namespace", "pod", "policy"]), (selectors.relations(pods, named), ["namespace", "pod", "kind", "name"])):
        assert got.columns == columns
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == got.distinct().count() == 60_000 and max(sizes) <= 40_000


def compiled_loops(done):
    """In which compiled loops the plan of what was collected expands objects and pods; empty text: in none."""
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    loops = [line.split("Generate")[0].strip(" :+-") for line in plan.splitlines() if "Generate explode" in line or "Generate inline" in line][:2]
    assert len(loops) == 2
    return loops


def test_pairs_of_a_pod_at_a_time(spark):
    """Pods and objects aren't expanded in one compiled loop, which makes all pairs of a block before it gives the first; kinds may be null."""
    pods = spark.range(30).selectExpr("'n' AS namespace", "concat('p', id) AS name", "map('app', 'web') AS labels")
    named = spark.range(24).selectExpr("'n' AS namespace", "nullif(concat('K', id % 3), 'K2') AS kind", "concat('s', nullif(id, 7)) AS name", "map('app', 'web') AS match_labels")
    got = selectors.relations(pods, named)
    rows = sorted((str(r.kind), r.name or "", r.pod) for r in got.collect())
    assert rows == sorted((["K0", "K1", "None"][i % 3], f"s{i}" if i != 7 else "", f"p{p}") for i in range(24) for p in range(30))
    assert "" in compiled_loops(got)


def test_policies_of_a_pod_at_a_time(spark):
    pods = spark.range(30).selectExpr("'n' AS namespace", "concat('p', id) AS name", "map('app', 'web') AS labels")
    policies = spark.range(24).selectExpr("'n' AS namespace", "concat('s', nullif(id, 7)) AS name", f"CAST(NULL AS {selectors.SELECTOR}) AS pod_selector")
    got = selectors.candidates(pods, policies)
    assert sorted((r.policy or "", r.pod) for r in got.collect()) == sorted((f"s{i}" if i != 7 else "", f"p{p}") for i in range(24) for p in range(30))
    assert "" in compiled_loops(got)


def test_custom_objects_are_parsed_once(spark):
    """The objects' text is parsed before the join, in all tasks, and not once for each time that relations reads them."""
    plan = registry.QUERIES["custom_selectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan.lower() and "variant" not in plan.lower()


def test_pods_of_services_one_at_a_time(spark):
    got = registry.QUERIES["pod_services"](spark, "/root/testdata/sf0.001")
    assert got.collect() and "" in compiled_loops(got)
